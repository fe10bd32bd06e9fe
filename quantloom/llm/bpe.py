"""Operator 7: byte-level BPE encoding and decoding, exact and in linear time.

Token bytes are mapped to Latin-1 text for an Aho-Corasick automaton, which gives the longest token
at every position of a piece.  Encoding goes forward from longest matches and steps back where two
adjacent tokens could not have come out of the merges; that test is memoised, and a bit a position
remembers dead ends, so each position is left for good after a bounded number of tries.

Defined results: a null text is the empty text (no ids, the hash of nothing); row order, repeated
rows and other columns do not matter; an empty table gives an empty result.  The memos of pieces are
bounded, and the older half goes when they are full; that changes speed only.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, released

#: Pieces that a memo holds; there are two, the older one of which is dropped when the other is full.
MEMO = 120_000
#: Pairs of tokens whose compatibility is remembered.
FITS = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _merge_below(ranks: dict[bytes, int], piece: bytes, limit: int) -> list[bytes]:
    """The plain merge loop with ranks under a limit; used once a token to learn how it was made."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if best >= limit:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Codec:
    """Encoder and decoder over mergeable ranks and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {r: b for b, r in ranks.items()}
        self.made: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.auto = ahocorasick.Automaton()
        usable = set()
        for b, r in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) > 1:
                parts = _merge_below(ranks, b, r)
                if len(parts) != 2:
                    continue  # no merges lead to it: only a piece that equals it whole is given its id
                pair = (ranks[parts[0]], ranks[parts[1]])
                self.made[r] = pair
                self.joined[pair] = r
            else:
                self.made[r] = (r, r)
            usable.add(r)
            self.auto.add_word(b.decode("latin-1"), (len(b), r))
        self.auto.make_automaton()
        # the next shorter token that begins the same way
        self.shorter: dict[int, int | None] = {}
        for r in usable:
            b = self.tokens[r]
            self.shorter[r] = next((ranks[b[:k]] for k in range(len(b) - 1, 0, -1) if ranks.get(b[:k]) in usable), None)
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[int, bytes, bytes]] = {}
        self.older: dict[str, tuple[int, bytes, bytes]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges keep the border between two adjacent tokens; memoised."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > FITS:
                self.fits.clear()
            known = self.fits[(left, right)] = self._compatible(left, right)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # undo the later merge of the two border tokens, again and again; the border breaks if what
        # then meets would have merged before that undone merge took place
        limit = 1 << 60
        while True:
            if self.joined.get((a, b), limit) < limit:
                return False
            if a > b:
                order = ((0, a), (1, b))
            else:
                order = ((1, b), (0, a))
            for side, token in order:
                part = self.made[token][1 - side]
                if part != token:
                    if side == 0:
                        a, limit = part, token
                    else:
                        b, limit = part, token + 1
                    break
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        longest: list[int | None] = [None] * n
        size = [0] * n
        for end, (k, r) in self.auto.iter(piece.decode("latin-1")):
            at = end - k + 1
            if k > size[at]:
                size[at], longest[at] = k, r
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            last = out[-1] if out else None
            while token is not None:
                end = pos + len(self.tokens[token])
                if open_[end] and (last is None or self.compatible(last, token)):
                    break
                token = self.shorter[token]
            if token is not None:
                out.append(token)
                pos = end
                token = longest[pos] if pos < n else None
            else:
                if last is None:
                    raise ValueError("the ranks do not cover every byte")
                open_[pos] = 0
                out.pop()
                pos -= len(self.tokens[last])
                token = last
        return out

    def forget(self) -> None:
        """Empty the memos: a worker idles between tasks, and other stages need the memory."""
        self.memo, self.older = {}, {}
        self.fits.clear()

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def _piece(self, piece: str) -> tuple[int, bytes, bytes]:
        got = self.older.get(piece)
        if got is None:
            ids = self.encode_piece(piece.encode("utf-8"))
            got = (len(ids), " ".join(map(str, ids)).encode(), self.decode(ids))
        if len(piece) < 100:
            if len(self.memo) >= MEMO:  # what is used again comes back from the older one
                self.memo, self.older = {}, self.memo
            self.memo[piece] = got
        return got

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pattern.findall(text) for i in self.encode_piece(p.encode("utf-8"))]

    def digest(self, text: str) -> tuple[int, str, str, bytes]:
        """Number of ids, hash of the ids, hash of the bytes that they decode to, the ids as decimal text."""
        memo, slow = self.memo, self._piece
        got = [memo.get(p) or slow(p) for p in self.pattern.findall(text)]
        ids = b" ".join([g[1] for g in got])
        return sum([g[0] for g in got]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(b"".join([g[2] for g in got])).hexdigest(), ids


_codecs: dict[tuple, Codec] = {}


def codec(ranks: dict[bytes, int], pattern: str, key) -> Codec:
    """One codec a worker process, built from the broadcast vocabulary."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) and the ``extra`` columns of docs; the vocabulary's size bounds the broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    key = (path, pattern)

    def run(batches):
        own = None
        for b in batches:
            own = own or codec(shared.value, pattern, key)
            texts = [t or "" for t in b.column(1).to_pylist()]
            got = [own.digest(t) if with_ids else own.digest(t)[:3] for t in texts]
            cols = [*b.columns[2:], b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())]
            names = [*extra, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ids = np.fromstring(b" ".join([g[3] for g in got]), np.int32, sep=" ")
                ends = np.cumsum([0, *(g[0] for g in got)], dtype=np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)
        if own:
            own.forget()

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = "".join(f"`{c}` {kinds[c]}, " for c in extra) + "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra).mapInArrow(released(run), schema)
    return out.select("doc_id", *extra, *[c for c in out.columns if c != "doc_id" and c not in extra])


def op7_bpe(spark, sf_dir):
    import public_tokenizers

    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
