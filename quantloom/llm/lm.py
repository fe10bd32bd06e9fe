"""Operator 9: n-gram language model in Elias-Fano tries.

Training counts words, then bigrams, then trigrams (with an end token a document).  Words are known by
64-bit hashes.  The trie is cut into shards by its first word; a shard's levels are files in the shared
folder, memory-mapped by the tasks that score:

  level 1   sorted word hashes (Elias-Fano), counts, back-off weight
  level 2   pointers from words (monotone, Elias-Fano), word ids made monotone by adding the last id of
            the context before (Elias-Fano), quantised discounted probability, back-off weight
  level 3   the same from bigrams, without a weight; in blocks of ``PAIRS`` bigrams, so that the n-grams
            of a frequent first word spread over many files

A level of a shard (or block) is one file, rank directories included; a worker keeps ``OPEN`` of them
mapped at most, so neither file handles nor maps grow with the model.

A query finds its context's range by the pointers and its word by a successor search relative to the
context.  Smoothing is interpolated absolute discounting over an add-one unigram:
P(w|c) = max(n(cw) - D, 0) / n(c) + b(c) P(w|shorter c), with b(c) what the kept n-grams leave.
``train`` prunes bigrams and trigrams below ``min_count``; b(c) takes up their mass.  The registered
query prunes none (``QUERY_MIN_COUNT``).

Plan: one Arrow pass cuts the training texts to numbered words, packed and written; each count is one
pass over these; a task sends each shard one sorted, delta-coded, compressed run of distinct n-grams
with counts (so a hot word is one entry a task); shards are dealt one a task, which merges its runs as
they come and writes its level.  Scoring is one Arrow pass with no shuffle.  Nothing of the corpus comes
to the driver but sizes by shard.

Defined results: null and empty texts are the end token alone; repeated rows count each; a null doc_id
counts as the empty text for the fold; with no training rows counts are zero and the scores follow
from the same formulas; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import mmap
import os
import re
from collections import OrderedDict, defaultdict
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, ensure_dir, local_path, remainder, scratch, written

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
END = b"\n"  # no word holds it
DISCOUNT = 0.75
#: Default of ``train``.
MIN_COUNT = 2
#: Of the registered query: every n-gram counted is kept.
QUERY_MIN_COUNT = 1
#: Bytes of training text a shard, about.
SHARD_TEXT = 32 << 20
#: Bytes of text that a task counts or scores at once.
PIECE = 8 << 20
#: N-grams that a task gathers before it sends them on.
HELD = 2_000_000
#: Bigrams of a block of level 3.
PAIRS = 1 << 22
#: Files that a worker keeps mapped.
OPEN = 256
#: Steps of a quantised log10 probability or weight.
STEPS = 4096.0
U = np.uint64
BYTE_SELECT = np.array([[([i for i in range(8) if b >> i & 1] + [8] * 8)[k] for k in range(8)] for b in range(256)], np.int64)
ONCE, HIGH, NIBBLE, PAIR, ODD = U(0x0101010101010101), U(0x8080808080808080), U(0x0F0F0F0F0F0F0F0F), U(0x3333333333333333), U(0x5555555555555555)


class EliasFano:
    """A nondecreasing sequence of 64-bit numbers in about 2 + log2(u/n) bits each."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray, n: int, bits: int):
        self.low, self.high, self.ones, self.zeros, self.n, self.bits = low, high, ones, zeros, n, bits

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        at = (values >> U(bits)).astype(np.int64) + np.arange(n)
        words = (n + (universe >> bits) + 2) // 64 + 1
        flags = np.zeros(words * 64, bool)
        flags[at] = True
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        low = np.zeros((n * bits >> 6) + 2, np.uint64)
        if bits:
            part = values & U((1 << bits) - 1)
            place = np.arange(n) * bits
            w, off = place >> 6, (place & 63).astype(np.uint64)
            np.bitwise_or.at(low, w, part << off)
            over = (place & 63) + bits > 64
            np.bitwise_or.at(low, w[over] + 1, part[over] >> (U(64) - off[over]))
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))
        return cls(low, high, ones, np.arange(len(ones)) * 64 - ones, n, bits)

    def parts(self, name: str, searched: bool = True) -> dict[str, np.ndarray]:
        """Arrays of a file; only a sequence that is searched needs the ranks of zeros."""
        out = {"low": self.low, "high": self.high, "ones": self.ones, "size": np.array([self.n, self.bits])}
        if searched:
            out["zeros"] = self.zeros
        return {f"{name}-{k}": v for k, v in out.items()}

    @classmethod
    def of(cls, held: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = held[f"{name}-size"].tolist()
        return cls(held[f"{name}-low"], held[f"{name}-high"], held[f"{name}-ones"], held.get(f"{name}-zeros"), n, bits)

    def _select(self, k: np.ndarray, zero: bool) -> np.ndarray:
        """Places of the k-th ones or zeros (from 0)."""
        counts = self.zeros if zero else self.ones
        at = np.searchsorted(counts, k, "right") - 1
        w = self.high[at]
        if zero:
            w = ~w
        r = (k - counts[at]).astype(np.uint64)
        # byte i of s: ones in the bytes 0..i of the word
        s = w - ((w >> U(1)) & ODD)
        s = (s & PAIR) + ((s >> U(2)) & PAIR)
        s = ((s + (s >> U(4))) & NIBBLE) * ONCE
        byte = np.bitwise_count((((r * ONCE) | HIGH) - s) & HIGH).astype(np.uint64) << U(3)
        r -= ((s << U(8)) >> byte) & U(255)
        inner = BYTE_SELECT[((w >> byte) & U(255)).astype(np.int64), r.astype(np.int64)]
        return at * 64 + byte.astype(np.int64) + inner

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        place = i * self.bits
        w, off = place >> 6, (place & 63).astype(np.uint64)
        v = self.low[w] >> off
        v = np.where(off > 0, v | (self.low[w + 1] << ((U(64) - off) & U(63))), v)
        return v & U((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, False) - i).astype(np.uint64) << U(self.bits)) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the first element >= x where that is x itself, else -1."""
        out = np.full(len(x), -1, np.int64)
        for a in range(0, len(x) if self.n else 0, 1 << 16):
            part = x[a:a + (1 << 16)].astype(np.uint64)
            h = (part >> U(self.bits)).astype(np.int64)
            ok = np.flatnonzero(h < self.zeros[-1])
            h, want = h[ok], part[ok] & U((1 << self.bits) - 1)
            lo = np.zeros(len(ok), np.int64)
            some = h > 0
            lo[some] = self._select(h[some] - 1, True) - (h[some] - 1)
            hi = end = self._select(h, True) - h
            lo, hi = np.minimum(lo, self.n), np.minimum(hi, self.n)
            while True:
                go = np.flatnonzero(lo < hi)
                if not len(go):
                    break
                mid = (lo[go] + hi[go]) >> 1
                less = self._low(mid) < want[go]
                lo[go[less]] = mid[less] + 1
                hi[go[~less]] = mid[~less]
            hit = np.flatnonzero(lo < np.minimum(end, self.n))
            hit = hit[self._low(lo[hit]) == want[hit]]
            out[a + ok[hit]] = lo[hit]
        return out


def _save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays in one file, behind a head that says where each is; under a name of its own first, so that
    a task that is tried again leaves a whole file."""
    own = f"{path}.{os.getpid()}-{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
    at, where = 0, {}
    for k, x in arrays.items():
        where[k] = (at, x.dtype.str, len(x))
        at += -(-x.nbytes // 8) * 8
    head = json.dumps(where).encode()
    head += b" " * (-len(head) % 8)
    with open(own, "wb") as f:
        f.write(np.array([len(head)], np.uint64).tobytes() + head)
        for x in arrays.values():
            f.write(np.ascontiguousarray(x).tobytes() + b"\0" * (-x.nbytes % 8))
    os.replace(own, path)


_files: OrderedDict[str, dict[str, np.ndarray]] = OrderedDict()


def _mapped(path: str) -> dict[str, np.ndarray]:
    """A file's arrays, memory-mapped; the ``OPEN`` files last used stay mapped."""
    held = _files.get(path)
    if held is None:
        while len(_files) >= OPEN:
            _files.popitem(last=False)
        with open(path, "rb") as f:
            # the map outlives the file's handle
            whole = mmap.mmap(f.fileno(), 0, prot=mmap.PROT_READ, trackfd=False)
        head = int(np.frombuffer(whole, np.uint64, 1)[0])
        where = json.loads(bytes(whole[8:8 + head]))
        held = _files[path] = {k: np.frombuffer(whole, np.dtype(kind), n, 8 + head + at) for k, (at, kind, n) in where.items()}
    _files.move_to_end(path)
    return held


def _quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) * STEPS), 0, 65535).astype(np.uint16)


def _restore(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (-q.astype(np.float64) / STEPS)


class Level:
    """Children of contexts: pointers, monotone ids, probabilities, weights."""

    def __init__(self, path: str):
        held = _mapped(path)
        self.ptr, self.ids = EliasFano.of(held, "ptr"), EliasFano.of(held, "ids")
        self.prob, self.weight, self.counts = held["prob"], held["weight"], held.get("counts")

    @staticmethod
    def build(path: str, contexts: int, context: np.ndarray, word: np.ndarray, count: np.ndarray, total: np.ndarray, counts: bool = False) -> None:
        """n-grams sorted by (context, word); total: count of each context; counts: whether to keep them."""
        ptr = np.searchsorted(context, np.arange(contexts + 1))
        arrays = EliasFano.build(ptr, max(1, len(word) + 1)).parts("ptr", False)
        last = np.zeros(len(word), np.int64)
        if len(word):
            head = np.concatenate(([True], context[1:] != context[:-1]))
            tail = np.append(head[1:], True)
            rises = np.cumsum(np.where(tail, word + 1, 0)) - np.where(tail, word + 1, 0)
            last = rises  # of all contexts before
        stored = word + 1 + last
        arrays |= EliasFano.build(stored, int(stored[-1]) + 1 if len(stored) else 1).parts("ids")
        p = (count - DISCOUNT) / total[context]
        left = 1.0 - np.bincount(context, p, minlength=contexts)
        arrays |= {"prob": _quantise(p), "weight": _quantise(np.minimum(left, 1.0))}
        if counts:
            arrays["counts"] = _narrow(count)
        _save(path, arrays)

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Index of each (context, word), or -1: a successor search from the context's first id."""
        if not len(context):
            return np.zeros(0, np.int64)
        # queries come sorted: each context's range is read once
        head = np.concatenate(([True], context[1:] != context[:-1]))
        run, own = np.cumsum(head) - 1, context[head]
        lo, hi, base = (np.zeros(len(own), np.int64) for _ in range(3))
        for a in range(0, len(own), 1 << 16):
            c = own[a:a + (1 << 16)]
            lo[a:a + len(c)], hi[a:a + len(c)] = self.ptr.access(c).astype(np.int64), self.ptr.access(c + 1).astype(np.int64)
        inner = np.flatnonzero((hi > lo) & (lo > 0))
        for a in range(0, len(inner), 1 << 16):
            at = inner[a:a + (1 << 16)]
            base[at] = self.ids.access(lo[at] - 1).astype(np.int64)
        out = np.full(len(context), -1, np.int64)
        some = np.flatnonzero((hi > lo)[run])
        r = run[some]
        i = self.ids.find(base[r] + word[some] + 1)
        ok = (i >= lo[r]) & (i < hi[r])
        out[some[ok]] = i[ok]
        return out


class Trained(NamedTuple):
    """A written model: its folder and, by shard, the words and bigrams that it holds."""

    folder: str
    levels: int
    tokens: int
    words: np.ndarray
    pairs: np.ndarray


class Model:
    """The shards of a folder, mapped when asked."""

    def __init__(self, trained: Trained):
        self.folder, self.levels, self.tokens = trained.folder, trained.levels, trained.tokens
        self.shards = len(trained.words)
        self.base = np.concatenate(([0], np.cumsum(trained.words)))
        self.vocabulary = int(self.base[-1])
        #: The first block of level 3 of each shard.
        self.block = _blocks(trained.pairs)

    def level(self, k: int, number: int) -> Level:
        return Level(f"{self.folder}/{k}-{number}")

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, -1 if unknown; counts) of word hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = (hashes % U(self.shards)).astype(np.int64)
        for s, at in _by(shard):
            held = _mapped(f"{self.folder}/1-{s}")
            i = EliasFano.of(held, "words").find(hashes[at])
            ok = i >= 0
            counts[at[ok]] = held["counts"][i[ok]]
            ids[at[ok]] = i[ok] + self.base[s]
        return ids, counts

    def bigrams(self, first: np.ndarray, second: np.ndarray):
        """Of pairs of ids (both known): shard, index or -1, probability, weight of the first word."""
        shard = np.searchsorted(self.base, first, "right") - 1
        index, p, b = np.full(len(first), -1, np.int64), np.zeros(len(first)), np.ones(len(first))
        for s, at in _by(shard):
            level = self.level(2, s)
            c = first[at] - self.base[s]
            i = level.find(c, second[at])
            b[at] = _restore(level.weight[c])
            ok = i >= 0
            index[at[ok]] = i[ok]
            p[at[ok]] = _restore(level.prob[i[ok]])
        return shard, index, p, b

    def trigrams(self, shard: np.ndarray, bigram: np.ndarray, third: np.ndarray):
        """Of known bigrams (shard, index; in order) and ids: probability, weight of the bigram."""
        p, b = np.zeros(len(third)), np.ones(len(third))
        block, inner = self.block[shard] + bigram // PAIRS, bigram % PAIRS
        for number, at in _by(block):
            level = self.level(3, number)
            i = level.find(inner[at], third[at])
            b[at] = _restore(level.weight[inner[at]])
            ok = i >= 0
            p[at[ok]] = _restore(level.prob[i[ok]])
        return p, b


def _by(x: np.ndarray):
    """(value, places) of each value, in order."""
    order = np.argsort(x, kind="stable")
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), np.diff(x[order]) != 0)))
    for a, b in zip(head.tolist(), [*head[1:].tolist(), len(x)]):
        yield int(x[order[a]]), order[a:b]


def _blocks(pairs: np.ndarray) -> np.ndarray:
    """The first block of level 3 of each shard, and the number of blocks."""
    return np.concatenate(([0], np.cumsum(np.maximum(1, -(-pairs // PAIRS))))).astype(np.int64)


def _numbering() -> defaultdict:
    """Numbers for words as they come; the end token is 0."""
    known: defaultdict = defaultdict(count().__next__)
    known[END]
    return known


def pieces(texts):
    """Texts (bytes) in pieces of bounded size -> (token numbers, texts' ends, distinct word hashes)."""
    known = _numbering()
    flat: list[np.ndarray] = []
    ends, size, n = [], 0, 0
    for t in texts:
        ws = WORD.findall((t or b"").lower())
        ws.append(END)
        flat.append(np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)))
        n += len(ws)
        ends.append(n)
        size += len(t or b"")
        if size >= PIECE:
            yield np.concatenate(flat), np.array(ends), np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
            known, flat, ends, size, n = _numbering(), [], [], 0, 0
    if flat:
        yield np.concatenate(flat), np.array(ends), np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))


def _ranks(ids: np.ndarray) -> np.ndarray:
    """Ranks of a piece's distinct words in the order of ids; unknown words all come last."""
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(ids)] = np.arange(len(ids))
    rank[ids < 0] = len(ids)
    return rank


def _by_pair(a: np.ndarray, b: np.ndarray, most_a: int, most_b: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by (a, b), whether each in that order is the first of its pair); a and b are not negative."""
    x, y, z = most_a.bit_length(), most_b.bit_length(), len(a).bit_length()
    if x + y + z <= 63:  # pair and place in one number: a plain sort is far faster than one of places
        key = np.sort((a.astype(np.uint64) << U(y + z)) | (b.astype(np.uint64) << U(z)) | np.arange(len(a), dtype=np.uint64))
        order, key = (key & U((1 << z) - 1)).astype(np.int64), key >> U(z)
        return order, np.concatenate((np.ones(min(1, len(a)), bool), key[1:] != key[:-1]))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    return order, np.concatenate((np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])))


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 64-bit keys and counts, delta-coded by bytes of like weight, compressed."""
    delta = np.diff(keys, prepend=U(0))
    body = delta.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(1).compress(body)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    delta, counts = (np.ascontiguousarray(x.reshape(8, -1).T).view(np.uint64).ravel() for x in np.split(raw, 2))
    return np.cumsum(delta, dtype=np.uint64), counts.astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32 if x.max(initial=0) < 1 << 32 else np.uint64)


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers under 2^32, by bytes of like weight, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())


def _stretch(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def numbered(docs: DataFrame) -> DataFrame:
    """docs (text) -> the pieces of texts, a row each: token numbers, ends of texts, hashes of the words."""

    def run(batches):
        for b in batches:
            for tokens, ends, hashes in pieces(b.column(0).cast(pa.binary()).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([_squeeze(tokens)], pa.binary()), pa.array([_squeeze(ends)], pa.binary()), pa.array([hashes.tobytes()], pa.binary())], ["tokens", "ends", "hashes"])

    return docs.select("text").mapInArrow(run, "tokens binary, ends binary, hashes binary")


def _count(cut: DataFrame, shards: int, ngrams, build) -> np.ndarray:
    """ngrams(tokens, ends, hashes) -> (shard, keys, counts) of a piece; build(shard, keys, counts)
    writes a level's file and returns what is collected by shard."""

    def gather(batches):
        held: list[tuple] = []
        size = 0
        for b in batches:
            for tokens, ends, hashes in zip(*b.columns):
                held.append(ngrams(_stretch(tokens.as_py()), _stretch(ends.as_py()), np.frombuffer(hashes.as_py(), np.uint64)))
                size += len(held[-1][0])
                if size > HELD:
                    yield from _runs_of(held)
                    held, size = [], 0
        if held:
            yield from _runs_of(held)

    def merge(batches):
        runs: dict[int, list[tuple]] = {}
        for b in batches:
            for s, data in zip(b.column(0).to_pylist(), b.column(1)):
                own = runs.setdefault(s, [])
                own.append(_unpack(data.as_py()))
                # what has been summed waits until as much has come again
                if len(own) > 1 and sum(len(x[0]) for x in own[1:]) > max(HELD, len(own[0][0])):
                    own[:] = [_summed(*map(np.concatenate, zip(*own)))]
        for s in sorted(runs):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([build(s, *_summed(*map(np.concatenate, zip(*runs.pop(s)))))], pa.list_(pa.int64()))], ["shard", "n"])

    sent = cut.mapInArrow(gather, "shard int, run binary")
    every = cut.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(_pack(np.zeros(0, np.uint64), np.zeros(0, np.int64))).alias("run"))
    done = written(sent.union(every).repartitionById(shards, F.col("shard")).mapInArrow(merge, "shard int, n array<long>"), "lm-level")
    return np.array([r.n for r in done.orderBy("shard").collect()], np.int64)


def _runs_of(held: list[tuple]):
    shard, keys, counts = (np.concatenate(x) for x in zip(*held))
    got = [(s, _pack(*_summed(keys[at], counts[at]))) for s, at in _by(shard)]
    yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.binary())], ["shard", "run"])


def train(docs: DataFrame, min_count: int = MIN_COUNT, shard_text: int = SHARD_TEXT) -> Trained:
    """docs (text) -> a written model."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_text))
    folder = local_path(scratch(spark, "lm"))
    cut = written(numbered(docs), "lm-tokens", "uncompressed")

    def words(tokens, ends, hashes):
        return (hashes % U(shards)).astype(np.int64), hashes, np.bincount(tokens, minlength=len(hashes))

    def build_words(s, keys, counts):
        ensure_dir(folder)
        keys, counts = keys[counts > 0], counts[counts > 0]
        _save(f"{folder}/1-{s}", {**EliasFano.build(keys, 1 << 64).parts("words"), "counts": _narrow(counts)})
        return [len(keys), int(counts.sum())]

    sizes = _count(cut, shards, words, build_words)
    if sizes[:, 0].sum() >= 1 << 32:
        raise ValueError("more than 2^32 distinct words")
    first = Trained(folder, 1, int(sizes[:, 1].sum()), sizes[:, 0], np.zeros(shards, np.int64))
    shared = spark.sparkContext.broadcast(first)  # a few numbers a shard

    def pairs(tokens, ends, hashes):
        own = Model(shared.value)
        ids = own.words(hashes)[0][tokens]
        inner = np.ones(len(ids), bool)
        inner[ends - 1] = False
        inner = inner[:-1]
        key, n = np.unique((ids[:-1][inner].astype(np.uint64) << U(32)) | ids[1:][inner].astype(np.uint64), return_counts=True)
        return np.searchsorted(own.base, (key >> U(32)).astype(np.int64), "right") - 1, key, n

    def build_pairs(s, keys, counts):
        keep = counts >= min_count
        keys, counts = keys[keep], counts[keep]
        if len(keys) >= 1 << 32:
            raise ValueError("a shard has more than 2^32 bigrams; take a smaller shard_text")
        total = _mapped(f"{folder}/1-{s}")["counts"].astype(np.float64)
        base = int(shared.value.words[:s].sum())
        Level.build(f"{folder}/2-{s}", len(total), (keys >> U(32)).astype(np.int64) - base, (keys & U(0xFFFFFFFF)).astype(np.int64), counts, total, True)
        return [len(keys)]

    second = first._replace(levels=2, pairs=_count(cut, shards, pairs, build_pairs)[:, 0])
    told = spark.sparkContext.broadcast(second)
    block = _blocks(second.pairs)

    def triples(tokens, ends, hashes):
        own = Model(told.value)
        ids = own.words(hashes)[0]
        rank = _ranks(ids)[tokens]
        inner = np.ones(len(tokens), bool)
        inner[ends - 1] = False
        inner[np.maximum(ends - 2, 0)] = False
        at = np.flatnonzero(inner)
        order, head = _by_pair(rank[at], rank[at + 1], len(ids), len(ids))
        at, pair = at[order], np.cumsum(head) - 1
        one = at[head]
        shard, index, _, _ = own.bigrams(ids[tokens[one]], ids[tokens[one + 1]])
        ok = index[pair] >= 0
        at, pair = at[ok], pair[ok]
        # known bigrams are numbered as their shards and indexes go
        order, head = _by_pair(pair, rank[at + 2], len(one), len(ids))
        first = np.flatnonzero(head)
        at, pair = at[order[first]], pair[order[first]]
        return own.block[shard[pair]] + index[pair] // PAIRS, ((index[pair] % PAIRS).astype(np.uint64) << U(32)) | ids[tokens[at + 2]].astype(np.uint64), np.diff(np.append(first, len(order)))

    def build_triples(n, keys, counts):
        keep = counts >= min_count
        keys, counts = keys[keep], counts[keep]
        own = _blocks(told.value.pairs)
        s = int(np.searchsorted(own, n, "right")) - 1
        at = (n - int(own[s])) * PAIRS
        total = Level(f"{folder}/2-{s}").counts[at:at + PAIRS].astype(np.float64)
        Level.build(f"{folder}/3-{n}", len(total), (keys >> U(32)).astype(np.int64), (keys & U(0xFFFFFFFF)).astype(np.int64), counts, total)
        return [len(keys)]

    _count(cut, int(block[-1]), triples, build_triples)
    return second._replace(levels=3)


def score_piece(own: Model, tokens: np.ndarray, ends: np.ndarray, hashes: np.ndarray):
    """(n_known, base_score, score) of each text of a piece."""
    ids, counts = own.words(hashes)
    base = (counts + 1.0) / (own.tokens + own.vocabulary + 1.0)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    begins = ends - np.diff(ends, prepend=0)
    p = base[tokens]
    known = np.bincount(text, counts[tokens] > 0, minlength=len(ends)).astype(np.int64)
    base_score = np.bincount(text, np.log10(p), minlength=len(ends))
    place = np.arange(len(tokens)) - begins[text]
    rank = _ranks(ids)[tokens]
    # an unknown word after a known one has the back-off weight only
    second = np.where(ids >= 0, ids, (1 << 32) - 1)
    at = np.flatnonzero((place[1:] >= 1) & (rank[:-1] < len(ids))) + 1
    order, head = _by_pair(rank[at - 1], rank[at], len(ids), len(ids))
    at, pair = at[order], np.cumsum(head) - 1
    one = at[head]
    shard, index, pp, bb = own.bigrams(ids[tokens[one - 1]], second[tokens[one]])
    p[at] = pp[pair] + bb[pair] * p[at]
    before = np.full(len(tokens), -1, np.int64)
    before[at] = np.where(index[pair] >= 0, pair, -1)
    at = np.flatnonzero((place[1:] >= 2) & (before[:-1] >= 0)) + 1
    # known bigrams are numbered as their shards and indexes go
    order, head = _by_pair(before[at - 1], rank[at], len(one), len(ids))
    at, back = at[order], np.cumsum(head) - 1
    one = at[head]
    pair = before[one - 1]
    pp, bb = own.trigrams(shard[pair], index[pair], second[tokens[one]])
    p[at] = pp[back] + bb[back] * p[at]
    return known, base_score, np.bincount(text, np.log10(p), minlength=len(ends))


def score(docs: DataFrame, trained: Trained) -> DataFrame:
    """docs (doc_id, held_out, text) -> with n_tokens, n_known, train_tokens, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast(trained)

    def run(batches):
        own = None
        for b in batches:
            own = own or Model(shared.value)
            row = 0
            for tokens, ends, hashes in pieces(b.column(2).cast(pa.binary()).to_pylist()):
                known, base, full = score_piece(own, tokens, ends, hashes)
                part = b.slice(row, len(ends))
                row += len(ends)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(ends, prepend=0)), pa.array(known), pa.array(np.full(len(ends), own.tokens)), pa.array(base), pa.array(full)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return score(rows, train(rows.filter("not held_out"), QUERY_MIN_COUNT))
