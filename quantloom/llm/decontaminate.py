"""Operator 8: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

Items and documents are cut to lower-case words; in scripts written without blanks each character is a
word.  A first pass counts, over all documents, in how many each word bigram of the items occurs.  An
item's seeds are all its trigrams and, of its bigrams, the rarest that no alignment within the threshold
can do without (``seed_count``); an item of one word has that word.  A second pass finds seeds in the
documents; wherever one stands, the item is aligned with that window of the document by
Smith-Waterman over words, unless too few of its words are there, and the pair is reported when the
alignment's score reaches the item's threshold (``asked``) of a full copy's.

What the seeds can miss: copies with so many inserted words that no three words in a row and none of
the rare pairs are left together.  An item of more than ``LONG`` words is searched by its parts of that
many words, each an item of its own; the best part found is given, with its own score and place.

Items are the query set; they are handled in blocks of bounded size, each broadcast, against all
documents.  Documents are never shuffled: both passes are one scan; only counts are.

Defined results: null and empty texts, and items without a word, match nothing; repeated rows of either
table are each reported; null ids are kept; empty tables give an empty result; other columns are
ignored; of windows that score alike, the first in the document is given.  A document and an item are one
row of the result, however often the one holds the other.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, released

#: Scripts without blanks: Thai, Lao, Myanmar, Khmer, kana, Han.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af"
PLAIN = re.compile(r"[^\W_]+")
WORD = re.compile(rf"[{UNSPACED}]|[^\W_{UNSPACED}]+")
ANY_UNSPACED = re.compile(f"[{UNSPACED}]")
#: In ASCII, what is no letter or digit is a blank.
BLANKS = "".join(chr(c) if chr(c).isalnum() else " " for c in range(128))
#: Items of fewer words are asked for a copy with at most one edit, those under ``TINY`` for a full one.
MIN_WORDS = 8
TINY = 4
#: Score of an alignment as a share of the item's own (2 a word).
THRESHOLD = 0.5
MATCH, MISS, GAP = 2, -1, -1
#: Words of items in a block.
BLOCK_WORDS = 2_000_000
#: Longer items are searched by parts.
LONG = 2_000


def cut(text: str) -> list[str]:
    """The words of a text, in lower case."""
    text = text.lower()
    if text.isascii():
        return text.translate(BLANKS).split()
    return (WORD if ANY_UNSPACED.search(text) else PLAIN).findall(text)


def asked(m: int, threshold: float) -> float:
    """Share of a full copy's score that an item of m words has to reach."""
    if m >= MIN_WORDS:
        return threshold
    return max(threshold, 1.0 if m < TINY else (MATCH * (m - 1) + MISS) / (MATCH * m))


def seed_count(m: int, share: float) -> int:
    """Bigrams of an item of m words of which an alignment with that share of the score has one.

    A replaced or left-out word costs 3 of the score and at most two bigrams, a word cut off at an end
    costs 2 and one bigram; so those lost are at most 2/3 of the score that may be lost.
    """
    return min(m - 1, int(MATCH * m * (1 - share) * 2 / (MATCH - MISS) + 1e-9) + 1)


def smith_waterman(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, and the window's words [start, end) that it covers."""
    n = len(window)
    row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    step = np.arange(n + 1)
    best = (0, 0, 0)
    for x in item:
        up, diag = row + GAP, row[:-1] + np.where(window == x, MATCH, MISS)
        new, source = np.maximum(up, 0), np.where(up > 0, begin, step)
        better = diag > new[1:]
        new[1:][better], source[1:][better] = diag[better], begin[:-1][better]
        # gaps along the row: the running maximum of new + j
        lifted = new - GAP * step
        top = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted == top, step, 0))
        begin = np.where(top + GAP * step > 0, source[at], step)
        row = np.maximum(top + GAP * step, 0)
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), int(begin[k]), k)
    return best


class Items:
    """A block of items: word ids, n-grams, seeds."""

    def __init__(self, rows: list[tuple], threshold: float = THRESHOLD):
        self.vocab: dict[str, int] = {}
        self.ids, self.words = [], []
        #: Which row of the block each item is of: repeated rows and parts are told apart by it.
        self.row = []
        for row, (item_id, text) in enumerate(rows):
            w = cut(text or "")
            parts = -(-len(w) // LONG)
            edges = [k * len(w) // parts for k in range(parts + 1)] if w else []
            for a, b in zip(edges, edges[1:]):
                self.ids.append(item_id)
                self.row.append(row)
                self.words.append(np.array([self.vocab.setdefault(x, len(self.vocab)) for x in w[a:b]], np.int64))
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.need = [asked(len(w), threshold) for w in self.words]
        #: Words that a document can have between those of an item, at most.
        self.room = np.array([int(MATCH * m * (1 - x) / -GAP + 1e-9) for m, x in zip(self.size.tolist(), self.need)], np.int64)
        grams = [self.grams(w, 2) for w in self.words]
        self.item, self.pos, self.gram = self._listed(grams)
        self.distinct = np.unique(self.gram)

    @staticmethod
    def _listed(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place, key) of all n-grams of all items."""
        if not grams:
            return (np.zeros(0, np.int64),) * 3
        return np.repeat(np.arange(len(grams)), [len(g) for g in grams]), np.concatenate([np.arange(len(g)) for g in grams]), np.concatenate(grams)

    @staticmethod
    def places(w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where all of n words in a row are words of items, and the n-grams' hashes (not negative).
        N-grams that share a hash by chance are aligned in vain."""
        if len(w) < n:
            return (np.zeros(0, np.int64),) * 2
        known, size = w >= 0, len(w) - n + 1
        ok = known[:size]
        for i in range(1, n):
            ok = ok & known[i:size + i]
        at = np.flatnonzero(ok)
        key = np.full(len(at), n, np.uint64)
        for i in range(n):
            key = (key ^ w[at + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return at, (key >> np.uint64(1)).astype(np.int64)

    @classmethod
    def grams(cls, w: np.ndarray, n: int) -> np.ndarray:
        """n-gram hashes of an item's words."""
        return cls.places(w, n)[1]

    def read(self, text: str) -> np.ndarray:
        w = cut(text)
        return np.fromiter(map(self.vocab.get, w, repeat(-1)), np.int64, len(w))

    def choose(self, df: dict[int, int]) -> None:
        """Take the seeds, sorted by key."""
        counts = np.array([df.get(g, 0) for g in self.gram.tolist()], np.int64)
        # of each item the rarer occurrences of its bigrams
        order = np.lexsort((self.pos, counts, self.item))
        first = np.searchsorted(self.item, np.arange(len(self.words)))
        rank = np.arange(len(order)) - first[self.item[order]]
        many = np.array([seed_count(m, x) for m, x in zip(self.size.tolist(), self.need)], np.int64)
        keep = order[rank < many[self.item[order]]]
        ones = self._listed([self.grams(w, 1) if len(w) == 1 else w[:0] for w in self.words])
        item, pos, gram = (np.concatenate(x) for x in zip((self.item[keep], self.pos[keep], self.gram[keep]), self._listed([self.grams(w, 3) for w in self.words]), ones))
        order = np.lexsort((pos, item, gram))
        self.seed, self.seed_item, self.seed_pos = gram[order], item[order], pos[order]
        #: Each distinct seed's range.
        self.keys, self.lo = np.unique(self.seed, return_index=True)
        self.hi = np.append(self.lo[1:], len(self.seed))
        self.lengths = [n for n, any_ in ((1, len(ones[0])), (2, len(keep)), (3, len(self.seed) - len(keep) - len(ones[0]))) if any_]

    def leaks(self, text: str) -> list[tuple]:
        """(item_id, score, start, end) of the items that a text holds; start and end in its words."""
        w = self.read(text)
        places, at = [], []
        for n in self.lengths:
            hit, g = self.places(w, n)
            i = np.minimum(np.searchsorted(self.keys, g), max(0, len(self.keys) - 1))
            ok = np.flatnonzero(self.keys[i] == g) if len(self.keys) else i[:0]
            places.append(hit[ok])
            at.append(i[ok])
        if not any(map(len, places)):
            return []
        hit, at = np.concatenate(places), np.concatenate(at)
        lo, n = self.lo[at], self.hi[at] - self.lo[at]
        where = np.repeat(hit, n)
        row = np.repeat(lo, n) + np.arange(len(where)) - np.repeat(np.cumsum(n) - n, n)
        item, diag = self.seed_item[row], where - self.seed_pos[row]
        order = np.lexsort((diag, item))
        item, diag = item[order], diag[order]
        # seeds of an item whose diagonals lie within a third of its length belong to one window
        edge = np.flatnonzero((item[1:] != item[:-1]) | (diag[1:] - diag[:-1] > self.size[item[1:]] // 3)) + 1
        found: dict[int, tuple] = {}  # by row of the block
        here = np.zeros(len(self.vocab), bool)
        for a, b in zip(np.concatenate(([0], edge)).tolist(), np.append(edge, len(item)).tolist()):
            i = int(item[a])
            m, room, x = int(self.size[i]), int(self.room[i]), self.words[i]
            first, last = max(0, int(diag[a]) - room), min(len(w), int(diag[b - 1]) + m + room)
            for start in range(first, last, 4096):  # bounded rows, overlapping by an item's span
                window = w[start:min(last, start + 4096 + 2 * m)]
                # matches are at most the item's words that are there at all
                there = window[window >= 0]
                here[there] = True
                shared = int(np.count_nonzero(here[x]))
                here[there] = False
                if MATCH * shared < self.need[i] * MATCH * m - 1e-9:
                    continue
                score, s, e = smith_waterman(x, window)
                score = score / (MATCH * m)
                if score >= self.need[i] - 1e-9 and score > found.get(self.row[i], (0,))[0]:
                    found[self.row[i]] = (score, start + s, start + e, self.ids[i])
        return [(x[3], *x[:3]) for _, x in sorted(found.items())]


def blocks(benchmark: DataFrame):
    """Items in blocks of bounded size, by a stable order."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    part, size = [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        part.append((r.item_id, r.text))
        size += len(cut(r.text or ""))
        if size >= BLOCK_WORDS:
            yield part
            part, size = [], 0
    if part:
        yield part


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word) of each document and item that it holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    schema = "doc_id long, item_id long, score double, start_word long, end_word long"
    out = spark.createDataFrame([], schema)
    for part in blocks(benchmark):
        items = Items(part, threshold)
        if not items.words:
            continue
        plain = spark.sparkContext.broadcast(items)  # BLOCK_WORDS words and one item's

        def count(batches, plain=plain):
            own = plain.value
            total = np.zeros(len(own.distinct), np.int64)
            for b in batches:
                for text in b.column(0).to_pylist():
                    g = np.unique(own.places(own.read(text), 2)[1]) if len(total) else own.distinct
                    at = np.searchsorted(own.distinct, g)
                    ok = np.flatnonzero(at < len(total))
                    total[at[ok[own.distinct[at[ok]] == g[ok]]]] += 1
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(own.distinct[at]), pa.array(total[at])], ["gram", "df"])

        # at most one row an n-gram of the block
        df = dict(map(tuple, rows.select("text").mapInArrow(released(count), "gram long, df long").groupBy("gram").agg(F.sum("df")).collect()))
        items.choose(df)
        seeded = spark.sparkContext.broadcast(items)

        def align(batches, seeded=seeded):
            own = seeded.value
            for b in batches:
                got = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in own.leaks(t)]
                cols = list(zip(*got)) if got else [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "item_id", "score", "start_word", "end_word"])

        out = out.union(rows.mapInArrow(released(align), schema))
    return out


def op8_decontaminate(spark, sf_dir):
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
