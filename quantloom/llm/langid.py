"""Operator 5: language identification with hyperdimensional profiles.

Each letter has a random +1/-1 vector drawn from its code point; the letters of a trigram are
permuted (rolled) by their place and bound by multiplication; a text is the bundle (sum) of its
trigrams' vectors, a language the bundle of its training texts at unit length.  The language whose
prototype has the largest cosine with the text wins; ties go to the name that sorts first.

Plan: one Arrow pass bundles training texts by language within each task, summed by (language,
component): languages x DIM rows; one Arrow pass with the prototypes scores all texts, no shuffle.

Defined results: null texts and texts without letters are ``und`` with score 0; rows with a null
lang or such texts teach nothing; with nothing learned every text is ``und``; a null doc_id counts
as the empty text for the fold; repeated rows count each; other columns are ignored.  Score is the
cosine, from 0 (negative cosines too) to 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, released, remainder

DIM = 512
#: Texts bundled together by one matrix product, and the trigrams that it takes at once.
GROUP = 96
TRIGRAMS = 8192
#: Letter vectors a worker remembers; beyond, it starts anew (speed only).
LETTERS = 16_384
#: Least cosine of a text that is taken to be in a known language.  Unrelated vectors of DIM components
#: have cosines of about 0 with a deviation of DIM ** -0.5 = 0.044; the bound is kept below that, since a
#: few words of a known language can score as low.
MIN_COSINE = 0.02


class Hypervectors:
    """Letter vectors, made when first met, and the trigrams' vectors bound from them."""

    def __init__(self, dim: int = DIM, seed: int = 1):
        self.dim, self.seed = dim, seed
        self.at = np.full(0x110000, -1, np.int32)
        self.n = 0
        #: A letter's vector as it is rolled in each of the three places.
        self.table = np.zeros((3, 256, dim), np.int8)
        self.alpha = np.zeros(0x110000, bool)
        self.known = np.zeros(0x110000 >> 8, bool)

    def _learn(self, codes: np.ndarray) -> None:
        """Give the letters of at most TRIGRAMS trigrams their rows."""
        new = codes[self.at[codes] < 0]
        if self.n + len(new) > LETTERS and self.n:
            self.at[:], self.n = -1, 0
            new = codes
        if self.n + len(new) > self.table.shape[1]:
            grown = np.zeros((3, 2 * (self.n + len(new)), self.dim), np.int8)
            grown[:, :self.n] = self.table[:, :self.n]
            self.table = grown
        for code in new.tolist():
            v = (np.random.default_rng([self.seed, code]).integers(0, 2, self.dim, np.int8) * 2 - 1).astype(np.int8)
            for place in range(3):
                self.table[place, self.n] = np.roll(v, 2 - place)
            self.at[code] = self.n
            self.n += 1

    def bound(self, keys: np.ndarray) -> np.ndarray:
        """Vectors (rows) of trigrams."""
        codes = [((keys >> np.uint64(s)) & np.uint64(0x1FFFFF)).astype(np.int64) for s in (42, 21, 0)]
        self._learn(np.unique(np.concatenate(codes)))
        a, b, c = (self.table[k][self.at[x]] for k, x in enumerate(codes))
        a *= b
        a *= c
        return a

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct trigram keys and counts of the lowered letters; runs of others are one blank."""
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        pages = np.unique(code >> 8)
        for p in pages[~self.known[pages]]:
            self.alpha[p << 8:(p + 1) << 8] = [chr(c).isalpha() for c in range(int(p) << 8, (int(p) + 1) << 8)]
            self.known[p] = True
        letter = self.alpha[code]
        if not letter.any():
            return None
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first of each run of others stays, as a blank
        x = np.where(letter, code, 0)[keep].astype(np.uint64)
        x = np.concatenate((x[:0] if x[0] == 0 else np.zeros(1, np.uint64), x, np.zeros(0 if x[-1] == 0 else 1, np.uint64)))
        return np.unique((x[:-2] << np.uint64(42)) | (x[1:-1] << np.uint64(21)) | x[2:], return_counts=True)

    def bundles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of the texts (rows), and whether each has a letter."""
        out, some = np.zeros((len(texts), self.dim)), np.zeros(len(texts), bool)
        for lo in range(0, len(texts), GROUP):
            got = [(i, g) for i in range(lo, min(lo + GROUP, len(texts))) if texts[i] and (g := self.trigrams(texts[i]))]
            if not got:
                continue
            at = np.array([i for i, _ in got])
            some[at] = True
            row = np.repeat(np.arange(len(got)), [len(g[0]) for _, g in got])
            key, n = (np.concatenate(x) for x in zip(*(g for _, g in got)))
            order = np.argsort(key, kind="stable")
            key, row, n = key[order], row[order], n[order]
            head = np.concatenate(([True], key[1:] != key[:-1]))
            where, keys = np.cumsum(head) - 1, key[head]
            starts = np.append(np.flatnonzero(head), len(key))
            for k in range(0, len(keys), TRIGRAMS):
                part = keys[k:k + TRIGRAMS]
                own = slice(starts[k], starts[k + len(part)])
                counts = np.zeros((len(got), len(part)), np.float32)
                counts[row[own], where[own] - k] = n[own]
                out[at] += counts @ self.bound(part).astype(np.float32)
        return out, some


_vectors: dict[int, Hypervectors] = {}


def vectors(dim: int) -> Hypervectors:
    if dim not in _vectors:
        _vectors[dim] = Hypervectors(dim)
    return _vectors[dim]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / max(float(np.sqrt(v @ v)), 1e-12)


def prototypes(labelled: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """(lang, text) rows -> sorted language names and their unit vectors."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        own = vectors(dim)
        for b in batches:
            vs, some = own.bundles(b.column(1).to_pylist())
            for lang, v, ok in zip(b.column(0).to_pylist(), vs, some):
                if ok:
                    sums[lang] = sums.get(lang, 0) + np.rint(_unit(v) * (1 << 20)).astype(np.int64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(v)], ["lang", "k", "v"])

    # whole numbers: the sum is the same in any order
    got = labelled.select("lang", "text").mapInArrow(released(run), "lang string, k int, v long").groupBy("lang", "k").agg(F.sum("v").alias("v")).toPandas()
    names = sorted(set(got.lang))
    table = np.zeros((len(names), dim))
    table[got.lang.map({x: i for i, x in enumerate(names)}).to_numpy(int), got.k.to_numpy()] = got.v
    return names, np.array([_unit(v) for v in table]).reshape(len(names), dim)


def tell(texts: list[str | None], names: list[str], table: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and cosine (0 to 1) of each text."""
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    if names:
        vs, some = vectors(table.shape[1]).bundles(texts)
        for i in np.flatnonzero(some).tolist():
            cos = table @ _unit(vs[i])
            k = int(cos.argmax())
            lang[i], score[i] = names[k], float(min(max(cos[k], 0.0), 1.0))
    return lang, score


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs (doc_id, held_out, text) -> doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vector a language

    def run(batches):
        names, table = shared.value
        for b in batches:
            lang, score = tell(b.column(2).to_pylist(), names, table)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.mapInArrow(released(run), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float = MIN_COSINE) -> DataFrame:
    """The rows of docs, whole, whose text is in a known language: one is predicted (not ``und``) with a
    cosine of ``least`` or more.  One pass over the rows themselves, so an id need not tell them apart."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        names, table = shared.value
        for b in batches:
            lang, score = tell(b.column(at).to_pylist(), names, table)
            yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)


def split(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all rows to predict, rows to learn from)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    taught = docs.filter((remainder(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows, taught


def op5_langid(spark, sf_dir):
    rows, taught = split(documents(spark, sf_dir))
    return predict(rows, prototypes(taught))
