"""Operator 1: quality classifier, Naive Bayes support vectors.

Features are indicators of the byte n-grams (1 to 3 bytes, hashed to a fixed space) and of word
bigram repeats that a text holds.  Their class log-count ratios come from every labelled training
row, smoothed by one in each class; a feature that fewer than ``LEAST`` training rows hold is given the
ratio 0, as its sign would be chance.  Indicators are scaled by these ratios and a linear hinge-loss model
is fitted to them by dual coordinate descent.  The fit takes a sample of about ``fit_rows`` rows, chosen by
a hash of id, label and features, in which rows alike in all three count once, so that the sample stays
bounded however often an id or a text repeats; counts and scores cover all rows.

Plan: labels join compressed texts once (training rows only; labels grow with the corpus, so neither
side is broadcast) -> one Arrow pass counts features by class, summed
by key -> ratios: at most 2 x DIM rows -> the fit runs in one task on the bounded sample -> weights
(DIM floats, a fixed size) go out with the scoring pass, which has no shuffle.

Defined results: a null or empty text has only the bias feature and is scored like any other; a null
doc_id counts as the empty text for the fold; labels that are null or not 0/1 teach nothing; a
doc_id with several labels teaches once for each; with no label of one class every score is 0.5;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, remainder, written

BITS = 18
DIM = 1 << BITS
#: About as many labelled rows are used in the fit (not in the counts).
FIT_ROWS = 8000
#: Training rows that must hold a feature for its ratio to count.
LEAST = 3
#: Score from which a document is predicted to be of label 1.
THRESHOLD = 0.3
LINE = re.compile(rb"[^\n]+")


def features(text: bytes) -> np.ndarray:
    """Sorted distinct feature ids of a text; id 0 is always there (the bias)."""
    seen = np.zeros(DIM, bool)
    seen[0] = True
    for k in range(0, len(text), 1 << 20):  # bounded memory on very long texts
        x = np.frombuffer(text[k:k + (1 << 20) + 2], np.uint8).astype(np.uint32)
        seen[x + 1] = True
        if len(x) > 1:
            two = x[:-1] | (x[1:] << np.uint32(8))
            seen[((two + np.uint32(1 << 24)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)] = True
            if len(x) > 2:
                three = two[:-1] | (x[2:] << np.uint32(16))
                seen[(three * np.uint32(2246822519)) >> np.uint32(32 - BITS)] = True
    words = text.split()
    pairs = len(words) - 1
    if pairs > 7:  # how much of the text repeats itself, in eighths
        share = 1 - len(set(zip(words, words[1:]))) / pairs
        seen[DIM - 1 - min(7, int(8 * share))] = True
    lines = LINE.findall(text)
    if len(lines) > 3:
        seen[DIM - 9 - min(7, int(8 * (1 - len(set(lines)) / len(lines))))] = True
    return np.flatnonzero(seen).astype(np.int32)


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float = 1.0, epochs: int = 15, seed: int = 7) -> np.ndarray:
    """Linear hinge-loss weights over unit-length rows x = scale[ids]/norm; y is -1 or 1."""
    w = np.zeros(len(scale))
    xs = []
    for ids in rows:
        v = scale[ids]
        xs.append(v / max(np.sqrt(v @ v), 1e-9))
    share = max((y > 0).mean(), 1e-9), max((y < 0).mean(), 1e-9)
    cap = np.where(y > 0, c / (2 * share[0]), c / (2 * share[1]))  # classes weigh the same
    q = np.array([max(x @ x, 1e-9) for x in xs])
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            ids, x = rows[i], xs[i]
            g = y[i] * (w[ids] @ x) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), cap[i])
            step = new - alpha[i]
            if step:
                w[ids] += step * y[i] * x
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def margin(ids: np.ndarray, w: np.ndarray, scale: np.ndarray) -> float:
    v = scale[ids]
    return float(w[ids] @ v / max(np.sqrt(v @ v), 1e-9))


def sigmoid_fit(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1/(1+exp(-(a m + b))) by Newton steps on the log-loss, with damped targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        d, h = p - t, np.maximum(p * (1 - p), 1e-9)
        ga, gb = d @ m + 1e-3 * a, d.sum()
        haa, hab, hbb = h @ (m * m) + 1e-3, h @ m, h.sum() + 1e-9
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)


def train(labelled: DataFrame, fit_rows: int = FIT_ROWS):
    """labelled: (doc_id, text, y in 0/1) -> (weights, scale, a, b), or None if a class is missing."""

    def extract(batches):
        for b in batches:
            rows = [features(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "y", "ids"])

    def count(batches):
        total = np.zeros((2, DIM), np.int64)
        n = np.zeros(2, np.int64)
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            ids = b.column(1)
            sizes = np.diff(ids.offsets.to_numpy())
            flat, label = ids.flatten().to_numpy(), np.repeat(y, sizes)
            for k in (0, 1):
                total[k] += np.bincount(flat[label == k], minlength=DIM)
                n[k] += (y == k).sum()
        for k in (0, 1):
            at = np.flatnonzero(total[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, k, np.int32)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[k][at], n[k]))], ["y", "id", "n"])

    rows = written(labelled.select("doc_id", "text", F.col("y").cast("int").alias("y")).mapInArrow(extract, "doc_id long, y int, ids array<int>"), "features")
    got = rows.select("y", "ids").mapInArrow(count, "y int, id int, n long").groupBy("y", "id").agg(F.sum("n").alias("n")).toPandas()
    n, counts = np.zeros(2), np.zeros((2, DIM))
    for k in (0, 1):
        part = got[got.y == k]
        counts[k, part.id[part.id >= 0]] = part.n[part.id >= 0]
        n[k] = part.n[part.id < 0].sum()
    if not n.all():
        return None
    # of Bernoulli features: the odds of the smoothed shares of documents that hold each
    p, q = (counts[1] + 1) / (n[1] + 2), (counts[0] + 1) / (n[0] + 2)
    scale = np.log(p / q)
    scale[counts.sum(0) < LEAST] = 0.0
    scale[0] = 1.0
    share = min(1.0, fit_rows / n.sum())
    drawn = rows.withColumn("h", F.xxhash64("ids")).filter(F.pmod(F.xxhash64("doc_id", "y", "h"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = drawn.groupBy("doc_id", "y", "h").agg(F.first("ids").alias("ids"))

    def fit(batches):
        x, y = [], []
        for b in batches:
            at = b.column(1).offsets.to_numpy()
            flat = b.column(1).flatten().to_numpy()
            x += [flat[i - at[0]:j - at[0]] for i, j in zip(at, at[1:])]
            y += b.column(0).to_pylist()
        y = np.array(y) * 2.0 - 1
        if not len(x):
            return
        order = np.lexsort((np.array([int(v.sum()) for v in x]), np.array([len(v) for v in x]), y))
        x, y = [x[i] for i in order], y[order]
        w = dual_coordinate_descent(x, y, scale)
        # the sigmoid is fitted to margins that a model of the other half gave
        m, half = np.zeros(len(x)), np.arange(len(x)) % 2
        for k in (0, 1):
            there, other = np.flatnonzero(half == k), np.flatnonzero(half != k)
            wk = dual_coordinate_descent([x[i] for i in other], y[other], scale) if len(other) else w
            m[there] = [margin(x[i], wk, scale) for i in there]
        a, b = sigmoid_fit(m, y)
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([a]), pa.array([b])], ["w", "a", "b"])

    model = sample.select("y", "ids").coalesce(1).mapInArrow(fit, "w array<double>, a double, b double").first()
    return None if model is None else (np.array(model.w), scale, model.a, model.b)


def score(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, held_out, text) -> doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of DIM doubles at most

    def run(batches):
        for b in batches:
            texts = b.column(2).cast(pa.binary()).to_pylist()
            if shared.value is None:
                s = np.full(len(texts), 0.5)
            else:
                w, scale, a, c = shared.value
                m = np.array([margin(features(t or b""), w, scale) for t in texts])
                s = 1 / (1 + np.exp(-np.clip(a * m + c, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, y) -> (doc_id, text, y); texts are compressed on their way."""

    def pack(batches):
        z = zstandard.ZstdCompressor(1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([z.compress(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()], pa.binary())], ["doc_id", "z"])

    def unpack(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            text = pa.array([z.decompress(t) for t in b.column(1).to_pylist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), text, b.column(2)], ["doc_id", "text", "y"])

    packed = docs.select("doc_id", "text").mapInArrow(pack, "doc_id long, z binary")
    return packed.join(labels.hint("merge"), "doc_id").select("doc_id", "z", "y").mapInArrow(unpack, "doc_id long, text string, y int")


def op1_quality(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    labels = labels.filter(remainder(F.col("doc_id"), 5) != 0)
    return score(docs, train(labelled_texts(docs.filter("not held_out"), labels)))
