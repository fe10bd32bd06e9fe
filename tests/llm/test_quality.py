"""Quality classifier: features, ratios and the fit against plain versions, odd rows."""

import math
import random

import numpy as np
import pytest

from quantloom.llm import quality


def plain_features(text):
    seen = {0}
    for i, a in enumerate(text):
        seen.add(a + 1)
        if i + 1 < len(text):
            two = a | text[i + 1] << 8
            seen.add(((two + (1 << 24)) * 2654435761 & 0xFFFFFFFF) >> (32 - quality.BITS))
        if i + 2 < len(text):
            three = a | text[i + 1] << 8 | text[i + 2] << 16
            seen.add((three * 2246822519 & 0xFFFFFFFF) >> (32 - quality.BITS))
    w = text.split()
    if len(w) > 8:
        seen.add(quality.DIM - 1 - min(7, int(8 * (1 - len(set(zip(w, w[1:]))) / (len(w) - 1)))))
    lines = [x for x in text.split(b"\n") if x]
    if len(lines) > 3:
        seen.add(quality.DIM - 9 - min(7, int(8 * (1 - len(set(lines)) / len(lines)))))
    return sorted(seen)


def test_features_equal_plain_sets():
    rng = random.Random(1)
    texts = [b"", b"a", b"ab", "é\n\n".encode(), b"a b " * 30, b"l1\nl2\nl1\nl1\nl1\n"]
    texts += [bytes(rng.choice(b"abc de\nf\xff") for _ in range(rng.randint(0, 200))) for _ in range(50)]
    texts.append(bytes(rng.randrange(256) for _ in range((1 << 20) + 5)))  # over the border of a piece
    for t in texts:
        assert quality.features(t).tolist() == plain_features(t)


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    n, d = 30, 12
    rows = [np.sort(rng.choice(d, rng.integers(1, 6), replace=False)).astype(np.int32) for _ in range(n)]
    y = np.where(rng.random(n) < 0.4, 1.0, -1.0)
    scale = rng.normal(0, 1, d)
    w = quality.dual_coordinate_descent(rows, y, scale, epochs=5000)
    x = np.zeros((n, d))
    for i, ids in enumerate(rows):
        x[i, ids] = scale[ids] / max(np.linalg.norm(scale[ids]), 1e-9)
    cap = np.where(y > 0, 1 / (2 * (y > 0).mean()), 1 / (2 * (y < 0).mean()))
    # plain projected gradient on the dual
    z = x * y[:, None]
    gram, alpha = z @ z.T, np.zeros(n)
    step = 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(50_000):
        alpha = np.clip(alpha + step * (1 - gram @ alpha), 0, cap)
    primal = lambda v: 0.5 * v @ v + (cap * np.maximum(0, 1 - z @ v)).sum()
    assert primal(w) == pytest.approx(primal(z.T @ alpha), abs=1e-3)


def test_ratios_cover_all_rows_and_the_sample_is_bounded(spark):
    rng = random.Random(3)
    rows = [(k % 7 if k < 300 else 1, "good " + rng.choice("abc") if k % 2 else "bad " + rng.choice("xyz"), k % 2) for k in range(400)]
    rows += [(1, "good a", 1)] * 3000 + [(None, None, 0), (5, "", 0), (5, "", 1)]
    weights, scale, a, b = quality.train(spark.createDataFrame(rows, "doc_id long, text string, y int"), fit_rows=50)
    n, counts = [0, 0], [{}, {}]
    for _, t, y in rows:
        n[y] += 1
        for f in plain_features((t or "").encode()):
            counts[y][f] = counts[y].get(f, 0) + 1
    for f in set(counts[0]) | set(counts[1]):
        p, q = counts[1].get(f, 0), counts[0].get(f, 0)
        want = 1.0 if f == 0 else 0.0 if p + q < quality.LEAST else math.log((p + 1) / (n[1] + 2) / ((q + 1) / (n[0] + 2)))
        assert scale[f] == pytest.approx(want, abs=1e-12)
    assert a > 0 and weights.shape == scale.shape


def test_odd_rows_are_scored(spark):
    rng = random.Random(4)
    labelled = [(k, ("fine words here " if k % 2 else "##!! $$ ") * rng.randint(1, 9), k % 2) for k in range(200)]
    model = quality.train(spark.createDataFrame(labelled, "doc_id long, text string, y int"))
    odd = [(None, True, None), (1, False, ""), (1, False, ""), (2, True, "fine words here " * 200_000), (3, True, "\x00")]
    got = quality.score(spark.createDataFrame(odd, "doc_id long, held_out boolean, text string"), model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= quality.THRESHOLD) for r in got)
    assert [r.predicted for r in got if r.doc_id == 2] == [1]


def test_the_query_keeps_every_row_and_reads_no_label_as_input(spark, tmp_path):
    rng = random.Random(5)
    docs = [(k if k % 11 else None, rng.choice(["fine words ", "## $$ "]) * rng.randint(0, 20), "en", "s", 1, k % 2) for k in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int("fine" in t), 0) for k, t, *_ in docs if k is not None] + [(None, 1, 0), (5, None, 1), (7, 9, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = quality.op1_quality(spark, str(tmp_path))
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert sorted((r.doc_id or -1) for r in got.collect()) == sorted((d[0] or -1) for d in docs)
