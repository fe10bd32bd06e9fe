"""Exact top-k search against brute force: rows are told apart, lengths and odd vectors are kept apart."""

import logging
import os

import numpy as np
import pytest

from quantloom.llm import knn


def brute(rows, asked, k=10):
    """rows (vec_id, vector): the ranked answers of each query row."""
    out = []
    for i, (q, a) in enumerate(rows):
        if asked(q):
            found = sorted((-sum(int(x) * int(y) for x, y in zip(a, b)), v) for j, (v, b) in enumerate(rows) if j != i and len(a) == len(b))[:k]
            out.append((q, tuple((v, -s) for s, v in found)))
    return sorted(x for x in out if x[1])


def search(spark, rows, asked="vec_id % 100 = 0", k=10, **kw):
    v = knn.keyed(knn.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1))
    got = {}
    for r in knn.top_k(v.filter(asked), v, k, **kw).collect():
        got.setdefault((r.query_row, r.query_id), []).append((r["rank"], r.vec_id, r.score))
    for x in got.values():
        assert sorted(y[0] for y in x) == list(range(1, len(x) + 1))
    return sorted((q, tuple((v, s) for _, v, s in sorted(x))) for (_, q), x in got.items())


hundred = lambda q: q % 100 == 0


@pytest.mark.parametrize("pivots", [None, 8, 300])
def test_equals_brute_force_with_ties_and_repeated_rows(spark, pivots):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)]
    rows += [(0, rows[0][1]), (0, [2.0, 2.0, 2.0, 2.0]), (100, rows[100][1]), (200, rows[7][1])]
    assert search(spark, rows, pivots=pivots, slice_rows=40) == brute(rows, hundred)


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (100, [0.0, 0.0])]
    odd = [(2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (None, [9.0, 9.0])]
    assert search(spark, rows + odd) == brute(rows, hundred)
    assert search(spark, odd) == []
    assert search(spark, rows[:1]) == []


def test_each_length_is_a_search_of_its_own(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-5, 6, 3).astype(float).tolist()) for i in range(120)] + [(500, [1.0]), (501, [2.0]), (600, [4.0]), (700, []), (701, []), (800, [1.0] * 9)]
    assert search(spark, rows) == brute(rows, hundred)


def test_many_rows_of_the_query_id(spark):
    rng = np.random.default_rng(5)
    rows = [(100, rng.integers(-9, 9, 4).astype(float).tolist()) for _ in range(40)] + [(i, rng.integers(-9, 9, 4).astype(float).tolist()) for i in range(118) if i not in (0, 100)]
    want = brute(rows, hundred)
    assert search(spark, rows) == want and len(want) == 40 and all(len(x[1]) == 10 for x in want)


def test_products_at_the_ends_of_64_bits(spark):
    big = float(1 << 40)
    rows = [(0, [big, big]), (1, [big, big]), (2, [-big, -big]), (3, [1.0, 0.0])]
    ends = {1: (1 << 63) - 1, 2: -(1 << 63), 3: 1 << 40}
    assert search(spark, rows, "vec_id = 0") == [(0, tuple(sorted(ends.items(), key=lambda x: -x[1])))]


def test_bounds_prune_and_lose_nothing(spark, caplog):
    # clusters of unlike size far from each other: most products need not be taken
    rng = np.random.default_rng(6)
    rows = []
    for c in range(12):
        centre = rng.normal(0, 300, 16)
        rows += [(len(rows) + i, np.floor(centre + rng.normal(0, 4 + c, 16)).tolist()) for i in range(10 + 12 * c)]
    with caplog.at_level(logging.INFO, "quantloom.llm.knn"):
        assert search(spark, rows) == brute(rows, hundred)
    pruned, of = (int(x) for x in caplog.records[-1].getMessage().split()[1:4:2])
    assert pruned > of // 2


@pytest.mark.parametrize("seed", range(6))
def test_bounds_hold(seed):
    rng = np.random.default_rng(seed)
    d, n, k = int(rng.integers(1, 9)), 200, int(rng.integers(1, 12))
    x = np.floor(rng.normal(0, rng.choice([3, 100]), (n, d)) + rng.choice([0, 50], (n, 1)))
    own = knn.Pivots(np.arange(20), np.arange(20), x[:20])
    ring, dist, norm, dot = own.place(x)
    names = np.unique(ring)
    told = [np.array([f(v[ring == r]) for r in names]) for f, v in ((len, ring), (np.max, dist), (np.max, norm), (np.min, dot), (np.max, dot))]
    need = knn.Router(own, k, names, *told).needed(np.arange(n), x)
    for i in range(n):
        s = x @ x[i]
        best = sorted((j for j in range(n) if j != i), key=lambda j: (-s[j], j))[:k]
        assert need[i][np.searchsorted(names, ring[best])].all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_the_registered_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    got = knn.op2_topk(spark, "/root/testdata/sf0.001")
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(knn.OP2_SQL).fetchall())


def test_sql_tells_rows_apart(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(9)
    rows = [(i % 130, (rng.integers(-3, 4, 3) / 1024).tolist()) for i in range(150)] + [(200, [0.5]), (300, [0.25]), (400, []), (500, []), (7, None), (None, [0.1, 0.2, 0.3])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", knn.F.lit(1)).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(map(tuple, knn.op2_topk(spark, str(tmp_path)).collect())) == sorted(con.execute(knn.OP2_SQL).fetchall())
