"""Tables that are kept: what a step reads and rewrites, and what it leaves when it is repeated or breaks off."""

import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators.factors import PRICE, price_factors
from quantloom.sources.matrices import MatrixCache, forward_returns, universe_hash
from quantloom.sources.tables import Conflict, KeyedTable, Manifest


def bars(spark, symbols=4, days=200, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(symbols):
        for t in range(days):
            # the last symbol is seldom traded, another begins late, a third ends early
            if (k == 3 and t % 9) or (k == 2 and t < 120) or (k == 1 and t > 150):
                continue
            rows.append((f"S{k}", t, 100 * rng.uniform(0.9, 1.1)))
    return spark.createDataFrame(rows, "symbol string, t int, close double").selectExpr("symbol", "date_add(date'2020-01-01', t) as date", "close").cache()


def upto(d, day):
    return d.filter(F.expr(f"date <= date_add(date'2020-01-01', {day})"))


def alike(a, b):
    cols = a.columns
    key = lambda r: tuple(f"{x:.10g}" if isinstance(x, float) else str(x) for x in r)
    left, right = sorted(map(key, a.select(*cols).collect())), sorted(map(key, b.select(*cols).collect()))
    assert left == right and left


@pytest.mark.parametrize("factor", ["momentum_20d", "volatility_20d", "quality_price_proxy", "value_price_proxy", "growth_price_proxy"])
def test_grown_values_equal_one_build(spark, tmp_path, factor):
    d = bars(spark)
    cache = MatrixCache(spark, str(tmp_path))
    for day in (3, 60, 61, 130, 199):
        got = cache.values(upto(d, day), factor)
    alike(got.filter("value is not null"), price_factors(d, [factor]).selectExpr("symbol", "date as signal_date", f"{factor} as value").filter("value is not null"))
    assert cache.stats["grown"] == 4 and cache.stats["bars_read"] == d.count()


def test_every_factor_looks_no_further_back_than_it_says(spark, tmp_path):
    d = bars(spark, symbols=1, days=260)
    for f in PRICE:
        cache = MatrixCache(spark, f"{tmp_path}/{f.name}")
        cache.values(upto(d, 200), f.name)
        alike(cache.values(d, f.name).filter("value is not null"), price_factors(d, [f.name]).selectExpr("symbol", "date as signal_date", f"{f.name} as value").filter("value is not null"))


def test_labels_grow_by_date_and_by_horizon(spark, tmp_path):
    d = bars(spark)
    cache = MatrixCache(spark, str(tmp_path))
    cache.labels(upto(d, 100), [5])
    cache.labels(upto(d, 100), [5, 30])  # a horizon more
    got = cache.labels(d, [5, 30, 7])  # dates and a horizon at once
    alike(got, forward_returns(d, [5, 7, 30]))
    alike(cache.labels(d, [7]), forward_returns(d, [7]))
    assert cache.stats["extended"] == 2 and cache.stats["grown"] == 1 and cache.stats["hits"] == 2


def test_second_build_reads_new_dates_only(spark, tmp_path):
    at = f"{tmp_path}/bars"
    bars(spark).write.partitionBy("date").parquet(at)
    stored = spark.read.parquet(at)
    cache = MatrixCache(spark, f"{tmp_path}/cache")
    cache.values(upto(stored, 150), "momentum_20d")
    before = cache.stats["bars_read"]
    # history before the new dates is gone: what is needed of it is in the entry
    late = stored.filter("date > date_add(date'2020-01-01', 150)")
    got = cache.values(late, "momentum_20d")
    assert cache.stats["bars_read"] - before == late.count()
    alike(got, price_factors(stored, ["momentum_20d"]).selectExpr("symbol", "date as signal_date", "momentum_20d as value"))


def test_matrix_key_check_and_universe(spark, tmp_path):
    d = bars(spark)
    cache = MatrixCache(spark, str(tmp_path))
    one = cache.matrix(d, "volatility_20d", [5], ["s0 ", "S1"])
    alike(one, cache.matrix(d, "volatility_20d", [5], ["S1", "s0", "S0"]))
    assert cache.stats["built"] == 2 and {r.symbol for r in one.select("symbol").distinct().collect()} == {"S0", "S1"}
    assert one.filter("value > 0").count() == 0  # the factor's direction
    cache.matrix(d, "volatility_20d", [5], ["S0", "S1"], start="2020-03-01")
    cache.matrix(d, "volatility_20d", [5], ["S0", "S1"], version="2")
    assert cache.stats["built"] == 6
    # a history restated without a new version is noticed by its number of bars
    fewer = d.filter("date <> date'2020-02-02'")
    alike(cache.matrix(fewer, "volatility_20d", [5], ["S0", "S1"], check=True), MatrixCache(spark, f"{tmp_path}/b").matrix(fewer, "volatility_20d", [5], ["S0", "S1"]))
    assert cache.stats["invalidated"] == 2
    assert universe_hash(None) == "all" and universe_hash(["b", "A "]) == universe_hash(["a", "B"]) != universe_hash(["a"])
    assert cache.matrix(d.limit(0), "momentum_20d", [5], ["none"]).count() == 0


ROWS = "k long, day date, v int, x string"


def rows(spark, data):
    return spark.createDataFrame(data, "k long, day string, v int, x string").selectExpr("k", "cast(day as date) as day", "v", "x")


def content(table):
    return sorted(((r.k, str(r.day), r.v, r.x) for r in table.read().collect()), key=str)


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), ["k", "day"], ["v"], buckets=8)
    assert t.read() is None
    t.upsert(rows(spark, [(k, "2024-01-01", 1, "a") for k in range(100)] + [(None, None, 1, "none")]), "one")
    first = t.manifest.last()[1]["paths"]
    done = t.upsert(rows(spark, [(5, "2024-01-01", 2, "b")]), "two")
    second = t.manifest.last()[1]["paths"]
    assert done["written"] == 1 and sum(first[b] != second[b] for b in first) == 1
    assert (5, "2024-01-01", 2, "b") in content(t) and len(content(t)) == 101
    # an older row loses, an equal one wins, repeated rows of a run are one, null keys are keys
    t.upsert(rows(spark, [(5, "2024-01-01", 1, "late"), (6, "2024-01-01", 1, "same"), (7, "2024-01-01", 3, "p"), (7, "2024-01-01", 3, "q"), (None, None, 2, "still")]), "three")
    got = {r[0]: r[2:] for r in content(t)}
    assert got[5] == (2, "b") and got[6] == (1, "same") and got[7] == (3, "q") and got[None] == (2, "still") and len(content(t)) == 101


def test_run_tried_again_changes_nothing(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), ["k", "day"], [], buckets=4)
    t.upsert(rows(spark, [(1, "2024-01-01", 1, "a")]), "r1")
    t.upsert(rows(spark, [(1, "2024-01-01", 1, "b")]), "r2")
    assert t.upsert(rows(spark, [(1, "2024-01-01", 1, "a"), (9, "2024-01-01", 1, "z")]), "r1")["repeated"]
    assert content(t) == [(1, "2024-01-01", 1, "b")] and t.manifest.last()[0] == 2


def test_a_run_that_breaks_off_leaves_the_table(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, str(tmp_path), ["k", "day"], ["v"], buckets=4)
    t.upsert(rows(spark, [(k, "2024-01-01", 1, "a") for k in range(20)]), "one")
    before = content(t)
    with monkeypatch.context() as m:
        m.setattr(Manifest, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            t.upsert(rows(spark, [(k, "2024-01-01", 2, "b") for k in range(20)]), "two")
    assert content(KeyedTable(spark, str(tmp_path), ["k", "day"], ["v"])) == before
    t.upsert(rows(spark, [(k, "2024-01-01", 2, "b") for k in range(20)]), "two")
    assert {r[3] for r in content(t)} == {"b"}


def test_two_writers_are_told(spark, tmp_path):
    m = Manifest(spark, str(tmp_path))
    assert m.last() == (0, {})
    assert m.commit(0, {"a": 1}) == 1
    with pytest.raises(Conflict):
        m.commit(0, {"a": 2})
    spark.createDataFrame([(2, "other", "", "{}"), (2, "another", "", "{}")], m.SCHEMA).write.mode("append").json(m.path)
    assert m.last() == (1, {"a": 1})  # none of two lines of one generation counts
    assert m.commit(1, {"a": 3}, "run") == 3 and m.has_run("run") and m.last()[1] == {"a": 3}


def test_columns_are_held_to(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), ["k"], ["v"], buckets=4)
    t.upsert(rows(spark, [(1, "2024-01-01", 1, "a")]), "one")
    with pytest.raises(ValueError):
        t.upsert(rows(spark, [(1, "2024-01-01", 1, "a")]).drop("x"), "two")
    t.upsert(rows(spark, [(1, "2024-01-01", 1, "a")]).limit(0), "none")
    t.upsert(rows(spark, [(1, "2024-01-02", 5, "c")]).select("x", "v", "k", "day"), "order")
    assert content(t) == [(1, "2024-01-02", 5, "c")]
