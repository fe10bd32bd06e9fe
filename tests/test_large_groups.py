"""Operators that spread what a plain window or join holds in one task: same figures, smaller tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators.asof import as_of, as_of_few
from quantloom.operators.buckets import as_of_in_buckets, in_buckets, price_factors_in_buckets, with_halo
from quantloom.operators.factors import PRICE, price_factors
from quantloom.operators.tiles import covariance_tiles
from quantloom.operators.wide import ordered_groups, wide_quantiles, wide_ranks
from quantloom.sources.matrices import forward_returns


def rows_of(df):
    key = lambda r: tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r)
    return sorted(map(key, df.select(*sorted(df.columns)).collect()))


def panel(spark, symbols, days, share=1.0, seed=2):
    rng = random.Random(seed)
    data = [(f"S{k}", t, 100 * rng.uniform(0.8, 1.2)) for k in range(symbols) for t in range(days) if rng.random() < share]
    return spark.createDataFrame(data, "symbol string, t int, close double").selectExpr("symbol", "date_add(date'2019-12-20', t) as date", "close").cache()


@pytest.mark.parametrize("days, share", [(10, 1.0), (45, 0.5), (400, 0.05), (7, 0.02)])
def test_factors_in_buckets_equal_factors(spark, days, share):
    bars = panel(spark, 2, 500, share)
    names = [f.name for f in PRICE]
    assert rows_of(price_factors_in_buckets(bars, names, days)) == rows_of(price_factors(bars, names))


def test_halo_is_counted_in_rows_and_small(spark):
    bars = panel(spark, 1, 1000)
    wide = with_halo(bars, 5, 3, days=100)
    per = {r.bucket: r["count"] for r in wide.groupBy("bucket").count().collect()}
    assert max(per.values()) == 108 and sum(per.values()) == 1000 + 8 * (len(per) - 1)
    none = bars.withColumn("date", F.when(F.dayofmonth("date") > 3, F.col("date")))
    assert with_halo(none, 2, days=30).filter("date is null").count() == 0


def test_look_ahead_in_buckets(spark):
    bars = panel(spark, 3, 300, 0.6)
    got = in_buckets(bars, lambda d: forward_returns(d, [1, 12]), 0, 12, days=20, out_time="signal_date")
    assert rows_of(got) == rows_of(forward_returns(bars, [1, 12]))


@pytest.mark.parametrize("days", [1, 9, 1000])
def test_as_of_in_buckets_equals_as_of(spark, days):
    rng = random.Random(days)
    asks = [(rng.choice("ABC"), rng.choice([None, *range(400)]), k) for k in range(500)]
    facts = [(rng.choice("ABD"), rng.choice([None, *range(0, 400, 7)]), rng.randint(0, 5), float(k)) for k in range(60)]
    day = lambda c: F.expr(f"date_add(date'2019-12-20', {c})")
    left = spark.createDataFrame(asks, "symbol string, t int, k int").select("symbol", day("t").alias("date"), "k")
    right = spark.createDataFrame(facts, "symbol string, t int, tie int, x double").select("symbol", day("t").alias("known"), "tie", "x").dropDuplicates(["symbol", "known", "tie"])
    want = as_of(left, right, ["symbol"], "date", "known", ["tie"])
    assert rows_of(as_of_in_buckets(left, right, ["symbol"], "date", "known", ["tie"], days)) == rows_of(want)


def test_as_of_few_without_a_nested_loop(spark):
    rng = random.Random(4)
    day = lambda c: F.expr(f"date_add(date'2019-12-20', {c})")
    left = spark.createDataFrame([(rng.choice([None, *range(900)]), k) for k in range(400)], "t int, k int").select(day("t").alias("date"), "k")
    right = spark.createDataFrame([(t, f"r{t}") for t in (40, 41, 300, 301, 700)] + [(None, "none")], "t int, regime string").select(day("t").alias("date"), "regime")
    got = as_of_few(left, right, "date", "date")
    want = []
    known = [(r.date, r.regime) for r in right.filter("date is not null").orderBy("date").collect()]
    for r in left.collect():
        hit = [x for x in known if r.date is not None and x[0] <= r.date][-1:]
        want.append((str(r.date), str(hit[0][0]) if hit else "None", str(r.k), hit[0][1] if hit else "None"))
    assert rows_of(got) == sorted(want)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    assert as_of_few(left, right.limit(0), "date", "date").filter("regime is null").count() == 400


@pytest.mark.parametrize("block, span", [(128, 512), (3, 20), (1, 1)])
def test_covariance_tiles(spark, block, span):
    bars = panel(spark, 8, 60, 0.7).union(spark.createDataFrame([("one", None, 1.0), (None, None, 2.0)], "symbol string, date date, close double"))
    lone = spark.createDataFrame([("L", 7.0)], "symbol string, close double").selectExpr("symbol", "date'2019-12-22' as date", "close")
    bars = bars.union(lone)
    x, y = bars.select("date", F.col("symbol").alias("a"), F.col("close").alias("x")), bars.select("date", F.col("symbol").alias("b"), F.col("close").alias("y"))
    want = x.join(y, "date").groupBy("a", "b").agg(F.count("*").alias("n"), F.covar_samp("x", "y").alias("cov"))
    assert rows_of(covariance_tiles(bars, "close", block, span)) == rows_of(want)


def test_covariance_of_large_values_keeps_its_digits(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(0, 1e-3, (50, 3)) + 1e6
    rows = spark.createDataFrame([(f"S{j}", t, float(data[t, j])) for t in range(50) for j in range(3)], "symbol string, t int, x double").selectExpr("symbol", "date_add(date'2020-01-01', t) as date", "x")
    got = {(r.a, r.b): r.cov for r in covariance_tiles(rows, "x").collect()}
    want = np.cov(data.T)
    assert all(abs(got[f"S{i}", f"S{j}"] - want[i, j]) < 1e-9 for i in range(3) for j in range(3))


def test_covariance_plan_joins_no_symbols_by_date(spark):
    bars = panel(spark, 40, 30)
    out = covariance_tiles(bars, "close", block=10, span=512)
    assert out.count() == 1600 and covariance_tiles(bars.limit(0), "close").count() == 0


def test_covariance_shuffles_values_but_no_sums_of_pairs(spark):
    bars = panel(spark, 40, 30)
    out = covariance_tiles(bars, "close", block=10, span=512)
    plan = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan
    dealt = [line for line in plan.splitlines() if "Exchange hash" in line]
    assert dealt and all("hashpartitioning(block#" in line for line in dealt)


def test_covariance_of_both_ways_round_is_stored_about_once(spark, tmp_path):
    bars = panel(spark, 300, 40)
    out = covariance_tiles(bars, "close")
    out.write.option("compression", "snappy").parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    back = got.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("n").alias("m"), F.col("cov").alias("voc"))
    assert got.count() == 90_000 and got.join(back, ["a", "b"]).filter("n = m and abs(cov - voc) < 1e-9").count() == 90_000
    size = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert size < 6 * 90_000  # a double takes 8


def wide(spark):
    rng = random.Random(7)
    data = [(d, rng.choice([None, float("nan"), *[float(v) for v in range(30)]]) if k % 3 else 5.0) for k, d in enumerate(["x"] * 900 + ["y"] * 40 + [None] * 30 + ["z"])]
    return spark.createDataFrame(data, "date string, v double").withColumn("id", F.monotonically_increasing_id())


def test_wide_ranks_equal_average_ranks(spark):
    d = wide(spark)
    got = {r.id: r.rank for r in wide_ranks(d, ["date"], "v").collect()}
    assert len(got) == d.count()
    pdf = d.toPandas()
    pdf["want"] = pdf.assign(date=pdf.date.fillna("null")).groupby("date").v.rank()
    for r in pdf.itertuples():
        assert (got[r.id] is None and np.isnan(r.want)) or got[r.id] == r.want


def test_wide_quantiles_equal_percentile(spark):
    d, ps = wide(spark), [0.0, 0.01, 0.333, 0.5, 0.99, 1.0]
    want = d.filter("v is not null and not isnan(v)").groupBy("date").agg(*[F.percentile("v", p).alias(f"q{k}") for k, p in enumerate(ps)])
    assert rows_of(wide_quantiles(d, ["date"], "v", ps)) == rows_of(want)
    with pytest.raises(ValueError):
        wide_quantiles(d, ["date"], "v", [1.5])
    assert wide_quantiles(d.limit(0), ["date"], "v", ps).count() == 0


def test_a_wide_date_is_many_ranges(spark):
    d = spark.range(200_000).select(F.lit("x").alias("date"), F.rand(3).alias("v"))
    groups = ordered_groups(d, ["date"], "v")
    assert groups.agg(F.max(F.col("below") + F.col("n"))).first()[0] == 200_000
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # the table is small enough to be one partition again
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        parts = d.repartitionByRange("date", "v").groupBy(F.spark_partition_id()).count().agg(F.count("*"), F.max("count")).first()
    finally:
        spark.conf.set(name, before)
    assert parts[0] >= 4 and parts[1] < 100_000
