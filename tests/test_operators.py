import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from quantloom.functions import columns as C
from quantloom.operators import backtest, crosssection, evaluate, markets
from quantloom.operators.asof import as_of
from quantloom.operators.factors import PRICE, price_factors
from quantloom.sources import panel


def days(n, start=dt.date(2024, 1, 1)):
    return [start + dt.timedelta(days=k) for k in range(n)]


def bars(spark, n=140, shock_from=None):
    rows = []
    for i, s in enumerate(["AAA", "BBB", "CCC"]):
        for k, day in enumerate(days(n)):
            c = (40 + 25 * i) * math.exp(0.001 * (i - 1) * k) * (1 + 0.03 * math.sin(k / (4.0 + i)) + 0.004 * math.cos(1.7 * k + i))
            if shock_from is not None and k >= shock_from:
                c *= 3
            rows.append((s, day, float(c)))
    return spark.createDataFrame(rows, "symbol string, date date, close double")


@pytest.mark.parametrize("name", [f.name for f in PRICE])
def test_no_lookahead(spark, name):
    cut = days(140)[125]
    past = lambda b: {(r.symbol, r.date): r[name] for r in price_factors(b, [name]).filter(F.col("date") < cut).collect()}
    assert past(bars(spark)) == past(bars(spark, shock_from=125))


def test_momentum_values(spark):
    b = bars(spark)
    got = {(r.symbol, r.date): r.momentum_20d for r in price_factors(b, ["momentum_20d"]).collect()}
    close = {(r.symbol, r.date): r.close for r in b.collect()}
    d = days(140)
    assert got["AAA", d[19]] is None
    assert math.isclose(got["AAA", d[50]], close["AAA", d[50]] / close["AAA", d[30]] - 1, rel_tol=1e-12)


def test_flat_price_has_no_volatility(spark):
    b = spark.createDataFrame([("A", d, 100.0) for d in days(90)], "symbol string, date date, close double")
    r = price_factors(b, ["volatility_20d", "risk_adjusted_momentum", "quality_price_proxy"]).agg(F.count("volatility_20d"), F.count("risk_adjusted_momentum"), F.count("quality_price_proxy")).first()
    assert tuple(r) == (0, 0, 0)


def test_correlation_guards(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0), ("c", 1.0, 2.0), ("c", 2.0, 4.0)], "k string, x double, y double")
    got = {r.k: r.c for r in d.groupBy("k").agg(C.correlation("x", "y").alias("c")).collect()}
    assert got["a"] is None and got["b"] is None and math.isclose(got["c"], 1.0)


def test_average_rank_ties(spark):
    d = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0)], "k int, v double")
    assert sorted(r.r for r in d.withColumn("r", C.average_rank("v", "k")).collect()) == [1.0, 2.5, 2.5]


def test_quantile_single_row(spark):
    d = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0, 0.1)], "symbol string, signal_date date, value double, future_return double")
    assert backtest.assign_quantiles(d, 5).first()["quantile"] == 1


def test_half_even_quantiles(spark):
    d = spark.createDataFrame([(f"S{i}", dt.date(2024, 1, 1), float(i), 0.0) for i in range(5)], "symbol string, signal_date date, value double, future_return double")
    assert [r["quantile"] for r in backtest.assign_quantiles(d, 3).orderBy("value").collect()] == [1, 1, 2, 3, 3]


def test_asof_same_day_and_ties(spark):
    left = spark.createDataFrame([("A", dt.date(2024, 1, 10)), ("A", dt.date(2024, 1, 1)), ("B", dt.date(2024, 1, 10))], "symbol string, date date")
    right = spark.createDataFrame([("A", dt.date(2024, 1, 10), 1, 5.0), ("A", dt.date(2024, 1, 10), 2, 6.0), ("A", dt.date(2024, 1, 11), 9, 7.0)], "symbol string, report_date date, period int, x double")
    got = {(r.symbol, r.date): r.x for r in as_of(left, right, ["symbol"], "date", "report_date", ["period"]).collect()}
    assert got == {("A", dt.date(2024, 1, 10)): 6.0, ("A", dt.date(2024, 1, 1)): None, ("B", dt.date(2024, 1, 10)): None}


def test_turnover_equals_union_rule(spark):
    d = days(3)
    rows = [(d[0], "A", 1.0), (d[0], "B", 2.0), (d[1], "B", 1.0), (d[1], "C", 2.0), (d[2], "B", 1.0), (d[2], "C", 2.0)]
    a = backtest.assign_quantiles(spark.createDataFrame([(s, t, v, 0.0) for t, s, v in rows], "symbol string, signal_date date, value double, future_return double"), 2)
    got = [r.turnover for r in backtest.turnover(a, 2).orderBy("signal_date").collect()]
    # weights: (A -1, B +1) then (B -1, C +1): half of 1 + 2 + 1
    assert got == [None, 2.0, 0.0]


def test_pipeline_constant_and_single(spark):
    d = spark.createDataFrame([("A", 1, 5.0, None), ("B", 1, 5.0, None), ("C", 2, 1.0, "x"), ("D", 2, None, "x")], "symbol string, date int, v double, sector string")
    got = crosssection.pipeline(d, "v").collect()
    assert {r.symbol: r.zscore for r in got} == {"A": 0.0, "B": 0.0, "C": 0.0}
    assert {r.sector for r in got} == {"Unknown", "x"}


def test_mean_available_and_clip(spark):
    d = spark.createDataFrame([(1.0, None, 3.0), (1.0, None, None)], "a double, b double, c double")
    got = d.select(C.mean_available([F.col(x) for x in "abc"], 2).alias("m"), C.clip(F.col("c"), -1.0, 2.0).alias("k")).collect()
    assert [tuple(r) for r in got] == [(2.0, 2.0), (None, None)]


def test_upsert_and_restated(spark):
    old = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 2.0)], "symbol string, date int, close double")
    new = spark.createDataFrame([("A", 2, 9.0), ("A", 3, 3.0)], "symbol string, date int, close double")
    assert sorted(map(tuple, panel.upsert(old, new, ["symbol", "date"]).collect())) == [("A", 1, 1.0), ("A", 2, 9.0), ("A", 3, 3.0)]
    o = spark.createDataFrame([("A", dt.date(2024, 1, 2))], "symbol string, report_date date")
    n = spark.createDataFrame([("A", dt.date(2024, 1, 1)), ("B", None)], "symbol string, report_date date")
    assert {r.symbol: r.action for r in panel.upsert_restated(o, n, ["symbol"]).collect()} == {"A": "skipped", "B": "inserted"}
    assert {r.symbol: r.action for r in panel.upsert_restated(o, n, ["symbol"], force=True).collect()} == {"A": "updated", "B": "inserted"}


def test_normalise(spark):
    d = spark.createDataFrame([(" spy ", "2024-01-02", "1", "2", "0.5", "1.5", None), ("spy", "bad", "1", "1", "1", "1", "3"), ("qqq", "2024-01-02", "x", "1", "1", "1", "1")], "symbol string, date string, open string, high string, low string, Close string, volume string")
    got = panel.normalise(d, {"Close": "close"}).collect()
    assert len(got) == 1 and got[0].symbol == "SPY" and got[0].adj_close == 1.5 and got[0].volume == 0


def test_windows_purge_and_embargo():
    for f in markets.windows(dt.date(2020, 1, 1), dt.date(2023, 12, 31), 365, 90, 10, 5):
        _, a, b, c, e = f
        assert a <= b < c <= e <= dt.date(2023, 12, 31) and (c - b).days >= 16


def test_drawdown_peak_is_at_least_one(spark):
    d = spark.createDataFrame([(dt.date(2024, 1, 1), -0.1), (dt.date(2024, 1, 2), 0.05)], "date date, ret double")
    assert math.isclose(markets.drawdowns(d).agg(F.min("drawdown")).first()[0], -0.1)


def test_sma_fold_keeps_cash(spark):
    rows = [("A", d, 10.0, None) for d in days(3)] + [("A", days(5)[3], 10.0, "BUY"), ("A", days(5)[4], 20.0, "SELL")]
    r = markets.sma_backtest(spark.createDataFrame(rows, "symbol string, date date, close double, side string"), 105.0).first()
    assert r.final_value == 205.0 and r.position == 0 and r.trades == 2


def test_decay_half_life(spark):
    d = spark.createDataFrame([(1, 0.5), (2, 0.25), (3, 0.125)], "horizon int, m double")
    assert evaluate.half_life(d, "m", True).first()["half_life"] == 1.0
    assert evaluate.half_life(d.limit(2), "m", True).first()["half_life"] is None


def test_scores_of_missing_and_extreme_values(spark):
    from quantloom.operators import scores

    c = F.col
    d = spark.createDataFrame([(1, None, None, None), (2, 0.5, None, None), (3, 3.0, -8.0, -2.0), (4, -0.1, 1.0, -0.25)], "k int, a double, b double, d double")
    quality = {r.k: r.q for r in d.select("k", scores.return_quality(c("a"), c("b"), c("d")).alias("q")).collect()}
    assert quality[1] is None and abs(quality[3] - 2 / 3) < 1e-12 and abs(quality[4] - 1.25 / 3) < 1e-12
    grades = [r.g for r in d.orderBy("k").select(scores.grade(c("a"), F.lit(0.5)).alias("g")).collect()]
    assert grades == ["insufficient_evidence", "weak_or_inconclusive", "candidate", "weak_or_inconclusive"]
    assert d.filter("k = 3").select(scores.grade(c("a"), F.lit(0.1))).first()[0] == "blocked_by_coverage"
    one = d.groupBy("k").agg(scores.consistency("a").alias("s")).collect()
    assert {r.k: r.s for r in one} == {1: None, 2: 0.5, 3: 0.5, 4: 0.5}
    none = F.lit(None).cast("double")
    assert d.filter("k = 1").select(scores.warnings(F.lit(40), none, none, none, none, none, none, none)).first()[0] == []


def test_fill_batches_keep_all_shares(spark):
    from quantloom.operators import scores

    o = spark.createDataFrame([(1, 10), (2, 0), (3, 3)], "id int, shares long")
    got = scores.fill_batches(o, 4, 0.5).collect()
    assert [r.fill for r in sorted(got, key=lambda r: r.batch) if r.id == 1 and r.mode == "twap"] == [3, 3, 2, 2]
    for i, n in ((1, 10), (2, 0), (3, 3)):
        assert sum(r.fill for r in got if r.id == i and r.mode == "twap") == n
    assert {r.fill for r in got if r.mode == "partial_fill"} == {5, 0, 1}
