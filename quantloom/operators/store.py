"""History tables of factors and regimes: latest rows, health ranks, regime statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import div
from .markets import health_score
from .scores import consistency

#: Samples from which a regime's figures count in full.
ENOUGH = 30


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a history table; earlier ones stay."""
    rows.write.mode("append").parquet(path)


def missing_keys(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the store has not: what a resumed run still has to compute."""
    return rows.join(stored.select(*keys).distinct(), keys, "left_anti")


def latest(history: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, by the columns of ``order``."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return history.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def factor_history(history: DataFrame, limit: int, factor: str | None = None) -> DataFrame:
    """The last rows of one factor (any case), or of all."""
    d = history if factor is None else history.filter(F.lower("factor_name") == factor.strip().lower())
    return d.orderBy(F.desc("evaluation_date"), F.desc("id")).limit(limit)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in sorted(tables.items())])


def rank_factors(definitions: DataFrame, evaluations: DataFrame, backtests: DataFrame, stabilities: DataFrame) -> DataFrame:
    """Each defined factor with its latest rows, its health and its places; factors without any row have none.

    Of equal healths the later name comes first at the top, the earlier one at the bottom.
    """
    e = latest(evaluations, "factor_name", ["evaluation_date", "id"]).select("factor_name", "ic", "rank_ic", "icir", F.col("coverage").alias("e_cover"), F.lit(1).alias("has_eval"))
    b = latest(backtests, "factor_name", ["evaluation_date", "id"]).select("factor_name", "long_short_return", "sharpe", "drawdown", "turnover", F.col("coverage").alias("b_cover"), F.lit(1).alias("has_backtest"))
    s = latest(stabilities, "factor_name", ["evaluation_date", "id"]).select("factor_name", "stability_score", "confidence_score", F.lit(1).alias("has_stability"))
    d = definitions
    for side in (e, b, s):  # a row a factor
        d = d.join(F.broadcast(side), "factor_name", "left")
    zero = lambda *cs: F.coalesce(*[F.col(c) for c in cs], F.lit(0.0))
    d = d.select(*definitions.columns, *[zero(c).alias(c) for c in ("ic", "rank_ic", "icir", "stability_score", "confidence_score", "long_short_return", "sharpe", "turnover")], zero("e_cover", "b_cover").alias("coverage"), "drawdown", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("has_eval", "has_backtest", "has_stability")])
    tested = (F.col("has_eval") + F.col("has_backtest") + F.col("has_stability")) > 0
    d = d.withColumn("health", F.when(tested, health_score(F.col("icir"), F.col("coverage"), F.col("stability_score"), F.col("drawdown"))))
    place = lambda *order: F.when(tested, F.row_number().over(Window.partitionBy(tested).orderBy(*order)))
    name = F.col("factor_name")
    return d.withColumn("top", place(F.desc("health"), name.desc())).withColumn("bottom", place(F.col("health"), name)).withColumn("most_stable", place(F.desc("stability_score"), name.desc()))


def support(samples: Column) -> Column:
    return F.bround(F.least(F.greatest(F.coalesce(samples, F.lit(0)) / float(ENOUGH), F.lit(0.0)), F.lit(1.0)), 6)


def evaluation_by_regime(ic: DataFrame, by: list[str]) -> DataFrame:
    """Daily (by, regime, ic, rank_ic, n) -> a row a regime with at least two usable dates."""
    std = F.stddev_samp("rank_ic")
    g = ic.groupBy(*by, "regime").agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), F.when(std > 0, F.try_divide(F.avg("rank_ic"), std)).alias("icir"), consistency("rank_ic").alias("steady"), F.count("rank_ic").alias("sample_days"), F.sum("n").alias("samples"))
    share = F.try_divide("samples", F.sum("samples").over(Window.partitionBy(*by)))
    steady = F.when(F.col("sample_days") >= 3, F.bround(F.bround("steady", 6) * support(F.col("samples")), 6))
    return g.withColumn("share", share).withColumn("stability", steady).drop("steady").filter("sample_days >= 2")


def backtest_by_regime(periods: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, regime, long_short_return) -> mean, ratio, share and steadiness of the spread a regime."""
    x = F.col("long_short_return")
    std = F.stddev_samp(x)
    g = periods.groupBy(*by, "regime").agg(F.avg(x).alias("mean_spread_return"), F.when(std > 0, F.try_divide(F.avg(x), std)).alias("return_ir"), F.when(F.count(x) >= 3, F.bround(consistency("long_short_return"), 6)).alias("stability"), F.count(x).alias("samples"), F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return g.withColumn("share", F.try_divide("samples", total)).filter("samples > 0").drop("n")


def regime_rank(history: DataFrame) -> DataFrame:
    """Rows a factor, regime and run -> sample-weighted means, health times support, places in the regime."""
    w = F.coalesce("samples", F.lit(1))
    mean = lambda c: div(F.sum(F.col(c) * w), F.sum(w)).alias(c)
    g = history.groupBy("factor_name", "regime").agg(mean("ic"), mean("rank_ic"), mean("icir"), F.avg("share").alias("share"), F.avg("stability").alias("stability"), F.sum(F.coalesce("sample_days", "samples")).alias("days"), F.count("*").alias("history_rows"))
    g = g.withColumn("support", support(F.col("days")))
    raw = F.bround(health_score(F.col("icir"), F.col("share"), F.col("stability"), F.lit(None).cast("double")) * F.col("support"), 6)
    g = g.withColumn("raw_health", raw).withColumn("health", F.bround(F.col("raw_health") * F.col("support"), 6))
    place = lambda *order: F.row_number().over(Window.partitionBy("regime").orderBy(*order))
    return g.withColumn("best", place(F.desc("raw_health"), F.desc("factor_name"))).withColumn("worst", place("raw_health", "factor_name"))


def regime_warnings(counts: DataFrame) -> DataFrame:
    """(regime, n) -> (code, regime, n): regimes with few samples, and too many dates without one."""
    total, name = F.sum("n").over(Window.partitionBy()), F.col("regime")  # a row a regime
    few = (name != "UNKNOWN") & (F.col("n") > 0) & (F.col("n") < ENOUGH)
    code = F.when(few, "WARN_LOW_REGIME_SAMPLE").when((name == "UNKNOWN") & (F.col("n") / total > 0.2), "WARN_HIGH_UNKNOWN_REGIME_RATIO")
    return counts.withColumn("code", code).filter("code is not null").select("code", "regime", "n")


def warning_counts(warnings: DataFrame, text: str) -> DataFrame:
    """How often each code is: the part of a warning before its first colon."""
    return warnings.groupBy(F.trim(F.split_part(F.col(text), F.lit(":"), F.lit(1))).alias("code")).agg(F.count("*").alias("n"))


def mean_nested(rows: DataFrame, column: str) -> DataFrame:
    """Mean of each key of a map column."""
    return rows.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.avg("value").alias("mean"))
