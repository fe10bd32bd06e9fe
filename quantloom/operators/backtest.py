"""Quantile long-short backtest over overlapping periods; spreads are additive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import quantile_even


def assign_quantiles(obs: DataFrame, q: int, by: list[str] = ()) -> DataFrame:
    """Evenly spaced quantiles a date; ``by`` names what runs side by side (factors, universes)."""
    w = Window.partitionBy(*by, "signal_date")
    rank0 = F.row_number().over(w.orderBy("value", "symbol")) - 1
    return obs.withColumn("quantile", quantile_even(rank0, F.count("*").over(w), q))


def periods(assigned: DataFrame, q: int, by: list[str] = ()) -> DataFrame:
    """A row a signal date: leg returns and their spread."""
    leg = lambda k: F.avg(F.when(F.col("quantile") == k, F.col("future_return")))
    n = lambda k: F.count_if(F.col("quantile") == k)
    out = assigned.groupBy(*by, "signal_date").agg(leg(q).alias("long_return"), leg(1).alias("short_return"), n(q).alias("n_long"), n(1).alias("n_short"), F.max("future_date").alias("future_date"))
    return out.withColumn("long_short_return", F.col("long_return") - F.col("short_return"))


def turnover(assigned: DataFrame, q: int, by: list[str] = ()) -> DataFrame:
    """Half the sum of weight changes between neighbouring periods, without a loop: each weight is
    entered with plus in its own period and with minus in the next."""
    d = assigned.withColumn("side", F.when(F.col("quantile") == q, 1).when(F.col("quantile") == 1, -1))
    d = d.filter("side is not null").withColumn("w", F.col("side") / F.count("*").over(Window.partitionBy(*by, "signal_date", "side")))
    dates = assigned.select(*by, "signal_date").distinct().withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("signal_date")))
    d = d.join(dates, [*by, "signal_date"]).select(*by, "symbol", "w", "k")
    moves = d.select(*by, "symbol", F.explode(F.array(F.struct(F.col("k").alias("k"), F.col("w").alias("w")), F.struct((F.col("k") + 1).alias("k"), (-F.col("w")).alias("w")))).alias("m")).select(*by, "symbol", "m.*")
    change = moves.groupBy(*by, "k", "symbol").agg(F.sum("w").alias("d")).groupBy(*by, "k").agg((F.sum(F.abs("d")) * 0.5).alias("turnover"))
    return dates.join(change, [*by, "k"], "left").select(*by, "signal_date", F.when(F.col("k") > 1, F.coalesce("turnover", F.lit(0.0))).alias("turnover"))


def legs(assigned: DataFrame, q: int, by: list[str] = ()) -> DataFrame:
    """A row a signal date with all a report holds of the period: symbols and weights of both legs, exposures,
    the mean return of each quantile, leg returns and turnover.

    Weights are even, negative in the short leg.  Lists and maps are as long as the legs, by what a report is;
    where those are not wanted, ``periods`` carries counts alone.  An empty quantile has a NULL mean.
    """
    side = lambda k: F.array_sort(F.collect_list(F.when(F.col("quantile") == k, F.col("symbol"))))
    means = F.map_from_arrays(F.array(*[F.lit(f"q{k}") for k in range(1, q + 1)]), F.array(*[F.avg(F.when(F.col("quantile") == k, F.col("future_return"))) for k in range(1, q + 1)]))
    d = assigned.groupBy(*by, "signal_date").agg(F.max("future_date").alias("future_date"), side(q).alias("long_symbols"), side(1).alias("short_symbols"), means.alias("quantile_returns"))
    even = lambda c, sign: F.map_from_arrays(c, F.transform(c, lambda _: F.lit(float(sign)) / F.size(c)))
    d = d.withColumn("long_weights", even("long_symbols", 1)).withColumn("short_weights", even("short_symbols", -1))
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0.0), lambda a, w: a + w)
    d = d.withColumn("long_weight_sum", total("long_weights")).withColumn("short_weight_sum", total("short_weights"))
    d = d.withColumn("net_exposure", F.col("long_weight_sum") + F.col("short_weight_sum")).withColumn("gross_exposure", F.col("long_weight_sum") - F.col("short_weight_sum"))
    d = d.withColumn("long_return", F.col("quantile_returns")[f"q{q}"]).withColumn("short_return", F.col("quantile_returns")["q1"])
    d = d.withColumn("long_short_return", F.col("long_return") - F.col("short_return"))
    return d.join(turnover(assigned, q, by), [*by, "signal_date"])


def summary(per: DataFrame, horizon: int, by: list[str] = ()) -> DataFrame:
    """Of complete periods: mean, median, sum, hit rate, volatility, Sharpe-like, additive drawdown."""
    d = per.filter("long_short_return is not null")
    w = Window.partitionBy(*by).orderBy("signal_date").rowsBetween(Window.unboundedPreceding, 0)  # a row a date
    d = d.withColumn("cum", F.sum("long_short_return").over(w)).withColumn("fall", F.col("cum") - F.max("cum").over(w))
    x, std = F.col("long_short_return"), F.stddev_samp("long_short_return")
    return d.groupBy(*by).agg(F.count("*").alias("n_periods"), F.avg(x).alias("mean_spread"), F.median(x).alias("median_spread"), F.sum(x).alias("cumulative_spread"), F.avg((x > 0).cast("double")).alias("hit_rate"), (std * F.sqrt(F.lit(252.0))).alias("volatility"), F.when(std > 0, F.try_divide(F.avg(x), std) * F.sqrt(F.lit(252.0))).alias("sharpe"), F.min("fall").alias("max_drawdown"), (F.avg(x) * 252 / horizon).alias("annual_spread"))
