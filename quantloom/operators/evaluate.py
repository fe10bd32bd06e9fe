"""Observations, information coefficients, quantiles, decay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import average_rank, correlation, div
from .factors import by_symbol


def observations(values: DataFrame, factor: str, horizons: list[int], sign: int = 1) -> DataFrame:
    """(symbol, date, close, <factor>) -> a row a horizon with the forward return; labels look h rows on."""
    legs = []
    for h in horizons:
        ahead = F.lead("close", h).over(by_symbol())
        ok = (ahead > 0) & (F.col("close") > 0)
        legs.append(F.struct(F.lit(h).alias("horizon"), F.lead("date", h).over(by_symbol()).alias("future_date"), F.when(ok, ahead / F.col("close") - 1).alias("future_return")))
    d = values.select("symbol", F.col("date").alias("signal_date"), (F.col(factor) * sign).alias("value"), F.array(*legs).alias("legs"))
    return d.select("symbol", "signal_date", "value", F.explode("legs").alias("leg")).select("symbol", "signal_date", "value", "leg.*").filter("value is not null and future_return is not null")


def daily_ic(obs: DataFrame, by: list[str] = ("horizon",)) -> DataFrame:
    """Per date: Pearson and rank correlation of value and forward return, with the rows behind them."""
    keys = [*by, "signal_date"]
    r = obs.withColumn("rv", average_rank("value", *keys)).withColumn("rr", average_rank("future_return", *keys))
    return r.groupBy(*keys).agg(correlation("value", "future_return").alias("ic"), correlation("rv", "rr").alias("rank_ic"), F.count("*").alias("n"))


def ic_summary(ic: DataFrame, by: list[str] = ("horizon",)) -> DataFrame:
    def of(c, name):
        std = F.stddev_samp(c)
        return [F.avg(c).alias(f"{name}_mean"), std.alias(f"{name}_std"), F.when(std > 0, F.try_divide(F.avg(c), std)).alias(f"{name}_ir"), F.avg((F.bround(c, 12) > 0).cast("double")).alias(f"{name}_positive_rate")]

    return ic.groupBy(*by).agg(*of("ic", "ic"), *of("rank_ic", "rank_ic"), F.count("ic").alias("n_dates"))


def quintiles(obs: DataFrame, buckets: int = 5) -> DataFrame:
    """Date-weighted bucket means: ranks in (date, symbol) order of ties, ceil(rank / n * buckets)."""
    w = Window.partitionBy("signal_date")
    rank = F.row_number().over(w.orderBy("value", "symbol"))
    b = F.ceil(rank * F.lit(float(buckets)) / F.count("*").over(w)).cast("int")
    daily = obs.withColumn("bucket", b).groupBy("signal_date", "bucket").agg(F.avg("future_return").alias("r"))
    return daily.groupBy("bucket").agg(F.avg("r").alias("mean_return"), F.count("*").alias("n_dates"))


def half_life(decay: DataFrame, column: str, same_sign: bool) -> DataFrame:
    """ln 2 / rate of the exponential through |column| by horizon; three points at least."""
    x = F.col(column)
    d = decay.filter(x.isNotNull() & (x != 0)).withColumn("l", F.log(F.abs(x))).withColumn("h", F.col("horizon").cast("double"))
    agg = d.agg(F.regr_slope("l", "h").alias("slope"), F.count("*").alias("n"), F.min(F.signum(x)).alias("lo"), F.max(F.signum(x)).alias("hi"))
    ok = (F.col("n") >= 3) & (F.col("slope") < 0)
    if same_sign:
        ok = ok & (F.col("lo") == F.col("hi"))
    return agg.select(F.when(ok, F.bround(div(F.log(F.lit(2.0)), -F.col("slope")), 1)).alias("half_life"), F.col("n").alias("points"))
