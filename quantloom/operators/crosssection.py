"""Cross-sectional transforms: pipeline, combination, scoring, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import average_rank, clip, div


def pipeline(d: DataFrame, value: str, date: str = "date", sector: str = "sector", low: float = 0.05, high: float = 0.95, sign: int = 1, fill: float | None = None) -> DataFrame:
    """Missing dropped (or filled), winsorised, z-scored, made neutral by sector, rank-normalised, directed: per date."""
    w = Window.partitionBy(date)
    d = d.withColumn("filled", F.col(value) if fill is None else F.coalesce(value, F.lit(float(fill)))).filter("filled is not null")
    d = d.withColumn("winsorized", F.least(F.greatest(F.col("filled"), F.percentile("filled", F.lit(low)).over(w)), F.percentile("filled", F.lit(high)).over(w)))
    std = F.stddev_samp("winsorized").over(w)
    d = d.withColumn("zscore", F.coalesce(F.when(std > 0, F.try_divide(F.col("winsorized") - F.avg("winsorized").over(w), std)), F.lit(0.0)))
    d = d.withColumn("sector", F.coalesce(F.col(sector), F.lit("Unknown")))
    d = d.withColumn("neutral", F.col("zscore") - F.avg("zscore").over(Window.partitionBy(date, "sector")))
    n = F.count("*").over(w)
    return d.withColumn("score", F.when(n <= 1, 0.0).otherwise((average_rank("neutral", date) / n - 0.5) * 2) * sign)


def summary_columns(value: str, prefix: str) -> list:
    """Count, missing, mean, deviation and range of a column, as aggregates."""
    c = F.col(value)
    return [F.count(c).alias(f"{prefix}_count"), F.count_if(c.isNull()).alias(f"{prefix}_missing"), F.avg(c).alias(f"{prefix}_mean"), F.stddev_samp(c).alias(f"{prefix}_std"), F.min(c).alias(f"{prefix}_min"), F.max(c).alias(f"{prefix}_max")]


def combine_rank(d: DataFrame, value: str, date: str = "date", higher: bool = True) -> DataFrame:
    """(average rank - 1) / (n - 1); constant or single: 0.5."""
    w = Window.partitionBy(date)
    n, lo, hi = F.count(value).over(w), F.min(value).over(w), F.max(value).over(w)
    s = F.when((n <= 1) | (lo == hi), 0.5).otherwise(div(average_rank(value, date) - 1, n - 1))
    return d.filter(F.col(value).isNotNull()).withColumn("score", s if higher else 1 - s)


def combine_z(d: DataFrame, value: str, date: str = "date", higher: bool = True) -> DataFrame:
    """Population z-score; constant or single: 0.5."""
    w = Window.partitionBy(date)
    std = F.stddev_pop(value).over(w)
    s = F.when((F.count(value).over(w) <= 1) | ~(std > 0), 0.5).otherwise(F.try_divide(F.col(value) - F.avg(value).over(w), std) * (1 if higher else -1))
    return d.filter(F.col(value).isNotNull()).withColumn("score", s)


def composite(d: DataFrame, weights: dict[str, float], lower: set[str] = frozenset(), date: str = "date") -> DataFrame:
    """Weighted sum of direction-aware rank scores: 1 best, 0 worst; constant or single: 1."""
    w = Window.partitionBy(date)
    total = F.lit(0.0)
    for name, weight in weights.items():
        d = d.withColumn("_v", -F.col(name) if name in lower else F.col(name))
        n = F.count("_v").over(w)
        rank = F.rank().over(w.orderBy(F.col("_v").desc_nulls_last())) + (F.count("*").over(Window.partitionBy(date, "_v")) - 1) / 2.0
        s = F.when(F.col("_v").isNull(), None).when((n <= 1) | (F.min("_v").over(w) == F.max("_v").over(w)), 1.0).otherwise(1 - div(rank - 1, n - 1))
        d = d.withColumn(f"score_{name}", s)
        total = total + F.coalesce(F.col(f"score_{name}"), F.lit(0.0)) * weight
    return d.drop("_v").withColumn("composite", total)


def target_weights(d: DataFrame, score: str, top: int, cap: float, cash: float = 0.0, date: str = "date") -> DataFrame:
    """The best ``top`` by score (ties by symbol), weighted by positive score, capped; the rest is cash."""
    w = Window.partitionBy(date)
    d = d.filter(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(w.orderBy(F.col(score).desc(), "symbol"))).filter(F.col("rank") <= top)
    pos = F.greatest(F.col(score), F.lit(0.0))
    return d.withColumn("weight", F.bround(F.least(F.coalesce(div(pos, F.sum(pos).over(w)) * (1 - cash), F.lit(0.0)), F.lit(cap)), 6))


def equal_weights(d: DataFrame, date: str = "date", cash: float = 0.0) -> DataFrame:
    return d.withColumn("weight", F.lit(1 - cash) / F.count("*").over(Window.partitionBy(date)))


__all__ = ["clip", "combine_rank", "combine_z", "composite", "equal_weights", "pipeline", "summary_columns", "target_weights"]
