"""Ranks and quantiles of groups too large for one task: a date with very many symbols.

A window by date, or a percentile's buffer, puts a date into one task.  Here equal values are counted
first (partly in each task), the counts are dealt by ranges of (keys, value) and summed within the ranges,
and a small table of a row a range and key tells what lies before.  Ranks are exact, ties averaged;
quantiles are exact, interpolated as ``percentile`` does.  NULL and NaN values take no part in either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept


def ordered_groups(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, <value>, n, below, total): each value of a key with its rows, the key's rows below it, and all; written."""
    x = F.col(value)
    counts = rows.filter(x.isNotNull() & ~F.isnan(x.cast("double"))).groupBy(*keys, value).agg(F.count("*").alias("n"))
    # dealt once and written: what a range holds must be the same for both uses
    dealt = counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id())
    running = F.sum("n").over(Window.partitionBy("_part", *keys).orderBy(value))
    placed = kept(dealt.withColumn("_upto", running), "wide-values")
    ranges = placed.groupBy(*keys, "_part").agg(F.sum("n").alias("_n"))
    w = Window.partitionBy(*keys)  # a row a range
    starts = ranges.withColumn("_start", F.sum("_n").over(w.orderBy("_part")) - F.col("_n")).withColumn("total", F.sum("_n").over(w))
    starts = starts.select(*[F.col(c).alias(f"_s_{c}") for c in (*keys, "_part")], "_start", "total")
    same = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in (*keys, "_part")]
    out = placed.join(starts, same).select(*keys, value, "n", (F.col("_start") + F.col("_upto") - F.col("n")).alias("below"), "total")
    return kept(out, "wide-groups")


def wide_ranks(rows: DataFrame, keys: list[str], value: str, out: str = "rank") -> DataFrame:
    """Rows with the rank of ``value`` within keys, from 1, ties averaged; NULL where the value is none."""
    groups = ordered_groups(rows, keys, value).select(*[F.col(c).alias(f"_k_{c}") for c in keys], F.col(value).alias("_v"), (F.col("below") + (F.col("n") + 1) / 2.0).alias(out))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys] + [F.col(value) == F.col("_v")]
    return rows.join(groups, same, "left").select(*rows.columns, out)


def wide_quantiles(rows: DataFrame, keys: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """(keys, q0, q1, ...): the quantiles of each key, linear between neighbours."""
    if not all(0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities are 0 to 1")
    groups = ordered_groups(rows, keys, value)
    ends = []
    for p in probabilities:
        at = (F.col("total") - 1) * F.lit(float(p))
        holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
        ends += [F.max(F.when(holds(F.floor(at)), F.col(value))), F.max(F.when(holds(F.ceil(at)), F.col(value))), F.max(at - F.floor(at))]
    got = groups.groupBy(*keys).agg(*[e.alias(f"_{k}") for k, e in enumerate(ends)])
    between = lambda k: F.col(f"_{3 * k}") * (1 - F.col(f"_{3 * k + 2}")) + F.col(f"_{3 * k + 1}") * F.col(f"_{3 * k + 2}")
    return got.select(*keys, *[between(k).alias(f"q{k}") for k in range(len(probabilities))])
