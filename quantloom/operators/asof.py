"""As-of joins as a union and a window: linear in the rows, no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of_few(left: DataFrame, right: DataFrame, left_time: str, right_time: str, days: int = 31) -> DataFrame:
    """as_of without keys, for a right side of a row a time (regimes: a few hundred a year).

    The right rows go by buckets of ``days``, each bucket's with the last row before it; a left row looks
    its bucket up by an equal key, at most one row, and takes the last of these that is not later.
    """
    gain = right.columns
    bucket = lambda c: F.floor(F.unix_date(F.col(c).cast("date")) / days).cast("int")
    r = right.filter(F.col(right_time).isNotNull()).select(F.struct(F.col(right_time).alias("_t"), *[F.col(c).alias(f"_r_{c}") for c in gain]).alias("_x"), bucket(right_time).alias("_b"))
    ends = r.agg(F.min("_b"), F.max("_b")).first()
    if ends[0] is None:
        return left.select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c if c not in left.columns else f"{c}_right") for c in gain])
    every = left.sparkSession.range(ends[0], ends[1] + 1).select(F.col("id").cast("int").alias("_b"))
    held = every.join(r.groupBy("_b").agg(F.array_sort(F.collect_list("_x")).alias("_xs")), "_b", "left")
    before = F.last(F.element_at("_xs", -1), ignorenulls=True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))  # a row a bucket
    held = held.select("_b", F.array_compact(F.concat(F.array(before), F.coalesce("_xs", F.array().cast(dict(held.dtypes)["_xs"])))).alias("_xs"))
    out = left.withColumn("_b", F.least(bucket(left_time), F.lit(ends[1]))).join(held, "_b", "left")
    out = out.withColumn("_x", F.try_element_at(F.filter("_xs", lambda x: x["_t"] <= F.col(left_time)), F.lit(-1)))
    return out.select(*left.columns, *[F.col(f"_x._r_{c}").alias(c if c not in left.columns else f"{c}_right") for c in gain])


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, ties: list[str] = ()) -> DataFrame:
    """Each left row with the latest right row of its keys at or before its time.

    Rows of a key sort by (time, right before left); the last right row so far is carried on.  Of
    right rows at one time the one with the largest ``ties`` is taken.  Unmatched rows get NULLs.
    """
    gain = [c for c in right.columns if c not in keys]
    body = F.struct(*[F.col(c) for c in gain])
    facts = right.filter(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*[F.col(c) for c in ties], F.lit(0)).alias("_tie"), body.alias("_fact"))
    asks = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"))
    both = facts.unionByName(asks, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_hit", F.last("_fact", ignorenulls=True).over(w)).filter("_side = 1")
    return found.select("_row.*", *[F.col(f"_hit.{c}").alias(c if c not in left.columns else f"{c}_right") for c in gain])
