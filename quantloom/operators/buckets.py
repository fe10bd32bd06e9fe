"""Long histories in buckets of time: windows and as-of joins of one symbol in many tasks.

A window by symbol puts a symbol's whole history into one task.  Here the history is cut into buckets of
days, and each bucket also gets the rows around it that its windows reach (a halo, counted in rows,
so it holds however sparse a symbol is).  What is carried forward without end, as the last known
statement is, goes from bucket to bucket in a table of a row a bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .factors import PRICE, REGISTRY, price_factors

#: Days of a bucket; a bucket should hold many times the rows of a halo.
DAYS = 1461


def bucket_of(time: str, days: int):
    return F.floor(F.unix_date(F.col(time).cast("date")) / days).cast("int")


def with_halo(rows: DataFrame, before: int, after: int = 0, time: str = "date", days: int = DAYS) -> DataFrame:
    """Rows (symbol, <time>, ...) with ``bucket``: each in its own bucket and in those that lie within reach.

    A bucket gets the ``before`` rows of the symbol ahead of its first row and the ``after`` ones behind its last.
    Rows without a time take no part.
    """
    d = rows.withColumn("_b", bucket_of(time, days)).filter("_b is not null")
    # a row a symbol and bucket: where it begins and ends, counted in the symbol's rows
    sizes = d.groupBy("symbol", "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("symbol").orderBy("_b")
    sizes = sizes.withColumn("_end", F.sum("_n").over(w)).withColumn("_start", F.col("_end") - F.col("_n"))
    # buckets have a row at least, so no other is further than the halo's rows
    near = F.collect_list(F.struct(F.col("_b").alias("bucket"), F.col("_start").alias("start"), F.col("_end").alias("end"))).over(w.rowsBetween(-after, before))
    sizes = sizes.select("symbol", "_b", "_start", near.alias("_near"))
    place = F.row_number().over(Window.partitionBy("symbol", "_b").orderBy(time)) - 1
    placed = d.withColumn("_k", place).join(sizes, ["symbol", "_b"]).withColumn("_k", F.col("_start") + F.col("_k"))
    reach = F.filter("_near", lambda x: (F.col("_k") >= x.start - before) & (F.col("_k") < x.end + after))
    return placed.select(*rows.columns, F.explode(reach.bucket).alias("bucket"))


def in_buckets(rows: DataFrame, compute: Callable[[DataFrame], DataFrame], before: int, after: int = 0, time: str = "date", days: int = DAYS, out_time: str | None = None) -> DataFrame:
    """``compute`` (a function over windows by symbol) of rows, a task a symbol and bucket.

    It must keep ``symbol`` and a time (``out_time`` if renamed), by which a row's own bucket is told from halos.
    """
    wide = with_halo(rows, before, after, time, days)
    wide = wide.withColumn("symbol", F.struct("symbol", "bucket")).drop("bucket")
    out = compute(wide)
    return out.filter(F.col("symbol.bucket") == bucket_of(out_time or time, days)).withColumn("symbol", F.col("symbol.symbol"))


def price_factors_in_buckets(bars: DataFrame, names: list[str] | None = None, days: int = DAYS) -> DataFrame:
    """``price_factors``, with long histories spread."""
    names = names or [f.name for f in PRICE]
    return in_buckets(bars.select("symbol", "date", "close"), lambda d: price_factors(d, names), max(REGISTRY[n].lookback for n in names), days=days)


def as_of_in_buckets(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, ties: list[str] = (), days: int = DAYS) -> DataFrame:
    """``as_of``, with a key's rows spread over buckets of time.

    Each bucket begins with the last fact of those before it: a fact a bucket, carried over a table of
    buckets.  Left rows without a time find nothing.
    """
    gain = [c for c in right.columns if c not in keys]
    order = F.struct(F.col(right_time).alias("t"), *[F.col(c).alias(f"tie_{c}") for c in ties])
    facts = right.filter(F.col(right_time).isNotNull()).select(*keys, bucket_of(right_time, days).alias("_b"), order.alias("_o"), F.struct(*gain).alias("_fact"))
    asks = left.select(*keys, bucket_of(left_time, days).alias("_b"), F.col(left_time).alias("_t"), F.struct(*left.columns).alias("_row"))
    last = facts.groupBy(*keys, "_b").agg(F.max_by("_fact", "_o").alias("_fact"))
    buckets = last.unionByName(asks.select(*keys, "_b").distinct(), allowMissingColumns=True).groupBy(*keys, "_b").agg(F.max_by("_fact", F.col("_fact").isNotNull()).alias("_fact"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    entering = buckets.select(*keys, "_b", F.last("_fact", ignorenulls=True).over(earlier).alias("_fact")).filter("_fact is not null and _b is not null")
    # in a bucket: what enters, then facts and questions by time, facts of a time first
    parts = [entering.withColumn("_side", F.lit(0)), facts.select(*keys, "_b", F.col("_o.t").alias("_t"), F.col("_o").alias("_tie"), "_fact", F.lit(1).alias("_side")), asks.withColumn("_side", F.lit(2))]
    both = parts[1].unionByName(parts[0], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_b").orderBy(F.col("_side") != 0, "_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_hit", F.last("_fact", ignorenulls=True).over(w)).filter("_side = 2")
    return found.select("_row.*", *[F.col(f"_hit.{c}").alias(c if c not in left.columns else f"{c}_right") for c in gain])
