"""An ordered sink: files in one order over all, each row with its place, without one task that sorts everything.

Rows go by ranges of the keys to as many tasks as asked for, and each sorts its own; the file's number and the row's
in it are written with every row (``ord``), so the order is in the data and not in how files are read back.
Places counted without gaps come from a table of a row a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a file have the file's number in the bits from here.
SHIFT = 33


def write_ordered(rows: DataFrame, keys: list[str], path: str, files: int = 200) -> None:
    """Write rows in the order of ``keys``, nulls first, ties by a hash of the other columns; ``ord`` tells the order."""
    if "ord" in rows.columns:
        raise ValueError("a column is called ord")
    rest = [c for c in rows.columns if c not in keys]
    tie = [F.xxhash64(*rest)] if rest else []
    sorted_rows = rows.repartitionByRange(files, *keys).sortWithinPartitions(*keys, *tie)
    sorted_rows.withColumn("ord", F.monotonically_increasing_id()).write.parquet(path)


def read_ordered(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows with ``position`` (from 0, without gaps), or those of positions ``first`` to ``last`` alone.

    A span reads the files that it touches: which these are is known from the number of rows a file.
    """
    rows = spark.read.parquet(path)
    file = F.shiftright("ord", SHIFT).cast("int")
    # a row a file
    sizes = rows.groupBy(file.alias("_f")).agg(F.count("*").alias("n"), F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("start", before)
    if first is None and last is None:
        placed = rows.withColumn("_f", file).join(starts.select("_f", "start"), "_f")
        return placed.withColumn("position", F.col("start") + F.col("ord").bitwiseAND((1 << SHIFT) - 1)).drop("_f", "start", "ord")
    first, last = first or 0, (1 << 62) if last is None else last
    hit = starts.filter((F.col("start") + F.col("n") > first) & (F.col("start") <= last)).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    # row groups are skipped by the bounds of ord
    near = rows.filter(F.col("ord").between(hit.lo, hit.hi)) if hit.lo is not None else rows.limit(0)
    placed = near.withColumn("_f", file).join(starts.select("_f", "start"), "_f")
    return placed.withColumn("position", F.col("start") + F.col("ord").bitwiseAND((1 << SHIFT) - 1)).drop("_f", "start", "ord").filter(F.col("position").between(first, last))
