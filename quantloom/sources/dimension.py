"""Metadata of symbols as a kept dimension: what held from which day on, asked as of a day.

A version is (symbol, valid_from, attributes); the table is upserted by symbol and day, so a run that is repeated changes
nothing, and a version lasts until the symbol's next one.  Versions that change nothing are joined with the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.asof import as_of
from .tables import KeyedTable

ATTRIBUTES = ["name", "asset_type", "sector", "industry", "currency", "exchange"]


class SymbolDimension:
    """Symbols upper-cased and trimmed; rows without a symbol or a day, or with a blank symbol, are left out."""

    def __init__(self, spark: SparkSession, root: str, attributes: list[str] = tuple(ATTRIBUTES), buckets: int = 64):
        self.spark, self.attributes = spark, list(attributes)
        self.table = KeyedTable(spark, root, ["symbol", "valid_from"], ["revision"], buckets)

    def upsert(self, rows: DataFrame, run: str, revision: int = 0) -> dict:
        """Versions (symbol, valid_from, attributes); a missing attribute is null, the higher revision of a day counts."""
        given = [F.col(a).cast("string").alias(a) if a in rows.columns else F.lit(None).cast("string").alias(a) for a in self.attributes]
        clean = rows.select(F.upper(F.trim("symbol")).alias("symbol"), F.col("valid_from").cast("date").alias("valid_from"), F.lit(revision).cast("int").alias("revision"), *given)
        return self.table.upsert(clean.filter("symbol <> '' and valid_from is not null"), run)

    def versions(self) -> DataFrame:
        """(symbol, valid_from, valid_to, attributes): valid_to is the day before the next version, null for the last."""
        rows = self.table.read()
        if rows is None:
            fields = ", ".join(f"`{a}` string" for a in self.attributes)
            return self.spark.createDataFrame([], f"symbol string, valid_from date, valid_to date, {fields}")
        w = Window.partitionBy("symbol").orderBy("valid_from")
        body = F.struct(*self.attributes)
        new = rows.withColumn("_same", F.lag(body).over(w).eqNullSafe(body) & (F.row_number().over(w) > 1)).filter("not _same")
        return new.select("symbol", "valid_from", F.date_sub(F.lead("valid_from").over(w), 1).alias("valid_to"), *self.attributes)

    def on(self, day) -> DataFrame:
        """What held on a day: at most a row a symbol."""
        d = F.lit(day).cast("date") if isinstance(day, str) else day
        return self.versions().filter((F.col("valid_from") <= d) & (F.col("valid_to").isNull() | (F.col("valid_to") >= d)))

    def get(self, symbols: list[str], day) -> DataFrame:
        return self.on(day).filter(F.col("symbol").isin([s.strip().upper() for s in symbols]))

    def by(self, attribute: str, value: str, day) -> DataFrame:
        """Symbols of a sector, a type or whatever the attribute says on a day; letters' case does not count."""
        if attribute not in self.attributes:
            raise ValueError(f"no attribute {attribute}")
        return self.on(day).filter(F.lower(attribute) == value.strip().lower())

    def attach(self, rows: DataFrame, time: str = "date") -> DataFrame:
        """Rows with the attributes that held at their time; null before a symbol's first version."""
        key = F.upper(F.trim("symbol"))
        found = as_of(rows.withColumn("_s", key), self.versions().drop("valid_to").withColumnRenamed("symbol", "_s"), ["_s"], time, "valid_from")
        return found.drop("_s")
