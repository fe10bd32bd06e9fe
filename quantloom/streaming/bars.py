"""Extension: bars of a live event stream, by event time with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(events: DataFrame, key: str, time: str, value: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """events (batch or stream) -> open, high, low, close and count by key and tumbling window."""
    order = F.struct(time, value)
    g = events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), F.col(key).alias("symbol"))
    return g.agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count("*").alias("n")).select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")
