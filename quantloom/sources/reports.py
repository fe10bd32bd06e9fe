"""Reports and targets as JSON: small ones as files that the driver writes, a few values or rows; large ones
row by row as lines, or as stored documents that are taken apart, both by tasks."""

from __future__ import annotations

import datetime as dt
import json
import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What stored reports hold, in the form that operators/evaluation.py takes.
WEIGHTS = T.MapType(T.StringType(), T.DoubleType())
NAMES = T.ArrayType(T.StringType())


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _doubles(*names: str) -> dict:
    return {n: T.DoubleType() for n in names}


PERIOD = _struct(signal_date=T.DateType(), future_date=T.DateType(), long_symbols=NAMES, short_symbols=NAMES, long_weights=WEIGHTS, short_weights=WEIGHTS, **_doubles("long_return", "short_return", "long_short_return", "turnover", "gross_exposure", "net_exposure"))
EQUITY = _struct(date=T.DateType(), **_doubles("equity", "cash"), positions=WEIGHTS)
TRADE = _struct(date=T.DateType(), symbol=T.StringType(), side=T.StringType(), **_doubles("notional", "total_cost"))
FACTOR_HEAD = _struct(no_lookahead=T.BooleanType(), warnings=NAMES, **_doubles("total_return", "annual_return", "volatility", "sharpe", "hit_rate", "turnover", "gross_exposure", "net_exposure", "long_leg_return", "short_leg_return"))
ACCOUNT_HEAD = _struct(no_lookahead=T.BooleanType(), **_doubles("initial_cash"))
METRICS = _struct(**_doubles("total_return", "annual_return", "volatility", "sharpe", "max_drawdown", "turnover", "cash_ratio"))


def plain(x):
    """A value that JSON has: dates as text, rows as objects, NaN and infinities as null."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if hasattr(x, "asDict"):
        return plain(x.asDict(recursive=True))
    if isinstance(x, (list, tuple, set)):
        return [plain(v) for v in x]
    if isinstance(x, (dt.date, dt.datetime)):
        return x.isoformat()
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x if x is None or isinstance(x, (bool, int, float, str)) else str(x)


def report_path(folder: str, prefix: str, now: dt.datetime | None = None) -> str:
    """A new name in the folder, by time; a number is added while it is taken."""
    os.makedirs(folder, exist_ok=True)
    stem = f"{folder}/{prefix}_{(now or dt.datetime.now()):%Y%m%d_%H%M%S}"
    path, n = f"{stem}.json", 1
    while os.path.exists(path):
        path, n = f"{stem}_{n}.json", n + 1
    return path


def write_report(path: str, report: dict, sort_keys: bool = False) -> str:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(plain(report), f, indent=2, sort_keys=sort_keys, ensure_ascii=False)
    return path


def rows(frame: DataFrame, limit: int = 10_000) -> list[dict]:
    """A small frame's rows; one of more than ``limit`` is refused, and goes to ``frame.write.json``."""
    got = frame.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} rows; write them with frame.write.json")
    return [plain(r) for r in got]


def write_targets(path: str, weights: DataFrame) -> str:
    """(symbol, weight) as one object, cash with what is left of one."""
    held = {r["symbol"]: round(float(r["weight"]), 6) for r in rows(weights.select("symbol", "weight"))}
    held.setdefault("cash", round(1.0 - sum(held.values()), 6))
    return write_report(path, held, sort_keys=True)


def write_lines(rows: DataFrame, path: str) -> str:
    """A row a line, by tasks: what is too large for one document.  NULLs are left out of a line."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return path


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, and apart from them the lines (``line``) that are no JSON or do not fit the schema.

    Blank lines are neither; unknown names are ignored; what a line lacks is NULL.
    """
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    d = spark.read.text(path).filter(F.trim("value") != "").select("value", F.from_json("value", full, {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return d.filter("r._bad is null").select("r.*").drop("_bad"), d.filter("r._bad is not null").select(F.col("value").alias("line"))


def _documents(docs: DataFrame, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    return docs.select("run", F.from_json("text", full, {"columnNameOfCorruptRecord": "_bad"}).alias("r"))


def factor_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(run, text) of stored factor reports -> reports, periods, problems (run, problem).

    A text that is no such document gives ``unreadable``, one without periods ``no_periods``; neither is in the other two.
    """
    d = _documents(docs, T.StructType([*FACTOR_HEAD.fields, T.StructField("periods", T.ArrayType(PERIOD))]))
    problem = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "unreadable").when(F.coalesce(F.size("r.periods"), F.lit(0)) < 1, "no_periods")
    d = d.withColumn("problem", problem)
    good = d.filter("problem is null")
    return good.select("run", *[f"r.{f.name}" for f in FACTOR_HEAD]), good.select("run", F.inline("r.periods")), d.filter("problem is not null").select("run", "problem")


def account_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(run, text) of stored account reports -> reports, equity, trades, problems.

    Besides ``unreadable``: ``no_metrics``, and ``short_curve`` for one of fewer than two rows.
    """
    d = _documents(docs, T.StructType([*ACCOUNT_HEAD.fields, T.StructField("metrics", METRICS), T.StructField("equity_curve", T.ArrayType(EQUITY)), T.StructField("trades", T.ArrayType(TRADE))]))
    problem = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "unreadable").when(F.col("r.metrics").isNull(), "no_metrics").when(F.coalesce(F.size("r.equity_curve"), F.lit(0)) < 2, "short_curve")
    d = d.withColumn("problem", problem)
    good = d.filter("problem is null")
    reports = good.select("run", *[f"r.{f.name}" for f in ACCOUNT_HEAD], "r.metrics.*")
    return reports, good.select("run", F.inline("r.equity_curve")), good.select("run", F.inline("r.trades")), d.filter("problem is not null").select("run", "problem")
