"""A single series of returns, and panels put on common dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .markets import DAYS, drawdowns

IN_ORDER = "date"


def equity_returns(equity: DataFrame) -> DataFrame:
    """(date, equity) -> (date, ret); the first date has none."""
    return equity.withColumn("ret", F.col("equity") / F.lag("equity").over(Window.orderBy(IN_ORDER)) - 1).filter("ret is not null").select("date", "ret")


def drawdown_span(returns: DataFrame) -> DataFrame:
    """The deepest fall with the dates of its peak and its end: a single row.

    The end is the first date of the least value; the start the first date of the highest equity until
    then, or the first date of all while equity stays under one.
    """
    d = drawdowns(returns)
    end = d.agg(F.min_by("date", F.struct("drawdown", "date")).alias("end"), F.min("drawdown").alias("max_drawdown"), F.min("date").alias("first"))
    before = d.join(F.broadcast(end), F.col("date") <= F.col("end"))
    top = before.agg(F.min_by("date", F.struct(-F.col("equity"), F.col("date"))).alias("at"), F.max("equity").alias("peak"), F.first("end").alias("drawdown_end"), F.first("max_drawdown").alias("max_drawdown"), F.first("first").alias("first"))
    start = F.when(F.col("peak") >= 1, F.col("at")).otherwise(F.col("first"))
    return top.select("max_drawdown", start.alias("drawdown_start"), "drawdown_end", F.date_diff("drawdown_end", start).alias("drawdown_days"))


def against(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(date, ret) of both -> benchmark return, excess return, information ratio: a single row."""
    total = lambda d: d.agg((F.product(1 + F.col("ret")) - 1).alias("total"))
    both = returns.join(benchmark.withColumnRenamed("ret", "other"), "date").withColumn("active", F.col("ret") - F.col("other"))
    std = F.stddev_samp("active")
    ratio = both.agg(F.when(std > 0, F.avg("active") / std * F.sqrt(F.lit(DAYS))).alias("information_ratio"), F.count("*").alias("n_common"))
    out = total(benchmark).select(F.col("total").alias("benchmark_return")).join(total(returns), F.lit(True)).join(ratio, F.lit(True))  # single rows
    return out.select("benchmark_return", (F.col("total") - F.col("benchmark_return")).alias("excess_return"), "information_ratio", "n_common")


def cost_figures(total_cost, total_return, capital=None):
    """Cost drag and cost against return, as columns; a return or capital of zero counts as none."""
    base = F.lit(1.0) if capital is None else F.when(capital == 0, 1.0).otherwise(F.abs(capital))
    return {"cost_drag": -F.abs(total_cost) / base, "cost_to_return": F.try_divide(F.abs(total_cost), F.abs(total_return) * base)}


def rolling(returns: DataFrame, window: int, annual: bool) -> DataFrame:
    """Return, Sharpe ratio and fall from the window's peak over full windows of the series."""
    w = Window.orderBy(IN_ORDER)
    frame = w.rowsBetween(-(window - 1), 0)
    full = F.count("*").over(frame) >= window
    d = drawdowns(returns)
    std = F.stddev_samp("ret").over(frame)
    ratio = F.when(full & (std > 0), F.avg("ret").over(frame) / std * (F.sqrt(F.lit(DAYS)) if annual else 1.0))
    return d.select("date", F.when(full, F.product(1 + F.col("ret")).over(frame) - 1).alias("rolling_return"), ratio.alias("rolling_sharpe"), F.when(full, F.col("equity") / F.max("equity").over(frame) - 1).alias("rolling_drawdown"))


def calendar(returns: DataFrame, unit: str) -> DataFrame:
    """Compounded returns a month, quarter or year; those without a row between the first and the last are 0."""
    step = {"month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}[unit]
    d = returns.groupBy(F.to_date(F.date_trunc(unit, "date")).alias("period")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))
    every = d.agg(F.explode(F.sequence(F.min("period"), F.max("period"), F.expr(step))).alias("period"))
    return every.join(d, "period", "left").select("period", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def extremes(returns: DataFrame) -> DataFrame:
    """Best and worst date: a single row; of equals the first."""
    return returns.agg(F.min_by("date", F.struct(-F.col("ret"), F.col("date"))).alias("best_date"), F.max("ret").alias("best_return"), F.min_by("date", F.struct("ret", "date")).alias("worst_date"), F.min("ret").alias("worst_return"))


def grid(bars: DataFrame) -> DataFrame:
    """Every date with every symbol (dates times symbols: the size of a full panel), closes carried on.

    (symbol, date, close, mark, stale): mark is the last close so far, stale the rows since it, or since
    the start where there was none.
    """
    every = bars.select("date").distinct().join(F.broadcast(bars.select("symbol").distinct()), F.lit(True))  # a row a symbol
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = every.join(bars.select("symbol", "date", "close"), ["symbol", "date"], "left").withColumn("mark", F.last("close", ignorenulls=True).over(w))
    d = d.withColumn("_run", F.count("close").over(w))
    return d.withColumn("stale", F.count_if(F.col("close").isNull()).over(Window.partitionBy("symbol", "_run").orderBy("date"))).drop("_run")


def complete_dates(marks: DataFrame) -> DataFrame:
    """Rows of the dates on which every symbol has a mark."""
    return marks.withColumn("_least", F.count_if(F.col("mark").isNull()).over(Window.partitionBy("date"))).filter("_least = 0").drop("_least")
