"""Strategies judged from their stored reports, all runs in one job: a row a run out.

Two kinds of reports are brought into one form (``Evidence``): periods of long and short legs, and
accounts with an equity curve and trades.  Everything is keyed by ``run``; windows run over one run's
dates or symbols.

Defined results: a run without returns keeps its row, with NULL metrics and ``n`` = 0; NULL, NaN and
infinite returns are left out; of equal returns the first date counts, of equal contributions the first
symbol; figures that a report states itself go before those computed from its returns.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import div, finite
from . import scores
from .markets import DAYS
from .series import cost_figures

#: What a report may state itself; NULL where it does not.
STATED = ["total_return", "annual_return", "volatility", "sharpe", "max_drawdown", "hit_rate"]


class Evidence(NamedTuple):
    """returns (run, date, ret); parts (run, symbol, contribution, cost, turnover, weight), weight the mean
    size while held; facts, a row a run: what ``FACTS`` names and ``stated_*``."""

    returns: DataFrame
    parts: DataFrame
    facts: DataFrame


FACTS = ["n_source_warnings", "no_lookahead", "total_cost", "turnover", "gross_exposure", "net_exposure", "cash_share", "capital", "long_side", "short_side", "long_contribution", "short_contribution"]


def _stated(frame: DataFrame) -> list[Column]:
    """Stated figures; a column that the report does not have is NULL."""
    return [(finite(c) if c in frame.columns else F.lit(None).cast("double")).alias(f"stated_{c}") for c in STATED]


def _parts(*frames: DataFrame) -> DataFrame:
    """Rows with some of contribution, cost, turnover and weight -> one row a run and symbol; sums, but for the weight."""
    names = ["contribution", "cost", "turnover"]
    full = [f.select("run", "symbol", *[(F.col(c) if c in f.columns else F.lit(None).cast("double")).alias(c) for c in [*names, "weight"]]) for f in frames]
    return reduce(DataFrame.union, full).groupBy("run", "symbol").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names], F.avg("weight").alias("weight"))


def from_periods(reports: DataFrame, periods: DataFrame) -> Evidence:
    """Factor reports: ``reports`` a row a run with stated figures, ``periods`` as ``backtest.legs`` gives them.

    A leg's return is dealt evenly to its symbols, the short leg's with its sign turned.  Turnover of a symbol
    is the sum of its weight's changes between neighbouring periods; a symbol in both legs counts as short.
    """
    side = lambda symbols, ret, sign: F.when(finite(ret).isNotNull(), F.transform(symbols, lambda s: F.struct(s.alias("symbol"), (sign * finite(ret) / F.size(symbols)).alias("contribution"))))
    none = F.array().cast("array<struct<symbol:string,contribution:double>>")
    shares = F.concat(F.coalesce(side("long_symbols", "long_return", 1), none), F.coalesce(side("short_symbols", "short_return", -1), none))
    given = periods.select("run", F.inline(shares))

    long_only = F.map_filter("long_weights", lambda s, _: ~F.coalesce(F.map_contains_key("short_weights", s), F.lit(False)))
    weights = F.concat(F.map_entries(long_only), F.map_entries("short_weights"))
    place = periods.select("run", "signal_date").distinct().withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy("signal_date")))
    held = periods.select("run", "signal_date", F.inline(weights).alias("symbol", "w")).join(place, ["run", "signal_date"])
    # each weight is entered with plus in its own period and with minus in the next
    moves = held.select("run", "symbol", F.inline(F.array(F.struct(F.col("k").alias("k"), F.col("w").alias("w")), F.struct((F.col("k") + 1).alias("k"), (-F.col("w")).alias("w")))))
    last = place.groupBy("run").agg(F.max("k").alias("n_periods"))
    moved = moves.groupBy("run", "k", "symbol").agg(F.sum("w").alias("d")).join(last, "run").filter("k > 1 and k <= n_periods")
    moved = moved.select("run", "symbol", F.abs("d").alias("turnover"))
    sizes = held.groupBy("run", "symbol").agg(F.avg(F.abs("w")).alias("weight"))

    whole = periods.filter(finite("long_short_return").isNotNull())
    legs = whole.groupBy("run").agg(F.sum("long_return").alias("long_contribution"), (-F.sum("short_return")).alias("short_contribution"))
    facts = reports.join(legs, "run", "left").select(
        "run", F.size(F.coalesce("warnings", F.array().cast("array<string>"))).alias("n_source_warnings"), "no_lookahead", F.lit(0.0).alias("total_cost"), "turnover", "gross_exposure", "net_exposure", F.lit(0.0).alias("cash_share"), F.lit(1.0).alias("capital"),
        F.col("long_leg_return").alias("long_side"), F.col("short_leg_return").alias("short_side"), "long_contribution", "short_contribution", *_stated(reports),
    )
    return Evidence(whole.select("run", F.col("signal_date").alias("date"), finite("long_short_return").alias("ret")), _parts(given, moved, sizes), facts)


def from_accounts(reports: DataFrame, equity: DataFrame, trades: DataFrame) -> Evidence:
    """Account reports: ``reports`` a row a run (initial_cash, turnover, no_lookahead, stated figures), ``equity``
    (run, date, equity, cash, positions as a map of values), ``trades`` (run, symbol, side, notional, total_cost).

    A symbol's contribution is what its sales brought less what its purchases and costs took, over the initial
    cash (1 where that is none); positions still held are not in it.  Days with equity of zero or less give no share.
    """
    base = reports.select("run", F.when(finite("initial_cash") > 0, finite("initial_cash")).otherwise(1.0).alias("capital"))
    signed = F.when(F.upper("side") == "SELL", F.col("notional")).otherwise(-F.col("notional"))
    t = trades.withColumn("notional", F.coalesce(finite("notional"), F.lit(0.0))).withColumn("total_cost", F.coalesce(finite("total_cost"), F.lit(0.0)))
    # capital is one value a run: sums first, then one division
    t = t.groupBy("run", "symbol").agg(F.sum(signed - F.col("total_cost")).alias("contribution"), (-F.sum("total_cost")).alias("cost"), F.sum(F.abs("notional")).alias("turnover"))
    t = t.join(base, "run").select("run", "symbol", *[(F.col(c) / F.col("capital")).alias(c) for c in ("contribution", "cost", "turnover")])

    live = equity.filter(finite("equity") > 0)
    held = live.select("run", "equity", F.explode("positions").alias("symbol", "value"))
    sizes = held.groupBy("run", "symbol").agg(F.avg(F.abs(F.col("value")) / F.col("equity")).alias("weight"))
    gross = F.aggregate(F.map_values("positions"), F.lit(0.0), lambda a, v: a + F.abs(v)) / F.col("equity")
    shares = live.groupBy("run").agg(F.avg(F.coalesce(finite("cash"), F.lit(0.0)) / F.col("equity")).alias("cash_share"), F.avg(gross).alias("gross"))
    spent = t.join(base, "run").groupBy("run").agg(F.sum(-F.col("cost") * F.col("capital")).alias("total_cost"))
    optional = lambda c: finite(c) if c in reports.columns else F.lit(None).cast("double")
    exposure = F.when(optional("cash_ratio").isNotNull(), F.greatest(1 - optional("cash_ratio"), F.lit(0.0))).otherwise(F.col("gross"))
    facts = reports.join(base, "run").join(shares, "run", "left").join(spent, "run", "left")
    total = optional("total_return")
    facts = facts.select(
        "run", F.lit(0).alias("n_source_warnings"), "no_lookahead", F.coalesce("total_cost", F.lit(0.0)).alias("total_cost"), "turnover", exposure.alias("gross_exposure"), exposure.alias("net_exposure"), "cash_share", "capital",
        total.alias("long_side"), F.lit(0.0).alias("short_side"), F.lit(None).cast("double").alias("long_contribution"), F.lit(None).cast("double").alias("short_contribution"), *_stated(reports),
    )
    before = F.lag("equity").over(Window.partitionBy("run").orderBy("date"))
    rets = equity.select("run", "date", finite("equity").alias("equity")).withColumn("ret", finite(div(F.col("equity"), before) - 1)).filter("ret is not null")
    return Evidence(rets.select("run", "date", "ret"), _parts(t, sizes), facts)


def falls(returns: DataFrame) -> DataFrame:
    """(run, date, ret) -> a row a run: deepest fall from the peak (1 at least), its dates and days.

    The start is the first date of the highest equity up to the end, or the first date of all while equity
    stays under 1; the end is the first date of the least value.
    """
    w = Window.partitionBy("run").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = returns.withColumn("equity", F.product(1 + F.col("ret")).over(w))
    d = d.withColumn("top", F.max(F.struct("equity", (-F.unix_date("date")).alias("back"))).over(w))
    fall = F.col("equity") / F.greatest(F.col("top.equity"), F.lit(1.0)) - 1
    d = d.withColumn("fall", fall)
    low = F.min(F.struct("fall", "date", "top")).alias("low")
    g = d.groupBy("run").agg(low, F.min("date").alias("first"))
    start = F.when(F.col("low.top.equity") >= 1, F.date_from_unix_date(-F.col("low.top.back"))).otherwise(F.col("first"))
    return g.select("run", F.col("low.fall").alias("fall"), start.alias("drawdown_start"), F.col("low.date").alias("drawdown_end"), F.date_diff(F.col("low.date"), start).alias("drawdown_days"))


def _figures(returns: DataFrame) -> DataFrame:
    """A row a run: figures of its returns."""
    r = F.col("ret")
    win, loss = F.when(r > 0, r), F.when(r < 0, r)
    order = F.unix_date("date")
    g = returns.groupBy("run").agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), (F.product(1 + r) - 1).alias("compound"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.stddev_samp(loss).alias("down"), F.count(loss).alias("n_down"),
        F.avg((r > 0).cast("double")).alias("hits"), F.avg(win).alias("average_win"), F.avg(loss).alias("average_loss"), F.max(F.struct("ret", (-order).alias("back"))).alias("best"), F.min(F.struct("ret", order.alias("on"))).alias("worst"),
    )
    ratio = lambda c: F.when(F.col(c) > 0, F.col("mean") / F.col(c) * F.sqrt(F.lit(DAYS)))
    annual = F.when(F.col("compound") <= -1, -1.0).otherwise(F.pow(1 + F.col("compound"), F.lit(DAYS) / F.col("n")) - 1)
    return g.select(
        "run", "n", "first_date", "last_date", "compound", annual.alias("annual"), (F.col("std") * F.sqrt(F.lit(DAYS))).alias("deviation"), ratio("std").alias("ratio"), F.when(F.col("n_down") > 1, ratio("down")).alias("sortino"), "hits", "average_win", "average_loss", div(F.col("average_win"), F.abs("average_loss")).alias("win_loss_ratio"),
        F.date_from_unix_date(-F.col("best.back")).alias("best_date"), F.col("best.ret").alias("best_return"), F.date_from_unix_date("worst.on").alias("worst_date"), F.col("worst.ret").alias("worst_return"),
    )


def _shares(parts: DataFrame) -> DataFrame:
    """A row a run: what the best contributors bring, and what the largest positions hold."""
    by = lambda c: F.row_number().over(Window.partitionBy("run").orderBy(F.desc_nulls_last(c), "symbol"))
    d = parts.withColumn("j", by("contribution")).withColumn("k", by("weight"))
    gain = F.when(F.col("contribution") > 0, F.col("contribution"))
    top = lambda n: F.coalesce(F.sum(F.when(F.col("j") <= n, gain)), F.lit(0.0))
    held = lambda n: F.coalesce(F.sum(F.when(F.col("k") <= n, F.col("weight"))), F.lit(0.0))
    largest = F.max(F.when((F.col("k") == 1) & F.col("weight").isNotNull(), F.col("symbol")))
    return d.groupBy("run").agg(top(1).alias("top_1"), top(3).alias("top_3"), F.sum(gain).alias("gains"), largest.alias("largest_position"), held(1).alias("largest_weight"), held(3).alias("top_3_weight"), held(5).alias("top_5_weight"))


def against(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(run, date, ret) and one benchmark (date, ret): each run's information ratio over the dates of both, and the benchmark's return."""
    both = returns.join(benchmark.select("date", F.col("ret").alias("other")), "date").withColumn("active", F.col("ret") - F.col("other"))
    std = F.stddev_samp("active")
    ratio = both.groupBy("run").agg(F.when(std > 0, F.avg("active") / std * F.sqrt(F.lit(DAYS))).alias("information_ratio"))
    whole = benchmark.agg((F.product(1 + F.col("ret")) - 1).alias("benchmark_return"))  # a single row
    return returns.select("run").distinct().join(ratio, "run", "left").join(whole, F.lit(True))


def evaluate(e: Evidence, benchmark: DataFrame | None = None) -> DataFrame:
    """A row a run: figures, exposures, costs, concentration, the deepest fall and an array of warning codes."""
    d = e.facts.join(_figures(e.returns), "run", "left").join(falls(e.returns), "run", "left").join(_shares(e.parts), "run", "left")
    if benchmark is not None:
        d = d.join(against(e.returns, benchmark), "run", "left")
    else:
        d = d.select("*", *[F.lit(None).cast("double").alias(c) for c in ("benchmark_return", "information_ratio")])
    said = lambda c, own: F.coalesce(F.col(f"stated_{c}"), F.col(own)).alias(c)
    d = d.withColumn("n", F.coalesce("n", F.lit(0))).select("*", said("total_return", "compound"), said("annual_return", "annual"), said("volatility", "deviation"), said("sharpe", "ratio"), said("hit_rate", "hits"), (-F.abs(F.coalesce("stated_max_drawdown", "fall"))).alias("max_drawdown"))
    total, c = F.col("total_return"), F.col
    size = F.when(total.isNull() | (total == 0), c("gains")).otherwise(F.abs(total))
    share = lambda n: F.when(size > 0, c(f"top_{n}") / size)
    cost = cost_figures(c("total_cost"), total, c("capital"))
    d = d.select("*", (total - c("benchmark_return")).alias("excess_return"), share(1).alias("top_1_share"), share(3).alias("top_3_share"), div(c("annual_return"), F.abs("max_drawdown")).alias("calmar"), cost["cost_drag"].alias("cost_drag"), cost["cost_to_return"].alias("cost_to_return"))
    codes = scores.warnings(c("n"), total, c("sharpe"), c("max_drawdown"), c("turnover"), None, c("long_side"), c("short_side"), c("cost_drag"), c("excess_return"), top_share=c("top_1_share"))
    codes = F.concat(F.array_compact(F.array(F.when(c("n_source_warnings") > 0, "SOURCE_WARNING"))), codes, F.array_compact(F.array(F.when(~F.coalesce("no_lookahead", F.lit(False)), "NO_LOOKAHEAD_NOT_MARKED"))))
    return d.withColumn("codes", codes).select(
        "run", "n", "first_date", "last_date", "total_return", "annual_return", "volatility", "sharpe", "sortino", "max_drawdown", "calmar", "hit_rate", "win_loss_ratio", "average_win", "average_loss", "best_date", "best_return", "worst_date", "worst_return",
        "turnover", "total_cost", "cost_drag", "cost_to_return", "gross_exposure", "net_exposure", "cash_share", "long_side", "short_side", "long_contribution", "short_contribution", "benchmark_return", "excess_return", "information_ratio",
        "drawdown_start", "drawdown_end", "drawdown_days", "top_1_share", "top_3_share", "largest_position", "largest_weight", "top_3_weight", "top_5_weight", "codes",
    )


def attribution(e: Evidence, top: int = 5) -> DataFrame:
    """All parts, each with its kind and, among the ``top`` best gains and worst losses, its place."""
    kind = F.when(F.col("contribution") > 0, "contributor").when(F.col("contribution") < 0, "detractor")
    d = e.parts.withColumn("kind", kind)
    place = F.row_number().over(Window.partitionBy("run", "kind").orderBy(F.desc(F.abs("contribution")), "symbol"))
    return d.withColumn("place", F.when(F.col("kind").isNotNull() & (place <= top), place))


def by_calendar(returns: DataFrame, unit: str) -> DataFrame:
    """Compounded returns of each run a month, quarter or year; those without a row between a run's first and last are 0."""
    step = {"month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}[unit]
    d = returns.groupBy("run", F.to_date(F.date_trunc(unit, "date")).alias("period")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))
    every = d.groupBy("run").agg(F.explode(F.sequence(F.min("period"), F.max("period"), F.expr(step))).alias("period"))
    return every.join(d, ["run", "period"], "left").select("run", "period", F.coalesce("ret", F.lit(0.0)).alias("ret"))
