"""Accounts: marks, allocation, rebalance plans, the ledger, checks of what was reported."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import div


def mark_prices(bars: DataFrame, day: str) -> DataFrame:
    """(symbol, price): the last close at or before the day, else the latest close there is."""
    before = F.col("date") <= F.lit(day).cast("date")
    seen = F.max_by("close", F.when(before, F.col("date")))
    return bars.groupBy("symbol").agg(F.coalesce(F.when(F.count_if(before) > 0, seen), F.max_by("close", "date")).alias("price"))


def allocation(positions: DataFrame, prices: DataFrame, cash: float, cash_alone: bool = True) -> DataFrame:
    """positions (symbol, qty) -> (symbol, qty, price, current_value, current_weight), cash as a row of its own.

    A position without a price has no value (NULL): callers check.  Without any position of value the total
    is the cash, or, where not ``cash_alone``, there is none and weights are NULL.
    """
    d = positions.join(prices, "symbol", "left").select("symbol", F.col("qty").cast("double").alias("qty"), "price", (F.col("qty") * F.col("price")).alias("current_value"))
    one = positions.sparkSession.createDataFrame([("cash", 0.0, None, float(cash))], "symbol string, qty double, price double, current_value double")
    every = Window.partitionBy()  # a row a position
    total = _total(F.sum("current_value").over(every), F.count("current_value").over(every), cash_alone)
    return d.union(one).withColumn("current_weight", F.when(total.isNotNull(), F.coalesce(div(F.col("current_value"), total), F.lit(0.0))))


def _total(worth, valued, cash_alone: bool):
    """The worth of an allocation's rows, of which cash is one; see ``allocation``."""
    return worth if cash_alone else F.when(valued > 1, worth)


def rebalance(positions: DataFrame, targets: DataFrame, prices: DataFrame, cash: float, rate: float = 0.001, cash_alone: bool = True) -> DataFrame:
    """targets (symbol, target_weight) -> what to trade a symbol, in whole shares.

    Buys are sized so that their commission fits, sells by what is held.  Where that costs more than cash
    and sells bring, all buys are scaled alike, to one share at least.  Where there is no total (see
    ``allocation``), weights, target values and differences are NULL and nothing is traded.
    """
    held = allocation(positions, prices, cash, cash_alone)
    total = held.agg(_total(F.sum("current_value"), F.count("current_value"), cash_alone).alias("total_assets"))
    d = held.filter("symbol <> 'cash'").select("symbol", "qty", "current_value", "current_weight").join(targets.filter("symbol <> 'cash'"), "symbol", "full").join(prices, "symbol", "left").join(F.broadcast(total), F.lit(True))
    d = d.na.fill(0.0, ["qty", "current_value", "current_weight", "target_weight"])
    d = d.withColumn("current_weight", F.when(F.col("total_assets").isNotNull(), F.col("current_weight")))
    d = d.withColumn("target_value", F.col("total_assets") * F.col("target_weight")).withColumn("difference", F.col("target_value") - F.col("current_value"))
    p, gap = F.col("price"), F.col("difference")
    buy, sell = F.floor(gap / (p * (1 + rate))), F.least(F.floor("qty"), F.floor(F.abs(gap) / p))
    d = d.withColumn("action", F.when((gap > 0) & (buy > 0), "BUY").when((gap < 0) & (sell > 0), "SELL").otherwise("HOLD"))
    d = d.withColumn("wanted", F.when(F.col("action") == "BUY", buy).when(F.col("action") == "SELL", sell).otherwise(0).cast("long"))
    every = Window.partitionBy()  # a row a symbol
    worth = lambda side: F.sum(F.when(F.col("action") == side, F.col("wanted") * p).otherwise(0.0)).over(every)
    d = d.withColumn("_buys", worth("BUY")).withColumn("_sells", worth("SELL")).withColumn("_fees", (F.col("_buys") + F.col("_sells")) * rate)
    budget = F.greatest(cash + F.col("_sells") - F.col("_fees"), F.lit(0.0))
    short = (cash + F.col("_sells") - F.col("_buys") - F.col("_fees") < -1e-8) & (budget < F.col("_buys"))
    scaled = F.greatest(F.lit(1), F.floor(F.col("wanted") * budget / F.col("_buys")))
    d = d.withColumn("shares", F.when(short & (F.col("action") == "BUY"), scaled).otherwise(F.col("wanted")).cast("long"))
    d = d.withColumn("commission", F.col("shares") * p * rate)
    signed = F.when(F.col("action") == "SELL", F.col("shares") * p).when(F.col("action") == "BUY", -F.col("shares") * p).otherwise(0.0)
    return d.withColumn("cash_after", cash + F.sum(signed).over(every) - F.sum("commission").over(every)).select("symbol", "current_value", "current_weight", "target_weight", "target_value", "difference", "price", "action", "shares", "commission", "cash_after")


def ledger(trades: DataFrame, cash: float) -> DataFrame:
    """trades (account, ord, symbol, side, shares, price) -> (account, symbol, qty, avg_cost, cash, rejected).

    An account's trades are folded in their order, since whether one can be paid depends on all before:
    buys beyond the cash and sells beyond the position are rejected; the average cost changes with buys
    alone.  Trades of one ``ord`` go by their other columns.  A row a position, or one without a symbol for
    an account that holds nothing.  Spark sorts the trades and a task reads them in a stream: it holds a
    batch and the open positions of its accounts, which are what it returns.
    """
    names = ["account", "symbol", "side", "shares", "price"]
    types = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]

    def fold(batches):
        accounts = {}
        for b in batches:
            for account, symbol, side, shares, price in zip(*[b.column(n).to_numpy(zero_copy_only=False).tolist() for n in names]):
                state = accounts.get(account)
                if state is None:
                    state = accounts[account] = [cash, {}, 0]
                held = state[1]
                amount = shares * price
                qty, cost = held.get(symbol, (0.0, 0.0))
                if side == "BUY" and amount <= state[0]:
                    state[0] -= amount
                    held[symbol] = (qty + shares, (qty * cost + amount) / (qty + shares))
                elif side == "SELL" and qty >= shares:
                    state[0] += amount
                    held[symbol] = (qty - shares, cost)
                    if qty == shares:
                        del held[symbol]
                else:
                    state[2] += 1
        rows = []
        for account, (money, held, rejected) in accounts.items():
            rows += [(account, s, q, c, money, rejected) for s, (q, c) in sorted(held.items())] or [(account, None, 0.0, None, money, rejected)]
            if len(rows) > 10_000:
                yield table(rows)
                rows = []
        if rows:
            yield table(rows)

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], ["account", "symbol", "qty", "avg_cost", "cash", "rejected"])

    text, number = lambda c: F.col(c).cast("string").alias(c), lambda c: F.col(c).cast("double").alias(c)
    d = trades.select(*map(text, names[:3]), *map(number, names[3:]), "ord")
    # by order alone, an account's trades among others': the first key then decides nearly all comparisons
    d = d.repartition("account").sortWithinPartitions(F.col("ord").asc_nulls_last(), *names[1:]).select(*names)
    return d.mapInArrow(fold, "account string, symbol string, qty double, avg_cost double, cash double, rejected long")


def marked(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Ledger positions with market value and unrealised gain; unpriced ones have neither."""
    value = F.col("qty") * F.col("price")
    return positions.join(prices, "symbol", "left").withColumn("market_value", value).withColumn("unrealised", value - F.col("qty") * F.col("avg_cost"))


def unmatched_fills(fills: DataFrame, orders: DataFrame, key: str) -> DataFrame:
    """Fills that name no known order."""
    return fills.join(orders.select(key).distinct(), key, "left_anti")


def weight_checks(weights: DataFrame, by: list[str], tolerance: float = 0.02) -> DataFrame:
    """A row a portfolio: whether its weights sum to one and none is negative."""
    g = weights.groupBy(*by).agg(F.sum("weight").alias("total"), F.min("weight").alias("least"))
    return g.withColumn("problem", F.when(F.abs(F.col("total") - 1) > tolerance, "weights outside tolerance").when(F.col("least") < -tolerance, "negative weights"))


def reconcile(accounts: DataFrame, positions: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """accounts (account, cash, equity), positions (account, market_value) -> those that do not add up."""
    held = positions.groupBy("account").agg(F.sum("market_value").alias("held"))
    d = accounts.join(held, "account", "left").withColumn("gap", F.col("cash") + F.coalesce("held", F.lit(0.0)) - F.col("equity"))
    return d.filter(F.abs("gap") > tolerance).select("account", "gap")


def concentration(weights: DataFrame) -> DataFrame:
    """(symbol, weight) over time -> average size of each symbol's weight, and what the largest hold: a single row."""
    mean = weights.groupBy("symbol").agg(F.avg(F.abs("weight")).alias("w"))
    k = F.row_number().over(Window.orderBy(F.desc("w"), "symbol"))  # a row a symbol
    top = lambda n: F.coalesce(F.sum(F.when(F.col("k") <= n, F.col("w"))), F.lit(0.0))
    return mean.withColumn("k", k).agg(F.max(F.when(F.col("k") == 1, F.col("symbol"))).alias("largest"), top(1).alias("top_1"), top(3).alias("top_3"), top(5).alias("top_5"))


def contributors(parts: DataFrame, n: int = 5) -> DataFrame:
    """(symbol, part) -> the n best above zero and the n worst below, each with its place."""
    k = lambda order: F.row_number().over(Window.partitionBy("kind").orderBy(order, "symbol"))
    d = parts.filter("part <> 0").withColumn("kind", F.when(F.col("part") > 0, "contributor").otherwise("detractor"))
    return d.withColumn("place", k(F.desc(F.abs("part")))).filter(F.col("place") <= n)


def return_concentration(parts: DataFrame, total: float | None = None) -> DataFrame:
    """Share of the return (or, without one, of all gains) that the best one and the best three bring."""
    gains = parts.filter("part > 0").withColumn("k", F.row_number().over(Window.orderBy(F.desc("part"), "symbol")))
    base = F.sum("part") if not total else F.lit(abs(float(total)))
    return gains.agg(div(F.sum(F.when(F.col("k") <= 1, F.col("part"))), base).alias("top_1_pct"), div(F.sum(F.when(F.col("k") <= 3, F.col("part"))), base).alias("top_3_pct"))
