"""Regimes, execution costs, portfolios, data quality, walk-forward windows, return statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, div
from .factors import by_symbol
from .tiles import covariance_tiles

#: Trading days a year.
DAYS = 252.0


def regime_features(series: DataFrame, long: int = 200, vol: int = 20, trend: int = 60) -> DataFrame:
    """(date, close) of one benchmark -> features; early rows need half a window of values."""
    w = Window.orderBy("date")  # one series: a row a date
    d = series.withColumn("market_return", F.col("close") / F.lag("close", 1).over(w) - 1)
    total = F.count("*").over(Window.partitionBy())
    need = F.greatest(F.lit(20), F.floor(F.least(F.lit(long), total) / 2))
    vf, lf = w.rowsBetween(-(vol - 1), 0), w.rowsBetween(-(long - 1), 0)
    return d.select(
        "date", "close", "market_return",
        F.when(F.count("market_return").over(vf) >= max(5, vol // 2), F.stddev_samp("market_return").over(vf) * F.sqrt(F.lit(DAYS))).alias("volatility"),
        F.when(F.count("close").over(lf) >= need, F.avg("close").over(lf)).alias("moving_average"),
        (F.col("close") / F.lag("close", trend).over(w) - 1).alias("trend_strength"),
        (F.col("close") / F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("drawdown"),
    )


#: Thresholds of the regimes.
REGIME = {"high_vol": 0.25, "low_vol": 0.12, "crisis": -0.20, "recovery": -0.10, "trend": 0.05, "shock": -0.08}


def classify(features: DataFrame, t: dict = REGIME) -> DataFrame:
    """The first rule that holds names the regime; NULL features are UNKNOWN."""
    vol, trend, fall, ret = (F.col(c) for c in ("volatility", "trend_strength", "drawdown", "market_return"))
    close, ma = F.col("close"), F.col("moving_average")
    r0 = F.coalesce(ret, F.lit(0.0))
    missing = close.isNull() | ma.isNull() | vol.isNull() | trend.isNull() | fall.isNull()
    regime = (
        F.when(missing, "UNKNOWN").when((fall <= t["crisis"]) & ((vol >= t["high_vol"]) | (r0 <= t["shock"])), "CRISIS")
        .when((fall <= t["recovery"]) & (trend > t["trend"]) & (r0 > 0), "RECOVERY").when(vol >= t["high_vol"], "HIGH_VOL")
        .when((vol <= t["low_vol"]) & (F.abs(trend) < t["trend"]), "LOW_VOL").when((close > ma) & (trend > 0), "BULL")
        .when((close < ma) & (trend < 0), "BEAR").when(F.abs(trend) >= t["trend"], "TRENDING").otherwise("RANGE_BOUND")
    )
    conf = F.least(F.lit(1.0), 0.35 + F.abs(trend) * 2.0 + F.abs(fall) + clip(vol, 0.0, 1.0) * 0.35)
    return features.withColumn("regime", regime).withColumn("confidence", F.when(missing, 0.0).otherwise(F.bround(conf, 6)))


#: The default and the realistic cost profile.
COSTS = {"fixed_fee": 1.0, "commission_rate": 0.001, "min_commission": 1.0, "slippage_bps": 5.0, "impact_bps": 0.0, "participation_factor": 1.0, "volatility_factor": 0.0, "liquidity_rate": 0.0}
PROFILES = {"conservative": {}, "realistic": {"commission_rate": 0.0005, "impact_bps": 2.0, "volatility_factor": 0.05}}


def cost_columns(notional: Column, participation: Column, volatility: Column, profile: str = "realistic") -> dict[str, Column]:
    """Fee, commission, slippage, market impact (square root of participation), liquidity, total."""
    c = {**COSTS, **PROFILES[profile]}
    p = F.greatest(participation, F.lit(0.0))
    root = F.sqrt(p)
    extra = F.coalesce(F.greatest(volatility, F.lit(0.0)) * 10000.0 * c["volatility_factor"] * root, F.lit(0.0))
    bps = F.when(participation.isNull(), c["impact_bps"]).otherwise(F.greatest(c["impact_bps"] * (1.0 + c["participation_factor"] * root) + extra, F.lit(0.0)))
    parts = {"fee": F.lit(c["fixed_fee"]), "commission": F.greatest(notional * c["commission_rate"], F.lit(c["min_commission"])), "slippage": notional * c["slippage_bps"] / 10000.0, "impact": notional * bps / 10000.0, "liquidity": F.when(participation.isNull(), 0.0).otherwise(notional * c["liquidity_rate"] * p)}
    total = parts["fee"] + parts["commission"] + parts["slippage"] + parts["impact"] + parts["liquidity"]
    return {**parts, "total_cost": total}


def slippage(model: str, notional: Column, shares: Column, adv: Column, volatility: Column, amount: float = 1.0, bps: float = 5.0, scaled_bps: float = 10.0, multiplier: float = 0.1) -> Column:
    usage = F.coalesce(F.when(adv > 0, F.greatest(shares / adv, F.lit(0.0))), F.lit(0.0))
    kinds = {"fixed": F.lit(amount), "bps": notional * bps / 10000.0, "volume_scaled": notional * (scaled_bps * usage) / 10000.0, "volatility_scaled": notional * F.greatest(F.coalesce(volatility, F.lit(0.0)), F.lit(0.0)) * multiplier}
    return F.when((notional > 0) & (shares > 0), kinds[model]).otherwise(0.0)


def constrain(requested: Column, price: Column, adv: Column, side: Column, held: Column, equity: Column, participation: float = 0.1, max_weight: float = 0.2, min_shares: int = 1, min_notional: float = 50.0) -> dict[str, Column]:
    """Quantity that may trade and why: no price, volume cap, position cap (buys), minimum sizes."""
    capped = F.when(adv > 0, F.least(requested, F.floor(adv * participation))).otherwise(requested)
    room = F.floor(F.greatest(F.lit(0.0), max_weight * equity - F.greatest(held, F.lit(0)) * price) / price)
    capped = F.when((F.upper(side) == "BUY") & (equity > 0), F.least(capped, room)).otherwise(capped)
    no_price = price.isNull() | (price <= 0)
    status = F.when(no_price, "SKIPPED_NO_PRICE").when(capped < min_shares, "SKIPPED_MINIMUM_SHARES").when(capped * price < min_notional, "SKIPPED_MIN_NOTIONAL").when(capped == requested, "OK").otherwise("ADJUSTED_BY_CONSTRAINTS")
    return {"status": status, "quantity": F.when(status.startswith("SKIPPED"), 0).otherwise(capped).cast("long")}


def liquidity(bars: DataFrame, n: int = 20) -> DataFrame:
    """Of each symbol's last n bars with volume: mean volume, mean notional, volatility of returns."""
    back = Window.partitionBy("symbol").orderBy(F.desc("date"))
    d = bars.withColumn("k", F.row_number().over(back)).filter(F.col("k") <= n).filter((F.col("volume") > 0) & (F.col("close") > 0))
    d = d.withColumn("ret", F.col("close") / F.lag("close", 1).over(by_symbol()) - 1)
    return d.groupBy("symbol").agg(F.avg("volume").alias("adv"), F.avg(F.col("volume") * F.col("close")).alias("avg_notional"), F.stddev_samp("ret").alias("volatility"), F.count("*").alias("n_rows"))


def aligned_returns(bars: DataFrame) -> DataFrame:
    """Returns of the dates that every symbol has."""
    n = bars.select(F.count_distinct("symbol").alias("n_all"))
    d = bars.join(F.broadcast(n), F.lit(True))  # a single row
    w = Window.partitionBy("date")
    d = d.withColumn("here", F.count("*").over(w)).filter("here = n_all").select("symbol", "date", "close")
    return d.withColumn("ret", F.col("close") / F.lag("close", 1).over(by_symbol()) - 1).filter("ret is not null")


def covariance(returns: DataFrame, shrink: float = 0.0) -> DataFrame:
    """(a, b, cov) of aligned returns; off-diagonal entries times 1 - shrink."""
    c = covariance_tiles(returns, "ret").select("a", "b", "cov")
    return c.withColumn("cov", F.when(F.col("a") == F.col("b"), F.col("cov")).otherwise(F.col("cov") * (1 - shrink)))


def recent_covariance(bars: DataFrame, end: str, lookback: int = 252, shrink: float = 0.4) -> DataFrame:
    """(a, b, cov) of each symbol's last ``lookback`` returns up to ``end``, over the dates that all of them have.

    Bars of three times as many calendar days are looked at; a symbol with fewer than a third of ``lookback``
    rows or returns is left out.  Alignment by all dates, with gaps dropped, gives the same rows and so needs no
    second path.  Without a date in common, or with one alone, there is no covariance.
    """
    least = lookback // 3
    last = F.lit(end).cast("date")
    d = bars.filter(F.col("close").isNotNull() & F.col("date").between(F.date_sub(last, 3 * lookback), last)).select("symbol", "date", "close")
    own = Window.partitionBy("symbol")
    d = d.withColumn("n", F.count("*").over(own)).filter(F.col("n") >= least)
    d = d.withColumn("ret", div(F.col("close"), F.lag("close", 1).over(by_symbol())) - 1).filter("ret is not null")
    d = d.withColumn("k", F.row_number().over(own.orderBy(F.desc("date")))).filter(F.col("k") <= lookback)
    d = d.withColumn("n", F.count("*").over(own)).filter(F.col("n") >= least).select("symbol", "date", "ret")
    every = d.select(F.count_distinct("symbol").alias("n_all"))  # a single row
    here = F.count("*").over(Window.partitionBy("date"))
    d = d.withColumn("here", here).join(F.broadcast(every), F.lit(True)).filter("here = n_all").select("symbol", "date", "ret")
    return covariance(d, shrink)


def inverse_volatility(returns: DataFrame, cash: float = 0.0) -> DataFrame:
    v = returns.groupBy("symbol").agg(F.stddev_samp("ret").alias("vol"))
    v = v.withColumn("inv", F.when(F.col("vol") > 0, 1 / F.col("vol")).otherwise(1.0))
    return v.withColumn("weight", F.col("inv") / F.sum("inv").over(Window.partitionBy()) * (1 - cash)).select("symbol", "vol", "weight")


def constrain_weights(weights: DataFrame, max_position: float, max_sector: float, cash: float) -> DataFrame:
    """(symbol, sector, weight): position cap, then sector cap (unknown sectors free), then cash floor."""
    d = weights.withColumn("w", F.least(F.greatest("weight", F.lit(0.0)), F.lit(max_position)))
    s = F.sum("w").over(Window.partitionBy("sector"))
    d = d.withColumn("w", F.when((F.coalesce("sector", F.lit("Unknown")) != "Unknown") & (s > max_sector), F.col("w") * max_sector / s).otherwise(F.col("w")))
    t = F.sum("w").over(Window.partitionBy())
    d = d.withColumn("w", F.when(t > 1 - cash, F.col("w") * (1 - cash) / t).otherwise(F.col("w")))
    return d.select("symbol", "sector", F.bround("w", 6).alias("weight")).filter("weight > 0")


def optimise(cov_rows: DataFrame, mode: str, rounds: int = 250) -> DataFrame:
    """(run, a, b, cov) -> (run, symbol, weight): equal, risk_adjusted, min_variance or risk_parity; a matrix a run."""
    if mode not in ("equal", "risk_adjusted", "min_variance", "risk_parity"):
        raise ValueError(f"unknown mode {mode}")
    import numpy as np
    import pandas as pd

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="a", columns="b", values="cov").sort_index().sort_index(axis=1)
        c, n = m.to_numpy(float), len(m)
        if mode == "min_variance":
            raw = np.linalg.pinv(c + 1e-8 * np.eye(n)) @ np.ones(n)
            w = np.clip(raw / raw.sum(), 0, None)
            w = w / w.sum() if w.sum() > 0 else np.full(n, 1 / n)
        elif mode == "risk_adjusted":
            w = 1 / np.maximum(np.sqrt(np.maximum(np.diag(c), 0)), 1e-4)
            w = w / w.sum()
        else:
            w = np.full(n, 1 / n)
            for _ in range(rounds if mode == "risk_parity" else 0):
                share = w * (c @ w)
                share = share / share.sum()
                w = w * (1 / n / np.maximum(share, 1e-8)) ** 0.35
                w = w / w.sum()
                if np.abs(share - 1 / n).max() < 0.01:
                    break
        return pd.DataFrame({"run": pdf["run"].iloc[0], "symbol": m.index, "weight": np.round(w, 6)})

    return cov_rows.groupBy("run").applyInPandas(solve, "run string, symbol string, weight double")


def risk_contributions(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """Share of the portfolio's variance that each symbol brings."""
    w = weights.select("symbol", "weight")
    d = cov.join(w.withColumnsRenamed({"symbol": "a", "weight": "wa"}), "a").join(w.withColumnsRenamed({"symbol": "b", "weight": "wb"}), "b")
    part = d.groupBy("a").agg(F.sum(F.col("wa") * F.col("wb") * F.col("cov")).alias("part"))
    return part.select(F.col("a").alias("symbol"), div(F.col("part"), F.sum("part").over(Window.partitionBy())).alias("share"))


def risk_report(holdings: DataFrame, cash: float) -> DataFrame:
    """(symbol, sector, value) -> concentration and a score from 0 to 100."""
    total = F.sum("value").over(Window.partitionBy()) + cash
    d = holdings.withColumn("pct", F.col("value") / total * 100).withColumn("k", F.row_number().over(Window.orderBy(F.desc("value"), "symbol")))
    sector = d.groupBy("sector").agg(F.sum("pct").alias("p")).agg(F.max("p").alias("sector_pct"))
    r = d.agg(F.max("pct").alias("single_pct"), F.sum(F.when(F.col("k") <= 5, F.col("pct"))).alias("top5_pct"), (100 - F.sum("pct")).alias("cash_pct")).join(F.broadcast(sector), F.lit(True))
    share = lambda c, cap, points: F.least(F.col(c) / cap, F.lit(1.0)) * points
    cash_risk = F.when(F.col("cash_pct") < 5, (5 - F.col("cash_pct")) / 5 * 15).when(F.col("cash_pct") > 50, F.least((F.col("cash_pct") - 50) / 50, F.lit(1.0)) * 15).otherwise(0.0)
    return r.withColumn("score", F.bround(F.least(share("single_pct", 50.0, 35.0) + share("sector_pct", 75.0, 30.0) + share("top5_pct", 100.0, 20.0) + cash_risk, F.lit(100.0)), 2))


def sma_signals(bars: DataFrame, short: int, long: int) -> DataFrame:
    """Rows where the short average crosses the long one."""
    mean = lambda n: F.when(F.count("close").over(by_symbol().rowsBetween(-(n - 1), 0)) >= n, F.avg("close").over(by_symbol().rowsBetween(-(n - 1), 0)))
    d = bars.select("symbol", "date", "close", mean(short).alias("s"), mean(long).alias("l"))
    ps, pl = F.lag("s").over(by_symbol()), F.lag("l").over(by_symbol())
    side = F.when((ps <= pl) & (F.col("s") > F.col("l")), "BUY").when((ps >= pl) & (F.col("s") < F.col("l")), "SELL")
    return d.withColumn("side", side)


def sma_backtest(signals: DataFrame, cash: float = 100000.0, commission: float = 0.0) -> DataFrame:
    """All in on a cross up, all out on a cross down: an account folded along each symbol's rows.

    The fold is an aggregate over the symbol's ordered array: no Python.
    """
    rows = F.array_sort(F.collect_list(F.struct("date", "close", "side")))
    start = F.struct(F.lit(float(cash)).alias("cash"), F.lit(0).cast("long").alias("qty"), F.lit(0).alias("trades"))

    def step(a, x):
        n = F.floor((a["cash"] - commission) / x["close"]).cast("long")
        buy = (F.coalesce(x["side"], F.lit("")) == "BUY") & (a["qty"] == 0) & (n > 0)
        sell = (F.coalesce(x["side"], F.lit("")) == "SELL") & (a["qty"] > 0)
        left = F.when(buy, a["cash"] - n * x["close"] - commission).when(sell, a["cash"] + a["qty"] * x["close"] - commission).otherwise(a["cash"])
        return F.struct(left.alias("cash"), F.when(buy, n).when(sell, F.lit(0).cast("long")).otherwise(a["qty"]).alias("qty"), (a["trades"] + (buy | sell).cast("int")).alias("trades"))

    d = signals.groupBy("symbol").agg(rows.alias("rows")).withColumn("a", F.aggregate("rows", start, step))
    last = F.element_at("rows", -1)["close"]
    return d.select("symbol", (F.col("a.cash") + F.col("a.qty") * last).alias("final_value"), F.col("a.qty").alias("position"), F.col("a.trades").alias("trades"))


def simulate(targets: DataFrame, prices: DataFrame, cash: float = 1_000_000.0, rate: float = 0.001) -> DataFrame:
    """Account of each run along its dates: targets of a date trade at the next date's prices.

    targets (run, date, symbol, weight); prices (date, symbol, close).  All signals are relational; only
    the account, whose cash and positions carry over, is folded, one run a task.
    """
    import pandas as pd

    runs = targets.select("run").distinct()
    tape = prices.crossJoin(F.broadcast(runs)).join(targets.withColumnRenamed("date", "d").select("run", F.col("d").alias("date"), "symbol", "weight"), ["run", "date", "symbol"], "left")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, int] = {}
        last: dict[str, float] = {}
        money, pending, out = cash, None, []
        for date, day in pdf.sort_values(["date", "symbol"]).groupby("date", sort=True):
            price = dict(zip(day["symbol"], day["close"]))
            last |= price
            cost = 0.0
            if pending is not None:
                equity = money + sum(q * last[s] for s, q in held.items())
                want = {s: int(equity * w // price[s]) for s, w in pending.items() if s in price}
                for s in sorted(set(held) | set(want)):  # sells come first
                    q = held.get(s, 0) - want.get(s, 0)
                    if q > 0 and s in price:
                        fee = q * price[s] * rate
                        money, cost = money + q * price[s] - fee, cost + fee
                        held[s] -= q
                for s in sorted(want):
                    q = want[s] - held.get(s, 0)
                    if q > 0:
                        q = min(q, int(money // (price[s] * (1 + rate))))
                        if q > 0:
                            fee = q * price[s] * rate
                            money, cost = money - q * price[s] - fee, cost + fee
                            held[s] = held.get(s, 0) + q
                held = {s: q for s, q in held.items() if q}
            due = day[day["weight"].notna()]
            pending = dict(zip(due["symbol"], due["weight"])) if len(due) else None
            out.append((pdf["run"].iloc[0], date, money, money + sum(q * last[s] for s, q in held.items()), cost, len(held)))
        return pd.DataFrame(out, columns=["run", "date", "cash", "equity", "cost", "n_positions"])

    return tape.groupBy("run").applyInPandas(fold, "run string, date date, cash double, equity double, cost double, n_positions long")


def windows(start: dt.date, end: dt.date, train_days: int, test_days: int, purge: int = 0, embargo: int = 0) -> list[tuple]:
    """Rolling folds: (fold, train_start, train_end, test_start, test_end), in calendar days."""
    span = train_days + embargo + test_days
    folds = max(0, ((end - start).days + 1 - span) // test_days + 1)  # each fold starts test_days after the one before
    on = lambda k, n: start + dt.timedelta(days=k * test_days + n)
    return [(k, on(k, 0), on(k, max(0, train_days - 1 - purge)), on(k, train_days + embargo), on(k, span - 1)) for k in range(folds)]


def auto_purge(purge: int, embargo: int, horizon: int) -> int:
    """Without purge and embargo the factor's horizon is purged, so that no label reaches into the test."""
    return horizon if purge == embargo == 0 else purge


def fold_ic(ic: DataFrame, folds: DataFrame) -> DataFrame:
    """Daily ICs by fold and side; the folds are a few rows, broadcast as a range join."""
    sides = folds.select("fold", F.explode(F.array(F.struct(F.lit("train").alias("side"), F.col("train_start").alias("lo"), F.col("train_end").alias("hi")), F.struct(F.lit("test").alias("side"), F.col("test_start").alias("lo"), F.col("test_end").alias("hi")))).alias("x")).select("fold", "x.*")
    j = ic.join(F.broadcast(sides), ic.signal_date.between(F.col("lo"), F.col("hi")))
    return j.groupBy("fold", "side").agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.count("ic").alias("n_dates"))


def quality(bars: DataFrame, today: str) -> DataFrame:
    """Nine checks a symbol, each PASS, WARNING or FAIL, and the worst."""
    prices = [F.col(c) for c in ("open", "high", "low", "close", "adj_close")]
    bad = prices[0] <= 0
    for p in prices[1:]:
        bad = bad | (p <= 0)
    d = bars.withColumn("ret", F.col("close") / F.lag("close", 1).over(by_symbol()) - 1).withColumn("gap", F.date_diff("date", F.lag("date").over(by_symbol())))
    g = d.groupBy("symbol").agg(
        F.count("*").alias("n_rows"), F.count_distinct("date").alias("n_dates"), F.min("date").alias("lo"), F.max("date").alias("hi"),
        F.count_distinct(F.when(F.weekday("date") < 5, F.col("date"))).alias("weekdays"),
        F.count_if(F.abs("ret") > 0.25).alias("outliers"), F.count_if(bad).alias("bad_prices"), F.count_if(F.coalesce("volume", F.lit(0)) == 0).alias("zero_volume"),
        F.count_if(F.col("gap") > 5).alias("gaps"), F.count_if(F.col("adj_close").isNull()).alias("no_adj"),
    )
    span = F.size(F.filter(F.sequence("lo", "hi"), lambda x: F.weekday(x) < 5))
    g = g.withColumn("missing_ratio", F.bround((span - F.col("weekdays")) / F.greatest(span, F.lit(1)), 6)).withColumn("duplicates", F.col("n_rows") - F.col("n_dates")).withColumn("stale_days", F.date_diff(F.lit(today).cast("date"), F.col("hi")))
    above = lambda c, warn, fail: F.when(F.col(c) > fail, 2).when(F.col(c) > warn, 1).otherwise(0)
    level = F.greatest(
        F.when(F.col("missing_ratio") >= 0.20, 2).when(F.col("missing_ratio") > 0.05, 1).otherwise(0), above("duplicates", 0, 0), above("outliers", 0, 3), above("bad_prices", 0, 0), above("zero_volume", 0, 5),
        F.when(F.col("n_rows") < 20, 2).when(F.col("n_rows") < 60, 1).otherwise(0), above("gaps", 0, 3), above("stale_days", 10, 45), above("no_adj", 0, 0),
    )
    return g.withColumn("status", F.element_at(F.array(F.lit("PASS"), F.lit("WARNING"), F.lit("FAIL")), level + 1)).select("symbol", "n_rows", "missing_ratio", "duplicates", "outliers", "bad_prices", "zero_volume", "gaps", "stale_days", "no_adj", "status")


def drawdowns(returns: DataFrame) -> DataFrame:
    """(date, ret) of one series -> compounded equity and its fall from the peak (1 at least)."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = returns.withColumn("equity", F.product(1 + F.col("ret")).over(w))
    return d.withColumn("drawdown", F.col("equity") / F.greatest(F.max("equity").over(w), F.lit(1.0)) - 1)


def return_stats(returns: DataFrame) -> DataFrame:
    """Total, annual, volatility, Sharpe, Sortino, Calmar, drawdown, hit rate, win/loss of one series."""
    d = drawdowns(returns)
    r, loss, win = F.col("ret"), F.when(F.col("ret") < 0, F.col("ret")), F.when(F.col("ret") > 0, F.col("ret"))
    a = d.agg(F.count("*").alias("n"), (F.product(1 + r) - 1).alias("total_return"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.stddev_samp(loss).alias("down"), F.min("drawdown").alias("max_drawdown"), F.avg((r > 0).cast("double")).alias("hit_rate"), F.avg(win).alias("average_win"), F.avg(loss).alias("average_loss"))
    a = a.withColumn("annual_return", F.when(F.col("total_return") <= -1, -1.0).otherwise(F.pow(1 + F.col("total_return"), F.lit(DAYS) / F.col("n")) - 1))
    ratio = lambda c: F.when(F.col(c) > 0, F.try_divide(F.col("mean"), F.col(c)) * F.sqrt(F.lit(DAYS)))
    return a.select("n", "total_return", "annual_return", (F.col("std") * F.sqrt(F.lit(DAYS))).alias("volatility"), ratio("std").alias("sharpe"), ratio("down").alias("sortino"), div(F.col("annual_return"), F.abs("max_drawdown")).alias("calmar"), "max_drawdown", "hit_rate", "average_win", "average_loss", div(F.col("average_win"), F.abs("average_loss")).alias("win_loss_ratio"))


def health_score(icir: Column, coverage: Column, stability: Column, drawdown: Column) -> Column:
    """0 to 100 from ratio, coverage, stability and drawdown, each held to 0..1."""
    unit = lambda c: F.coalesce(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    fall = F.when(drawdown.isNull(), 0.5).otherwise(F.least(F.greatest(1 + drawdown, F.lit(0.0)), F.lit(1.0)))
    return F.bround((0.35 * F.when(icir.isNull(), 0.0).otherwise(unit(icir)) + 0.30 * F.when(coverage.isNull(), 0.0).otherwise(unit(coverage)) + 0.25 * F.when(stability.isNull(), 0.0).otherwise(unit(stability)) + 0.10 * fall) * 100, 6)
