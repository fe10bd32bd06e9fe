"""Queries over regimes, costs, portfolios, simulation, quality and walk-forward, each with its SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import backtest, crosssection, evaluate, markets
from ..operators.asof import as_of_few
from ..sources import panel
from ..sources.panel import BARS, FUND, SECTORS
from .research import ASSIGN, IC, OBS, PER, R, R9, _composite, _rounded, assigned, bars, obs

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


BENCH = f"{BARS}, bench as (select date, avg(close) as close from bars where close > 0 group by date)"
FEAT = """ret0 as (select date, close, close / lag(close) over (order by date) - 1 as market_return, count(*) over () as total from bench),
feat as (select date, close, market_return,
  case when count(market_return) over (order by date rows 19 preceding) >= 10 then stddev_samp(market_return) over (order by date rows 19 preceding) * sqrt(252) end as volatility,
  case when count(close) over (order by date rows 199 preceding) >= greatest(20, floor(least(200, total) / 2)) then avg(close) over (order by date rows 199 preceding) end as moving_average,
  close / lag(close, 60) over (order by date) - 1 as trend_strength, close / max(close) over (order by date) - 1 as drawdown from ret0),
reg as (select *, case when close is null or moving_average is null or volatility is null or trend_strength is null or drawdown is null then 'UNKNOWN'
  when drawdown <= -0.20 and (volatility >= 0.25 or coalesce(market_return, 0) <= -0.08) then 'CRISIS'
  when drawdown <= -0.10 and trend_strength > 0.05 and coalesce(market_return, 0) > 0 then 'RECOVERY' when volatility >= 0.25 then 'HIGH_VOL'
  when volatility <= 0.12 and abs(trend_strength) < 0.05 then 'LOW_VOL' when close > moving_average and trend_strength > 0 then 'BULL'
  when close < moving_average and trend_strength < 0 then 'BEAR' when abs(trend_strength) >= 0.05 then 'TRENDING' else 'RANGE_BOUND' end as regime from feat)"""


def bench(spark, d):
    return bars(spark, d).groupBy("date").agg(F.avg("close").alias("close"))


def regimes(spark, d):
    return markets.classify(markets.regime_features(bench(spark, d)))


@query("regime_features", f"with {BENCH}, {FEAT} select date, {', '.join(f'{R(c)} as {c}' for c in ['volatility', 'moving_average', 'trend_strength', 'drawdown', 'market_return'])} from feat")
def regime_features(spark, d):
    return _rounded(markets.regime_features(bench(spark, d)).drop("close"), "date")


@query("regime_classify", f"with {BENCH}, {FEAT} select date, regime, case when regime = 'UNKNOWN' then 0.0 else {R('least(1.0, 0.35 + abs(trend_strength) * 2 + abs(drawdown) + least(greatest(volatility, 0), 1) * 0.35)')} end as confidence from reg")
def regime_classify(spark, d):
    return regimes(spark, d).select("date", "regime", "confidence")


@query("regime_counts", f"with {BENCH}, {FEAT} select regime, count(*) as n, min(date) as first_date, max(date) as last_date from reg group by 1")
def regime_counts(spark, d):
    return regimes(spark, d).groupBy("regime").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


FBR = f"with {OBS('momentum_20d', [20])}, bench as (select date, avg(close) as close from bars where close > 0 group by date), {FEAT}, {IC}"


@query("regime_asof_join", f"with {BENCH}, {FEAT}, sig as (select distinct date + 3 as date from bars) select s.date, r.date as regime_date, r.regime from sig s asof left join reg r on s.date >= r.date")
def regime_asof_join(spark, d):
    sig = bars(spark, d).select(F.date_add("date", 3).alias("date")).distinct()
    r = regimes(spark, d).select(F.col("date").alias("regime_date"), "regime")
    return as_of_few(sig, r, "date", "regime_date").select("date", "regime_date", "regime")


@query("factor_by_regime", f"{FBR}, j as (select regime, ic, rank_ic from ic join reg on ic.signal_date = reg.date) select regime, {R('avg(ic)')} as ic_mean, {R('avg(rank_ic)')} as rank_ic_mean, {R('avg(rank_ic) / nullif(stddev_samp(rank_ic), 0)')} as icir, count(ic) as n_dates from j group by 1 having count(ic) >= 2")
def factor_by_regime(spark, d):
    ic = evaluate.daily_ic(obs(spark, d, "momentum_20d", [20]))
    r = regimes(spark, d).select(F.col("date").alias("regime_date"), "regime")
    j = as_of_few(ic, r, "signal_date", "regime_date")
    std = F.stddev_samp("rank_ic")
    out = j.groupBy("regime").agg(F.avg("ic").alias("ic_mean"), F.avg("rank_ic").alias("rank_ic_mean"), F.when(std > 0, F.try_divide(F.avg("rank_ic"), std)).alias("icir"), F.count("ic").alias("n_dates"))
    return _rounded(out.filter("n_dates >= 2"), "regime")


TRADES = """tr as (select l_orderkey, l_linenumber, l_quantity as shares, l_extendedprice as notional, l_extendedprice / l_quantity as price, 200.0 + p_size * 10 as adv, l_discount as vol,
 case when l_returnflag = 'R' then 'SELL' else 'BUY' end as side from lineitem join part on l_partkey = p_partkey)"""


def trades(spark, d):
    item = spark.read.parquet(f"{d}/lineitem.parquet")
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size")
    j = item.join(part, item.l_partkey == part.p_partkey)
    return j.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("shares"), F.col("l_extendedprice").alias("notional"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (200.0 + F.col("p_size") * 10).alias("adv"), F.col("l_discount").alias("vol"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"))


@query("cost_estimate", f"""with {TRADES}, c as (select *, shares / adv as p, greatest(notional * 0.0005, 1.0) as commission, notional * 5.0 / 10000 as slippage,
 notional * greatest(2.0 * (1 + sqrt(shares / adv)) + greatest(vol, 0) * 10000 * 0.05 * sqrt(shares / adv), 0) / 10000 as impact from tr)
select l_orderkey, l_linenumber, {R9('commission')} as commission, {R9('slippage')} as slippage, {R9('impact')} as impact, {R9('1.0 + commission + slippage + impact')} as total_cost from c""")
def cost_estimate(spark, d):
    c = markets.cost_columns(F.col("notional"), F.col("shares") / F.col("adv"), F.col("vol"))
    return trades(spark, d).select("l_orderkey", "l_linenumber", *[F.bround(c[n], 9).alias(n) for n in ("commission", "slippage", "impact", "total_cost")])


@query("cost_by_side", f"""with {TRADES} select side, count(*) as n, {R('sum(greatest(notional * 0.001, 1.0) + 1.0 + notional * 5.0 / 10000) / sum(notional)')} as cost_share from tr group by 1""")
def cost_by_side(spark, d):
    c = markets.cost_columns(F.col("notional"), F.col("shares") / F.col("adv"), F.col("vol"), "conservative")
    return _rounded(trades(spark, d).groupBy("side").agg(F.count("*").alias("n"), (F.sum(c["total_cost"]) / F.sum("notional")).alias("cost_share")), "side")


@query("slippage_models", f"""with {TRADES} select side, {R('sum(notional * 5.0 / 10000)')} as bps, {R('sum(notional * (10.0 * shares / adv) / 10000)')} as volume_scaled, {R('sum(notional * vol * 0.1)')} as volatility_scaled, {R('sum(1.0)')} as fixed from tr group by 1""")
def slippage_models(spark, d):
    s = lambda m: F.sum(markets.slippage(m, F.col("notional"), F.col("shares"), F.col("adv"), F.col("vol"))).alias(m)
    return _rounded(trades(spark, d).groupBy("side").agg(*[s(m) for m in ("bps", "volume_scaled", "volatility_scaled", "fixed")]), "side")


@query("execution_constraints", f"""with {TRADES}, c as (select *, least(shares, floor(adv * 0.1)) as q1 from tr),
c2 as (select *, case when side = 'BUY' then least(q1, floor(greatest(0.0, 0.2 * 100000.0 - 5 * price) / price)) else q1 end as q2 from c),
c3 as (select *, case when q2 < 1 then 'SKIPPED_MINIMUM_SHARES' when q2 * price < 50 then 'SKIPPED_MIN_NOTIONAL' when q2 = shares then 'OK' else 'ADJUSTED_BY_CONSTRAINTS' end as status from c2)
select l_orderkey, l_linenumber, status, cast(case when status like 'SKIPPED%' then 0 else q2 end as bigint) as quantity from c3""")
def execution_constraints(spark, d):
    c = markets.constrain(F.col("shares"), F.col("price"), F.col("adv"), F.col("side"), F.lit(5), F.lit(100000.0))
    return trades(spark, d).select("l_orderkey", "l_linenumber", c["status"].alias("status"), c["quantity"].alias("quantity"))


@query("liquidity_snapshot", f"""with {BARS}, l as (select * from (select *, row_number() over (partition by symbol order by date desc) as k from bars) where k <= 20 and volume > 0 and close > 0),
r as (select *, close / lag(close) over (partition by symbol order by date) - 1 as ret from l)
select symbol, {R('avg(volume)')} as adv, {R('avg(volume * close)')} as avg_notional, {R('stddev_samp(ret)')} as volatility, count(*) as n_rows from r group by 1""")
def liquidity_snapshot(spark, d):
    return _rounded(markets.liquidity(panel.bars(spark, d)), "symbol")


AL = f"""{BARS}, pos as (select * from bars where close > 0), al as (select symbol, date, close from (select *, count(*) over (partition by date) as here, (select count(distinct symbol) from pos) as n_all from pos) where here = n_all),
ar as (select * from (select symbol, date, close / lag(close) over (partition by symbol order by date) - 1 as ret from al) where ret is not null)"""


def returns(spark, d):
    return markets.aligned_returns(bars(spark, d))


@query("covariance_matrix", f"with {AL} select x.symbol as a, y.symbol as b, {R('covar_samp(x.ret, y.ret)')} as cov from ar x join ar y on x.date = y.date group by 1, 2")
def covariance_matrix(spark, d):
    return _rounded(markets.covariance(returns(spark, d)), "a", "b")


@query("covariance_shrunk", f"with {AL} select x.symbol as a, y.symbol as b, {R('covar_samp(x.ret, y.ret) * case when x.symbol = y.symbol then 1 else 0.6 end')} as cov from ar x join ar y on x.date = y.date group by 1, 2")
def covariance_shrunk(spark, d):
    return _rounded(markets.covariance(returns(spark, d), 0.4), "a", "b")


IV = "iv as (select symbol, vol, (1 / vol) / sum(1 / vol) over () as weight from (select symbol, stddev_samp(ret) as vol from ar group by 1))"


@query("weights_inverse_volatility", f"with {AL}, {IV} select symbol, {R('vol')} as vol, {R('weight')} as weight from iv")
def weights_inverse_volatility(spark, d):
    return _rounded(markets.inverse_volatility(returns(spark, d)), "symbol")


@query("weights_constrained", f"""with {AL}, {SECTORS}, {IV}, s1 as (select symbol, sector, least(weight, 0.045) as w from iv join sectors using (symbol)),
s2 as (select *, case when sum(w) over (partition by sector) > 0.3 then w * 0.3 / sum(w) over (partition by sector) else w end as w2 from s1),
s3 as (select *, case when sum(w2) over () > 0.9 then w2 * 0.9 / sum(w2) over () else w2 end as w3 from s2)
select symbol, sector, {R('w3')} as weight from s3""")
def weights_constrained(spark, d):
    w = markets.inverse_volatility(returns(spark, d)).join(panel.sectors(spark, d), "symbol")
    return markets.constrain_weights(w, 0.045, 0.3, 0.1)


@query("risk_contributions", f"with {AL}, {IV}, c as (select x.symbol as a, y.symbol as b, covar_samp(x.ret, y.ret) as cov from ar x join ar y on x.date = y.date group by 1, 2), p as (select a, sum(i.weight * j.weight * cov) as part from c join iv i on i.symbol = a join iv j on j.symbol = b group by 1) select a as symbol, {R('part / sum(part) over ()')} as share from p")
def risk_contributions(spark, d):
    r = returns(spark, d)
    return _rounded(markets.risk_contributions(markets.covariance(r), markets.inverse_volatility(r)), "symbol")


@query("weights_min_variance")
def weights_min_variance(spark, d):
    return markets.optimise(markets.covariance(returns(spark, d)).withColumn("run", F.lit("all")), "min_variance")


@query("weights_risk_parity")
def weights_risk_parity(spark, d):
    return markets.optimise(markets.covariance(returns(spark, d)).withColumn("run", F.lit("all")), "risk_parity")


@query("risk_report", f"""with {BARS}, {SECTORS}, h as (select symbol, sector, sum(volume * close) as value from bars join sectors using (symbol) group by 1, 2),
p as (select *, value / (sum(value) over () + 1000000.0) * 100 as pct, row_number() over (order by value desc, symbol) as k from h),
m as (select max(pct) as single_pct, sum(pct) filter (k <= 5) as top5_pct, 100 - sum(pct) as cash_pct, (select max(s) from (select sum(pct) as s from p group by sector)) as sector_pct from p)
select {R('single_pct')} as single_pct, {R('top5_pct')} as top5_pct, {R('cash_pct')} as cash_pct, {R('sector_pct')} as sector_pct,
 cast(round_even(least(least(single_pct / 50, 1) * 35 + least(sector_pct / 75, 1) * 30 + least(top5_pct / 100, 1) * 20 + case when cash_pct < 5 then (5 - cash_pct) / 5 * 15 when cash_pct > 50 then least((cash_pct - 50) / 50, 1) * 15 else 0 end, 100), 2) as double) as score from m""")
def risk_report(spark, d):
    h = panel.bars(spark, d).join(panel.sectors(spark, d), "symbol").groupBy("symbol", "sector").agg(F.sum(F.col("volume") * F.col("close")).alias("value"))
    return _rounded(markets.risk_report(h, 1_000_000.0))


@query("sma_signals", f"""with {BARS}, m as (select symbol, date, case when count(*) over w5 >= 5 then avg(close) over w5 end as s, case when count(*) over w20 >= 20 then avg(close) over w20 end as l from bars where close > 0
 window w5 as (partition by symbol order by date rows 4 preceding), w20 as (partition by symbol order by date rows 19 preceding)),
x as (select *, lag(s) over (partition by symbol order by date) as ps, lag(l) over (partition by symbol order by date) as pl from m)
select symbol, date, case when ps <= pl and s > l then 'BUY' else 'SELL' end as side from x where (ps <= pl and s > l) or (ps >= pl and s < l)""")
def sma_signals(spark, d):
    return markets.sma_signals(bars(spark, d), 5, 20).filter("side is not null").select("symbol", "date", "side")


@query("sma_backtest")
def sma_backtest(spark, d):
    return _rounded(markets.sma_backtest(markets.sma_signals(bars(spark, d), 5, 20)), "symbol")


@query("portfolio_simulation")
def portfolio_simulation(spark, d):
    t = crosssection.target_weights(_composite(spark, d), "composite", 5, 0.2, 0.05)
    w = Window.partitionBy(F.trunc("date", "MM"))
    t = t.withColumn("first", F.min("date").over(w)).filter("date = first").select(F.lit("top5").alias("run"), "date", "symbol", "weight")
    return _rounded(markets.simulate(t, bars(spark, d).select("date", "symbol", "close")), "run", "date")


@query("rebalance_dates", f"with {BARS}, x as (select distinct date from bars) select min(date) as date from x group by date_trunc('month', date)")
def rebalance_dates(spark, d):
    return panel.bars(spark, d).select("date").distinct().groupBy(F.trunc("date", "MM").alias("m")).agg(F.min("date").alias("date")).select("date")


FOLDS = markets.windows(dt.date(1995, 1, 1), dt.date(2001, 12, 31), 730, 365, 20, 5)


@query("walk_forward_ic", f"""with {OBS('momentum_20d', [20])}, {IC}, folds(fold, a, b, c, e) as (values {', '.join(f"({k}, date '{a}', date '{b}', date '{c}', date '{e}')" for k, a, b, c, e in FOLDS)}),
s as (select fold, 'train' as side, a as lo, b as hi from folds union all select fold, 'test', c, e from folds)
select fold, side, {R('avg(ic)')} as ic_mean, {R('stddev_samp(ic)')} as ic_std, count(ic) as n_dates from ic join s on signal_date between lo and hi group by 1, 2""")
def walk_forward_ic(spark, d):
    folds = spark.createDataFrame(FOLDS, "fold int, train_start date, train_end date, test_start date, test_end date")
    return _rounded(markets.fold_ic(evaluate.daily_ic(obs(spark, d, "momentum_20d", [20])), folds), "fold", "side")


@query("data_quality", f"""with {BARS}, r as (select *, close / lag(close) over (partition by symbol order by date) - 1 as ret, date - lag(date) over (partition by symbol order by date) as gap from bars),
g as (select symbol, count(*) as n_rows, count(distinct date) as n_dates, min(date) as lo, max(date) as hi, count(distinct date) filter (isodow(date) < 6) as wd, count(*) filter (abs(ret) > 0.25) as outliers,
 count(*) filter (open <= 0 or high <= 0 or low <= 0 or close <= 0 or adj_close <= 0) as bad_prices, count(*) filter (coalesce(volume, 0) = 0) as zero_volume, count(*) filter (gap > 5) as gaps, count(*) filter (adj_close is null) as no_adj from r group by 1),
h as (select *, len(list_filter(generate_series(cast(lo as timestamp), cast(hi as timestamp), interval 1 day), lambda x: isodow(x) < 6)) as span from g),
k as (select *, {R('(span - wd) / cast(greatest(span, 1) as double)')} as missing_ratio, n_rows - n_dates as duplicates, cast(date '2001-11-10' - hi as integer) as stale_days from h)
select symbol, n_rows, missing_ratio, duplicates, outliers, bad_prices, zero_volume, gaps, stale_days, no_adj,
 case when missing_ratio >= 0.2 or duplicates > 0 or outliers > 3 or bad_prices > 0 or zero_volume > 5 or n_rows < 20 or gaps > 3 or stale_days > 45 or no_adj > 0 then 'FAIL'
  when missing_ratio > 0.05 or outliers > 0 or zero_volume > 0 or n_rows < 60 or gaps > 0 or stale_days > 10 then 'WARNING' else 'PASS' end as status from k""")
def data_quality(spark, d):
    return markets.quality(panel.bars(spark, d), "2001-11-10")


@query("coverage_ready", f"with {BARS}, n as (select symbol, count(*) as n from bars group by 1) select count(*) as symbols, count(*) filter (n >= 61) as ready, {R('avg(n)')} as average_history from n")
def coverage_ready(spark, d):
    return _rounded(panel.bars(spark, d).groupBy("symbol").count().agg(F.count("*").alias("symbols"), F.count_if(F.col("count") >= 61).alias("ready"), F.avg("count").alias("average_history")))


@query("fundamental_quality", f"""with {FUND}, x as (select symbol, fiscal_year * 4 + cast(substr(fiscal_quarter, 2) as integer) as seq, * exclude (symbol) from fund), y as (select *, seq - lag(seq) over (partition by symbol order by seq) as step from x)
select symbol, count(*) as n_rows, count(*) filter (step > 1) as missing_quarters, count(*) filter (report_date < fiscal_period_end) as early_reports, count(*) filter (revenue < 0) as negative_revenue, count(*) filter (abs(pe_ratio) > 500 or abs(current_ratio) > 500) as extreme_ratios, count(*) filter (current_ratio is null or quick_ratio is null) as missing_values from y group by 1""")
def fundamental_quality(spark, d):
    f = panel.fundamentals(spark, d).withColumn("seq", F.col("fiscal_year") * 4 + F.substring("fiscal_quarter", 2, 1).cast("int"))
    f = f.withColumn("step", F.col("seq") - F.lag("seq").over(Window.partitionBy("symbol").orderBy("seq")))
    return f.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.count_if(F.col("step") > 1).alias("missing_quarters"), F.count_if(F.col("report_date") < F.col("fiscal_period_end")).alias("early_reports"), F.count_if(F.col("revenue") < 0).alias("negative_revenue"), F.count_if((F.abs("pe_ratio") > 500) | (F.abs("current_ratio") > 500)).alias("extreme_ratios"), F.count_if(F.col("current_ratio").isNull() | F.col("quick_ratio").isNull()).alias("missing_values"))


SER = f"with {OBS('momentum_20d', [20])}, {ASSIGN(5)}, {PER.format(q=5)}, ser as (select signal_date as date, (long_return - short_return) / 20 as ret from per where long_return - short_return is not null)"


def series(spark, d):
    return backtest.periods(assigned(spark, d), 5).filter("long_short_return is not null").select(F.col("signal_date").alias("date"), (F.col("long_short_return") / 20).alias("ret"))


@query("strategy_returns_stats", f"""{SER}, e as (select date, ret, product(1 + ret) over (order by date) as eq from ser), f as (select *, eq / greatest(max(eq) over (order by date), 1) - 1 as dd from e),
ag as (select count(*) as n, product(1 + ret) - 1 as total_return, avg(ret) as mean, stddev_samp(ret) as std, stddev_samp(ret) filter (ret < 0) as down, min(dd) as max_drawdown, avg(cast(ret > 0 as double)) as hit_rate, avg(ret) filter (ret > 0) as average_win, avg(ret) filter (ret < 0) as average_loss from f),
b as (select *, case when total_return <= -1 then -1.0 else pow(1 + total_return, 252.0 / n) - 1 end as annual_return from ag)
select n, {R('total_return')} as total_return, {R('annual_return')} as annual_return, {R('std * sqrt(252)')} as volatility, {R('mean / nullif(std, 0) * sqrt(252)')} as sharpe, {R('mean / nullif(down, 0) * sqrt(252)')} as sortino,
 {R('annual_return / nullif(abs(max_drawdown), 0)')} as calmar, {R('max_drawdown')} as max_drawdown, {R('hit_rate')} as hit_rate, {R('average_win')} as average_win, {R('average_loss')} as average_loss, {R('average_win / nullif(abs(average_loss), 0)')} as win_loss_ratio from b""")
def strategy_returns_stats(spark, d):
    return _rounded(markets.return_stats(series(spark, d)))


@query("strategy_monthly_returns", f"{SER} select cast(date_trunc('month', date) as date) as month, {R('product(1 + ret) - 1')} as ret from ser group by 1")
def strategy_monthly_returns(spark, d):
    return _rounded(series(spark, d).groupBy(F.trunc("date", "MM").alias("month")).agg((F.product(1 + F.col("ret")) - 1).alias("ret")), "month")


@query("strategy_rolling", f"{SER} select date, {R('case when count(*) over w >= 20 then product(1 + ret) over w - 1 end')} as rolling_return, {R('case when count(*) over w >= 20 then avg(ret) over w / nullif(stddev_samp(ret) over w, 0) end')} as rolling_ratio from ser window w as (order by date rows 19 preceding)")
def strategy_rolling(spark, d):
    w = Window.orderBy("date").rowsBetween(-19, 0)
    n = F.count("*").over(w) >= 20
    std = F.stddev_samp("ret").over(w)
    return _rounded(series(spark, d).select("date", F.when(n, F.product(1 + F.col("ret")).over(w) - 1).alias("rolling_return"), F.when(n & (std > 0), F.try_divide(F.avg("ret").over(w), std)).alias("rolling_ratio")), "date")


@query("strategy_contributions", f"with {OBS('momentum_20d', [20])}, {ASSIGN(5)}, n as (select *, count(*) over (partition by signal_date, quantile) as m from a) select symbol, {R('sum(case when quantile = 5 then future_return / m else -future_return / m end)')} as contribution, count(*) as n_periods from n where quantile in (1, 5) group by 1")
def strategy_contributions(spark, d):
    a = assigned(spark, d).withColumn("m", F.count("*").over(Window.partitionBy("signal_date", "quantile"))).filter("quantile in (1, 5)")
    return _rounded(a.groupBy("symbol").agg(F.sum(F.when(F.col("quantile") == 5, F.col("future_return") / F.col("m")).otherwise(-F.col("future_return") / F.col("m"))).alias("contribution"), F.count("*").alias("n_periods")), "symbol")
