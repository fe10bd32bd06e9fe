"""Queries over factors, evaluation, backtest and cross-sections, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import backtest, crosssection, evaluate
from ..operators.asof import as_of
from ..operators.factors import FUNDAMENTAL, PRICE, REGISTRY, fundamental_factors, price_factors
from ..sources import panel
from ..sources.panel import BARS, FUND, SECTORS

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


R9 = lambda x: f"cast(round_even({x}, 9) as double)"
R = lambda x: f"cast(round_even({x}, 6) as double)"
WS = "partition by symbol order by date"
AVG_RANK = "(rank() over (partition by {k} order by {v}) + (count(*) over (partition by {k}, {v}) - 1) / 2.0)"
CORR = "covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0)"

RET = f"""rets as (select *, close / lag(close) over ({WS}) - 1 as ret from bars where close > 0)"""
FACTORS = f"""{RET},
base as (select symbol, date, close, ret, close / lag(close, 20) over ({WS}) - 1 as m20, close / lag(close, 60) over ({WS}) - 1 as m60,
  close / lag(close, 5) over ({WS}) - 1 as m5, close / lag(close, 120) over ({WS}) - 1 as m120,
  case when count(ret) over ({WS} rows 19 preceding) >= 20 then nullif(stddev_samp(ret) over ({WS} rows 19 preceding), 0) end as vol20,
  avg(cast(ret > 0 as double)) over ({WS} rows 19 preceding) as up20, avg(cast(ret > 0 as double)) over ({WS} rows 59 preceding) as up60,
  nullif(stddev_samp(ret) over ({WS} rows 59 preceding), 0) as std60, avg(ret) over ({WS} rows 59 preceding) as mean60,
  lag(close, 60) over ({WS}) as c60, list(close) over ({WS} rows 59 preceding) as cl from rets),
fac as (select symbol, date, close, m20 as momentum_20d, m60 as momentum_60d, vol20 as volatility_20d, m60 / vol20 as risk_adjusted_momentum,
  -m5 as reversal_5d, -m20 as reversal_20d, -vol20 as low_volatility_score,
  case when c60 is not null then 0.35 * m20 + 0.45 * m60 + 0.20 * up20 end as growth_price_proxy,
  case when c60 is not null then mean60 / std60 + up60 + list_min(list_transform(range(1, len(cl) + 1), lambda i: cl[i] / list_max(cl[1:i]) - 1)) end as quality_price_proxy,
  -m120 / std60 as value_price_proxy from base)"""


def bars(spark, d):
    return panel.clean(panel.bars(spark, d))


def factor_frame(spark, d, names):
    return price_factors(bars(spark, d), names)


@query("bars_panel", f"with {BARS} select symbol, date, {R9('open')} as open, {R9('high')} as high, {R9('low')} as low, {R9('close')} as close, volume from bars")
def bars_panel(spark, d):
    return panel.bars(spark, d).select("symbol", "date", *[F.bround(c, 9).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query("scan_latest_rows", f"with {BARS} select date, {R('close')} as close, volume from bars where symbol = 'Brand#11' order by date desc limit 10")
def scan_latest_rows(spark, d):
    return panel.bars(spark, d).filter("symbol = 'Brand#11'").orderBy(F.desc("date")).limit(10).select("date", r6("close").alias("close"), "volume")


@query("scan_range", f"with {BARS} select symbol, date, {R('close')} as close from bars where symbol = 'Brand#12' and date between date '1996-01-01' and date '1997-12-31'")
def scan_range(spark, d):
    return panel.bars(spark, d).filter("symbol = 'Brand#12' and date between date'1996-01-01' and date'1997-12-31'").select("symbol", "date", r6("close").alias("close"))


@query("scan_many_symbols", f"with {BARS}, u(symbol) as (values ('Brand#11'), ('Brand#23'), ('MISSING')) select u.symbol, count(date) as n_rows, max(date) as last_date from u left join bars b on u.symbol = b.symbol group by 1")
def scan_many_symbols(spark, d):
    wanted = [" brand#11", "BRAND#23", "Brand#11 ", "missing", ""]
    u = spark.createDataFrame([(i, s) for i, s in enumerate(wanted)], "ord int, s string").select("ord", F.upper(F.trim("s")).alias("key")).filter("key <> ''").groupBy("key").agg(F.min("ord").alias("ord"))
    b = panel.bars(spark, d).withColumn("key", F.upper("symbol"))
    return u.join(b, "key", "left").groupBy("key").agg(F.max("symbol").alias("s"), F.count("date").alias("n_rows"), F.max("date").alias("last_date")).select(F.coalesce("s", "key").alias("symbol"), "n_rows", "last_date")


@query("symbols_distinct", "select distinct p_brand as symbol from lineitem join part on l_partkey = p_partkey")
def symbols_distinct(spark, d):
    return panel.bars(spark, d).select("symbol").distinct()


@query("upsert_bars", f"""with {BARS}, new as (select symbol, date, close * 2 as close from bars where date >= date '1998-01-01'
  union all select symbol, date + 7000, close from bars where date >= date '1998-06-01')
select symbol, date, {R9('close')} as close from new union all select symbol, date, {R9('close')} from bars b where not exists (select 1 from new n where n.symbol = b.symbol and n.date = b.date)""")
def upsert_bars(spark, d):
    old = panel.bars(spark, d).select("symbol", "date", "close")
    new = old.filter("date >= date'1998-01-01'").withColumn("close", F.col("close") * 2).union(old.filter("date >= date'1998-06-01'").withColumn("date", F.date_add("date", 7000)))
    return panel.upsert(old, new, ["symbol", "date"]).select("symbol", "date", F.bround("close", 9).alias("close"))


@query("refresh_counts", f"""with {BARS}, f as (select symbol, date from bars where date >= date '1997-01-01'), s as (select symbol, date from bars where date < date '1997-07-01')
select f.symbol, count(*) filter (s.date is null) as inserted, count(s.date) as updated from f left join s on f.symbol = s.symbol and f.date = s.date group by 1""")
def refresh_counts(spark, d):
    b = panel.bars(spark, d)
    return panel.refresh_counts(b.filter("date < date'1997-07-01'"), b.filter("date >= date'1997-01-01'"))


@query("fundamentals_panel", f"with {FUND} select symbol, fiscal_period_end, report_date, fiscal_year, fiscal_quarter, {', '.join(f'{R(c)} as {c}' for c in ['pe_ratio', 'ev_to_ebitda', 'net_margin', 'revenue_growth', 'current_ratio'])} from fund")
def fundamentals_panel(spark, d):
    return panel.fundamentals(spark, d).select("symbol", "fiscal_period_end", "report_date", "fiscal_year", "fiscal_quarter", *[r6(c).alias(c) for c in ("pe_ratio", "ev_to_ebitda", "net_margin", "revenue_growth", "current_ratio")])


@query("fundamental_restated_upsert", f"""with {FUND}, o as (select symbol, fiscal_period_end, report_date from fund where fiscal_year < 1997),
n as (select symbol, fiscal_period_end, report_date + (case when fiscal_quarter = 'Q1' then -10 else 10 end) as report_date from fund where fiscal_year >= 1996)
select n.symbol, n.fiscal_period_end, n.report_date, case when o.symbol is null then 'inserted' when n.report_date < o.report_date then 'skipped' else 'updated' end as action
from n left join o on n.symbol = o.symbol and n.fiscal_period_end = o.fiscal_period_end""")
def fundamental_restated_upsert(spark, d):
    f = panel.fundamentals(spark, d).select("symbol", "fiscal_period_end", "report_date", "fiscal_year", "fiscal_quarter")
    shift = F.when(F.col("fiscal_quarter") == "Q1", -10).otherwise(10)
    new = f.filter("fiscal_year >= 1996").withColumn("report_date", F.date_add("report_date", shift)).drop("fiscal_year", "fiscal_quarter")
    return panel.upsert_restated(f.filter("fiscal_year < 1997").drop("fiscal_year", "fiscal_quarter"), new, ["symbol", "fiscal_period_end"])


def _price_query(name):
    @query(f"factor_{name}", f"with {BARS}, {FACTORS} select symbol, date, {R(name)} as value from fac where {name} is not null")
    def run(spark, d):
        return factor_frame(spark, d, [name]).filter(F.col(name).isNotNull()).select("symbol", "date", r6(name).alias("value"))


for _f in PRICE:
    _price_query(_f.name)

MONTHS = "sig as (select symbol, date from bars)"
ASOF = f"""{BARS}, {FUND}, {MONTHS},
known as (select s.symbol, s.date, f.* exclude (symbol) from sig s asof left join fund f on s.symbol = f.symbol and s.date >= f.report_date)"""
YIELD = lambda c: f"case when {c} > 0 then 1 / {c} end"
CLIP = lambda c: f"case when {c} is not null then least(greatest({c}, -1.0), 2.0) end"
LIQ = lambda c, t: f"case when {c} > 0 then case when abs({c} - {t}) <= 1 then 0.0 else -(abs({c} - {t}) - 1) end end"
MEAN = lambda cs, k: f"case when len(list_filter([{', '.join(cs)}], lambda x: x is not null)) >= {k} then list_avg(list_filter([{', '.join(cs)}], lambda x: x is not null)) end"
FF = f"""ff as (select *, {MEAN(['fundamental_value_score', 'fundamental_quality_score', 'fundamental_growth_score', 'fundamental_health_score'], 3)} as fundamental_composite_score from (
 select *, {MEAN(['pe_value_factor', 'pb_value_factor', 'ev_ebitda_factor'], 2)} as fundamental_value_score,
  {MEAN(['roe', 'roa', 'gross_margin', 'net_margin'], 2)} as fundamental_quality_score, {MEAN(['revenue_growth_factor', 'eps_growth_factor'], 2)} as fundamental_growth_score,
  {MEAN(['debt_to_equity_factor', 'current_ratio_factor', 'quick_ratio_factor'], 2)} as fundamental_health_score from (
  select symbol, date, roe, roa, gross_margin, net_margin, roe as roe_quality_factor, roa as roa_quality_factor, gross_margin as gross_margin_factor, net_margin as net_margin_factor,
   {YIELD('pe_ratio')} as pe_value_factor, {YIELD('pb_ratio')} as pb_value_factor, {YIELD('ev_to_ebitda')} as ev_ebitda_factor,
   {CLIP('revenue_growth')} as revenue_growth_factor, {CLIP('eps_growth')} as eps_growth_factor, case when debt_to_equity >= 0 then -debt_to_equity end as debt_to_equity_factor,
   {LIQ('current_ratio', 2.0)} as current_ratio_factor, {LIQ('quick_ratio', 1.0)} as quick_ratio_factor from known)))"""


def known(spark, d):
    """Each bar with the fundamentals known by then."""
    return as_of(bars(spark, d).select("symbol", "date"), panel.fundamentals(spark, d), ["symbol"], "date", "report_date", ["fiscal_period_end"])


@query("asof_fundamentals", f"with {ASOF} select symbol, date, report_date, fiscal_period_end, {R('pe_ratio')} as pe_ratio from known")
def asof_fundamentals(spark, d):
    return known(spark, d).select("symbol", "date", "report_date", "fiscal_period_end", r6("pe_ratio").alias("pe_ratio"))


def _fundamental_query(name):
    @query(f"factor_{name}", f"with {ASOF}, {FF} select symbol, date, {R(name)} as value from ff where {name} is not null")
    def run(spark, d):
        return fundamental_factors(known(spark, d), [name]).filter(F.col(name).isNotNull()).select("symbol", "date", r6(name).alias("value"))


for _f in FUNDAMENTAL:
    _fundamental_query(_f.name)


def OBS(factor: str, horizons: list[int], sign: int = 1) -> str:
    legs = " union all ".join(f"select symbol, date as signal_date, {sign} * {factor} as value, {h} as horizon, lead(date, {h}) over ({WS}) as future_date, lead(close, {h}) over ({WS}) / close - 1 as future_return from fac" for h in horizons)
    return f"{BARS}, {FACTORS}, obs as (select * from ({legs}) where value is not null and future_return is not null)"


IC = f"""ranked as (select *, {AVG_RANK.format(k='horizon, signal_date', v='value')} as rv, {AVG_RANK.format(k='horizon, signal_date', v='future_return')} as rr from obs),
ic as (select horizon, signal_date, {CORR.format(x='value', y='future_return')} as ic, {CORR.format(x='rv', y='rr')} as rank_ic, count(*) as n from ranked group by 1, 2)"""
IC_SUM = ", ".join(f"{R(f'avg({c})')} as {c}_mean, {R(f'stddev_samp({c})')} as {c}_std, {R(f'avg({c}) / nullif(stddev_samp({c}), 0)')} as {c}_ir, {R(f'avg(cast(round_even({c}, 12) > 0 as double))')} as {c}_positive_rate" for c in ("ic", "rank_ic"))
H5 = [1, 5, 10, 20, 60]


def obs(spark, d, factor, horizons):
    return evaluate.observations(factor_frame(spark, d, [factor]), factor, horizons, REGISTRY[factor].sign)


def _rounded(df, *keys):
    return df.select(*keys, *[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


def _summary_query(name, factor, horizons):
    @query(name, f"with {OBS(factor, horizons, REGISTRY[factor].sign)}, {IC} select horizon, {IC_SUM}, count(ic) as n_dates from ic group by 1")
    def run(spark, d):
        return _rounded(evaluate.ic_summary(evaluate.daily_ic(obs(spark, d, factor, horizons))), "horizon")


_summary_query("flagship_ic", "momentum_20d", [20])
_summary_query("ic_decay_momentum", "momentum_20d", H5)
_summary_query("ic_decay_volatility", "volatility_20d", H5)
_summary_query("ic_quality_proxy", "quality_price_proxy", [20])
_summary_query("ic_growth_proxy", "growth_price_proxy", [20])


@query("ic_daily", f"with {OBS('momentum_20d', [20])}, {IC} select signal_date, {R('ic')} as ic, {R('rank_ic')} as rank_ic, n from ic")
def ic_daily(spark, d):
    return _rounded(evaluate.daily_ic(obs(spark, d, "momentum_20d", [20])).drop("horizon"), "signal_date")


def _half_life(column, same):
    extra = "and min(sign(m)) = max(sign(m))" if same else ""
    return f"""with {OBS('momentum_20d', H5)}, {IC}, dec as (select cast(horizon as double) as h, avg({column}) as m from ic group by horizon)
select cast(round_even(case when count(*) >= 3 and regr_slope(ln(abs(m)), h) < 0 {extra} then ln(2.0) / -regr_slope(ln(abs(m)), h) end, 1) as double) as half_life, count(*) as points from dec where m <> 0"""


@query("half_life_rank_ic", _half_life("rank_ic", True))
def half_life_rank_ic(spark, d):
    return evaluate.half_life(evaluate.ic_summary(evaluate.daily_ic(obs(spark, d, "momentum_20d", H5))), "rank_ic_mean", True)


@query("half_life_ic", _half_life("ic", False))
def half_life_ic(spark, d):
    return evaluate.half_life(evaluate.ic_summary(evaluate.daily_ic(obs(spark, d, "momentum_20d", H5))), "ic_mean", False)


QUINT = """b as (select *, cast(ceil(row_number() over (partition by signal_date order by value, symbol) * 5.0 / count(*) over (partition by signal_date)) as integer) as bucket from obs),
daily as (select signal_date, bucket, avg(future_return) as r from b group by 1, 2)"""


@query("quintile_returns", f"with {OBS('momentum_20d', [20])}, {QUINT} select bucket, {R('avg(r)')} as mean_return, count(*) as n_dates from daily group by 1")
def quintile_returns(spark, d):
    return _rounded(evaluate.quintiles(obs(spark, d, "momentum_20d", [20])), "bucket")


@query("quintile_spread", f"with {OBS('reversal_5d', [5])}, {QUINT} select {R('avg(r) filter (bucket = 5) - avg(r) filter (bucket = 1)')} as spread from daily")
def quintile_spread(spark, d):
    q = evaluate.quintiles(obs(spark, d, "reversal_5d", [5]))
    return q.agg((F.max(F.when(F.col("bucket") == 5, F.col("mean_return"))) - F.max(F.when(F.col("bucket") == 1, F.col("mean_return")))).alias("s")).select(r6("s").alias("spread"))


def ASSIGN(q: int) -> str:
    return f"""r0 as (select *, row_number() over (partition by signal_date order by value, symbol) - 1 as k, count(*) over (partition by signal_date) as n from obs),
a as (select *, cast(round_even(k * {q - 1} / cast(greatest(n - 1, 1) as double), 0) as integer) + 1 as quantile from r0)"""


PER = """per as (select signal_date, avg(future_return) filter (quantile = {q}) as long_return, avg(future_return) filter (quantile = 1) as short_return,
  count(*) filter (quantile = {q}) as n_long, count(*) filter (quantile = 1) as n_short, max(future_date) as future_date from a group by 1)"""
TURN = """dates as (select signal_date, row_number() over (order by signal_date) as k2 from (select distinct signal_date from a)),
w as (select d.k2 as k, symbol, case when quantile = {q} then 1.0 else -1.0 end / count(*) over (partition by a.signal_date, quantile) as w from a join dates d on a.signal_date = d.signal_date where quantile in (1, {q})),
mv as (select k, symbol, w from w union all select k + 1, symbol, -w from w),
ch as (select k, sum(abs(d)) * 0.5 as t from (select k, symbol, sum(w) as d from mv group by 1, 2) group by 1),
turn as (select signal_date, case when k2 > 1 then coalesce(t, 0.0) end as turnover from dates left join ch on k2 = k)"""


def assigned(spark, d, factor="momentum_20d", h=20, q=5):
    return backtest.assign_quantiles(obs(spark, d, factor, [h]), q)


@query("backtest_periods", f"with {OBS('momentum_20d', [20])}, {ASSIGN(5)}, {PER.format(q=5)} select signal_date, {R('long_return')} as long_return, {R('short_return')} as short_return, n_long, n_short, future_date, {R('long_return - short_return')} as long_short_return from per")
def backtest_periods(spark, d):
    return _rounded(backtest.periods(assigned(spark, d), 5), "signal_date")


@query("backtest_turnover", f"with {OBS('momentum_20d', [20])}, {ASSIGN(5)}, {TURN.format(q=5)} select signal_date, {R('turnover')} as turnover from turn")
def backtest_turnover(spark, d):
    return _rounded(backtest.turnover(assigned(spark, d), 5), "signal_date")


@query("backtest_summary", f"""with {OBS('momentum_20d', [20])}, {ASSIGN(5)}, {PER.format(q=5)}, x as (select signal_date, long_return - short_return as s from per where long_return - short_return is not null),
c as (select *, sum(s) over (order by signal_date) as cum from x), f as (select *, cum - max(cum) over (order by signal_date) as fall from c)
select count(*) as n_periods, {R('avg(s)')} as mean_spread, {R('median(s)')} as median_spread, {R('sum(s)')} as cumulative_spread, {R('avg(cast(s > 0 as double))')} as hit_rate,
 {R('stddev_samp(s) * sqrt(252)')} as volatility, {R('avg(s) / nullif(stddev_samp(s), 0) * sqrt(252)')} as sharpe, {R('min(fall)')} as max_drawdown, {R('avg(s) * 252 / 20')} as annual_spread from f""")
def backtest_summary(spark, d):
    return _rounded(backtest.summary(backtest.periods(assigned(spark, d), 5), 20))


@query("backtest_quantile_returns", f"with {OBS('low_volatility_score', [10])}, {ASSIGN(4)} select quantile, {R('avg(future_return)')} as mean_return, count(*) as n from a group by 1")
def backtest_quantile_returns(spark, d):
    return _rounded(assigned(spark, d, "low_volatility_score", 10, 4).groupBy("quantile").agg(F.avg("future_return").alias("mean_return"), F.count("*").alias("n")), "quantile")


@query("turnover_audit", f"""with {OBS('momentum_20d', [20])}, {ASSIGN(5)}, {TURN.format(q=5)} select {R('avg(turnover)')} as mean_turnover, {R('median(turnover)')} as median_turnover, {R('max(turnover)')} as max_turnover, {R('min(turnover)')} as min_turnover, {R('stddev_samp(turnover)')} as std_turnover, {R('avg(turnover) * 252 / 20')} as annual_turnover from turn""")
def turnover_audit(spark, d):
    t = backtest.turnover(assigned(spark, d), 5)
    x = F.col("turnover")
    return _rounded(t.agg(F.avg(x).alias("mean_turnover"), F.median(x).alias("median_turnover"), F.max(x).alias("max_turnover"), F.min(x).alias("min_turnover"), F.stddev_samp(x).alias("std_turnover"), (F.avg(x) * 252 / 20).alias("annual_turnover")))


@query("cost_sensitivity", f"""with {OBS('momentum_20d', [20])}, {ASSIGN(5)}, {PER.format(q=5)}, {TURN.format(q=5)}, lv(bps) as (values (0.0), (5.0), (10.0), (20.0), (50.0)),
n as (select bps, long_return - short_return - coalesce(turnover, 0) * bps / 10000 * 2 as net from per join turn using (signal_date), lv where long_return - short_return is not null)
select cast(bps as double) as bps, {R('avg(net)')} as mean_net, {R('avg(net) / nullif(stddev_samp(net), 0) * sqrt(252)')} as sharpe, {R('avg(cast(net > 0 as double))')} as hit_rate from n group by 1""")
def cost_sensitivity(spark, d):
    a = assigned(spark, d)
    per = backtest.periods(a, 5).join(backtest.turnover(a, 5), "signal_date").filter("long_short_return is not null")
    levels = F.explode(F.array(*[F.lit(float(b)) for b in (0, 5, 10, 20, 50)]))
    net = per.select("signal_date", levels.alias("bps"), "long_short_return", "turnover").withColumn("net", F.col("long_short_return") - F.coalesce("turnover", F.lit(0.0)) * F.col("bps") / 10000 * 2)
    std = F.stddev_samp("net")
    return _rounded(net.groupBy("bps").agg(F.avg("net").alias("mean_net"), F.when(std > 0, F.try_divide(F.avg("net"), std) * F.sqrt(F.lit(252.0))).alias("sharpe"), F.avg((F.col("net") > 0).cast("double")).alias("hit_rate")), "bps")


@query("decile_analysis", f"""with {OBS('momentum_20d', [20])}, {ASSIGN(10)}, m as (select quantile, avg(future_return) as r from a group by 1), k as (select *, rank() over (order by r) as rr from m)
select {R(CORR.format(x='quantile', y='rr'))} as spearman, {R('max(r) filter (quantile = 10) - max(r) filter (quantile = 1)')} as spread from k""")
def decile_analysis(spark, d):
    m = assigned(spark, d, q=10).groupBy("quantile").agg(F.avg("future_return").alias("r"))
    k = m.withColumn("one", F.lit(1)).withColumn("rr", F.rank().over(evaluate.Window.partitionBy("one").orderBy("r")).cast("double"))
    at = lambda n: F.max(F.when(F.col("quantile") == n, F.col("r")))
    return _rounded(k.agg(evaluate.correlation(F.col("quantile").cast("double"), F.col("rr")).alias("spearman"), (at(10) - at(1)).alias("spread")))


@query("universe_sensitivity", f"""with {OBS('momentum_20d', [20])}, u as (select symbol, row_number() over (order by symbol) as ord from (select distinct symbol from bars)), sz(size) as (values (5), (10), (20), (25)),
o as (select size, obs.* from obs join u using (symbol), sz where ord <= size),
ic as (select size, signal_date, {CORR.format(x='value', y='future_return')} as ic from o group by 1, 2)
select size, {R('avg(ic)')} as ic_mean, {R('stddev_samp(ic)')} as ic_std, count(ic) as n_dates from ic group by 1""")
def universe_sensitivity(spark, d):
    o = obs(spark, d, "momentum_20d", [20])
    w = evaluate.Window.orderBy("symbol")  # the universe: a row a symbol
    u = bars(spark, d).select("symbol").distinct().withColumn("ord", F.row_number().over(w))
    sized = o.join(u, "symbol").select("*", F.explode(F.filter(F.array(*map(F.lit, (5, 10, 20, 25))), lambda s: s >= F.col("ord"))).alias("size"))
    ic = sized.groupBy("size", "signal_date").agg(evaluate.correlation("value", "future_return").alias("ic"))
    return _rounded(ic.groupBy("size").agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.count("ic").alias("n_dates")), "size")


CS = f"{BARS}, {FACTORS}, {SECTORS}"
PIPE = f"""q as (select symbol, date, momentum_20d as v, least(greatest(momentum_20d, quantile_cont(momentum_20d, 0.05) over (partition by date)), quantile_cont(momentum_20d, 0.95) over (partition by date)) as w from fac where momentum_20d is not null),
z as (select *, coalesce((w - avg(w) over (partition by date)) / nullif(stddev_samp(w) over (partition by date), 0), 0.0) as z from q),
nt as (select z.*, coalesce(sector, 'Unknown') as sector, z - avg(z) over (partition by date, coalesce(sector, 'Unknown')) as neutral from z left join sectors using (symbol))"""


@query("pipeline_stages", f"with {CS}, {PIPE} select symbol, date, sector, {R('w')} as winsorized, {R('z')} as zscore, {R('neutral')} as neutral from nt")
def pipeline_stages(spark, d):
    f = factor_frame(spark, d, ["momentum_20d"]).join(panel.sectors(spark, d), "symbol", "left")
    p = crosssection.pipeline(f, "momentum_20d")
    return _rounded(p.select("symbol", "date", "sector", "winsorized", "zscore", "neutral"), "symbol", "date")


@query("combine_rank", f"with {BARS}, {FACTORS} select symbol, date, {R(f'''case when count(*) over (partition by date) <= 1 or min(volatility_20d) over (partition by date) = max(volatility_20d) over (partition by date) then 0.5 else 1 - ({AVG_RANK.format(k='date', v='volatility_20d')} - 1) / (count(*) over (partition by date) - 1) end''')} as score from fac where volatility_20d is not null")
def combine_rank(spark, d):
    return _rounded(crosssection.combine_rank(factor_frame(spark, d, ["volatility_20d"]), "volatility_20d", higher=False).select("symbol", "date", "score"), "symbol", "date")


@query("combine_zscore", f"with {BARS}, {FACTORS} select symbol, date, {R('''case when count(*) over (partition by date) <= 1 or stddev_pop(momentum_60d) over (partition by date) = 0 then 0.5 else (momentum_60d - avg(momentum_60d) over (partition by date)) / nullif(stddev_pop(momentum_60d) over (partition by date), 0) end''')} as score from fac where momentum_60d is not null")
def combine_zscore(spark, d):
    return _rounded(crosssection.combine_z(factor_frame(spark, d, ["momentum_60d"]), "momentum_60d").select("symbol", "date", "score"), "symbol", "date")


COMP = """nn as (select symbol, date, momentum_20d, volatility_20d, count(*) over (partition by date) as n from fac where momentum_20d is not null and volatility_20d is not null),
cs as (select symbol, date, 0.6 * case when n <= 1 then 1.0 else 1 - (rank() over (partition by date order by momentum_20d desc) - 1) / (n - 1.0) end
  + 0.4 * case when n <= 1 then 1.0 else 1 - (rank() over (partition by date order by volatility_20d) - 1) / (n - 1.0) end as composite from nn)"""


def _composite(spark, d):
    f = factor_frame(spark, d, ["momentum_20d", "volatility_20d"]).filter("momentum_20d is not null and volatility_20d is not null")
    return crosssection.composite(f, {"momentum_20d": 0.6, "volatility_20d": 0.4}, {"volatility_20d"}).withColumn("composite", F.bround("composite", 9))


@query("composite_score", f"with {BARS}, {FACTORS}, {COMP} select symbol, date, {R('composite')} as composite from cs")
def composite_score(spark, d):
    return _rounded(_composite(spark, d).select("symbol", "date", "composite"), "symbol", "date")


@query("alpha_targets", f"""with {BARS}, {FACTORS}, {COMP}, rk as (select symbol, date, round_even(composite, 9) as composite, row_number() over (partition by date order by round_even(composite, 9) desc, symbol) as rank from cs),
t as (select *, greatest(composite, 0) / nullif(sum(greatest(composite, 0)) over (partition by date), 0) * 0.95 as w from rk where rank <= 5)
select symbol, date, cast(rank as integer) as rank, {R('least(coalesce(w, 0), 0.2)')} as weight from t""")
def alpha_targets(spark, d):
    return crosssection.target_weights(_composite(spark, d), "composite", 5, 0.2, 0.05).select("symbol", "date", "rank", "weight")


@query("factor_collinearity", f"""with {BARS}, {FACTORS}, l as (unpivot (select symbol, date, momentum_20d, momentum_60d, reversal_5d, low_volatility_score from fac) on momentum_20d, momentum_60d, reversal_5d, low_volatility_score into name f value v)
select a.f as f1, b.f as f2, count(*) as n, {R('covar_samp(a.v, b.v) / nullif(stddev_samp(a.v) * stddev_samp(b.v), 0)')} as corr from l a join l b on a.symbol = b.symbol and a.date = b.date and a.f < b.f where a.v is not null and b.v is not null group by 1, 2 having count(*) >= 5""")
def factor_collinearity(spark, d):
    names = ["momentum_20d", "momentum_60d", "reversal_5d", "low_volatility_score"]
    f = factor_frame(spark, d, names)
    pairs = [(a, b) for a in sorted(names) for b in sorted(names) if a < b]
    # pairs of columns of one row: no self-join
    p = f.select(F.explode(F.array(*[F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])).alias("p")).select("p.*").filter("x is not null and y is not null")
    return _rounded(p.groupBy("f1", "f2").agg(F.count("*").alias("n"), evaluate.correlation("x", "y").alias("corr")).filter("n >= 5"), "f1", "f2")


@query("factor_coverage", f"with {ASOF}, {FF} select count(distinct symbol) filter (fundamental_value_score is not null) as covered, count(distinct symbol) as universe, min(date) filter (fundamental_value_score is not null) as first_date from ff")
def factor_coverage(spark, d):
    f = fundamental_factors(known(spark, d), ["fundamental_value_score"])
    ok = F.col("fundamental_value_score").isNotNull()
    return f.agg(F.count_distinct(F.when(ok, F.col("symbol"))).alias("covered"), F.count_distinct("symbol").alias("universe"), F.min(F.when(ok, F.col("date"))).alias("first_date"))
