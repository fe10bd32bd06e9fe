"""Queries over periods with their legs, stored reports, rankings with folds and scoring modes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import alpha, backtest, evaluation, markets, multifactor, scores, series
from ..operators.factors import REGISTRY
from ..sources import panel, reports
from ..sources.panel import BARS
from ..sources.tables import fresh, kept
from .extended import FAMILY, LONG, METRICS, NAMES, NORM, RANKED, TESTS, all_obs, cols, custom_weights, factor_metrics, fold_frame
from .markets import bench
from .research import ASSIGN, COMP, FACTORS, OBS, R, R9, TURN, _composite, _rounded, assigned, bars, factor_frame

Q: dict = {}
SQL: dict[str, str] = {}
BY = ["run"]


def query(name: str, sql: str):
    def put(f):
        Q[name], SQL[name] = f, sql
        return f

    return put


# periods with their legs -------------------------------------------------------------------------

MEANS = ", ".join(f"{R(f'avg(future_return) filter (quantile = {k})')} as q{k}" for k in range(1, 6))


@query("backtest_legs", f"""with {OBS('momentum_20d', [20])}, {ASSIGN(5)}, {TURN.format(q=5)},
p as (select signal_date, max(future_date) as future_date, coalesce(string_agg(symbol, ',' order by symbol) filter (quantile = 5), '') as long_symbols, coalesce(string_agg(symbol, ',' order by symbol) filter (quantile = 1), '') as short_symbols,
  count(*) filter (quantile = 5) as n_long, count(*) filter (quantile = 1) as n_short, {MEANS}, {R('avg(future_return) filter (quantile = 5) - avg(future_return) filter (quantile = 1)')} as long_short_return from a group by 1)
select signal_date, future_date, long_symbols, short_symbols, {R('1.0 / nullif(n_long, 0)')} as long_weight, {R('-1.0 / nullif(n_short, 0)')} as short_weight,
  cast(case when n_long > 0 then 1 else 0 end - case when n_short > 0 then 1 else 0 end as double) as net_exposure, cast(case when n_long > 0 then 1 else 0 end + case when n_short > 0 then 1 else 0 end as double) as gross_exposure,
  q1, q2, q3, q4, q5, long_short_return, {R('turnover')} as turnover from p join turn using (signal_date)""")
def backtest_legs(spark, d):
    """Every period with the symbols and weights of both legs, its exposures and the mean of each quantile."""
    p = backtest.legs(assigned(spark, d), 5)
    one = lambda c: F.try_element_at(F.map_values(c), F.lit(1))  # noqa: E731  # a leg's weights are even
    p = p.select("signal_date", "future_date", F.array_join("long_symbols", ",").alias("long_symbols"), F.array_join("short_symbols", ",").alias("short_symbols"), one("long_weights").alias("long_weight"), one("short_weights").alias("short_weight"), "net_exposure", "gross_exposure", *[F.col("quantile_returns")[f"q{k}"].alias(f"q{k}") for k in range(1, 6)], "long_short_return", "turnover")
    return _rounded(p, "signal_date")


# strategies judged from stored reports -----------------------------------------------------------

RUNS = f"al as ({' union all '.join(f'''select '{f}' as run, * from (with {OBS(f, [20], REGISTRY[f].sign)}, {ASSIGN(5)} select symbol, signal_date, future_date, future_return, quantile from a)''' for f in RANKED)})"
LEGS = """per as (select run, signal_date, avg(future_return) filter (quantile = 5) as long_return, avg(future_return) filter (quantile = 1) as short_return from al group by 1, 2),
w as (select run, signal_date, symbol, quantile, case when quantile = 5 then 1.0 else -1.0 end / count(*) over (partition by run, signal_date, quantile) as w from al where quantile in (1, 5)),
dates as (select run, signal_date, row_number() over (partition by run order by signal_date) as k, count(*) over (partition by run) as n_periods from (select distinct run, signal_date from al)),
mv as (select run, k, symbol, w from w join dates using (run, signal_date) union all select run, k + 1, symbol, -w from w join dates using (run, signal_date)),
mc as (select run, k, symbol, abs(sum(w)) as d from mv group by 1, 2, 3), tu as (select run, k, sum(d) * 0.5 as t from mc group by 1, 2),
pp as (select p.*, case when k > 1 then coalesce(t, 0.0) end as turnover, long_return - short_return as s from per p join dates using (run, signal_date) left join tu using (run, k)),
parts as (select run, symbol, coalesce(c, 0.0) as contribution, 0.0 as cost, coalesce(t, 0.0) as turnover, m as weight from
  (select w.run, w.symbol, sum(case when quantile = 5 then long_return else -short_return end * abs(w)) as c, avg(abs(w)) as m from w join per using (run, signal_date) group by 1, 2)
  left join (select mc.run, symbol, sum(d) as t from mc join (select distinct run, n_periods from dates) using (run) where k > 1 and k <= n_periods group by 1, 2) using (run, symbol)),
ser as (select run, signal_date as date, s as ret from pp where s is not null)"""
BENCHMARK = "bench as (select date, avg(close) as close from bars where close > 0 group by date), br as (select date, close / lag(close) over (order by date) - 1 as b from bench), b2 as (select * from br where b is not null)"
# from ser, parts and facts to a row a run
JUDGED = f"""e as (select run, date, ret, product(1 + ret) over (partition by run order by date) as eq from ser), f as (select *, eq / greatest(max(eq) over (partition by run order by date), 1) - 1 as dd, max(eq) over (partition by run order by date) as top from e),
lo as (select run, dd, date as d1, top from f qualify row_number() over (partition by run order by dd, date) = 1),
pk as (select lo.run, lo.dd, d1, case when any_value(lo.top) >= 1 then min(f.date) filter (f.eq = lo.top) else min(f.date) end as d0 from lo join f on f.run = lo.run and f.date <= d1 group by 1, 2, 3),
g as (select run, count(*) as n, min(date) as first_date, max(date) as last_date, product(1 + ret) - 1 as compound, avg(ret) as mean, stddev_samp(ret) as std, case when count(*) filter (ret < 0) > 1 then stddev_samp(ret) filter (ret < 0) end as down, avg(cast(ret > 0 as double)) as hits,
  avg(ret) filter (ret > 0) as average_win, avg(ret) filter (ret < 0) as average_loss, max(ret) as best_return, min(ret) as worst_return from ser group by 1),
xd as (select run, min(date) filter (ret = best_return) as best_date, min(date) filter (ret = worst_return) as worst_date from ser join g using (run) group by 1),
pr as (select *, row_number() over (partition by run order by contribution desc, symbol) as j, row_number() over (partition by run order by weight desc nulls last, symbol) as k from parts),
sh as (select run, coalesce(sum(contribution) filter (j <= 1 and contribution > 0), 0) as top_1, coalesce(sum(contribution) filter (j <= 3 and contribution > 0), 0) as top_3, max(symbol) filter (k = 1) as largest_position, sum(weight) filter (k <= 1) as largest_weight, sum(weight) filter (k <= 3) as top_3_weight, sum(weight) filter (k <= 5) as top_5_weight from pr group by 1),
ir as (select run, avg(ret - b) / nullif(stddev_samp(ret - b), 0) * sqrt(252) as information_ratio from ser join b2 using (date) group by 1),
z as (select *, coalesce(stated_total, compound) as total_return, coalesce(stated_annual, pow(1 + compound, 252.0 / n) - 1) as annual_return, coalesce(stated_volatility, std * sqrt(252)) as volatility, coalesce(stated_sharpe, mean / nullif(std, 0) * sqrt(252)) as sharpe, coalesce(stated_hit, hits) as hit_rate, -abs(dd) as max_drawdown, (select product(1 + b) - 1 from b2) as benchmark_return
  from facts join g using (run) join xd using (run) join pk using (run) join sh using (run) left join ir using (run)),
y as (select *, total_return - benchmark_return as excess_return, top_1 / nullif(abs(total_return), 0) as top_1_share, top_3 / nullif(abs(total_return), 0) as top_3_share, -total_cost / capital as cost_drag from z)
select run, n, first_date, last_date, {cols('total_return', 'annual_return', 'volatility', 'sharpe')}, {R('mean / nullif(down, 0) * sqrt(252)')} as sortino, {R('max_drawdown')} as max_drawdown, {R('annual_return / nullif(abs(max_drawdown), 0)')} as calmar, {R('hit_rate')} as hit_rate, {R('average_win / nullif(abs(average_loss), 0)')} as win_loss_ratio, {cols('average_win', 'average_loss')},
 best_date, {R('best_return')} as best_return, worst_date, {R('worst_return')} as worst_return, {cols('turnover', 'total_cost', 'cost_drag')}, {R('total_cost / nullif(abs(total_return) * capital, 0)')} as cost_to_return, {cols('gross_exposure', 'net_exposure', 'cash_share', 'long_side', 'short_side', 'long_contribution', 'short_contribution', 'benchmark_return', 'excess_return', 'information_ratio')},
 d0 as drawdown_start, d1 as drawdown_end, cast(d1 - d0 as integer) as drawdown_days, {cols('top_1_share', 'top_3_share')}, largest_position, {cols('largest_weight', 'top_3_weight', 'top_5_weight')},
 concat_ws(',', case when n < 30 then 'LOW_OBSERVATION_COUNT' end, case when turnover > 1 then 'HIGH_TURNOVER' end, case when abs(cost_drag) > 0.02 then 'HIGH_COST_DRAG' end, case when total_return < 0 and sharpe > 0 then 'NEGATIVE_COMPOUND_POSITIVE_SHARPE' end, case when max_drawdown < -0.2 then 'LARGE_DRAWDOWN' end,
  case when max_drawdown <= -1 then 'CAPITAL_WIPEOUT_OR_MARGIN_LOSS' end, case when excess_return < 0 then 'BENCHMARK_UNDERPERFORMANCE' end, case when top_1_share > 0.5 then 'SYMBOL_CONCENTRATION' end, case when abs(long_side / nullif(short_side, 0)) > 5 or abs(long_side / nullif(short_side, 0)) < 0.2 then 'LONG_SHORT_IMBALANCE' end, case when not no_lookahead then 'NO_LOOKAHEAD_NOT_MARKED' end) as codes from y"""
FACTS = """facts as (select run, true as no_lookahead, 0.0 as total_cost, avg(turnover) as turnover, 2.0 as gross_exposure, 0.0 as net_exposure, 0.0 as cash_share, 1.0 as capital, avg(long_return) as long_side, avg(short_return) as short_side, sum(long_return) as long_contribution, -sum(short_return) as short_contribution,
  sum(s) as stated_total, avg(s) * 252 / 20 as stated_annual, stddev_samp(s) * sqrt(252) as stated_volatility, avg(s) / nullif(stddev_samp(s), 0) * sqrt(252) as stated_sharpe, avg(cast(s > 0 as double)) as stated_hit from pp where s is not null group by 1)"""


def factor_reports(spark, d) -> evaluation.Evidence:
    """Reports of all ranked factors, written as JSON lines and read again: a line a period, a line a run."""
    a = backtest.assign_quantiles(all_obs(spark, d).withColumnRenamed("factor_name", "run"), 5, BY)
    legs = kept(backtest.legs(a, 5, BY), "legs")
    whole = legs.filter("long_short_return is not null")
    s = backtest.summary(legs, 20, BY).select("run", F.col("cumulative_spread").alias("total_return"), F.col("annual_spread").alias("annual_return"), "volatility", "sharpe", "hit_rate")
    mean = whole.groupBy("run").agg(*[F.avg(c).alias(n) for c, n in (("turnover", "turnover"), ("gross_exposure", "gross_exposure"), ("net_exposure", "net_exposure"), ("long_return", "long_leg_return"), ("short_return", "short_leg_return"))])
    heads = s.join(mean, "run").select("*", F.lit(True).alias("no_lookahead"), F.array().cast("array<string>").alias("warnings"))
    key = T.StructField("run", T.StringType())
    # read by several steps: parsed once
    read = lambda frame, name, schema: kept(reports.read_lines(spark, reports.write_lines(frame, fresh(spark, name)), T.StructType([key, *schema.fields]))[0], name)
    return evaluation.from_periods(read(heads, "heads", reports.FACTOR_HEAD), read(legs, "periods", reports.PERIOD))


def market(spark, d) -> DataFrame:
    return series.equity_returns(bench(spark, d).withColumnRenamed("close", "equity"))


def _judged(e: evaluation.Evidence, benchmark: DataFrame) -> DataFrame:
    return _rounded(evaluation.evaluate(e, benchmark).withColumn("codes", F.array_join("codes", ",")), "run")


@query("strategy_evaluation", f"with {RUNS}, {LEGS}, {FACTS}, {BARS}, {BENCHMARK}, {JUDGED}")
def strategy_evaluation(spark, d):
    """Each factor's long-short report judged against the mean of all symbols."""
    return _judged(factor_reports(spark, d), market(spark, d))


def _attribution(sql: str) -> str:
    return f"""{sql}, kd as (select *, case when contribution > 0 then 'contributor' when contribution < 0 then 'detractor' end as kind from parts), pl as (select *, row_number() over (partition by run, kind order by abs(contribution) desc, symbol) as p from kd)
select run, symbol, {cols('contribution', 'cost', 'turnover', 'weight')}, kind, cast(case when kind is not null and p <= 5 then p end as integer) as place from pl"""


@query("strategy_attribution", _attribution(f"with {RUNS}, {LEGS}"))
def strategy_attribution(spark, d):
    return _rounded(evaluation.attribution(factor_reports(spark, d)), "run", "symbol")


# accounts: a run an order priority ---------------------------------------------------------------

ACCOUNTS = f"""{BARS}, ln as (select o_orderpriority as run, p_brand as symbol, cast(date_trunc('week', l_shipdate) as date) as date, case when l_returnflag = 'R' then 'SELL' else 'BUY' end as side, l_quantity as qty, l_extendedprice as notional, l_extendedprice * l_tax * 0.01 as total_cost
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
tr as (select run, symbol, date, side, sum(qty) as qty, sum(notional) as notional, sum(total_cost) as total_cost from ln group by 1, 2, 3, 4), hd as (select run, 2 * sum(notional) as initial_cash, sum(notional) / (2 * sum(notional)) as turnover, sum(total_cost) as total_cost from tr group by 1),
fl as (select run, symbol, date, sum(case when side = 'SELL' then -qty else qty end) as q, sum(case when side = 'SELL' then notional else -notional end - total_cost) as cash from tr group by 1, 2, 3),
wk as (select symbol, cast(unnest(generate_series(min(date), (select max(date) from bars), interval 7 days)) as date) as date from bars group by 1),
mk as (select symbol, date, last_value(close ignore nulls) over (partition by symbol order by date) as mark from wk left join bars using (symbol, date)),
ps as (select run, symbol, date, mark * sum(coalesce(q, 0)) over (partition by run, symbol order by date) as value, coalesce(cash, 0) as cash from mk join (select distinct run, symbol from fl) using (symbol) left join fl using (run, symbol, date)),
dy as (select run, date, sum(value) as value, sum(abs(value)) as size, sum(cash) as cash from ps group by 1, 2), ec as (select dy.run, date, initial_cash + sum(dy.cash) over (partition by dy.run order by date) as cash, value, size from dy join hd using (run)),
eq0 as (select run, date, cash + value as equity, cash, size from ec), ser as (select * from (select run, date, equity / lag(equity) over (partition by run order by date) - 1 as ret from eq0) where ret is not null),
parts as (select run, symbol, coalesce(c, 0.0) as contribution, coalesce(k, 0.0) as cost, coalesce(t, 0.0) as turnover, weight from
  (select ps.run, ps.symbol, avg(abs(value) / equity) as weight from ps join eq0 using (run, date) where equity > 0 group by 1, 2) left join
  (select tr.run, tr.symbol, sum(case when side = 'SELL' then notional else -notional end - tr.total_cost) / any_value(initial_cash) as c, -sum(tr.total_cost) / any_value(initial_cash) as k, sum(notional) / any_value(initial_cash) as t from tr join hd using (run) group by 1, 2) using (run, symbol)),
facts as (select run, true as no_lookahead, total_cost, turnover, size as gross_exposure, size as net_exposure, cs as cash_share, initial_cash as capital, cast(null as double) as long_side, 0.0 as short_side, cast(null as double) as long_contribution, cast(null as double) as short_contribution,
  cast(null as double) as stated_total, cast(null as double) as stated_annual, cast(null as double) as stated_volatility, cast(null as double) as stated_sharpe, cast(null as double) as stated_hit from hd join (select run, avg(size / equity) as size, avg(cash / equity) as cs from eq0 where equity > 0 group by 1) using (run))"""


def account_reports(spark, d) -> evaluation.Evidence:
    """Each order priority as an account: its lines as trades of the brand, held positions marked every week."""
    item = spark.read.parquet(f"{d}/lineitem.parquet").join(spark.read.parquet(f"{d}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey")).join(spark.read.parquet(f"{d}/part.parquet"), F.col("l_partkey") == F.col("p_partkey"))
    rows = item.select(F.col("o_orderpriority").alias("run"), F.col("p_brand").alias("symbol"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("notional"), (F.col("l_extendedprice") * F.col("l_tax") * 0.01).alias("total_cost"))
    trades = kept(rows.groupBy("run", "symbol", "date", "side").agg(*[F.sum(c).alias(c) for c in ("qty", "notional", "total_cost")]), "trades")
    heads = trades.groupBy("run").agg((2 * F.sum("notional")).alias("initial_cash"), (F.sum("notional") / (2 * F.sum("notional"))).alias("turnover")).withColumn("no_lookahead", F.lit(True))
    sign = F.when(F.col("side") == "SELL", 1).otherwise(-1)
    flows = trades.groupBy("run", "symbol", "date").agg(F.sum(-sign * F.col("qty")).alias("q"), F.sum(sign * F.col("notional") - F.col("total_cost")).alias("cash"))

    b = panel.bars(spark, d).select("symbol", "date", "close")
    # each symbol's weeks from its first to the last of all, a row a symbol made long
    first = b.groupBy("symbol").agg(F.min("date").alias("lo"), F.max("date").alias("last"))
    end = F.max("last").over(Window.partitionBy())
    weeks = first.withColumn("hi", end).select("symbol", F.explode(F.sequence("lo", "hi", F.expr("interval 7 days"))).alias("date"))
    so_far = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    marks = weeks.join(b, ["symbol", "date"], "left").select("symbol", "date", F.last("close", ignorenulls=True).over(so_far).alias("mark"))
    p = marks.join(flows.select("run", "symbol").distinct(), "symbol").join(flows, ["run", "symbol", "date"], "left")
    held = F.sum(F.coalesce("q", F.lit(0.0))).over(Window.partitionBy("run", "symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    p = p.select("run", "date", "symbol", (F.col("mark") * held).alias("value"), F.coalesce("cash", F.lit(0.0)).alias("cash"))
    days = p.groupBy("run", "date").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "value"))).alias("positions"), F.sum("value").alias("value"), F.sum("cash").alias("flow"))
    cash = F.col("initial_cash") + F.sum("flow").over(Window.partitionBy("run").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    curve = days.join(heads.select("run", "initial_cash"), "run").withColumn("cash", cash)
    curve = kept(curve.select("run", "date", (F.col("cash") + F.col("value")).alias("equity"), "cash", "positions"), "curve")
    return evaluation.from_accounts(heads, curve, trades)


@query("strategy_evaluation_accounts", f"with {ACCOUNTS}, {BENCHMARK}, {JUDGED}")
def strategy_evaluation_accounts(spark, d):
    """Equity curves and trades judged: returns from the curve, costs and parts from the trades."""
    return _judged(account_reports(spark, d), market(spark, d))


@query("account_attribution", _attribution(f"with {ACCOUNTS}"))
def account_attribution(spark, d):
    return _rounded(evaluation.attribution(account_reports(spark, d)), "run", "symbol")


@query("account_calendar", f"""with {ACCOUNTS}, mo as (select run, cast(date_trunc('quarter', date) as date) as period, product(1 + ret) - 1 as ret from ser group by 1, 2), every as (select run, cast(unnest(generate_series(min(period), max(period), interval 3 months)) as date) as period from mo group by 1)
select run, period, {R('coalesce(ret, 0)')} as ret from every left join mo using (run, period)""")
def account_calendar(spark, d):
    return _rounded(evaluation.by_calendar(account_reports(spark, d).returns, "quarter"), "run", "period")


# rankings with folds -----------------------------------------------------------------------------

CLAMP = lambda x: f"case when {x} is not null then greatest(0.0, least(1.0, {x})) end"


@query("factor_rankings", f"""with {METRICS}, {RUNS}, per as (select run, signal_date as date, (avg(future_return) filter (quantile = 5) - avg(future_return) filter (quantile = 1)) / 20 as ret from al group by 1, 2), ts(fold, lo, hi) as (values {TESTS}),
fo as (select run, fold, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) as sharpe from per join ts on date between lo and hi where ret is not null group by 1, 2), wf as (select run as factor_name, avg(sharpe) as walk_forward_sharpe, count(sharpe) as n_folds from fo group by 1),
c as (select *, 0.45 * coalesce({CLAMP('coverage')}, 0) + 0.35 * coalesce({CLAMP('consistency')}, 0) + 0.20 * least(n_dates / 30.0, 1.0) as confidence from m left join wf using (factor_name)),
s as (select *, list_avg([{', '.join(CLAMP(f'(0.5 + {x} / 2)') for x in ('ic', 'rank_ic', 'icir', 'sharpe', 'walk_forward_sharpe', 'confidence'))}, {CLAMP('coverage')}, {CLAMP('(1 + fall)')}]) as rank_score from c)
select factor_name, {cols('ic', 'rank_ic', 'icir', 'coverage', 'cumulative', 'sharpe', 'fall', 'walk_forward_sharpe', 'confidence', 'rank_score')}, coalesce(n_folds, 0) as n_folds, case when coverage < 0.30 then 'blocked_by_coverage' when rank_score is null then 'insufficient_evidence' when rank_score >= 0.70 then 'candidate' when rank_score >= 0.55 then 'usable_but_needs_walk_forward' else 'weak_or_inconclusive' end as grade,
 case when coverage < 0.30 then 'LOW_FACTOR_COVERAGE' else '' end as blocking, cast(row_number() over (order by round_even(rank_score, 9) desc nulls last, factor_name desc) as integer) as place from s""")
def factor_rankings(spark, d):
    """Factors by evidence: ICs, backtest, test folds and confidence in one score, graded and placed."""
    spread = backtest.periods(backtest.assign_quantiles(all_obs(spark, d), 5, ["factor_name"]), 5, ["factor_name"])
    folds = scores.fold_sharpe(spread.select("factor_name", F.col("signal_date").alias("date"), (F.col("long_short_return") / 20).alias("ret")), fold_frame(spark), ["factor_name"])
    return _rounded(scores.ranked_factors(factor_metrics(spark, d), folds), "factor_name")


# scoring modes -----------------------------------------------------------------------------------

MODES = [alpha.Run("all", "momentum_20d", multi_factor=True, factor_weights=True), alpha.Run("multi", "momentum_20d", multi_factor=True), alpha.Run("weights", "momentum_20d", factor_weights=True), alpha.Run("plain", "momentum_20d")]


@query("alpha_modes", f"""with {BARS}, {FACTORS}, mf as (select date, symbol, score from (with {LONG}, {NORM}, fam as (select date, symbol, family, sum(s * w) / nullif(sum(w), 0) as fs, any_value(fw) as fw from sc join cv using (date, factor) group by 1, 2, 3) select date, symbol, {R('sum(round_even(fs * fw, 12))')} as score from fam group by 1, 2)),
cp as (select date, symbol, score from (with {COMP} select date, symbol, {R9('composite')} as score from cs)),
al as (select 'all' as run, 'multi_factor_alpha' as ranking_factor, * from mf union all select 'multi', 'multi_factor_alpha', * from mf union all select 'weights', 'composite_alpha_score', * from cp union all select 'plain', 'momentum_20d', date, symbol, {R9('momentum_20d')} from fac),
rk as (select *, row_number() over (partition by run, date order by score desc, symbol) as rank from al where score is not null),
t as (select *, greatest(score, 0) / nullif(sum(greatest(score, 0)) over (partition by run, date), 0) * 0.95 as w from rk where rank <= 5)
select run, date, symbol, ranking_factor, cast(rank as integer) as rank, {R('least(coalesce(w, 0), 0.3)')} as weight from t""")
def alpha_modes(spark, d):
    """Targets of four set-ups over one panel: multi-factor before factor weights before the plain factor."""
    rows = multifactor.long_form(factor_frame(spark, d, NAMES), NAMES)
    multi = multifactor.scores(rows, custom_weights(spark), FAMILY, NAMES).select("date", "symbol", F.bround("final_score", 6).alias("multi_factor_alpha"))
    mixed = _composite(spark, d).select("date", "symbol", F.col("composite").alias("composite_alpha_score"))
    plain = factor_frame(spark, d, ["momentum_20d"]).select("date", "symbol", F.bround("momentum_20d", 9).alias("momentum_20d"))
    values = plain.join(multi, ["date", "symbol"], "left").join(mixed, ["date", "symbol"], "left")
    return alpha.targets(alpha.scored(values, MODES), 5, 0.3, 0.05).select("run", "date", "symbol", "ranking_factor", "rank", "weight")


# histories ---------------------------------------------------------------------------------------


@query("history_normalised", f"""with {BARS}, t as (select symbol, date, case when volume % 7 = 0 then 'n/a' when volume % 7 = 1 then null when volume % 7 = 2 then '-1.5' when volume % 7 = 3 then ' 0 ' else cast(volume as varchar) end as close from bars)
select symbol, count(*) as n, count(*) filter (c <= 0) as n_not_above_zero, sum(c) as total from (select symbol, try_cast(trim(close) as double) as c from t) where c is not null group by 1""")
def history_normalised(spark, d):
    """Closes that come as text: what is no number goes, zero and less stay."""
    rest = F.col("volume") % 7
    text = F.when(rest == 0, "n/a").when(rest == 1, None).when(rest == 2, "-1.5").when(rest == 3, " 0 ").otherwise(F.col("volume").cast("string"))
    h = panel.numeric_history(panel.bars(spark, d).select("symbol", "date", text.alias("close")))
    return h.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("close") <= 0).alias("n_not_above_zero"), F.sum("close").alias("total"))


@query("covariance_recent", f"""with {BARS}, h as (select symbol, date, close, count(*) over (partition by symbol) as n from bars where date between date '2000-12-31' - 756 and date '2000-12-31'), r as (select symbol, date, close / lag(close) over (partition by symbol order by date) - 1 as ret from h where n >= 84),
t as (select *, count(*) over (partition by symbol) as n from (select * from r where ret is not null qualify row_number() over (partition by symbol order by date desc) <= 252)), u as (select * from t where n >= 84),
al as (select * from u qualify count(*) over (partition by date) = (select count(distinct symbol) from u))
select x.symbol as a, y.symbol as b, {R('covar_samp(x.ret, y.ret) * case when x.symbol = y.symbol then 1 else 0.6 end')} as cov from al x join al y using (date) group by 1, 2""")
def covariance_recent(spark, d):
    return _rounded(markets.recent_covariance(panel.bars(spark, d), "2000-12-31"), "a", "b")
