"""Queries over scores, evidence grades, warnings and execution batches, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import backtest, evaluate, markets, scores
from ..operators.factors import REGISTRY
from .markets import SER, series
from .research import ASSIGN, IC, OBS, PER, TURN, R, _rounded, assigned, bars, obs

Q: dict = {}
SQL: dict[str, str] = {}
RANKED = ["momentum_20d", "momentum_60d", "reversal_5d", "low_volatility_score", "volatility_20d"]


def query(name: str, sql: str):
    def put(f):
        Q[name], SQL[name] = f, sql
        return f

    return put


CLAMP = lambda x: f"case when {x} is not null then greatest(0.0, least(1.0, {x})) end"
ONE = " union all ".join(f"""select * from (with {OBS(f, [20], REGISTRY[f].sign)}, {IC}, t as (select count(*) as total from bars), o as (select count(*) as n_obs from obs)
 select '{f}' as factor_name, avg(ic) as ic, avg(rank_ic) as rank_ic, avg(ic) / nullif(stddev_samp(ic), 0) as icir, count(ic) as n_dates, any_value(n_obs) * 1.0 / any_value(total) as coverage,
 case when count(ic) = 1 then 0.5 when count(ic) > 1 then case when avg(abs(ic)) > 0 then greatest(0.0, least(1.0, 1 - stddev_samp(ic) / avg(abs(ic)))) else 0.0 end end as consistency from ic, t, o)""" for f in RANKED)
GRADED = f"""m as ({ONE}),
c as (select *, 0.45 * coalesce({CLAMP('coverage')}, 0) + 0.35 * coalesce({CLAMP('consistency')}, 0) + 0.20 * least(n_dates / 30.0, 1.0) as confidence from m),
s as (select *, list_avg([{', '.join(CLAMP(f'(0.5 + {x} / 2)') for x in ('ic', 'rank_ic', 'icir', 'confidence'))}, {CLAMP('coverage')}]) as rank_score from c)"""


def factor_metrics(spark, d) -> DataFrame:
    """A row a factor: mean ICs, their ratio, share of the panel observed, consistency of the daily ICs."""
    total = bars(spark, d).agg(F.count("*").alias("total"))
    legs = reduce(DataFrame.union, [obs(spark, d, f, [20]).withColumn("factor_name", F.lit(f)) for f in RANKED])
    ic = evaluate.daily_ic(legs, ["factor_name"])
    std = F.stddev_samp("ic")
    m = ic.groupBy("factor_name").agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), F.when(std > 0, F.try_divide(F.avg("ic"), std)).alias("icir"), F.count("ic").alias("n_dates"), F.sum("n").alias("n_obs"), scores.consistency("ic").alias("consistency"))
    m = m.join(F.broadcast(total), F.lit(True))  # a single row
    return m.withColumn("coverage", F.try_divide("n_obs", "total")).drop("n_obs", "total")


@query("research_ranking", f"with {GRADED} select factor_name, {', '.join(f'{R(c)} as {c}' for c in ['ic', 'rank_ic', 'icir', 'coverage', 'consistency', 'confidence', 'rank_score'])}, n_dates, case when coverage < 0.30 then 'blocked_by_coverage' when rank_score is null then 'insufficient_evidence' when rank_score >= 0.70 then 'candidate' when rank_score >= 0.55 then 'usable_but_needs_walk_forward' else 'weak_or_inconclusive' end as grade from s")
def research_ranking(spark, d):
    m = factor_metrics(spark, d).withColumn("confidence", scores.confidence(F.col("coverage"), F.col("consistency"), F.col("n_dates")))
    signed = [F.col(c) for c in ("ic", "rank_ic", "icir", "confidence")]
    m = m.withColumn("rank_score", scores.rank_score(signed, F.col("coverage"), F.lit(None).cast("double")))
    return _rounded(m.withColumn("grade", scores.grade(F.col("rank_score"), F.col("coverage"))), "factor_name")


@query("return_quality", f"""{SER}, e as (select date, ret, product(1 + ret) over (order by date) as eq from ser), f as (select *, eq / greatest(max(eq) over (order by date), 1) - 1 as dd from e),
g as (select product(1 + ret) - 1 as total, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) as sharpe, min(dd) as fall from f)
select {R('((case when total <= 0 then 0 else least(ln(1 + total) / ln(2), 1) end) + least(abs(sharpe) / 2, 1) + greatest(least(1 + fall, 1), 0)) / 3')} as return_quality from g""")
def return_quality(spark, d):
    s = markets.return_stats(series(spark, d))
    return _rounded(s.select(scores.return_quality(F.col("total_return"), F.col("sharpe"), F.col("max_drawdown")).alias("return_quality")))


@query("strategy_warnings", f"""{SER}, {TURN.format(q=5)}, e as (select date, ret, product(1 + ret) over (order by date) as eq from ser), f as (select *, eq / greatest(max(eq) over (order by date), 1) - 1 as dd from e),
g as (select count(*) as n, product(1 + ret) - 1 as total, avg(ret) / nullif(stddev_samp(ret), 0) as sharpe, min(dd) as fall from f), u as (select avg(turnover) as turnover from turn),
sides as (select sum(long_return) as long_side, -sum(short_return) as short_side from per where long_return - short_return is not null),
one as (select symbol, sum(case when quantile = 5 then future_return / m else -future_return / m end) / 20 as part from (select *, count(*) over (partition by signal_date, quantile) as m from a) where quantile in (1, 5) group by 1),
top as (select max(part) filter (part > 0) as top from one), al as (select * from g, u, sides, top)
select concat_ws(',', case when n < 30 then 'LOW_OBSERVATION_COUNT' end, case when turnover > 1 then 'HIGH_TURNOVER' end, case when total < 0 and sharpe > 0 then 'NEGATIVE_COMPOUND_POSITIVE_SHARPE' end,
 case when fall < -0.2 then 'LARGE_DRAWDOWN' end, case when fall <= -1 then 'CAPITAL_WIPEOUT_OR_MARGIN_LOSS' end, case when top / nullif(abs(total), 0) > 0.5 then 'SYMBOL_CONCENTRATION' end,
 case when abs(long_side / nullif(short_side, 0)) > 5 or abs(long_side / nullif(short_side, 0)) < 0.2 then 'LONG_SHORT_IMBALANCE' end) as codes, n as n_returns, {R('turnover')} as turnover from al""")
def strategy_warnings(spark, d):
    a = assigned(spark, d)
    stats = markets.return_stats(series(spark, d))
    turn = backtest.turnover(a, 5).agg(F.avg("turnover").alias("turnover"))
    sides = backtest.periods(a, 5).filter("long_short_return is not null").agg(F.sum("long_return").alias("long_side"), (-F.sum("short_return")).alias("short_side"))
    top = contributions(a).agg(F.max(F.when(F.col("part") > 0, F.col("part"))).alias("top"))
    row = stats
    for one in (turn, sides, top):  # single rows
        row = row.join(F.broadcast(one), F.lit(True))
    c = F.col
    codes = scores.warnings(c("n"), c("total_return"), c("sharpe"), c("max_drawdown"), c("turnover"), c("top"), c("long_side"), c("short_side"))
    return row.select(F.array_join(codes, ",").alias("codes"), c("n").alias("n_returns"), F.bround("turnover", 6).alias("turnover"))


def contributions(a: DataFrame) -> DataFrame:
    """Per symbol: what it brought to the spread, a day."""
    n = a.filter("quantile in (1, 5)").groupBy("signal_date", "quantile").agg(F.count("*").alias("m"))
    j = a.filter("quantile in (1, 5)").join(n, ["signal_date", "quantile"])
    signed = F.when(F.col("quantile") == 5, F.col("future_return")).otherwise(-F.col("future_return"))
    return j.groupBy("symbol").agg((F.sum(signed / F.col("m")) / 20).alias("part"))


@query("execution_batches", """with o as (select o_orderkey, cast(floor(o_totalprice / 100) as bigint) as shares from orders),
b as (select 'immediate' as mode, 1 as batch union all select 'partial_fill', 1 union all select 'twap', unnest([1, 2, 3, 4]))
select o_orderkey, mode, batch, cast(case when mode = 'twap' then shares // 4 + case when batch <= shares % 4 then 1 else 0 end when mode = 'partial_fill' then floor(shares * cast(0.5 as double)) else shares end as bigint) as fill from o, b""")
def execution_batches(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.floor(F.col("o_totalprice") / 100).cast("long").alias("shares"))
    return scores.fill_batches(o, 4, 0.5).drop("shares")
