"""Queries over strategies: their files checked line by line, and gates over what is known of them, with SQL.

A strategy a supplier: its file is written from the supplier's row, its trading from the supplier's lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import evaluate, gates
from ..operators.asof import as_of_few
from ..operators.factors import REGISTRY, price_factors
from ..operators.runs import Run
from ..sources import panel, strategies
from ..sources.dimension import SymbolDimension
from ..sources.ordered import read_ordered, write_ordered
from ..sources.panel import SECTORS
from ..sources.tables import fresh, kept
from ..streaming.restatements import merge_stream, restated
from .extended import DAILY, REG, all_obs
from .extended import SQL as EXTENDED
from .markets import regimes
from .ranking import RANKED
from .research import BARS, OBS, R, obs

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def put(f):
        Q[name], SQL[name] = f, sql
        return f

    return put


#: Names that the files give to factors; the last is none.
NAMES = [*RANKED[:4], "unheard_of"]
LIMITS = {"maximum_parameter_count": 9, "maximum_turnover": 1.17, "maximum_cost_drag": 0.041, "minimum_factor_history_count": 3, "minimum_icir": 0.1}


def strategy_files(spark, d) -> DataFrame:
    """(file, text): lines stand where they are in every file, so that SQL can name them."""
    names = ", ".join(f"'{n}'" for n in NAMES)
    every = lambda n, a, b: f"if({n}, '{a}', '{b}')"
    lines = [
        every("k % 11 = 0", "# no name", "name: strategy"), "concat('description: \"of nation # ', n, '\"  # a comment')", "concat('version: v', k % 3)", "'author: desk'", "'created_at: 1996-01-01'",
        "'universe:'", "concat('  type: ', case k % 7 when 0 then 'moon' when 1 then 'default' when 2 then 'default' else 'custom' end)", every("k % 7 in (1, 3)", "", "  symbols:"),
        "if(k % 7 in (1, 3), '', concat('    - S', k))", "if(k % 7 in (1, 3), '', if(k % 13 = 0, '    - no good', concat('    - \"T.', k, '\"')))",
        "'factors:'", f"concat('  - name: ', array({names})[k % 5])", every("k % 17 = 0", "    weight: -0.5", "    weight: 5e-1"), f"concat('  - name: ', array({names})[(k * k + 1) % 5])", "concat('    weight: ', (k % 4 + 1) * 0.25)",
        "'regime:'", every("k % 2 = 0", "  enabled: true", "  enabled: false"), "'  preferred_regimes:'", every("k % 3 = 0", "", "    - BULL"),
        "'portfolio:'", every("k % 19 = 0", "  method: luck", "  method: risk_parity"), "concat('  max_position_weight: ', p, 'e-2')",
        "'validation:'", "concat('  minimum_regime_sample: ', n, if(k % 23 = 0, '.5', ''))", every("k % 29 = 0", "  no_lookahead: false", "  require_walk_forward: true"),
    ]
    s = spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey as k", "s_nationkey as n", "cast(floor(s_acctbal / 100) as int) as p")
    return s.select(F.concat(F.lit("supplier_"), F.col("k").cast("string"), F.lit(".yaml")).alias("file"), F.concat_ws("\n", *map(F.expr, lines)).alias("text"))


P = f"""p0 as (select s_suppkey as k, s_nationkey as n, cast(floor(s_acctbal / 100) as integer) as p, {NAMES}[s_suppkey % 5 + 1] as a, {NAMES}[(s_suppkey * s_suppkey + 1) % 5 + 1] as b from supplier),
pr as (select 'supplier_' || k || '.yaml' as file, unnest([
  case when k % 11 = 0 then {{'line': null::integer, 'code': 'MISSING_NAME', 'detail': null::varchar}} end,
  case when k % 7 = 0 then {{'line': 7, 'code': 'UNSUPPORTED_UNIVERSE_TYPE', 'detail': 'moon'}} end,
  case when k % 7 = 1 then {{'line': 7, 'code': 'WARN_DEFAULT_UNIVERSE_USED', 'detail': null}} end,
  case when k % 7 = 3 then {{'line': 7, 'code': 'CUSTOM_UNIVERSE_REQUIRES_SYMBOLS', 'detail': null}} end,
  case when k % 13 = 0 and k % 7 not in (1, 3) then {{'line': 10, 'code': 'INVALID_SYMBOL', 'detail': 'NO GOOD'}} end,
  case when a = 'unheard_of' then {{'line': 12, 'code': 'UNSUPPORTED_FACTOR', 'detail': a}} end,
  case when b = 'unheard_of' then {{'line': 14, 'code': 'UNSUPPORTED_FACTOR', 'detail': b}} end,
  case when a = b then {{'line': 14, 'code': 'DUPLICATE_FACTOR', 'detail': b}} end,
  case when k % 17 = 0 then {{'line': 12, 'code': 'INVALID_FACTOR_WEIGHT', 'detail': a}} end,
  case when (k % 4 + 1) * 0.25 + case when k % 17 = 0 then 0 else 0.5 end <> 1 then {{'line': null, 'code': 'WARN_FACTOR_WEIGHTS_NORMALIZED', 'detail': null}} end,
  case when k % 2 = 0 and k % 3 = 0 then {{'line': 17, 'code': 'WARN_REGIME_ENABLED_WITHOUT_PREFERRED_REGIMES', 'detail': null}} end,
  case when k % 19 = 0 then {{'line': 21, 'code': 'UNSUPPORTED_PORTFOLIO_METHOD', 'detail': 'luck'}} end,
  case when p <= 0 or p > 100 then {{'line': 22, 'code': 'INVALID_MAX_POSITION_WEIGHT', 'detail': p || 'e-2'}} end,
  case when k % 23 = 0 then {{'line': 24, 'code': 'INVALID_MINIMUM_REGIME_SAMPLE', 'detail': n || '.5'}} end,
  case when k % 29 = 0 then {{'line': 25, 'code': 'NO_LOOKAHEAD_OVERRIDE_NOT_ALLOWED', 'detail': null}} end,
  case when k % 29 = 0 then {{'line': 25, 'code': 'WARN_UNSUPPORTED_FIELD', 'detail': 'validation.no_lookahead'}} end]) as x from p0)"""


@query("strategy_problems", f"with {P} select file, x.line as line, x.code as code, x.detail as detail, case when x.code like 'WARN%' then 'WARNING' else 'ERROR' end as severity from pr where x.code is not null")
def strategy_problems(spark, d):
    files = strategy_files(spark, d)
    return strategies.problems(files, kept(strategies.entries(files), "entries"), RANKED)


def strategy_metrics(spark, d) -> DataFrame:
    """What the gates ask of every strategy, as rows (METRICS)."""
    files = strategy_files(spark, d)
    lines = kept(strategies.entries(files), "entries")

    def rows(df: DataFrame, gate: str, subject=None, **values) -> DataFrame:
        """A row a metric from one pass over rows that have ``strategy``."""
        made = F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in values.items()])
        return df.select("strategy", F.lit(gate).alias("gate"), (F.lit(None).cast("string") if subject is None else F.col(subject)).alias("subject"), F.explode(made).alias("x")).select("strategy", "gate", "x.metric", "subject", "x.value")

    of_kind = lambda s: F.count(F.when(F.col("severity") == s, 1))
    schema = strategies.problems(files, lines, RANKED).groupBy(F.col("file").alias("strategy")).agg(of_kind("ERROR").alias("e"), of_kind("WARNING").alias("w"))
    parts = ["universe", "regime", "portfolio", "risk", "execution", "validation", "metadata"]
    setting = F.col("section").isin(parts) & F.col("key").isNotNull() & F.col("item").isNull()
    named = F.when((F.col("section") == "factors") & (F.col("key") == "name"), 1)
    size = lines.filter("error is null").groupBy(F.col("file").alias("strategy")).agg(F.count(named).alias("f"), F.count(F.when(setting, 1)).alias("p"), F.max((F.col("section") == "regime") & (F.col("key") == "enabled") & (F.col("value") == "true")).alias("enabled"))
    factors = strategies.factors(lines).select(F.col("file").alias("strategy"), "name").distinct()

    # the history of factors: a row a factor and year
    ic = kept(evaluate.daily_ic(all_obs(spark, d), ["factor_name"]), "daily-ic")
    year = ic.groupBy("factor_name", F.year("signal_date").alias("yr")).agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), F.try_divide(F.avg("rank_ic"), F.stddev_samp("rank_ic")).alias("icir"), (F.count("ic") / F.count("*")).alias("coverage"))
    latest = lambda c: F.max_by(c, "yr")
    test, train = F.avg(F.when(F.col("yr") >= 1996, F.col("icir"))), F.avg(F.when(F.col("yr") < 1996, F.col("icir")))
    history = year.groupBy("factor_name").agg(F.count("*").alias("n"), latest("ic").alias("ic"), latest("rank_ic").alias("rank_ic"), latest("icir").alias("icir"), latest("coverage").alias("coverage"), test.alias("test"), (train - test).alias("gap"))
    r = regimes(spark, d).select(F.col("date").alias("regime_date"), "regime")
    seen = as_of_few(ic.select("factor_name", "signal_date"), r, "signal_date", "regime_date").groupBy("factor_name").agg(F.count_distinct("regime").alias("regimes"))
    least = r.groupBy("regime").agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]  # of a handful of regimes the rarest
    known = factors.join(history.join(seen, "factor_name", "left"), factors["name"] == F.col("factor_name"), "left")

    # trading: the supplier's lines; without any there is no evidence
    amount = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", F.year("l_shipdate").alias("yr"), "l_partkey", "l_extendedprice", (F.col("l_extendedprice") * F.col("l_tax")).alias("cost"))
    by_part = amount.groupBy("l_suppkey", "yr", "l_partkey").agg(F.sum("l_extendedprice").alias("v"), F.sum("cost").alias("c"), F.count("*").alias("n"))
    by_year = by_part.groupBy("l_suppkey", "yr").agg(F.sum("v").alias("v"))
    full = F.when(F.col("yr").between(1993, 1997), F.col("v"))
    down = by_year.groupBy("l_suppkey").agg((F.min(full) / F.max(full) - 1).alias("down"))
    trades = by_part.groupBy("l_suppkey", "l_partkey").agg(F.sum("v").alias("v"), F.sum("c").alias("c"), F.sum("n").alias("n")).groupBy("l_suppkey").agg(F.sum("v").alias("v"), F.sum("c").alias("c"), (F.sum("n") / F.count("*")).alias("turn"))
    sim = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string"), F.lit(".yaml")).alias("strategy"), F.col("s_suppkey").alias("l_suppkey")).join(trades, "l_suppkey", "left").join(down, "l_suppkey", "left")

    c = F.col
    return kept(reduce(DataFrame.unionByName, [
        rows(schema, "schema_validation", errors=c("e"), warnings=c("w")),
        rows(known, "factor_history", "name", history_count=c("n"), coverage=c("coverage"), ic=c("ic"), rank_ic=c("rank_ic"), icir=c("icir")),
        rows(known, "walk_forward", "name", fold_count=c("n"), test_sharpe=c("test"), train_test_gap=c("gap")),
        rows(size, "regime_coverage", regime_days=F.lit(least)),
        rows(known.join(size.filter("enabled"), "strategy", "left_semi"), "regime_coverage", "name", factor_regimes=c("regimes")),
        rows(sim, "trading_simulation", final_equity=c("v"), max_drawdown=c("down"), turnover=c("turn"), cost_drag=F.try_divide("c", "v")),
        rows(size, "complexity", factor_count=c("f"), parameter_count=c("f") + c("p")),
    ]), "gate-metrics")


GATES = f"""with {BARS}, {REG}, dl as ({DAILY}), {P},
yr as (select factor_name, year(signal_date) as y, avg(ic) as ic, avg(rank_ic) as rank_ic, avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) as icir, count(ic) * 1.0 / count(*) as coverage from dl group by 1, 2),
hist as (select factor_name, count(*) as n, arg_max(ic, y) filter (ic is not null) as ic, arg_max(rank_ic, y) as rank_ic, arg_max(icir, y) as icir, arg_max(coverage, y) as coverage, avg(icir) filter (y >= 1996) as test, avg(icir) filter (y < 1996) - avg(icir) filter (y >= 1996) as gap from yr group by 1),
reg_seen as (select factor_name, count(distinct regime) as regimes from dl asof join reg on dl.signal_date >= reg.date group by 1),
least as (select min(n) as least from (select regime, count(*) as n from reg group by 1)),
pf as (select distinct 'supplier_' || k || '.yaml' as file, k, unnest([a, b]) as name from p0), known as (select * from pf left join hist on hist.factor_name = name left join reg_seen on reg_seen.factor_name = name),
pn as (select file, count(*) filter (x.code not like 'WARN%') as errors, count(*) filter (x.code like 'WARN%') as warnings from pr where x.code is not null group by 1),
vy as (select l_suppkey, year(l_shipdate) as y, sum(l_extendedprice) as v from lineitem group by 1, 2), dd as (select l_suppkey, 1 - min(v) filter (y between 1993 and 1997) / max(v) filter (y between 1993 and 1997) as down from vy group by 1),
tr as (select l_suppkey, count(*) * 1.0 / count(distinct l_partkey) as turn, sum(l_extendedprice * l_tax) / sum(l_extendedprice) as drag from lineitem group by 1),
st as (select 'supplier_' || k || '.yaml' as file, k, coalesce(errors, 0) as errors, coalesce(warnings, 0) as warnings, down, turn, drag, least, 9 + case when k % 7 in (1, 3) then 0 else 1 end as params,
  from p0 left join pn on pn.file = 'supplier_' || k || '.yaml' left join dd on dd.l_suppkey = k left join tr on tr.l_suppkey = k, least),
kn as (select file, sum(cast(coalesce(n, 0) < 3 as integer) + cast(coalesce(coverage, -1) < 0.3 as integer) + cast(coalesce(ic < 0.02, false) as integer) + cast(coalesce(rank_ic < 0.02, false) as integer) + cast(coalesce(icir < 0.1, false) as integer)) as weak,
  sum(cast(coalesce(n, 0) < 3 as integer) + cast(coalesce(test < 0.2, false) as integer) + cast(coalesce(gap > 0.5, false) as integer)) as folds, count(*) filter (k % 2 = 0 and coalesce(regimes, 0) < 1) as unseen from known group by 1),
g as (select st.file as strategy, unnest([
  {{'gate': 'schema_validation', 'ord': 0, 'severity': case when errors > 0 then 4 when warnings > 0 then 2 else 0 end, 'reason': case when errors > 0 then 'STRATEGY_SCHEMA_INVALID' else 'WARN_STRATEGY_SCHEMA_WARNINGS' end, 'n': 1}},
  {{'gate': 'data_quality', 'ord': 1, 'severity': 0, 'reason': '', 'n': 0}},
  {{'gate': 'factor_history', 'ord': 2, 'severity': case when weak > 0 then 2 else 0 end, 'reason': 'WARN_FACTOR_EVIDENCE_WEAK', 'n': weak}},
  {{'gate': 'walk_forward', 'ord': 3, 'severity': case when folds > 0 then 2 else 0 end, 'reason': 'WARN_WALK_FORWARD_EVIDENCE_WEAK', 'n': folds}},
  {{'gate': 'regime_coverage', 'ord': 4, 'severity': case when least < 30 or unseen > 0 then 2 else 0 end, 'reason': case when least < 30 then 'WARN_LOW_REGIME_SAMPLE' else 'WARN_MISSING_FACTOR_REGIME_HISTORY' end, 'n': unseen + cast(least < 30 as integer)}},
  {{'gate': 'trading_simulation', 'ord': 5, 'severity': case when down > 0.25 then 4 when turn is null or turn > 1.17 or drag > 0.041 then 2 else 0 end,
    'reason': case when down > 0.25 then 'REJECT_MAX_DRAWDOWN' when turn is null then 'WARN_NO_TRADING_SIMULATION_EVIDENCE' when turn > 1.17 then 'WARN_HIGH_TURNOVER' else 'WARN_HIGH_COST_DRAG' end,
    'n': case when down > 0.25 or turn is null then 1 else cast(turn > 1.17 as integer) + cast(drag > 0.041 as integer) end}},
  {{'gate': 'complexity', 'ord': 6, 'severity': case when params > 9 then 2 else 0 end, 'reason': 'WARN_HIGH_PARAMETER_COUNT', 'n': 1}}]) as x from st join kn on kn.file = st.file),
gr as (select strategy, x.gate as gate, x.ord as ord, x.severity as severity, ['PASS', 'SKIPPED', 'WARNING', 'FAIL', 'REJECTED'][x.severity + 1] as status, case when x.severity = 0 then 'PASS' else x.reason end as reason, case when x.severity = 0 then 0 else cast(x.n as bigint) end as n_findings from g)"""


@query("strategy_gates", f"{GATES} select strategy, gate, ord, status, reason, n_findings from gr")
def strategy_gates(spark, d):
    m = strategy_metrics(spark, d)
    return gates.gate_results(m, gates.findings(m, gates.rules(spark, LIMITS))).drop("severity")


@query("strategy_status", f"""{GATES}, o as (select strategy, max(severity) as worst, count(*) filter (status = 'PASS') as n_passed, count(*) filter (status = 'WARNING') as n_warnings, count(*) filter (status = 'REJECTED') as n_rejected, arg_min(gate, ord - 100 * severity) as first_gate, arg_min(reason, ord - 100 * severity) as reason from gr group by 1)
select strategy, ['PASS', 'SKIPPED', 'WARNING', 'FAIL', 'REJECTED'][worst + 1] as status, case when worst > 0 then first_gate end as first_gate, case when worst > 0 then reason end as reason, n_passed, n_warnings, n_rejected from o""")
def strategy_status(spark, d):
    m = strategy_metrics(spark, d)
    return gates.overall(gates.gate_results(m, gates.findings(m, gates.rules(spark, LIMITS))))


@query("validation_run", f"""with dl as ({DAILY}), e as (select factor_name as factor, avg(ic) as ic, avg(rank_ic) as rank_ic, count(ic) as n_dates from dl group by 1),
y as (select factor_name as factor, year(signal_date) as yr, avg(rank_ic) as r from dl group by 1, 2), s as (select factor, avg(cast(round_even(r, 12) > 0 as double)) as positive, min(r) as worst from y group by 1)
select factor, {R('ic')} as ic, {R('rank_ic')} as rank_ic, n_dates, {R('positive')} as positive_years, {R('worst')} as worst_year, case when factor = '{RANKED[2]}' then 2 else 1 end as attempts, cast(row_number() over (order by round_even(rank_ic, 6) desc, factor) as integer) as place from e join s using (factor)""")
def validation_run(spark, d):
    """Broken off twice, by a task that fails and by a caller who goes away, and taken up again: as if never broken."""
    bars, root = kept(panel.clean(panel.bars(spark, d)).select("symbol", "date", "close"), "run-bars"), fresh(spark, "validation")

    def daily(name, source=None):
        values = price_factors(source or bars, [name])
        return evaluate.daily_ic(evaluate.observations(values, name, [20], REGISTRY[name].sign))

    def broken():
        return daily(RANKED[2], spark.read.parquet(f"{root}/nothing-is-here"))

    first = Run(spark, root)
    first.work("daily", {n: (lambda n=n: daily(n)) for n in RANKED if n != RANKED[2]} | {RANKED[2]: broken}, workers=2)
    run = Run(spark, root)  # whoever takes it up knows the folder alone
    run.work("daily", {n: (lambda n=n: daily(n)) for n in RANKED}, workers=2)

    def yearly(name):
        y = run.results("daily").filter(F.col("task") == name).groupBy(F.year("signal_date").alias("yr")).agg(F.avg("rank_ic").alias("r"))
        return y.agg(F.avg((F.bround("r", 12) > 0).cast("double")).alias("positive"), F.min("r").alias("worst"))

    run.work("years", {n: (lambda n=n: yearly(n)) for n in RANKED[:3]}, workers=2)
    run = Run(spark, root)
    run.work("years", {n: (lambda n=n: yearly(n)) for n in RANKED}, workers=2)
    e = run.results("daily").groupBy(F.col("task").alias("factor")).agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), F.count("ic").alias("n_dates"))
    y = run.results("years").select(F.col("task").alias("factor"), r6("positive").alias("positive_years"), r6("worst").alias("worst_year"))
    tries = run.state().filter("phase = 'daily'").select(F.col("task").alias("factor"), "attempts")
    place = F.row_number().over(Window.orderBy(F.desc(F.bround("rank_ic", 6)), "factor"))  # a row a factor
    return e.join(y, "factor").join(tries, "factor").select("factor", r6("ic").alias("ic"), r6("rank_ic").alias("rank_ic"), "n_dates", "positive_years", "worst_year", "attempts", place.alias("place"))


@query("matrix_ordered", f"with {OBS('momentum_20d', [5, 20, 60])} select row_number() over (order by signal_date, symbol, horizon) - 1 as position, signal_date, symbol, horizon, {R('value')} as value, {R('future_return')} as future_return from obs")
def matrix_ordered(spark, d):
    """Observations written by date, symbol and horizon in files of one order, and read again with their places."""
    at = fresh(spark, "ordered")
    write_ordered(obs(spark, d, "momentum_20d", [5, 20, 60]), ["signal_date", "symbol", "horizon"], at, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_ordered(spark, at).select("position", "signal_date", "symbol", "horizon", r6("value").alias("value"), r6("future_return").alias("future_return"))


MOVED = "symbol in ('Brand#11', 'Brand#23', 'Brand#34', 'Brand#42', 'Brand#55')"
DIM = f"""v as (select upper(symbol) as symbol, date '1992-01-01' as valid_from, sector from sectors union all select upper(symbol), date '1996-01-01', 'MOVED' from sectors where {MOVED}),
w as (select *, lead(valid_from) over (partition by symbol order by valid_from) - 1 as valid_to from v)"""


def dimension(spark, d) -> SymbolDimension:
    """Sectors from 1992 on; in 1996 some symbols change theirs, and the others are told anew without a change."""
    dim, s = SymbolDimension(spark, fresh(spark, "dimension"), ["sector", "asset_type"], buckets=8), panel.sectors(spark, d)
    kind = F.when(F.expr(MOVED), "FUND").otherwise("STOCK").alias("asset_type")
    dim.upsert(s.select("symbol", F.lit("1992-01-01").alias("valid_from"), "sector", kind), "first")
    later = s.select("symbol", F.lit("1996-01-01").alias("valid_from"), F.when(F.expr(MOVED), "MOVED").otherwise(F.col("sector")).alias("sector"), kind)
    dim.upsert(later, "second")
    dim.upsert(later, "second")
    return dim


@query("symbol_versions", f"with {SECTORS}, {DIM} select symbol, valid_from, cast(valid_to as date) as valid_to, sector from w")
def symbol_versions(spark, d):
    return dimension(spark, d).versions().select("symbol", "valid_from", "valid_to", "sector")


@query("symbols_by_sector", f"with {SECTORS}, {DIM}, a as (select date '1995-12-31' as day union all select date '1996-01-01') select day, symbol, sector from a join w on valid_from <= day and (valid_to is null or valid_to >= day) where sector = 'MOVED' or sector = 'PROMO'")
def symbols_by_sector(spark, d):
    """Two sectors on the days before and after the change."""
    dim = dimension(spark, d)
    of = lambda day, sector: dim.by("sector", sector, day).select(F.lit(day).cast("date").alias("day"), "symbol", "sector")
    return reduce(DataFrame.unionByName, [of(day, sector) for day in ("1995-12-31", "1996-01-01") for sector in ("moved", "Promo")])


@query("sector_closes_as_of", f"""with {BARS}, {SECTORS}, {DIM} select w.sector as sector, cast(year(b.date) as integer) as yr, count(*) as n, {R('avg(b.close)')} as close
from bars b join w on upper(b.symbol) = w.symbol and b.date >= w.valid_from and (w.valid_to is null or b.date <= w.valid_to) group by 1, 2""")
def sector_closes_as_of(spark, d):
    """Mean close by the sector that a symbol had at the time."""
    rows = dimension(spark, d).attach(panel.bars(spark, d).select("symbol", "date", "close"))
    return rows.groupBy("sector", F.year("date").alias("yr")).agg(F.count("*").alias("n"), r6(F.avg("close")).alias("close"))


@query("restated_stream", EXTENDED["fundamental_merge"])
def restated_stream(spark, d):
    """The table of ``fundamental_merge`` from a stream in which restatements come before what they restate, and once more from the start."""
    f = panel.fundamentals(spark, d).select("symbol", "fiscal_period_end", "fiscal_quarter", "report_date", "revenue", "fiscal_year")
    new = f.filter("fiscal_year >= 1996").withColumn("report_date", F.date_add("report_date", F.when(F.col("fiscal_quarter") == "Q1", -10).otherwise(10))).withColumn("revenue", -F.col("revenue"))
    at, keys = fresh(spark, "statements"), ["symbol", "fiscal_period_end", "fiscal_quarter"]
    for side, arrived in ((new, 2), (f.filter("fiscal_year < 1997"), 1)):
        side.drop("fiscal_year").withColumn("arrived", F.lit(arrived)).repartition(2, "symbol").write.mode("append").parquet(f"{at}/in")
    table = restated(spark, f"{at}/table", 8, keys)
    schema = spark.read.parquet(f"{at}/in").schema
    for checkpoint in ("checkpoint", "lost-and-begun-anew"):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
        merge_stream(stream, table, f"{at}/{checkpoint}").awaitTermination()
    return table.read().select("symbol", "fiscal_period_end", "fiscal_quarter", "report_date", r6("revenue").alias("revenue"))
