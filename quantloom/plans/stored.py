"""Queries over tables that are kept: matrices that grow, rows upserted by key, tiled covariances, long histories in buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import correlation, r6
from ..operators.buckets import as_of_in_buckets, price_factors_in_buckets
from ..operators.factors import PRICE, by_symbol
from ..operators.tiles import covariance_tiles
from ..operators.wide import wide_quantiles, wide_ranks
from ..sources import panel, statements
from ..sources.matrices import MatrixCache
from ..sources.panel import BARS, FUND
from ..sources.tables import KeyedTable, fresh, kept
from .research import ASOF, FACTORS, R

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def stored_bars(spark, d):
    """Weekly bars of brands, written in the order of dates: a scan of the newest reads their row groups alone."""
    at = fresh(spark, "bars")
    panel.clean(panel.bars(spark, d)).select("symbol", "date", "close").repartitionByRange("date").sortWithinPartitions("date").write.parquet(at)
    return spark.read.parquet(at)


@query("matrix_cache_growth", f"""with {BARS}, {FACTORS}, lead_h as (
  select symbol, date, unnest([5, 20, 60]) as horizon, unnest([f5, f20, f60]) as future_date, unnest([r5, r20, r60]) as future_return
  from (select symbol, date, lead(date, 5) over w as f5, lead(date, 20) over w as f20, lead(date, 60) over w as f60,
          lead(close, 5) over w / close - 1 as r5, lead(close, 20) over w / close - 1 as r20, lead(close, 60) over w / close - 1 as r60
        from bars where close > 0 window w as (partition by symbol order by date)))
select symbol, date as signal_date, horizon, future_date, {R('volatility_20d * -1')} as value, {R('future_return')} as future_return
from fac join lead_h using (symbol, date) where volatility_20d is not null and future_date is not null""")
def matrix_cache_growth(spark, d):
    """Built up to 1996, grown twice, then given a horizon more: the same as one build."""
    bars, cache = stored_bars(spark, d), MatrixCache(spark)
    for end in ("1996-12-31", "1997-06-30"):
        cache.matrix(bars.filter(F.col("date") <= F.lit(end).cast("date")), "volatility_20d", [5, 20])
    cache.matrix(bars, "volatility_20d", [5, 20])
    out = cache.matrix(bars, "volatility_20d", [5, 20, 60])
    return out.select("symbol", "signal_date", "horizon", "future_date", r6("value").alias("value"), r6("future_return").alias("future_return"))


RUNS = """runs as (
  select symbol, date, 1 as revision, close, volume from bars where date < date '1997-01-01'
  union all select symbol, date, 2, close * 1.01, volume + 1 from bars where date >= date '1996-01-01'
  union all select symbol, date, case when month(date) = 3 then 3 else 0 end, close * 0.5, volume + 2 from bars)"""


@query("store_upsert_runs", f"with {BARS}, {RUNS} select symbol, date, revision, {R('close')} as close, volume from (select *, row_number() over (partition by symbol, date order by revision desc) as k from runs) where k = 1")
def store_upsert_runs(spark, d):
    """Three runs, one of them tried again: by key, the row of the highest revision stays."""
    bars = panel.bars(spark, d)
    row = lambda revision, factor, more: [F.col("symbol"), F.col("date"), revision.cast("int").alias("revision"), (F.col("close") * factor).alias("close"), (F.col("volume") + more).alias("volume")]
    table = KeyedTable(spark, fresh(spark, "bars-store"), ["symbol", "date"], ["revision"], buckets=16)
    table.upsert(bars.filter("date < date'1997-01-01'").select(*row(F.lit(1), 1.0, 0)), "first")
    second = bars.filter("date >= date'1996-01-01'").select(*row(F.lit(2), 1.01, 1))
    table.upsert(second, "second")
    table.upsert(second, "second")
    table.upsert(bars.select(*row(F.when(F.month("date") == 3, 3).otherwise(0), 0.5, 2)), "third")
    return table.read().select("symbol", "date", "revision", r6("close").alias("close"), "volume")


NAMES = [f.name for f in PRICE]


@query("factors_in_buckets", f"with {BARS}, {FACTORS} select symbol, date, {', '.join(f'{R(n)} as {n}' for n in NAMES)} from fac")
def factors_in_buckets(spark, d):
    """All price factors of all bars, a task a symbol and year instead of a symbol."""
    out = price_factors_in_buckets(panel.clean(panel.bars(spark, d)), days=366)
    return out.select("symbol", "date", *[r6(n).alias(n) for n in NAMES])


@query("asof_in_buckets", f"with {ASOF} select symbol, date, report_date, fiscal_period_end, {R('pe_ratio')} as pe_ratio, {R('roe')} as roe from known")
def asof_in_buckets(spark, d):
    """The last statement known at each bar, carried from year to year."""
    bars = panel.clean(panel.bars(spark, d)).select("symbol", "date")
    out = as_of_in_buckets(bars, panel.fundamentals(spark, d), ["symbol"], "date", "report_date", ["fiscal_period_end"], days=366)
    return out.select("symbol", "date", "report_date", "fiscal_period_end", r6("pe_ratio").alias("pe_ratio"), r6("roe").alias("roe"))


@query("covariance_tiles", """with m as (
  select l_suppkey as symbol, cast(date_trunc('month', l_shipdate) as date) as date, sum(l_extendedprice) / sum(l_quantity) as close from lineitem group by 1, 2
), r as (
  select symbol, date, close / lag(close) over (partition by symbol order by date) - 1 as ret from m
), a as (select * from r where ret is not null)
select cast(x.symbol as varchar) as a, cast(y.symbol as varchar) as b, count(*) as n, cast(round_even(covar_samp(x.ret, y.ret), 6) as double) as cov
from a x join a y on x.date = y.date group by 1, 2""")
def covariance_tiles_of_suppliers(spark, d):
    """Covariances of the monthly returns of all suppliers, over the months that two of them share."""
    bars = panel.clean(panel.bars(spark, d, "l_suppkey", "month"))
    ret = F.col("close") / F.lag("close").over(by_symbol()) - 1
    out = covariance_tiles(bars.withColumn("ret", ret).filter("ret is not null"), "ret")
    return out.select("a", "b", "n", r6("cov").alias("cov"))


SUPPLIERS = """sp as (
  select cast(l_suppkey as varchar) as symbol, cast(date_trunc('month', l_shipdate) as date) as date, sum(l_extendedprice) / sum(l_quantity) as close from lineitem group by 1, 2
), so as (
  select symbol, date, close / lag(close, 3) over w - 1 as value, lead(close) over w / close - 1 as future_return from sp window w as (partition by symbol order by date)
), obs as (select * from so where value is not null and future_return is not null)"""


@query("rank_ic_wide", f"""with {SUPPLIERS}, rk as (
  select date, rank() over (partition by date order by value) + (count(*) over (partition by date, value) - 1) / 2.0 as rv,
         rank() over (partition by date order by future_return) + (count(*) over (partition by date, future_return) - 1) / 2.0 as rr from obs)
select date, {R('covar_samp(rv, rr) / nullif(stddev_samp(rv) * stddev_samp(rr), 0)')} as rank_ic, count(*) as n from rk group by 1""")
def rank_ic_wide(spark, d):
    """Rank correlation of three-month momentum and the next return over all suppliers, a date in many tasks."""
    bars = panel.clean(panel.bars(spark, d, "l_suppkey", "month"))
    value, ahead = F.col("close") / F.lag("close", 3).over(by_symbol()) - 1, F.lead("close").over(by_symbol()) / F.col("close") - 1
    obs = kept(bars.select("symbol", "date", value.alias("value"), ahead.alias("future_return")).filter("value is not null and future_return is not null"), "wide-obs")
    ranked = wide_ranks(wide_ranks(obs, ["date"], "value", "rv"), ["date"], "future_return", "rr")
    return ranked.groupBy("date").agg(r6(correlation("rv", "rr")).alias("rank_ic"), F.count("*").alias("n"))


@query("quantiles_wide", f"select l_returnflag, l_linestatus, {', '.join(R(f'quantile_cont(l_extendedprice / l_quantity, {p})') + f' as q{k}' for k, p in enumerate((0.01, 0.05, 0.5, 0.95, 0.99)))} from lineitem group by 1, 2")
def quantiles_wide(spark, d):
    """Bounds of unit prices by flag and status: a few groups that hold all rows, none in one task."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", "l_linestatus", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    out = wide_quantiles(rows, ["l_returnflag", "l_linestatus"], "price", [0.01, 0.05, 0.5, 0.95, 0.99])
    return out.select("l_returnflag", "l_linestatus", *[r6(f"q{k}").alias(f"q{k}") for k in range(5)])


METRICS = ["pe_ratio", "pb_ratio", "ev_to_ebitda", "roe", "roa", "gross_margin", "net_margin", "debt_to_equity", "current_ratio", "quick_ratio", "revenue_growth", "eps_growth"]


@query("statements_csv", f"with {FUND} select symbol, fiscal_period_end, report_date, fiscal_year, fiscal_quarter, 'USD' as currency, {', '.join(f'{R(c)} as {c}' for c in METRICS)} from (select * replace (upper(symbol) as symbol) from fund)")
def statements_csv(spark, d):
    """Metrics written as CSV and imported again: keys typed and upper-cased, empty cells NULL."""
    at = fresh(spark, "metrics-csv")
    panel.fundamentals(spark, d).withColumn("currency", F.lit("usd")).select(*statements.COMMON, *METRICS).write.option("header", True).csv(at)
    out = statements.read_csv(spark, at, "metrics")["fundamental_metrics"]
    return out.select(*statements.COMMON, *[r6(c).alias(c) for c in METRICS])
