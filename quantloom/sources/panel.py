"""Bars, fundamentals and dimensions over relational tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import div

BAR_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [("symbol", T.StringType()), ("date", T.DateType()), *[(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adj_close")], ("volume", T.LongType())]])


def bars(spark: SparkSession, sf_dir: str, symbol: str = "p_brand", unit: str = "week") -> DataFrame:
    """Bars of traded parts: a symbol a brand (or ``l_suppkey``), a row a week or day."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if symbol != "l_suppkey":
        part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", symbol)
        item = item.join(part, item.l_partkey == part.p_partkey)
    price = F.col("l_extendedprice") / F.col("l_quantity")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = item.select(F.col(symbol).cast("string").alias("symbol"), F.to_date(F.date_trunc(unit, "l_shipdate")).alias("date"), price.alias("price"), key.alias("key"), "l_extendedprice", "l_quantity")
    close = F.sum("l_extendedprice") / F.sum("l_quantity")
    return rows.groupBy("symbol", "date").agg(F.min_by("price", "key").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), close.alias("close"), close.alias("adj_close"), F.sum("l_quantity").cast("long").alias("volume"))


BARS = """bars as (
  select p_brand as symbol, cast(date_trunc('week', l_shipdate) as date) as date,
         arg_min(l_extendedprice / l_quantity, l_orderkey * 10 + l_linenumber) as open,
         max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
         sum(l_extendedprice) / sum(l_quantity) as close, sum(l_extendedprice) / sum(l_quantity) as adj_close,
         cast(sum(l_quantity) as bigint) as volume
  from lineitem join part on l_partkey = p_partkey group by 1, 2)"""


def clean(bars: DataFrame) -> DataFrame:
    """Rows with a positive finite close; done before any window, since a row less moves every lag."""
    c = F.col("close")
    return bars.filter((c > 0) & ~F.isnan(c) & (c < float("inf")))


def numeric_history(bars: DataFrame) -> DataFrame:
    """Rows whose close is a number, read from text where it has to be; unlike ``clean`` it keeps closes of zero and less.

    Text that is no number, NULL and NaN go; infinite closes stay, as numbers.
    """
    d = bars.withColumn("close", F.col("close").try_cast("double"))
    return d.filter(F.col("close").isNotNull() & ~F.isnan("close"))


METRICS = ["pe_ratio", "pb_ratio", "ev_to_ebitda", "roe", "roa", "gross_margin", "net_margin", "revenue_growth", "eps_growth", "debt_to_equity", "current_ratio", "quick_ratio"]


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a brand and quarter, known 45 days after the quarter's end."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    q = F.date_trunc("quarter", "l_shipdate")
    flag = lambda c, v: F.sum((F.col(c) == v).cast("long")).cast("double")
    price = F.col("l_extendedprice")
    out = item.join(part, item.l_partkey == part.p_partkey).groupBy(F.col("p_brand").alias("symbol"), F.to_date(q).alias("q")).agg(
        F.sum(price * (1 - F.col("l_discount"))).alias("revenue"), F.avg(price).alias("eps"),
        div(F.avg("p_retailprice"), F.avg("l_quantity")).alias("pe_ratio"), div(F.avg("p_retailprice"), F.avg("p_size")).alias("pb_ratio"),
        div(F.sum(price), F.sum(price * (F.col("l_discount") + F.col("l_tax")))).alias("ev_to_ebitda"),
        F.avg("l_discount").alias("roe"), F.avg("l_tax").alias("roa"), (1 - F.avg("l_discount")).alias("gross_margin"), (1 - F.avg("l_discount") - F.avg("l_tax")).alias("net_margin"),
        div(flag("l_returnflag", "R"), F.count("*").cast("double")).alias("debt_to_equity"), div(flag("l_linestatus", "O"), flag("l_linestatus", "F")).alias("current_ratio"), div(flag("l_returnflag", "N"), flag("l_returnflag", "A")).alias("quick_ratio"),
    )
    w = Window.partitionBy("symbol").orderBy("q")
    end = F.date_add(F.add_months("q", 3), -1)
    out = out.withColumn("revenue_growth", div(F.col("revenue"), F.lag("revenue").over(w)) - 1).withColumn("eps_growth", div(F.col("eps"), F.lag("eps").over(w)) - 1)
    return out.select("symbol", end.alias("fiscal_period_end"), F.date_add(end, 45).alias("report_date"), F.year("q").alias("fiscal_year"), F.concat(F.lit("Q"), F.quarter("q")).alias("fiscal_quarter"), "revenue", *METRICS)


FUND = """fq as (
  select p_brand as symbol, cast(date_trunc('quarter', l_shipdate) as date) as q,
    sum(l_extendedprice * (1 - l_discount)) as revenue, avg(l_extendedprice) as eps,
    avg(p_retailprice) / nullif(avg(l_quantity), 0) as pe_ratio, avg(p_retailprice) / nullif(avg(p_size), 0) as pb_ratio,
    sum(l_extendedprice) / nullif(sum(l_extendedprice * (l_discount + l_tax)), 0) as ev_to_ebitda,
    avg(l_discount) as roe, avg(l_tax) as roa, 1 - avg(l_discount) as gross_margin, 1 - avg(l_discount) - avg(l_tax) as net_margin,
    cast(count(*) filter (l_returnflag = 'R') as double) / count(*) as debt_to_equity,
    cast(count(*) filter (l_linestatus = 'O') as double) / nullif(count(*) filter (l_linestatus = 'F'), 0) as current_ratio,
    cast(count(*) filter (l_returnflag = 'N') as double) / nullif(count(*) filter (l_returnflag = 'A'), 0) as quick_ratio
  from lineitem join part on l_partkey = p_partkey group by 1, 2),
fund as (
  select *, cast(q + interval 3 month - interval 1 day as date) as fiscal_period_end,
    cast(q + interval 3 month - interval 1 day as date) + 45 as report_date,
    cast(year(q) as integer) as fiscal_year, 'Q' || quarter(q) as fiscal_quarter,
    revenue / nullif(lag(revenue) over (partition by symbol order by q), 0) - 1 as revenue_growth,
    eps / nullif(lag(eps) over (partition by symbol order by q), 0) - 1 as eps_growth
  from fq)"""


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sector of a brand: the most frequent first word of its parts' types, ties by name."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    n = part.groupBy(F.col("p_brand").alias("symbol"), F.split("p_type", " ")[0].alias("sector")).count()
    w = Window.partitionBy("symbol").orderBy(F.col("count").desc(), "sector")
    return n.withColumn("k", F.row_number().over(w)).filter("k = 1").select("symbol", "sector")


SECTORS = """sectors as (
  select symbol, sector from (
    select p_brand as symbol, split_part(p_type, ' ', 1) as sector, row_number() over (partition by p_brand order by count(*) desc, split_part(p_type, ' ', 1)) as k
    from part group by 1, 2) where k = 1)"""


def normalise(frame: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """A provider's frame in the bar schema: renamed, numbers or NULL, adj_close and volume filled,
    rows without a full OHLC dropped, symbols upper-cased and trimmed."""
    for old, new in (renames or {}).items():
        frame = frame.withColumnRenamed(old, new)
    have = set(frame.columns)
    num = {c: F.expr(f"try_cast({c} as double)") if c in have else F.lit(None).cast("double") for c in ("open", "high", "low", "close", "adj_close", "volume")}
    out = frame.select(F.upper(F.trim("symbol")).alias("symbol"), F.expr("try_to_date(cast(date as string))").alias("date"), *[num[c].alias(c) for c in ("open", "high", "low", "close")], F.coalesce(num["adj_close"], num["close"]).alias("adj_close"), F.coalesce(num["volume"].cast("long"), F.lit(0).cast("long")).alias("volume"))
    return out.dropna(subset=["date", "open", "high", "low", "close"])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars from CSV, all read as text, then normalised."""
    names = [f.name for f in BAR_SCHEMA]
    return normalise(spark.read.option("header", True).schema(", ".join(f"{n} string" for n in names)).csv(path))


def mock(spark: SparkSession, symbols: list[str], days: int = 30) -> DataFrame:
    """Business days from 2024-01-01 with close 100 + i, for demonstrations."""
    dates = spark.sql(f"select explode(filter(sequence(date'2024-01-01', date_add(date'2024-01-01', {days * 2 + 7})), d -> weekday(d) < 5)) as date")
    w = Window.orderBy("date")  # a few rows
    dates = dates.withColumn("i", F.row_number().over(w) - 1).filter(F.col("i") < days)
    close = F.lit(100.0) + F.col("i")
    return dates.select(F.explode(F.array(*map(F.lit, symbols))).alias("symbol"), "date", close.alias("open"), close.alias("high"), close.alias("low"), close.alias("close"), close.alias("adj_close"), F.lit(1000).cast("long").alias("volume"))


def latest_dates(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """The last date of each symbol of the universe; NULL where there is none."""
    return universe.select("symbol").distinct().join(bars.groupBy("symbol").agg(F.max("date").alias("last_date")), "symbol", "left")


def bounds(bars: DataFrame) -> DataFrame:
    """First and last date and the number of trading days: a single row."""
    return bars.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_distinct("date").alias("trading_days"))


def resume(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Fetched rows after each symbol's last stored date: what an incremental refresh adds."""
    last = stored.groupBy("symbol").agg(F.max("date").alias("_last"))
    return fetched.join(last, "symbol", "left").filter(F.col("_last").isNull() | (F.col("date") > F.col("_last"))).drop("_last")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, the new one where keys meet; of new rows of one key the largest by their other columns."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [F.col(c).desc_nulls_last() for c in old.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(F.col("_new").desc(), *rest)
    return both.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_new")


def upsert_restated(old: DataFrame, new: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """What an upsert does with each new row: an older report never replaces a newer one, unless forced."""
    o = old.select(*keys, F.col("report_date").alias("_old_date"), F.lit(True).alias("_there"))
    older = F.col("report_date") < F.col("_old_date")
    act = F.when(F.col("_there").isNull(), "inserted").when(F.coalesce(older, F.lit(False)) & F.lit(not force), "skipped").otherwise("updated")
    return new.join(o, keys, "left").withColumn("action", act).drop("_old_date", "_there")


def refresh_counts(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Per symbol: keys fetched that are new, and that are there already."""
    there = stored.select("symbol", "date", F.lit(1).alias("there")).distinct()
    j = fetched.select("symbol", "date").distinct().join(there, ["symbol", "date"], "left")
    return j.groupBy("symbol").agg(F.count_if(F.col("there").isNull()).alias("inserted"), F.count("there").alias("updated"))
