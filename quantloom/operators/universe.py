"""Universes: which symbols take part, and why others do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import full_frame
from .factors import FUNDAMENTAL, PRICE, by_symbol


def tokens(text: Column) -> Column:
    """Symbols of a text, parted by commas or blanks, as they stand."""
    return F.filter(F.split(F.translate(text, ",", " "), "\\s+"), lambda s: s != "")


def normalise_symbols(rows: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """(ord, symbol) -> upper case, trimmed, without empty and excluded ones; the first of equals stays."""
    name = F.upper(F.trim("symbol"))
    d = rows.select("ord", name.alias("symbol")).filter(F.coalesce(F.col("symbol") != "", F.lit(False)))
    if excluded:
        d = d.filter(~F.col("symbol").isin(*[x.upper() for x in excluded]))
    return d.groupBy("symbol").agg(F.min("ord").alias("ord"))


def dedupe_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def build(requested: DataFrame, metadata: DataFrame, max_symbols: int | None = None) -> DataFrame:
    """(ord, symbol), metadata (symbol, ...) -> (symbol, ord, selected, reason): those without metadata are
    out, and those after the first ``max_symbols`` that have it."""
    d = normalise_symbols(requested).join(metadata.select("symbol", F.lit(True).alias("_there")), "symbol", "left")
    place = F.count("_there").over(Window.orderBy("ord"))  # a row a requested symbol
    over = F.lit(False) if max_symbols is None else place > max_symbols
    reason = F.when(F.col("_there").isNull(), "missing metadata").when(over, "max_symbols limit")
    return d.select("symbol", "ord", reason.isNull().alias("selected"), reason.alias("reason"))


def exclusions(universe: DataFrame, bars: DataFrame, observations: DataFrame) -> DataFrame:
    """Each symbol of the universe with its rows and observations, and why it brings none."""
    n = bars.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.count_if(F.col("close") > 0).alias("n_closes"))
    o = observations.groupBy("symbol").agg(F.count("*").alias("n_pairs"))
    d = universe.select("symbol").join(n, "symbol", "left").join(o, "symbol", "left").na.fill(0, ["n_rows", "n_closes", "n_pairs"])
    reason = F.when(F.col("n_rows") == 0, "no price data").when(F.col("n_closes") == 0, "no valid close prices").when(F.col("n_pairs") == 0, "no valid factor and future-return pairs")
    return d.withColumn("reason", reason)


def common_date(bars: DataFrame) -> DataFrame:
    """The last date that every symbol has reached: a single row."""
    return bars.groupBy("symbol").agg(F.max("date").alias("last")).agg(F.min("last").alias("as_of"))


def alpha_rows(bars: DataFrame, short: int = 20, long: int = 60) -> DataFrame:
    """A row a symbol at the common date: momenta, volatility and their ratio, or why it is left out."""
    d = bars.join(F.broadcast(common_date(bars)), F.col("date") <= F.col("as_of")).filter("close is not null")
    w, back = by_symbol(), by_symbol().rowsBetween(-long, 0)
    d = d.withColumn("ret", F.col("close") / F.lag("close", 1).over(w) - 1)
    d = d.select(
        "symbol", "date", "as_of", F.count("*").over(w).alias("n"), F.min("close").over(back).alias("low"),
        (F.col("close") / F.lag("close", short).over(w) - 1).alias("momentum_short"), (F.col("close") / F.lag("close", long).over(w) - 1).alias("momentum_long"),
        full_frame(F.stddev_samp("ret"), "ret", short, w).alias("volatility"), F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))).alias("k"),
    ).filter("k = 1")
    reason = (
        F.when(F.col("n") <= long, F.concat(F.lit("need at least "), F.lit(str(long + 1)), F.lit(" closes"))).when(F.col("low") <= 0, "non-positive close price in recent history")
        .when(F.col("volatility").isNull(), "volatility is unavailable").when(F.col("volatility") <= 0, "volatility is zero")
    )
    kept = lambda c: F.when(reason.isNull(), F.col(c)).alias(c)
    return d.select("symbol", "as_of", F.col("date").alias("data_end"), "n", kept("momentum_short"), kept("momentum_long"), kept("volatility"), F.when(reason.isNull(), F.try_divide("momentum_short", "volatility")).alias("risk_adjusted"), reason.alias("reason"))


def next_date(bars: DataFrame, selected: DataFrame, as_of: str) -> DataFrame:
    """The first date after ``as_of`` by which all selected symbols trade again: a single row."""
    d = bars.filter(F.col("date") > F.lit(as_of).cast("date")).join(selected.select("symbol"), "symbol", "left_semi")
    return d.groupBy("symbol").agg(F.min("date").alias("first")).agg(F.max("first").alias("execution_date"))


def enough_history(bars: DataFrame, least: int) -> DataFrame:
    """Symbols with at least so many closes."""
    return bars.groupBy("symbol").agg(F.count("close").alias("n")).filter(F.col("n") >= least)


def select_factors(kind: str = "all", priority: list[str] = (), limit: int | None = None) -> list[str]:
    """Names of price, fundamental or all factors, the priority list first."""
    pool = {"price": PRICE, "fundamental": FUNDAMENTAL, "all": PRICE + FUNDAMENTAL}[kind]
    names = sorted(f.name for f in pool)
    first = [p for p in priority if p in names]
    return [*first, *(n for n in names if n not in first)][:limit]


def universe_hash(rows: DataFrame) -> DataFrame:
    """A short name for a set of symbols: a single row.  The set is the universe, a row a symbol."""
    return rows.agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_set(F.upper("symbol"))), "|"), 256), 1, 16).alias("universe_hash"))
