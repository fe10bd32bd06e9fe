"""Factor matrices that are kept and grow: values and forward returns, computed once a date.

An entry is named by what its rows depend on: the factor and its version, the universe and the first date
(values), or the universe and the first date alone (labels, which all factors share).  How far it goes
(newest date, horizons) is its state, in the entry's manifest.

When bars have grown, only bars after the entry's newest date are read.  What windows look back on comes
from the entry's tail, the last rows of each symbol, which is written with each generation: so nothing is
read twice, however late a symbol's last bar is.  A forward return is known once its future bar is; those
that were not are found among the tail's rows.  A new horizon reads closes alone and leaves all others.

Bars of dates that an entry has must not change: a restated history needs a new ``version``.  ``check``
compares the number of bars up to the newest date with that seen before (reading one column) and
builds anew if it differs.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.factors import REGISTRY, by_symbol, price_factors
from .tables import Manifest, fresh

LABELS = "symbol string, signal_date date, horizon int, future_date date, future_return double"
VALUES = "symbol string, signal_date date, value double"
TAIL = "symbol string, date date, close double"


def universe_hash(symbols) -> str:
    """Names a set of symbols, whatever their order, case and blanks; None: all."""
    if symbols is None:
        return "all"
    names = sorted({str(s).strip().upper() for s in symbols if str(s).strip()})
    return hashlib.sha256("|".join(names).encode()).hexdigest()[:16]


def forward_returns(bars: DataFrame, horizons: list[int]) -> DataFrame:
    """(symbol, date, close) -> a row a horizon whose future bar is known."""
    legs = [F.struct(F.lit(h).alias("horizon"), F.lead("date", h).over(by_symbol()).alias("future_date"), (F.lead("close", h).over(by_symbol()) / F.col("close") - 1).alias("future_return")) for h in horizons]
    d = bars.select("symbol", F.col("date").alias("signal_date"), F.array(*legs).alias("legs"))
    return d.select("symbol", "signal_date", F.explode("legs").alias("x")).select("symbol", "signal_date", "x.*").filter("future_date is not null")


def tail(bars: DataFrame, rows: int) -> DataFrame:
    """The last rows of each symbol."""
    back = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return bars.withColumn("k", F.row_number().over(back)).filter(F.col("k") <= rows).select("symbol", "date", "close")


class MatrixCache:
    """Entries under one folder.  ``stats`` counts what was served, built, grown and read."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or fresh(spark, "matrices")).rstrip("/")
        self.stats = {"hits": 0, "built": 0, "grown": 0, "extended": 0, "invalidated": 0, "bars_read": 0}

    def _bars(self, bars: DataFrame, symbols, start: str | None) -> DataFrame:
        d = bars.select("symbol", "date", "close").filter("close > 0")
        if symbols is not None:
            names = sorted({str(s).strip().upper() for s in symbols})
            d = d.filter(F.upper(F.trim("symbol")).isin(names))
        return d if start is None else d.filter(F.col("date") >= F.lit(start).cast("date"))

    def _write(self, rows: DataFrame, root: str, name: str) -> str:
        at = fresh_under(root, name)
        rows.write.parquet(at)
        return at

    def _grow(self, root: str, bars: DataFrame, halo: int, compute, state: dict, generation: int) -> dict:
        """Add what ``compute(work, newest)`` gives for bars after the newest date; work: these and the tail."""
        newest = state.get("newest")
        new = bars if newest is None else bars.filter(F.col("date") > F.lit(newest).cast("date"))
        # read once: extent, values, tail and count are of the same rows
        new = self.spark.read.schema(TAIL).parquet(self._write(new, root, "new"))
        seen = new.agg(F.count("*").alias("n"), F.max("date").cast("string").alias("newest")).first()
        if newest is not None and not seen.n:
            self.stats["hits"] += 1
            return state
        self.stats["built" if newest is None else "grown"] += 1
        self.stats["bars_read"] += seen.n
        work = new if newest is None else new.union(self.spark.read.schema(TAIL).parquet(state["tail"]))
        part = self._write(compute(work, newest), root, "rows")
        after = self._write(tail(work, halo), root, "tail")
        state = state | {"newest": seen.newest, "pieces": state.get("pieces", []) + [part], "tail": after, "halo": halo, "bars": state.get("bars", 0) + seen.n}
        Manifest(self.spark, root).commit(generation, state)
        return state

    def _state(self, root: str, bars: DataFrame, check: bool) -> tuple[int, dict]:
        generation, state = Manifest(self.spark, root).last()
        if check and state and bars.filter(F.col("date") <= F.lit(state["newest"]).cast("date")).count() != state["bars"]:
            self.stats["invalidated"] += 1
            state = {}
        return generation, state

    def values(self, bars: DataFrame, factor: str, symbols=None, start: str | None = None, version: str = "1", check: bool = False) -> DataFrame:
        """(symbol, signal_date, value) of a price factor."""
        known = REGISTRY[factor]
        root = f"{self.root}/values/{factor}-{universe_hash(symbols)}-{start or 'first'}-{version}"
        bars = self._bars(bars, symbols, start)
        generation, state = self._state(root, bars, check)

        def compute(work, newest):
            out = price_factors(work, [factor]).select("symbol", F.col("date").alias("signal_date"), F.col(factor).alias("value"))
            return out if newest is None else out.filter(F.col("signal_date") > F.lit(newest).cast("date"))

        state = self._grow(root, bars, known.lookback, compute, state, generation)
        return self.spark.read.schema(VALUES).parquet(*state["pieces"])

    def labels(self, bars: DataFrame, horizons: list[int], symbols=None, start: str | None = None, version: str = "1", check: bool = False) -> DataFrame:
        """(symbol, signal_date, horizon, future_date, future_return) of the horizons."""
        root = f"{self.root}/labels/{universe_hash(symbols)}-{start or 'first'}-{version}"
        bars = self._bars(bars, symbols, start)
        generation, state = self._state(root, bars, check)
        have = state.get("horizons", [])
        every = sorted({*have, *horizons})
        more = [h for h in every if h not in have]
        if state and more:
            # closes up to where the entry goes: later bars are the next step's, for all horizons alike
            old = bars.filter(F.col("date") <= F.lit(state["newest"]).cast("date"))
            part = self._write(forward_returns(old, more), root, "rows")
            after = self._write(tail(old, max(every)), root, "tail")
            state = state | {"horizons": every, "pieces": state["pieces"] + [part], "tail": after, "halo": max(every)}
            generation = Manifest(self.spark, root).commit(generation, state)
            self.stats["extended"] += 1

        def compute(work, newest):
            out = forward_returns(work, every)
            return out if newest is None else out.filter(F.col("future_date") > F.lit(newest).cast("date"))

        state = self._grow(root, bars, max(every), compute, state | {"horizons": every}, generation)
        return self.spark.read.schema(LABELS).parquet(*state["pieces"]).filter(F.col("horizon").isin(horizons))

    def matrix(self, bars: DataFrame, factor: str, horizons: list[int], symbols=None, start: str | None = None, version: str = "1", check: bool = False) -> DataFrame:
        """Observations (symbol, signal_date, horizon, value, future_date, future_return), both sides known; the value times the factor's direction."""
        sign = REGISTRY[factor].sign
        v = self.values(bars, factor, symbols, start, version, check).filter("value is not null").withColumn("value", F.col("value") * sign)
        out = v.join(self.labels(bars, horizons, symbols, start, version, check), ["symbol", "signal_date"])
        return out.select("symbol", "signal_date", "horizon", "value", "future_date", "future_return")


def fresh_under(root: str, name: str) -> str:
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"
