"""Sources of bars by name, with a check of their health; loading with its time; a store of built frames."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import panel

Source = Callable[..., DataFrame]
_sources: dict[str, Source] = {}


def register(name: str, source: Source, replace: bool = False) -> None:
    """Make a source known: source(spark, **options) gives bars."""
    key = name.strip().lower()
    if key in _sources and not replace:
        raise ValueError(f"source {key} is known already")
    _sources[key] = source


def names() -> list[str]:
    return sorted(_sources)


def source(name: str) -> Source:
    try:
        return _sources[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown source {name}; known are {', '.join(names())}") from None


def health(spark: SparkSession, name: str, **options) -> dict:
    """Whether a source gives rows: name, ok, message."""
    try:
        n = len(source(name)(spark, **options).head(1))
    except Exception as e:  # a source may fail in any way; the report says how
        return {"name": name, "ok": False, "message": f"{type(e).__name__}: {e}"[:200]}
    return {"name": name, "ok": n > 0, "message": "" if n else "no rows"}


def placeholder(spark: SparkSession, **options) -> DataFrame:
    raise NotImplementedError("this source is a placeholder")


def csv_first(spark: SparkSession, paths: list[str], symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of the first path that exists, of the symbols and dates asked for."""
    from pyspark.errors import AnalysisException

    for path in paths:
        try:
            d = panel.read_csv(spark, path)
        except AnalysisException:
            continue
        if symbols:
            d = d.filter(F.col("symbol").isin(*[s.upper().strip() for s in symbols]))
        return d.filter((F.col("date") >= F.lit(start or "0001-01-01").cast("date")) & (F.col("date") <= F.lit(end or "9999-12-31").cast("date")))
    raise ValueError("none of the paths can be read")


def load_timed(load: Callable[[], DataFrame]) -> tuple[DataFrame, dict]:
    """A frame, read and kept, with its rows and seconds."""
    began = time.perf_counter()
    d = load().persist()
    return d, {"rows": d.count(), "seconds": time.perf_counter() - began}


class Frames:
    """Frames kept by key (factor, universe, range, horizon, version): built once, dropped when asked."""

    def __init__(self):
        self.held: dict[tuple, DataFrame] = {}

    def get(self, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
        if key not in self.held:
            self.held[key] = build().persist()
        return self.held[key]

    def clear(self) -> None:
        for d in self.held.values():
            d.unpersist()
        self.held.clear()


register("mock", lambda spark, symbols=("SPY",), days=30: panel.mock(spark, list(symbols), days))
register("csv", csv_first)
register("tables", lambda spark, sf_dir, **options: panel.bars(spark, sf_dir, **options))
register("placeholder", placeholder)
