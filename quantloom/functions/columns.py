"""Column helpers with one meaning of "missing": NULL (NaN and infinities become NULL)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def div(a, b) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a, b)


def finite(c) -> Column:
    """c as a double, NULL where it is NaN or infinite."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.try_cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def r6(c) -> Column:
    """Rounded half to even, six places."""
    return F.bround(c, 6)


def correlation(x, y) -> Column:
    """Pearson; NULL for fewer than two rows or a side without variance."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def average_rank(value: str, *keys: str) -> Column:
    """Rank from 1 within keys, ties averaged."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0


def clip(c: Column, low, high) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def mean_available(columns: list[Column], least: int) -> Column:
    """Mean of the non-null columns, NULL if fewer than ``least``."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    return F.when(n >= least, div(total, n))


def full_frame(agg: Column, counted: str, n: int, window) -> Column:
    """agg over a frame of the last n rows, NULL until n values are there."""
    frame = window.rowsBetween(-(n - 1), 0)
    return F.when(F.count(counted).over(frame) >= n, agg.over(frame))


def quantile_even(rank0: Column, n: Column, q: int) -> Column:
    """Evenly spaced quantile of a 0-based rank, halves to even; a single row gets 1."""
    return (F.bround(rank0 * (q - 1) / F.greatest(n - 1, F.lit(1)), 0) + 1).cast("int")
