"""Covariances of many symbols by tiles: blocks of symbols, each pair of blocks one product.

Plan: values are centred by their symbol's mean (sums of products then cancel nothing) and written -> one
matrix a block of symbols, packed and written -> the blocks' table is paired with itself (a Cartesian product
of its few partitions: blocks with blocks, never symbols with symbols) -> a product of two matrices gives a
tile's covariances at once.  No partial sum is shuffled: what is written and shuffled are the values, once
each, so disk grows with the input though the pairs grow with its square.

The result has a row a pair, and is by far the largest thing written where there are many symbols.  A pair's two
rows (a, b) and (b, a) have the same count and covariance, so both are laid close to each other, in runs of MIRROR
rows one way and the same the other: a compressed file then holds each covariance about once, not twice.

A matrix has at most BLOCK symbols, and fewer where histories are longer than SPAN days, so that it stays
at about BLOCK * SPAN cells; a task holds two of them and the sums of one tile.

Pairs count the dates that both symbols have, so histories need not be aligned.  A pair without a date
in common has no row, one with a single date has NULL.  Rows without symbol, date or value take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import kept

#: Symbols of a block, about (they are dealt by hash), and days up to which a block has as many.
BLOCK, SPAN = 256, 2048
#: Partitions of the blocks' table (tasks: their square) and the blocks of one where there are more.
PARTS, PART_BLOCKS = 24, 16
#: Pairs of a run one way round, which the same pairs the other way round follow; a compressor has to see both at once.
MIRROR = 32
SIDE = ("names", "days", "cells")
PAIR = ["a", "b", "n", "cov"]


def _matrix(block: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Rows (block, symbol, day, x) of one block -> a row: names, days, cells by row, NaN where there is none."""
    t = pa.Table.from_batches(parts).combine_chunks()
    symbols = t["symbol"].combine_chunks().dictionary_encode()
    days, j = np.unique(t["day"].to_numpy(), return_inverse=True)
    m = np.full((len(symbols.dictionary), len(days)), np.nan)
    m[symbols.indices.to_numpy(), j] = t["x"].to_numpy()
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), one(symbols.dictionary), one(pa.array(days, pa.int32())), one(pa.array(m.ravel()))], ["block", *SIDE])


def _pack(batches):
    """Rows sorted by block -> a row a block."""
    at, parts = None, []
    for b in batches:
        if not b.num_rows:
            continue
        block = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for start, end in zip(cuts, cuts[1:]):
            if parts and block[start] != at:
                yield _matrix(at, parts)
                parts = []
            at = int(block[start])
            parts.append(b.slice(start, end - start))
    if parts:
        yield _matrix(at, parts)


def _side(b: pa.RecordBatch, k: int, of: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    names, days, cells = (b.column(f"{of}_{c}")[k].values for c in SIDE)
    return names, days.to_numpy(), cells.to_numpy().reshape(len(names), -1)


def _tile(dx: np.ndarray, x: np.ndarray, dy: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices and their days -> (n, cov) of each pair of their rows over the days that both have."""
    _, i, j = np.intersect1d(dx, dy, assume_unique=True, return_indices=True)
    x, y = x[:, i], y[:, j]
    mx, my = ((~np.isnan(z)).astype(float) for z in (x, y))
    x, y = np.nan_to_num(x), np.nan_to_num(y)
    n = mx @ my.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return n, (x @ y.T - (x @ my.T) * (mx @ y.T) / n) / (n - 1)


def _products(batches):
    """A row a pair of packed blocks -> (a, b, n, cov) of every pair of symbols, both ways round."""
    for batch in batches:
        for k in range(batch.num_rows):
            (xs, dx, x), (ys, dy, y) = _side(batch, k, "x"), _side(batch, k, "y")
            n, cov = _tile(dx, x, dy, y)
            same = batch.column("x")[k] == batch.column("y")[k]
            i, j = np.nonzero(np.triu(n > 0) if same else n > 0)
            other = i < j if same else np.ones(len(i), bool)  # the pairs that have another way round
            at = np.r_[np.arange(len(i)), np.flatnonzero(other)]
            back = np.arange(len(at)) >= len(i)
            order = np.argsort(at // MIRROR, kind="stable")
            at, back = at[order], back[order]
            i, j, names = i[at], j[at], pa.concat_arrays([xs, ys])
            a, b = (names.take(pa.array(np.where(way, j + len(xs), i))) for way in (back, ~back))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(n[i, j].astype(np.int64)), pa.array(cov[i, j], mask=n[i, j] < 2)], PAIR)


def covariance_tiles(values: DataFrame, column: str, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """(symbol, date, <column>) -> (a, b, n, cov): sample covariance over the n dates that both symbols have."""
    x = F.col(column)
    d = values.select(F.col("symbol").cast("string").alias("symbol"), F.unix_date("date").alias("day"), x.cast("double").alias("x")).filter("symbol is not null and day is not null and x is not null and not isnan(x)")
    d = kept(d, "tile-values")
    means = d.groupBy("symbol").agg(F.avg("x").alias("mean"))
    symbols, days = means.count(), d.select("day").distinct().count()
    most = max(1, min(block, block * span // max(1, days)))
    blocks = max(1, -(-symbols // most))
    d = d.join(means, "symbol").select(F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int").alias("block"), "symbol", "day", (F.col("x") - F.col("mean")).alias("x"))
    packed = d.repartition("block").sortWithinPartitions("block").mapInArrow(_pack, "block int, names array<string>, days array<int>, cells array<double>")
    packed = kept(packed, "tile-blocks").repartition(min(blocks, max(PARTS, -(-blocks // PART_BLOCKS))), "block")
    side = lambda of: packed.select(F.col("block").alias(of), *[F.col(c).alias(f"{of}_{c}") for c in SIDE])
    # the hint asks for the product of partitions: a broadcast would leave the pairs to the other side's partitions
    tiles = side("x").join(side("y").hint("shuffle_replicate_nl"), F.col("x") <= F.col("y"))
    return tiles.mapInArrow(_products, "a string, b string, n long, cov double")
