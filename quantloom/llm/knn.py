"""Operator 2: exact top-k search by a Voronoi kNN join.

Vectors are turned into integers, floor(scale * x).  Pivots, drawn from the data by hash (about the square
root of the rows, between ``LEAST_PIVOTS`` and ``PIVOTS``), part the data into Voronoi cells and each cell
into rings by the distance to its pivot.  Each ring has a summary: its size, the largest distance to the
pivot, the largest norm, and the range of its members' products with the pivot.  From the summaries and the
pivots alone each query gets a lower bound on its k-th best product and, for each ring, an upper bound on the
best; a query travels only to the rings that can still matter to it, and each (ring, slice, block) is solved
locally by blocked products.

Bounds for a query q and x in a ring of pivot c (distance at most r, norm at most s, products with c from
l to h), none of which supposes unit vectors:
  above: q.x = q.c + q.(x - c) <= q.c + |q| r;  q.x <= |q| s;  and with b = q.c / |c| and x's part along c,
         q.x <= max(b l, b h) / |c| + sqrt(|q|^2 - b^2) sqrt(s^2 - (part along c)^2)
  below: q.x >= q.c - |q| r; and the pivots are rows themselves, so their k-th best product is a bound.

Plan: cells and rings by one Arrow pass -> summaries by a grouped aggregate (at most PIVOTS x RINGS rows on
the driver, broadcast) -> one Arrow pass over the queries routes each -> data rings are cut in slices and
their queries in blocks by a hash, so that a hot ring spreads -> local top-k -> top-k of the union by a
window over at most k rows a slice.  The bounds prune what is near a pivot or short; in vectors spread
evenly over many dimensions few rings are far enough from a query, and most must be searched.

Defined results: vectors that are null, or hold null or non-finite components, take no part; products are
taken between vectors of one length, so each length is a search of its own; fewer than k others give all of
them; ties go to the smaller vec_id; a query is a row, and every other row is a candidate, rows with its
vec_id too; rows that repeat a query's vec_id are queries of their own, each with its k ranks; null vec_ids
take no part; products beyond 64 bits are held at the nearest end of that range; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Pivots at least and at most: the most bounds what the driver holds and broadcasts.
LEAST_PIVOTS, PIVOTS = 16, 512
#: Borders of the rings, as shares of the pivot's norm.
RINGS = (0.25, 0.5, 0.75)
#: Rows of a ring that one local problem holds, about.
SLICE = 20_000
#: Queries that one local problem holds, about.
BLOCK = 20_000
MAX_EXACT = float(1 << 53)
#: Room for rounding in the bounds, as a share of the numbers they are made of.
SLACK = 1e-9

log = logging.getLogger(__name__)


def quantise(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, v array<long>) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("long")).alias("v"))


def keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with a ``row`` key, written: keys made in passing could change when read twice."""
    return written(vectors.select("vec_id", "v").withColumn("row", F.monotonically_increasing_id()), "vectors")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products a @ b.T, by doubles where these are exact; beyond 64 bits the nearest end."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if most < MAX_EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2.0 ** 63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, len(flat) // n) if n else flat.reshape(0, 0)


class Pivots:
    """Pivots, and the ring (cell * rings + ring) of vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, v: np.ndarray):
        self.ids, self.rows, self.far = ids, rows, v.astype(np.float64)
        self.size2 = (self.far * self.far).sum(1)
        self.size = np.sqrt(self.size2)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """(ring, distance to the pivot, norm, product with the pivot) of each vector."""
        ring, dist, norm, dot = np.zeros(len(x), np.int32), np.zeros(len(x)), np.sqrt((x * x).sum(1)), np.zeros(len(x))
        for i in range(0, len(x), 4096):
            p = x[i:i + 4096]
            c = (self.size2 - 2 * (p @ self.far.T)).argmin(1)
            own = self.far[c]
            d = np.sqrt(((p - own) ** 2).sum(1))
            dist[i:i + 4096], dot[i:i + 4096] = d, (p * own).sum(1)
            ring[i:i + 4096] = c * (len(RINGS) + 1) + (d[:, None] > np.array(RINGS) * self.size[c][:, None]).sum(1)
        return ring, dist, norm, dot


class Router:
    """Bounds of queries against the rings' summaries."""

    def __init__(self, pivots: Pivots, k: int, ring: np.ndarray, n: np.ndarray, r: np.ndarray, norm: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.pivots, self.k, self.ring, self.n, self.r, self.norm = pivots, k, ring, n, r, norm
        self.cell = ring // (len(RINGS) + 1)
        size = np.maximum(pivots.size[self.cell], 1e-300)
        self.along = low / size, high / size

    def needed(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which rings (columns) each query (row) must be compared with."""
        qn = np.sqrt((q * q).sum(1))[:, None]
        qc = q @ self.pivots.far.T
        slack = SLACK * (1 + qn * self.norm.max(initial=0.0)) * max(1, q.shape[1])
        # below: each ring's members reach q.c - |q| r; all but the query's own row are candidates
        floor = qc[:, self.cell] - qn * self.r
        order = np.argsort(-floor, axis=1)
        reach = np.cumsum(self.n[order], axis=1) >= self.k + 1
        at = reach.argmax(1)
        level = np.where(reach.any(1), np.take_along_axis(floor, np.take_along_axis(order, at[:, None], 1), 1)[:, 0], -np.inf)
        if len(self.pivots.rows) > self.k:
            others = np.where(rows[:, None] == self.pivots.rows[None], -np.inf, qc)
            level = np.maximum(level, np.partition(others, len(self.pivots.rows) - self.k, axis=1)[:, len(self.pivots.rows) - self.k])
        # above
        top = np.minimum(qc[:, self.cell] + qn * self.r, qn * self.norm)
        b = qc / np.maximum(self.pivots.size, 1e-300)
        b = np.where(self.pivots.size > 0, b, 0.0)[:, self.cell]
        low, high = self.along
        least = np.where((low <= 0) & (high >= 0), 0.0, np.minimum(np.abs(low), np.abs(high)))
        across = np.sqrt(np.maximum(qn ** 2 - b ** 2, 0)) * np.sqrt(np.maximum(self.norm ** 2 - least ** 2, 0))
        top = np.minimum(top, np.maximum(b * low, b * high) + across)
        return top >= level[:, None] - slack


def _search(queries: DataFrame, data: DataFrame, k: int, pivots: int | None, slice_rows: int, n: int) -> DataFrame:
    """top_k of vectors of one length."""
    spark = data.sparkSession
    want = pivots or int(min(PIVOTS, max(LEAST_PIVOTS, round(n ** 0.5))))
    picked = data.withColumn("h", F.xxhash64("vec_id", "v", "row")).orderBy("h", "row").limit(want).select("vec_id", "row", "v").toPandas()
    own = Pivots(picked.vec_id.to_numpy(np.int64), picked.row.to_numpy(np.int64), np.array([list(v) for v in picked.v], np.int64))

    shared = spark.sparkContext.broadcast(own)  # at most PIVOTS vectors

    def place(batches):
        for b in batches:
            if b.num_rows:
                own = shared.value
                yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, own.place(_matrix(b.column(2)).astype(np.float64)))], ["row", "vec_id", "v", "ring", "dist", "norm", "dot"])

    placed = written(data.select("row", "vec_id", "v").mapInArrow(place, "row long, vec_id long, v array<long>, ring int, dist double, norm double, dot double"), "rings")
    told = placed.groupBy("ring").agg(F.count("*").alias("n"), F.max("dist").alias("r"), F.max("norm").alias("norm"), F.min("dot").alias("low"), F.max("dot").alias("high")).orderBy("ring").toPandas()
    router = Router(own, k, *(told[c].to_numpy() for c in ("ring", "n", "r", "norm", "low", "high")))
    bounds = spark.sparkContext.broadcast(router)

    def route(batches):
        router = bounds.value
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                q, ring = np.nonzero(router.needed(part.column(0).to_numpy(), _matrix(part.column(2)).astype(np.float64)))
                for j in range(0, len(q), 20_000):
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(q[j:j + 20_000])) for c in part.columns), pa.array(router.ring[ring[j:j + 20_000]].astype(np.int32))], ["row", "vec_id", "v", "ring"])

    routed = written(queries.select("row", "vec_id", "v").mapInArrow(route, "row long, vec_id long, v array<long>, ring int"), "routes")
    asks = {r.ring: r.n for r in routed.groupBy("ring").agg(F.count("*").alias("n")).collect()}
    if not asks:
        return spark.createDataFrame([], RESULT)
    rows = dict(zip(told.ring.tolist(), told.n.tolist()))
    asked = queries.count()
    compared = sum(rows[c] * m for c, m in asks.items())
    log.info("top_k: %d of %d products pruned, %d of %d rings for all queries", asked * sum(rows.values()) - compared, asked * sum(rows.values()), sum(asks.values()), asked * len(rows))
    # at most PIVOTS x RINGS rows; a ring's local problems are its slices times its blocks of queries
    shape = [(int(c), int(-(-rows[c] // slice_rows)), int(-(-m // BLOCK))) for c, m in asks.items()]
    cuts = F.broadcast(spark.createDataFrame(shape, "ring int, slices int, blocks int"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    ask = routed.join(cuts, "ring").select("ring", spread(F.col("slices")).alias("part"), F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("q"), "row", "vec_id", "v")
    give = placed.join(cuts, "ring").select("ring", F.pmod(F.xxhash64("row"), F.col("slices")).cast("int").alias("part"), spread(F.col("blocks")).alias("block"), F.lit(False).alias("q"), "row", "vec_id", "v")

    def solve(key, table):
        q = table["q"].to_numpy(zero_copy_only=False)
        row, ids, v = table["row"].to_numpy(), table["vec_id"].to_numpy(), _matrix(table["v"].combine_chunks())
        qr, qi, qv, xr, xi, xv = row[q], ids[q], v[q], row[~q], ids[~q], v[~q]
        order = np.argsort(xi, kind="stable")
        xr, xi, xv = xr[order], xi[order], xv[order]
        out = ([], [], [], [])
        for i in range(0, len(qi) if len(xi) else 0, 256):
            for line, r, name in zip(products(qv[i:i + 256], xv), qr[i:i + 256], qi[i:i + 256]):
                if len(line) > 4 * k + 64:  # those that reach the level of the k-th besides the query itself
                    at = np.flatnonzero(line >= np.partition(line, len(line) - k - 1)[len(line) - k - 1])
                else:
                    at = np.arange(len(line))
                at = at[xr[at] != r]
                at = at[np.lexsort((xi[at], ~line[at]))[:k]]
                for c, x in zip(out, (np.full(len(at), r), np.full(len(at), name), xi[at], line[at])):
                    c.append(x)
        cols = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]
        return pa.table(dict(zip(("query_row", "query_id", "vec_id", "score"), cols)))

    local = ask.union(give).groupBy("ring", "part", "block").applyInArrow(solve, "query_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id"))
    return local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_row")


RESULT = "query_id long, rank int, vec_id long, score long, query_row long"


def top_k(queries: DataFrame, data: DataFrame, k: int = 10, pivots: int | None = None, slice_rows: int = SLICE) -> DataFrame:
    """queries and data (vec_id, v, row) -> (query_id, rank, vec_id, score, query_row).

    ``row`` names the rows (``keyed``): a query's own row is no candidate.  Each length of vectors is
    searched by itself; there are few lengths.
    """
    lengths = data.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
    out = data.sparkSession.createDataFrame([], RESULT)
    for d, n in lengths:
        only = F.size("v") == d if len(lengths) > 1 else F.lit(True)
        out = out.union(_search(queries.filter(F.size("v") == d), data.filter(only), k, pivots, slice_rows, n))
    return out


def op2_topk(spark, sf_dir):
    data = keyed(quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return top_k(data.filter(F.col("vec_id") % 100 == 0), data).select("query_id", "rank", "vec_id", "score")


OP2_SQL = """
with v as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
           from embeddings
           where embedding is not null and vec_id is not null
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (select q.rid as rid, q.vec_id as query_id, x.vec_id as vec_id,
             cast(coalesce(list_sum(list_transform(list_zip(q.v, x.v), lambda z: z[1] * z[2])), 0) as bigint) as score
      from v q join v x on q.vec_id % 100 = 0 and q.rid <> x.rid and len(q.v) = len(x.v)),
r as (select *, cast(row_number() over (partition by rid order by score desc, vec_id) as integer) as rank from p)
select query_id, rank, vec_id, score from r where rank <= 10
"""
