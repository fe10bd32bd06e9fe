"""Shared pieces of the training-data operators: scratch tables, text access, graph components.

Everything that must outlive one job goes to the folder named by ``spark.checkpoint.dir``
(shared by driver and executors).  Only where that setting is absent and the session is local, as in
unit tests, a temporary folder is made and set; on a cluster its absence is an error.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as Spark's configuration names it."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    at = spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quantloom-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark, at = df.sparkSession, scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(at, compression=codec)
    return spark.read.schema(df.schema).parquet(at)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Queries run within give their shuffle files back when they end, not when the driver collects garbage.

    For steps whose results are written and read again: nothing that ended is asked for a second time.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def local_path(uri: str) -> str:
    """A ``file:`` URI as a path; other schemes are refused, since Python workers open these files."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"needs a shared file system mounted on every node, not {uri}")
    return uri


def released(run):
    """A task's function that ends by giving freed memory back to the system.

    Python workers outlive their tasks, and what allocators keep for later adds up over a job of many stages.
    """
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return wrapped


#: Bytes of an Arrow batch between the JVM and a Python worker; rows alone would let long texts fill both.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless the session has a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, spark.conf.get(name, str(BATCH_BYTES)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def ensure_dir(path: str) -> str:
    os.makedirs(path, exist_ok=True)
    return path


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step; a hot node costs a grouped minimum, never a list."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(low, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links of long ids -> (node, root): root is the smallest id of the component.

    Alternating large and small stars, each round written to the shared folder; ends when a round
    leaves the links as they were.  Nodes without links do not appear.
    """
    edges = written(edges.select("u", "v").filter("u <> v").distinct(), "links")
    last = None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
        last = state
        edges = written(_star(_star(edges, True), False), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
