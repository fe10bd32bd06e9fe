"""Tables that are kept: a shared folder, a manifest of generations, and a table upserted by key.

All through Spark's own readers and writers, so any storage that Spark knows will do.  Data files are
never changed: a step writes new ones and then adds one line to the manifest, which names what counts
from then on; a step that dies before leaves files that no manifest names.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Only a local session makes its own."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quantloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


class Conflict(RuntimeError):
    """Another writer has committed the same generation."""


class Manifest:
    """A folder's history: a line a generation, each with what holds from then on.

    Meant for one writer at a time.  Two that commit one generation are both told: neither's line counts
    then, and what was committed before stays in force.
    """

    SCHEMA = "generation long, token string, run string, body string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/_manifest"

    def lines(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).json(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def _alone(self) -> DataFrame:
        once = self.lines().groupBy("generation").agg(F.count("*").alias("n"), F.max(F.struct("token", "run", "body")).alias("x"))
        return once.filter("n = 1").select("generation", "x.*")

    def last(self) -> tuple[int, dict]:
        """The generation in force (0: none yet) and its body."""
        top = self._alone().orderBy(F.desc("generation")).first()
        return (top.generation, json.loads(top.body)) if top else (0, {})

    def has_run(self, run: str) -> bool:
        return bool(self._alone().filter(F.col("run") == run).head(1))

    def commit(self, after: int, body: dict, run: str = "") -> int:
        """Add the next generation; ``after`` is the one that this step started from."""
        seen = self.lines().agg(F.max("generation")).first()[0] or 0
        if self.last()[0] != after:
            raise Conflict(f"started from generation {after}, but {self.last()[0]} holds")
        token, generation = uuid.uuid4().hex, seen + 1
        line = self.spark.createDataFrame([(generation, token, run, json.dumps(body, sort_keys=True))], self.SCHEMA)
        line.coalesce(1).write.mode("append").json(self.path)
        if self.lines().filter(F.col("generation") == generation).count() != 1:
            raise Conflict(f"generation {generation} was committed twice; none of the two counts")
        return generation


class KeyedTable:
    """Rows by key in hash buckets; an upsert rewrites the buckets that it touches, and no others.

    ``order`` are the columns that say which of two rows of a key is the later one; equal ones go to the
    new row, and of equal new ones to the largest by the other columns.  Null keys are keys like any
    other.  ``buckets`` is fixed when a table is made, since it says where a key lies.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], order: list[str] = (), buckets: int = 64):
        self.spark, self.root, self.keys, self.order = spark, root.rstrip("/"), list(keys), list(order)
        self.manifest = Manifest(spark, root)
        self.buckets = self.manifest.last()[1].get("buckets", buckets)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, generation: dict | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets; None before the first upsert."""
        body = self.manifest.last()[1] if generation is None else generation
        paths = [p for b, p in sorted(body.get("paths", {}).items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets]
        if not body:
            return None
        if not paths:
            return self.spark.createDataFrame([], body["schema"])
        return self.spark.read.schema(body["schema"]).parquet(*paths)

    def upsert(self, rows: DataFrame, run: str) -> dict:
        """Merge rows; a run that was committed before changes nothing.  (written: buckets rewritten, generation.)"""
        generation, body = self.manifest.last()
        if self.manifest.has_run(run):
            return {"written": 0, "generation": generation, "repeated": True}
        schema = body.get("schema") or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        types = self.spark.createDataFrame([], schema).schema
        names = types.fieldNames()
        if set(names) != set(rows.columns):
            raise ValueError(f"columns {sorted(rows.columns)} are not the table's {sorted(names)}")
        new = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in types]).withColumn("_b", self._bucket())
        touched = sorted(r[0] for r in new.select("_b").distinct().collect())  # at most ``buckets`` numbers
        old = self.read(body, touched) if body else None
        both = new.withColumn("_new", F.lit(1))
        if old is not None:
            both = both.unionByName(old.withColumn("_b", self._bucket()).withColumn("_new", F.lit(0)))
        rest = [c for c in names if c not in self.keys and c not in self.order]
        # one row a key by a grouped maximum: a key that very many new rows have is reduced in their tasks
        rank = F.struct(*self.order, "_new", *rest)
        merged = both.groupBy("_b", *self.keys).agg(F.max(rank).alias("_r")).select("_b", *[F.col(c) if c in self.keys else F.col(f"_r.{c}").alias(c) for c in names])
        at = f"{self.root}/data-{generation + 1:06d}-{uuid.uuid4().hex[:8]}"
        if touched:
            merged.repartition(len(touched), "_b").write.partitionBy("_b").parquet(at)
        paths = body.get("paths", {}) | {str(b): f"{at}/_b={b}" for b in touched}
        done = self.manifest.commit(generation, {"buckets": self.buckets, "schema": schema, "paths": paths}, run)
        return {"written": len(touched), "generation": done, "repeated": False}



def kept(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder and read again: made once, whatever the number of uses."""
    at = fresh(rows.sparkSession, name)
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)
