"""The corpus pipeline: five stages, each written as Parquet and reread as the next one's documents.

Stages keep the columns of ``documents`` (doc_id, text, lang, source, n_chars), but for the last,
which returns each document's token ids with its doc_id, lang and source.  SQL can express none of the stages, so ORACLE_SQL is None and
tests/llm compares the stages with brute force.

Defined results: an input without rows gives no rows; null texts have no letter and go in the first
stage, as texts like no learned language do; a document is a row, whatever its doc_id (null or shared): the second and the fourth stage give
each row a key of their own, written with it; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import bpe, decontaminate, langid, simhash, suffix
from quantloom.llm.common import bounded_batches, documents, scratch, written

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
ORACLE_SQL = None


def _columns(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(*[F.col(c).cast(t).alias(c) for c, t in COLUMNS.items()])


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """The stage's columns and a ``row`` key, written: ids made in passing could change when read twice."""
    return written(_columns(docs).withColumn("row", F.monotonically_increasing_id()), name)


def _as_ids(rows: DataFrame) -> DataFrame:
    """(doc_id, text) with the row key for doc_id."""
    return rows.select(F.col("row").alias("doc_id"), "text")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in no language of the corpus go: those predicted ``und`` (no text, no letter)
    and those whose predicted language has a cosine under ``langid.MIN_COSINE``, no more than chance gives."""
    docs = _columns(docs)
    _, taught = langid.split(docs)
    return langid.keep_known(docs, langid.prototypes(taught))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group one row stays: of the smallest id (null last), then by a hash of the text and the other columns."""
    rows = _keyed(docs, "near-rows")
    group = simhash.groups(_as_ids(rows)).select(F.col("doc_id").alias("row"), F.col("component_id").alias("grp"))
    order = rows.select("row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text", "lang", "source", "n_chars").alias("h"), "row").alias("o"))
    kept = order.join(group, "row").groupBy("grp").agg(F.min("o").alias("o")).select(F.col("o.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings are cut out; documents of which nothing but blanks is left go."""
    docs = _columns(docs)
    return suffix.cut_documents(docs, list(COLUMNS))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    rows = _keyed(docs, "leak-rows")
    found = decontaminate.find_leaks(_as_ids(rows), _benchmark(spark, sf_dir)).select(F.col("doc_id").alias("row")).distinct()
    return rows.join(found, "row", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as token ids (doc_id, lang, source, n_tokens, digests, ids), with the digest of their decoding."""
    import public_tokenizers

    return bpe.encode_documents(_columns(docs), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True, extra=("lang", "source"))


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeats),
    ("benchmark_decontamination", leaks),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        at = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
