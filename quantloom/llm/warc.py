"""Operator 10: WARC archives, index first.

Writing gives an index row a record: file, offset, length, URL, payload digest.  Reading starts from
the index: the wanted rows are sorted by file and offset, neighbouring byte ranges are coalesced into
few reads, and the records are parsed out of these.

Plan: one Arrow pass digests payloads -> the largest page of each digest by a grouped maximum (partial
in each task) -> revisits by a join of digests alone, without payloads, that Spark may split on a hot
digest -> payloads, packed, meet these by row -> one pass writes an archive a task
to the shared folder (named by task attempt, so a retried or lost task leaves nothing that the index
names) -> the index, written as a table -> a range deal by file and offset, as many tasks as the bytes ask
-> coalesced reads, each returned before the next.

Defined results: null html is the empty payload; equal payloads of at least ``min_revisit`` bytes
have one response, that with the largest page_id (repeated rows of that id: the largest URL, then any
one of them); a null page_id never outranks another; empty tables give an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_dir, local_path, scratch, written

INDEX = "path string, at long, size long, url string, digest string, page_id long, record_type string, refers_to long"
#: Two ranges are read as one if the gap between them is at most this.
GAP = 1 << 16
#: The most bytes that one coalesced read takes (a larger record is read alone).
SPAN = 4 << 20
#: Bytes of archives that one task reads, about.
TASK = 8 << 20
#: The time that records carry; fixed, so that archives are the same each time.
DATE = "2024-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str | None) -> str:
    return "".join(c for c in url or "" if c > " ")


def _id(page_id: int | None, serial: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{serial}>"


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, serial: str) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit keeps the HTTP head, without the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(page_id, serial)}", f"WARC-Target-URI: {_clean(url)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to, 'response')}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return z.compress(raw) + z.flush()


def parse(member: bytes) -> dict:
    """One gzip member -> headers (lower-case names), HTTP headers, payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    return {"headers": headers, "http": fields, "payload": payload}


def classify(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, url, z, digest, record_type, refers_to), z the payload by zstd."""

    def digests(batches):
        z = zstandard.ZstdCompressor(3)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                payloads = [p or b"" for p in part.column(2).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([z.compress(p) for p in payloads], pa.binary()), pa.array([digest32(p) for p in payloads]), pa.array([len(p) for p in payloads], pa.int64())], ["page_id", "url", "z", "digest", "bytes"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.mapInArrow(digests, "page_id long, url string, z binary, digest string, bytes long").withColumn("nonce", F.monotonically_increasing_id())
    # the nonce parts repeated rows of one id; it must not change between the uses: keep it
    kept = written(rows, "pages")
    rank = F.struct(F.col("page_id").isNotNull().alias("some"), "page_id", "url", "nonce")
    first = kept.filter(F.col("bytes") >= min_revisit).groupBy("digest").agg(F.max(rank).alias("first"), F.count("*").alias("n"))
    # only digests that repeat have revisits, and the join that finds these carries no payload: Spark may
    # split a hot digest, and the payloads then meet the verdicts by the nonce, of which no two are alike
    first = written(first.filter("n > 1").select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.nonce").alias("first_nonce")), "responses")
    again = kept.filter(F.col("bytes") >= min_revisit).select("digest", "nonce").join(first, "digest").filter("nonce <> first_nonce").select("nonce", "refers_to", F.lit(True).alias("again"))
    out = kept.join(again, "nonce", "left")
    return out.select("page_id", "url", "z", "digest", F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"), "refers_to")


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write a record a row of ``classify`` under folder (shared) and return the index, a written table."""
    at = local_path(folder)

    def run(batches):
        ctx = TaskContext.get()
        path = f"{ensure_dir(at)}/part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.warc.gz"
        f, pos, unzip = None, 0, zstandard.ZstdDecompressor().decompress
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            offs, sizes = [], []
            for page_id, url, z, digest, kind, refers in zip(*cols):
                serial = "response" if kind == "response" else f"{ctx.partitionId()}-{pos}"
                member = record(page_id, url, unzip(z), digest, kind, refers, serial)
                f = f or open(path, "wb")
                f.write(member)
                offs.append(pos)
                sizes.append(len(member))
                pos += len(member)
            yield pa.RecordBatch.from_arrays([pa.array([path] * b.num_rows, pa.string()), pa.array(offs, pa.int64()), pa.array(sizes, pa.int64()), b.column(1), b.column(3), b.column(0), b.column(4), b.column(5)], ["path", "at", "size", "url", "digest", "page_id", "record_type", "refers_to"])
        if f:
            f.flush()
            os.fsync(f.fileno())
            f.close()

    return written(rows.select("page_id", "url", "z", "digest", "record_type", "refers_to").mapInArrow(run, INDEX), "warc-index")


def coalesced(at: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Row spans [i, j) of ranges sorted by offset that one read covers."""
    out, i = [], 0
    for j in range(1, len(at) + 1):
        if j == len(at) or at[j] - (at[j - 1] + size[j - 1]) > GAP or at[j] + size[j] - at[i] > SPAN:
            out.append((i, j))
            i = j
    return out


def read_records(index: DataFrame, task_bytes: int = TASK) -> DataFrame:
    """The records of the index rows: page_id, payload_bytes, payload_digest, record_type, refers_to, url, html."""

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def read(members):
        rows = []
        for member in members:
            r = parse(member)
            h, kind = r["headers"], r["headers"]["warc-type"]
            name = h["warc-record-id"].split(":")[2]
            refers = h["warc-refers-to"].split(":")[2] if kind == "revisit" else "none"
            if kind == "response" and (digest32(r["payload"]) != h["warc-payload-digest"][5:] or len(r["payload"]) != int(r["http"]["content-length"])):
                raise ValueError(f"damaged record {h['warc-record-id']}")
            rows.append((None if name == "none" else int(name), int(r["http"]["content-length"]), h["warc-payload-digest"][5:], kind, None if refers == "none" else int(refers), h["warc-target-uri"], r["payload"].decode("utf-8") if kind == "response" else None))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def run(batches):
        for b in batches:
            path, at, size = (c.to_pylist() for c in b.columns)
            order = sorted(range(len(path)), key=lambda i: (path[i], at[i]))
            for one in dict.fromkeys(path[i] for i in order):
                mine = [i for i in order if path[i] == one]
                a, s = np.array([at[i] for i in mine]), np.array([size[i] for i in mine])
                with open(one, "rb") as f:
                    for i, j in coalesced(a, s):  # a range's records go before the next is read
                        f.seek(int(a[i]))
                        data = f.read(int(a[j - 1] + s[j - 1] - a[i]))
                        yield read(data[a[k] - a[i]:a[k] - a[i] + s[k]] for k in range(i, j))

    # neighbours in a file come to the same task, in order; tasks by the bytes that the index names, not
    # by the size of the index
    total = index.agg(F.sum("size")).first()[0] or 0
    near = index.select("path", "at", "size").repartitionByRange(int(max(1, -(-total // task_bytes))), "path", "at").sortWithinPartitions("path", "at")
    return near.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string")


def archive(spark: SparkSession, pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Write every page, return the index."""
    return write_archives(classify(pages, min_revisit), scratch(spark, "warc"))


def op10_warc(spark, sf_dir):
    index = archive(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
