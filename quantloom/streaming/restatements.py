"""Restated statements as a stream, merged into a kept table; replays and late rows change nothing that they should not.

Of a key the later report stays, of equal reports the one that arrived last (``arrived``, told by the sender), so the
table depends on the rows and not on how they came: late, twice, or cut into other batches.  No row is dropped for being
late, so no state waits for it either: the table is the state, and a batch rewrites the buckets of its keys.
A batch is a run of the table under the name of its checkpoint: one that Spark tries again after a crash is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.statements import KEYS
from ..sources.tables import KeyedTable

ORDER = ["report_date", "arrived"]


def restated(spark: SparkSession, root: str, buckets: int = 64, keys: list[str] = tuple(KEYS)) -> KeyedTable:
    return KeyedTable(spark, root, list(keys), ORDER, buckets)


def merge_stream(rows: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Merge what is there and end; called again with the same checkpoint it goes on from there.

    Rows without a report date or without a key are left out, as the import refuses them.
    """
    known = " and ".join(f"{c} is not null" for c in [*table.keys, "report_date"])

    def put(batch: DataFrame, n: int) -> None:
        table.upsert(batch, f"{checkpoint}/{n}")

    return rows.filter(known).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
