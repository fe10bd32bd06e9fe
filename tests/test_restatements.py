"""A stream of restatements that breaks off, repeats itself and comes late."""

import random

import pytest
from pyspark.errors import StreamingQueryException

from quantloom.sources import statements
from quantloom.streaming import restatements

ROW = "symbol string, fiscal_period_end date, report_date date, arrived int, revenue double"


def sent(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, "symbol string, p string, r string, arrived int, revenue double").selectExpr("symbol", "cast(p as date) fiscal_period_end", "cast(r as date) report_date", "arrived", "revenue").coalesce(1).write.mode("append").parquet(str(tmp_path / name))


def run(spark, tmp_path, table, checkpoint, files=1):
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in"))
    restatements.merge_stream(stream, table, str(tmp_path / checkpoint)).awaitTermination()


def test_broken_replayed_and_late(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("ABC"), f"2020-{rng.choice(['03', '06'])}-30", f"2020-07-{rng.randrange(1, 9):02d}", n, float(n)) for n in range(60)]
    expected = {}
    for s, p, r, n, v in rows:
        if (s, p) not in expected or (r, n) > expected[s, p][:2]:
            expected[s, p] = (r, n, v)
    for k in (2, 0, 1):  # late ones last
        sent(spark, tmp_path, "in", rows[k * 20:k * 20 + 20] + [("A", "2020-03-30", None, 99, -1.0), (None, "2020-03-30", "2021-01-01", 99, -1.0)])
    table = restatements.restated(spark, str(tmp_path / "table"), 4, ["symbol", "fiscal_period_end"])
    got = lambda: {(r.symbol, str(r.fiscal_period_end)): (str(r.report_date), r.arrived, r.revenue) for r in table.read().collect()}
    real, calls = table.upsert, []

    def dying(batch, name):  # written, but Spark does not hear of it
        real(batch, name)
        calls.append(name)
        if len(calls) == 2:
            raise RuntimeError("lost")

    table.upsert = dying
    with pytest.raises(StreamingQueryException):
        run(spark, tmp_path, table, "c")
    table.upsert = real
    run(spark, tmp_path, table, "c")
    assert got() == expected
    assert table.manifest.last()[0] == 3  # the batch that was tried again is no new generation
    run(spark, tmp_path, table, "c")
    assert table.manifest.last()[0] == 3
    run(spark, tmp_path, table, "lost", files=3)
    assert got() == expected
    # in the order of arrival it is the rule of a batch
    old = None
    for s, p, r, n, v in rows[:8]:
        new = spark.createDataFrame([(s, p, r, n, v)], "symbol string, p string, r string, arrived int, revenue double").selectExpr("symbol", "cast(p as date) fiscal_period_end", "cast(r as date) report_date", "arrived", "revenue")
        old = new if old is None else spark.createDataFrame(statements.merge(old, new, ["symbol", "fiscal_period_end"]).collect(), ROW)
    some = restatements.restated(spark, str(tmp_path / "some"), 4, ["symbol", "fiscal_period_end"])
    some.upsert(spark.createDataFrame([(s, p, r, n, v) for s, p, r, n, v in rows[:8]], "symbol string, p string, r string, arrived int, revenue double").selectExpr("symbol", "cast(p as date) fiscal_period_end", "cast(r as date) report_date", "arrived", "revenue"), "x")
    cols = ["symbol", "fiscal_period_end", "report_date", "arrived", "revenue"]
    assert sorted(map(tuple, some.read().select(*cols).collect())) == sorted(map(tuple, old.select(*cols).collect()))
