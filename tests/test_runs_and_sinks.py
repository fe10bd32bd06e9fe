"""Runs that break off and go on, files in one order, symbols as of a day."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quantloom.operators.runs import Run
from quantloom.sources.dimension import SymbolDimension
from quantloom.sources.ordered import read_ordered, write_ordered


class Killed(BaseException):
    """What ends a caller: no task may catch it."""


def test_a_killed_run_goes_on(spark, tmp_path):
    calls = []

    def task(n, fail=None):
        def make():
            calls.append(n)
            if fail:
                raise fail
            return spark.range(n).select(F.col("id"), F.lit(n).alias("n"))
        return make

    run = Run(spark, str(tmp_path / "run"))
    assert run.results("p") is None and run.todo("p", ["a", "b"]) == ["a", "b"]
    with pytest.raises(Killed):
        run.work("p", {"a": task(1), "b": task(2, ValueError("no such thing")), "c": task(3, Killed()), "d": task(4)})
    assert calls == [1, 2, 3]
    assert {(r.task, r.status, r.attempts) for r in run.state().collect()} == {("a", "DONE", 1), ("b", "FAILED", 1)}
    assert "no such thing" in run.state().filter("task = 'b'").first().error
    # files of a dead attempt have no line
    spark.range(9).write.parquet(str(tmp_path / "run" / "p-dead"))
    again = Run(spark, str(tmp_path / "run"))
    assert again.todo("p", list("abcd")) == ["b", "c", "d"]
    assert again.work("p", {t: task(n) for t, n in zip("abcd", (1, 2, 3, 4))}, workers=3)
    assert sorted(calls[3:]) == [2, 3, 4]
    unbroken = Run(spark, str(tmp_path / "other"))
    assert unbroken.work("p", {t: task(n) for t, n in zip("abcd", (1, 2, 3, 4))})
    rows = lambda r: sorted(tuple(x) for x in r.results("p").select("task", "n", "id").collect())
    assert rows(again) == rows(unbroken) and len(rows(again)) == 10
    before = len(calls)
    assert again.work("p", {t: task(9) for t in "abcd"}) and len(calls) == before
    assert again.results("q") is None


def test_a_task_over_its_time_is_cancelled(spark, tmp_path):
    slow = F.udf(lambda x: (time.sleep(1), x)[1], "long")
    run = Run(spark, str(tmp_path / "run"))
    began = time.monotonic()
    done = run.work("p", {"slow": lambda: spark.range(0, 400, 1, 4).select(slow("id").alias("id")), "fast": lambda: spark.range(3)}, workers=2, task_seconds=6)
    assert not done and time.monotonic() - began < 60
    assert {(r.task, r.status) for r in run.state().collect()} == {("slow", "CANCELLED"), ("fast", "DONE")}
    assert not run.work("late", {"x": lambda: spark.range(1)}, seconds=0) and run.state().filter("phase = 'late'").count() == 0
    assert run.work("p", {"slow": lambda: spark.range(2), "fast": lambda: spark.range(3)})
    assert {(r.task, r.status, r.attempts) for r in run.state().collect()} == {("slow", "DONE", 2), ("fast", "DONE", 1)}
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_ordered_files(spark, tmp_path):
    rng = random.Random(3)
    # a third of the rows have one key, keys may be null
    rows = [(None if rng.random() < 0.05 else 7 if rng.random() < 0.35 else rng.randrange(200), rng.choice("abc"), k) for k in range(3000)]
    at = str(tmp_path / "o")
    write_ordered(spark.createDataFrame(rows, "k int, s string, v int"), ["k", "s"], at, 6)
    got = [tuple(r) for r in read_ordered(spark, at).repartition(5).orderBy("position").select("position", "k", "s", "v").collect()]
    assert [p for p, *_ in got] == list(range(3000))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert [key(r[1:]) for r in got] == sorted(map(key, rows)) and sorted(r[3] for r in got) == list(range(3000))
    for a, b in ((0, 9), (1490, 1510), (2995, 5000), (4000, 4010)):
        assert sorted(tuple(r) for r in read_ordered(spark, at, a, b).select("position", "k", "s", "v").collect()) == got[a:b + 1]
    import glob
    assert len(glob.glob(f"{at}/*.parquet")) > 3
    write_ordered(spark.createDataFrame([], "k int, s string"), ["k", "s"], str(tmp_path / "empty"), 3)
    assert read_ordered(spark, str(tmp_path / "empty")).count() == 0 and read_ordered(spark, str(tmp_path / "empty"), 0, 5).count() == 0
    with pytest.raises(ValueError):
        write_ordered(spark.range(1).withColumn("ord", F.lit(1)), ["id"], str(tmp_path / "x"))


def test_dimension_as_of(spark, tmp_path):
    dim = SymbolDimension(spark, str(tmp_path / "dim"), buckets=4)
    assert dim.versions().count() == 0 and dim.on("2020-01-01").count() == 0
    rows = [(" aaa ", "2020-01-01", "Tech", "STOCK"), ("BBB", "2020-01-01", "Energy", "ETF"), ("", "2020-01-01", "Tech", None), (None, "2020-01-01", "Tech", None), ("CCC", None, "Tech", None)]
    s = "symbol string, valid_from string, sector string, asset_type string"
    assert dim.upsert(spark.createDataFrame(rows, s), "one")["written"] > 0
    more = spark.createDataFrame([("AAA", "2020-03-01", "Tech", "STOCK"), ("AAA", "2020-05-01", "Media", "STOCK"), ("AAA", "2020-06-01", "Tech", "STOCK")], s)
    dim.upsert(more, "two")
    assert dim.upsert(more, "two")["repeated"]
    text = lambda d, *c: sorted(tuple(str(x) for x in r) for r in d.select(*c).collect())
    assert text(dim.versions(), "symbol", "valid_from", "valid_to", "sector") == [
        ("AAA", "2020-01-01", "2020-04-30", "Tech"), ("AAA", "2020-05-01", "2020-05-31", "Media"), ("AAA", "2020-06-01", "None", "Tech"), ("BBB", "2020-01-01", "None", "Energy")]
    assert text(dim.get(["aaa", "zzz"], "2020-05-31"), "symbol", "sector") == [("AAA", "Media")]
    assert text(dim.by("sector", "tech", "2020-04-30"), "symbol") == [("AAA",)] and text(dim.by("sector", "tech", "2020-05-01"), "symbol") == []
    assert text(dim.by("asset_type", "etf", "2021-01-01"), "symbol") == [("BBB",)] and dim.on("2019-12-31").count() == 0
    # a correction of a day counts by its revision, whenever it comes
    dim.upsert(spark.createDataFrame([("BBB", "2020-01-01", "Metals", "ETF")], s), "three", revision=2)
    dim.upsert(spark.createDataFrame([("BBB", "2020-01-01", "Water", "ETF")], s), "four", revision=1)
    assert text(dim.get(["BBB"], "2020-02-01"), "sector") == [("Metals",)]
    asked = spark.createDataFrame([("aaa", "2019-12-31", 1), ("AAA", "2020-05-01", 2), ("AAA", "2020-06-01", 3), ("ZZZ", "2020-06-01", 4), (None, "2020-06-01", 5)], "symbol string, date string, sector int").withColumn("date", F.col("date").cast("date"))
    assert text(dim.attach(asked), "sector", "sector_right") == [("1", "None"), ("2", "Media"), ("3", "Tech"), ("4", "None"), ("5", "None")]
    with pytest.raises(ValueError):
        dim.by("color", "x", "2020-01-01")
