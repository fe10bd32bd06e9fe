"""Validation runs that can be taken up again: phases of tasks whose results stay, failures as rows, a budget of seconds.

A task is a function that returns a DataFrame.  Its rows are written as Parquet, and then one line goes to the run's
log; a run that dies leaves files without a line, which nothing reads.  Who takes the run up asks the log which
tasks have no result yet (an anti-join) and does these alone.  A task that fails, or runs longer than it may, is a
line as well, and the others go on; it is tried again by the next call.

Spark does the work of tasks; here is only the order of phases.  Tasks of a phase may run side by side (``workers``),
each in a job group of its own, which is what a task over its time is cancelled by.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import missing_keys

LOG = "phase string, task string, attempt int, status string, path string, error string, seconds double"
DONE, FAILED, CANCELLED = "DONE", "FAILED", "CANCELLED"


class Run:
    """A run in a folder that driver and executors share; one caller works on it at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def log(self) -> DataFrame:
        """A line an attempt."""
        try:
            return self.spark.read.schema(LOG).json(f"{self.root}/_log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LOG)

    def _note(self, phase: str, task: str, attempt: int, status: str, path: str | None, error: str | None, seconds: float) -> None:
        line = self.spark.createDataFrame([(phase, task, attempt, status, path, error, round(seconds, 3))], LOG)
        line.coalesce(1).write.mode("append").json(f"{self.root}/_log")

    def todo(self, phase: str, tasks: list[str]) -> list[str]:
        """Tasks of a phase without a result, in the order given."""
        asked = self.spark.createDataFrame([(t, n) for n, t in enumerate(tasks)], "task string, n int")
        done = self.log().filter((F.col("phase") == phase) & (F.col("status") == DONE))
        return [r.task for r in missing_keys(asked, done, ["task"]).orderBy("n").collect()]  # names of tasks

    def results(self, phase: str) -> DataFrame | None:
        """Rows of a phase's finished tasks with their ``task``; None where none is finished."""
        done = self.log().filter((F.col("phase") == phase) & (F.col("status") == DONE)).groupBy("task").agg(F.max_by("path", "attempt").alias("path"))
        paths = sorted(r.path for r in done.collect())
        return self.spark.read.parquet(*paths) if paths else None

    def state(self) -> DataFrame:
        """(phase, task, status, attempts, error): where every task stands; a result outweighs later failures."""
        rank = F.struct((F.col("status") == DONE).alias("d"), "attempt")
        return self.log().groupBy("phase", "task").agg(F.max_by("status", rank).alias("status"), F.max("attempt").alias("attempts"), F.max_by("error", rank).alias("error"))

    def _attempt(self, group: str, make: Callable[[], DataFrame], task: str, at: str, seconds: float | None) -> tuple[str, str | None, float]:
        sc, ended, late, began = self.spark.sparkContext, threading.Event(), threading.Event(), time.monotonic()

        def watch():  # a task may start jobs one after another: each is cancelled
            while not ended.wait(0.2):
                if seconds is not None and time.monotonic() - began > seconds:
                    late.set()
                    sc.cancelJobGroup(group)

        sc.setJobGroup(group, f"{task} of a validation run", interruptOnCancel=False)
        guard = threading.Thread(target=watch, daemon=True)
        guard.start()
        try:
            make().withColumn("task", F.lit(task)).write.parquet(at)
            return DONE, None, time.monotonic() - began
        except Exception as e:  # the failure is the task's result
            return (CANCELLED if late.is_set() else FAILED), f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:300], time.monotonic() - began
        finally:
            ended.set()
            guard.join()
            for name in ("spark.jobGroup.id", "spark.job.description"):
                sc.setLocalProperty(name, None)

    def work(self, phase: str, tasks: dict[str, Callable[[], DataFrame]], workers: int = 1, task_seconds: float | None = None, seconds: float | None = None) -> bool:
        """Do what is missing of a phase; true if nothing is missing any more.

        ``task_seconds`` is what a task may take, ``seconds`` after which no further one is begun.
        """
        began = time.monotonic()
        tried = {r.task: r.n for r in self.log().filter(F.col("phase") == phase).groupBy("task").agg(F.max("attempt").alias("n")).collect()}
        left = self.todo(phase, list(tasks))
        failed = False
        running: dict = {}
        with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
            while left or running:
                while left and len(running) < max(1, workers):
                    if seconds is not None and time.monotonic() - began >= seconds:
                        failed, left = True, []
                        break
                    task = left.pop(0)
                    at = f"{self.root}/{phase}-{uuid.uuid4().hex[:12]}"
                    job = pool.submit(inheritable_thread_target(self.spark)(self._attempt), f"run-{uuid.uuid4().hex}", tasks[task], task, at, task_seconds)
                    running[job] = (task, at)
                ended, _ = wait(running, return_when=FIRST_COMPLETED) if running else ((), ())
                for job in ended:  # one thread writes the log
                    task, at = running.pop(job)
                    status, error, took = job.result()
                    failed |= status != DONE
                    self._note(phase, task, tried.get(task, 0) + 1, status, at if status == DONE else None, error, took)
        return not failed
