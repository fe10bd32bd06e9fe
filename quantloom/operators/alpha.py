"""Which score a run ranks by, and its targets."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crosssection import target_weights

EACH = ["run", "date"]


class Run(NamedTuple):
    """What a run is set up with; ``raw`` names its plain factor."""

    name: str
    raw: str
    multi_factor: bool = False
    factor_weights: bool = False
    pipeline: bool = False


def ranked_by(run: Run) -> str:
    """A multi-factor set-up goes before factor weights, these before the plain factor; a pipeline cleans what was chosen."""
    return "multi_factor_alpha" if run.multi_factor else "composite_alpha_score" if run.factor_weights else run.raw


def scored(values: DataFrame, runs: list[Run]) -> DataFrame:
    """(date, symbol, a column for each score in use) -> (run, date, symbol, ranking_factor, score), a row a run.

    A score cleaned by a pipeline stands in ``<score>_cleaned``.  A NULL score leaves the row out: the choice is
    the run's and is not made anew for a symbol that lacks its score.
    """
    legs = [F.struct(F.lit(r.name).alias("run"), F.lit(ranked_by(r)).alias("ranking_factor"), F.col(ranked_by(r) + ("_cleaned" if r.pipeline else "")).cast("double").alias("score")) for r in runs]
    return values.select("date", "symbol", F.inline(F.array(*legs))).select("run", "date", "symbol", "ranking_factor", "score").filter("score is not null")


def targets(scores: DataFrame, top: int, cap: float, cash: float = 0.0) -> DataFrame:
    """The ``top`` a run and date by score, ties to the smaller symbol, weighted by score under a cap."""
    return target_weights(scores, "score", top, cap, cash, date=EACH)
