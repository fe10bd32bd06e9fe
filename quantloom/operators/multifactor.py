"""Several factors as one score: families, weights, coverage, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import average_rank, div, finite
from .factors import REGISTRY

#: Families by the factors' own kinds; all others are PRICE.
FAMILIES = {"value": "VALUE", "quality": "QUALITY", "growth": "GROWTH", "health": "HEALTH", "composite": "QUALITY", "reversal": "REVERSAL"}
MODES = ("equal_weight", "custom_weight", "ic_weighted", "stability_weighted")


def family(name: str) -> str:
    kind = REGISTRY[name].family
    return FAMILIES.get(kind, "LOW_VOL" if kind == "volatility" and "low" in name else "PRICE")


def family_weights(names: list[str], raw: dict[str, float] | None = None) -> dict[str, float]:
    """Weights of the families that the factors have; equal where none is above zero."""
    have = {f: max((raw or {}).get(f, 0.0), 0.0) for f in sorted({family(n) for n in names})}
    if not any(have.values()):
        have = dict.fromkeys(have, 1.0)
    return {f: w / sum(have.values()) for f, w in have.items()}


def factor_weights(metrics: DataFrame, mode: str) -> DataFrame:
    """A row a factor (factor, custom, ic, rank_ic, icir, stability, coverage) -> (factor, weight); equal
    weights where no raw weight is above zero."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    above = lambda c: F.greatest(F.coalesce(finite(c), F.lit(0.0)), F.lit(0.0))
    raw = {
        "equal_weight": lambda: F.lit(1.0), "custom_weight": lambda: above("custom"),
        "ic_weighted": lambda: above("ic") + above("rank_ic") + above("icir"),
        "stability_weighted": lambda: above("stability") * F.greatest(F.coalesce(finite("coverage"), F.lit(1.0)), F.lit(0.0)),
    }[mode]()
    every = Window.partitionBy()  # a row a factor
    d = metrics.select("factor", raw.alias("raw"))
    total = F.sum("raw").over(every)
    return d.select("factor", F.when(total > 0, F.col("raw") / total).otherwise(1 / F.count("*").over(every)).alias("weight"))


def long_form(values: DataFrame, names: list[str]) -> DataFrame:
    """A column a factor -> (date, symbol, factor, value), NULLs kept."""
    legs = F.array(*[F.struct(F.lit(n).alias("factor"), finite(n).alias("value")) for n in names])
    return values.select("date", "symbol", F.explode(legs).alias("x")).select("date", "symbol", "x.*")


def coverage(rows: DataFrame) -> DataFrame:
    """Share of a date's symbols that have each factor."""
    return rows.groupBy("date", "factor").agg(F.bround(div(F.count("value"), F.count("*")), 6).alias("coverage"))


def normalised(rows: DataFrame) -> DataFrame:
    """Rank scores a date and factor from 0 to 1, the better the higher; constant or single: 0.5."""
    d = rows.filter("value is not null")
    w = Window.partitionBy("date", "factor")
    n = F.count("*").over(w)
    s = F.when((n <= 1) | (F.min("value").over(w) == F.max("value").over(w)), 0.5).otherwise(div(average_rank("value", "date", "factor") - 1, n - 1))
    lower = [n for n, f in REGISTRY.items() if f.sign < 0]
    return d.withColumn("score", F.when(F.col("factor").isin(*lower), 1 - s).otherwise(s))


def scores(rows: DataFrame, weights: DataFrame, families: dict[str, float], names: list[str], min_confidence: float = 0.0) -> DataFrame:
    """(date, symbol, final_score, confidence, n_factors).

    Within a family the weights of the factors that a symbol has are scaled to one; the families' own
    weights are not, so a family that is missing adds nothing.  A factor's confidence is its coverage
    times its stability, here the coverage again.
    """
    names_of = F.create_map(*[F.lit(x) for n in names for x in (n, family(n))])
    weight_of = F.create_map(*[F.lit(x) for f, w in families.items() for x in (f, w)])
    known = normalised(rows).join(F.broadcast(weights), "factor").join(coverage(rows), ["date", "factor"])  # weights: a row a factor
    known = known.withColumn("family", names_of[F.col("factor")]).withColumn("sure", F.bround(F.col("coverage") * F.col("coverage"), 6))
    per = known.groupBy("date", "symbol", "family").agg(div(F.sum(F.col("score") * F.col("weight")), F.sum("weight")).alias("family_score"), F.sum("sure").alias("sure"), F.count("*").alias("n"))
    part = F.bround(F.col("family_score") * weight_of[F.col("family")], 12)
    out = per.groupBy("date", "symbol").agg(F.sum(part).alias("final_score"), (F.sum("sure") / F.sum("n")).alias("confidence"), F.sum("n").alias("n_factors"))
    return out.withColumn("final_score", F.when(F.col("confidence") >= min_confidence, F.col("final_score")))
