"""Scores, grades and warnings: column expressions over metrics that other operators computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import div

# Grade borders, the coverage below which nothing is graded, and warning borders.
CANDIDATE, USABLE, LEAST_COVERAGE = 0.70, 0.55, 0.30
FEW_RETURNS, MUCH_TURNOVER, DEEP_FALL, ONE_SYMBOL, LEG_RATIO, MUCH_COST = 30, 1.0, -0.2, 0.5, (0.2, 5.0), 0.02


def unit(c: Column) -> Column:
    """c held to 0..1; NULL stays NULL."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def mean_of(*parts: Column) -> Column:
    """Mean of the parts that are not NULL; NULL if all are."""
    there = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return div(sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)), there)


def confidence(coverage: Column, stability: Column, count: Column) -> Column:
    known = lambda c: F.coalesce(unit(c), F.lit(0.0))
    return 0.45 * known(coverage) + 0.35 * known(stability) + 0.20 * known(count / 30)


def return_quality(spread: Column, sharpe: Column, drawdown: Column) -> Column:
    """Mean of a log-scaled return (1 at 100 %), the size of the Sharpe ratio (1 at 2) and the fall.

    A missing Sharpe ratio counts 0, a missing fall 0.5, a missing return not at all.
    """
    gain = F.when(spread <= 0, 0.0).otherwise(F.least(F.log1p(spread) / F.log(F.lit(2.0)), F.lit(1.0)))
    fall = F.coalesce(unit(1 + drawdown), F.lit(0.5))
    whole = mean_of(gain, F.coalesce(unit(F.abs(sharpe) / 2), F.lit(0.0)), fall)
    return F.when(F.coalesce(spread, sharpe, drawdown).isNotNull(), whole)


def consistency(series: str) -> Column:
    """Aggregate: 1 - deviation / mean size of a series; 0.5 for one value, NULL for none."""
    c = F.col(series)
    size = F.avg(F.abs(c))
    spread = unit(1 - F.try_divide(F.stddev_samp(c), size))
    return F.when(F.count(c) == 1, 0.5).when(F.count(c) > 1, F.when(size > 0, spread).otherwise(0.0))


def rank_score(signed: list[Column], coverage: Column, drawdown: Column) -> Column:
    """Mean of what is known: signed ratios mapped to 0..1, coverage, and 1 + drawdown."""
    return mean_of(*[unit(0.5 + s / 2) for s in signed], unit(coverage), unit(1 + drawdown))


def grade(score: Column, coverage: Column) -> Column:
    return (
        F.when(coverage < LEAST_COVERAGE, "blocked_by_coverage").when(score.isNull(), "insufficient_evidence")
        .when(score >= CANDIDATE, "candidate").when(score >= USABLE, "usable_but_needs_walk_forward").otherwise("weak_or_inconclusive")
    )


def fold_sharpe(returns: DataFrame, folds: DataFrame, by: list[str]) -> DataFrame:
    """(date, ret) keyed by ``by`` over test windows -> mean Sharpe ratio of the folds that have one, and how many have."""
    std = F.stddev_samp("ret")
    d = returns.filter("ret is not null").join(folds.select("fold", "test_start", "test_end"), F.col("date").between(F.col("test_start"), F.col("test_end")))
    each = d.groupBy(*by, "fold").agg(F.when(std > 0, F.avg("ret") / std * F.sqrt(F.lit(252.0))).alias("sharpe"))
    return each.groupBy(*by).agg(F.avg("sharpe").alias("walk_forward_sharpe"), F.count("sharpe").alias("n_folds"))


def ranked_factors(metrics: DataFrame, folds: DataFrame) -> DataFrame:
    """Metrics a factor and its folds -> score, grade, what blocks it, and its place.

    A factor without folds is scored by the rest.  Equal scores stand in falling order of names, unscored ones last.
    """
    c = F.col
    d = metrics.join(folds, "factor_name", "left").withColumn("confidence", confidence(c("coverage"), c("consistency"), c("n_dates")))
    signed = [c(n) for n in ("ic", "rank_ic", "icir", "sharpe", "walk_forward_sharpe", "confidence")]
    d = d.withColumn("rank_score", rank_score(signed, c("coverage"), c("fall")))
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc_nulls_last(F.bround("rank_score", 9)), F.desc("factor_name")))  # a row a factor
    blocking = F.when(c("coverage") < LEAST_COVERAGE, "LOW_FACTOR_COVERAGE").otherwise("")
    return d.select("factor_name", "ic", "rank_ic", "icir", "coverage", "cumulative", "sharpe", "fall", "walk_forward_sharpe", "confidence", "rank_score", F.coalesce("n_folds", F.lit(0)).alias("n_folds"), grade(c("rank_score"), c("coverage")).alias("grade"), blocking.alias("blocking"), place.alias("place"))


def warnings(n: Column, total: Column, sharpe: Column, drawdown: Column, turnover: Column, top: Column | None, long_side: Column, short_side: Column, cost_drag: Column | None = None, excess: Column | None = None, top_share: Column | None = None) -> Column:
    """Array of the codes that hold; a NULL metric warns of nothing.

    ``top`` is the best symbol's contribution, held against the total; ``top_share`` its share where that is known.
    """
    none = F.lit(None).cast("double")
    cost_drag, excess = none if cost_drag is None else cost_drag, none if excess is None else excess
    top_share = div(top, F.abs(total)) if top_share is None else top_share
    ratio = F.abs(F.try_divide(long_side, short_side))
    codes = [
        (n < FEW_RETURNS, "LOW_OBSERVATION_COUNT"), (turnover > MUCH_TURNOVER, "HIGH_TURNOVER"), (F.abs(cost_drag) > MUCH_COST, "HIGH_COST_DRAG"),
        ((total < 0) & (sharpe > 0), "NEGATIVE_COMPOUND_POSITIVE_SHARPE"), (drawdown < DEEP_FALL, "LARGE_DRAWDOWN"),
        (drawdown <= -1, "CAPITAL_WIPEOUT_OR_MARGIN_LOSS"), (excess < 0, "BENCHMARK_UNDERPERFORMANCE"), (top_share > ONE_SYMBOL, "SYMBOL_CONCENTRATION"),
        ((ratio > LEG_RATIO[1]) | (ratio < LEG_RATIO[0]), "LONG_SHORT_IMBALANCE"),
    ]
    return F.array_compact(F.array(*[F.when(holds, code) for holds, code in codes]))


def fill_batches(orders: DataFrame, slices: int, fill_ratio: float) -> DataFrame:
    """A row an order, mode and batch: the shares that immediate, partial and evenly sliced execution fill.

    Slices are equal but for the remainder, of which the first ones take a share each.
    """
    n, k = F.col("shares"), F.col("batch")
    batch = F.explode(F.flatten(F.array(
        F.array(F.struct(F.lit("immediate").alias("mode"), F.lit(1).alias("batch"))),
        F.array(F.struct(F.lit("partial_fill").alias("mode"), F.lit(1).alias("batch"))),
        F.transform(F.sequence(F.lit(1), F.lit(slices)), lambda i: F.struct(F.lit("twap").alias("mode"), i.alias("batch"))),
    )))
    d = orders.select("*", batch.alias("b")).select(*orders.columns, "b.*")
    twap = F.floor(n / slices) + (k <= n % slices).cast("int")
    return d.withColumn("fill", F.when(F.col("mode") == "twap", twap).when(F.col("mode") == "partial_fill", F.floor(n * F.lit(fill_ratio))).otherwise(n).cast("long"))


def steps(value: Column, borders: list[tuple[float, float]]) -> Column:
    """Points of the first border that the value exceeds (borders fall); 0 below all and for NULL."""
    out = F.when(value > borders[0][0], borders[0][1])
    for border, points in borders[1:]:
        out = out.when(value > border, points)
    return F.coalesce(out, F.lit(0.0))


def scorecard(m: dict[str, Column]) -> dict[str, Column]:
    """Five component scores of a factor from 0 to 100, their weighted sum, and PASS, WATCH, REJECT or ERROR.

    ``m``: ic, rank_ic, icir, positive, cumulative, mean_spread, sharpe, fall, hit, turnover, n_obs,
    n_warnings, fallback.  A missing metric adds nothing.  Borders and weights are fixed values.
    """
    zero, one = F.lit(0.0), F.lit(1.0)
    held = lambda c: F.coalesce(c, zero)
    best = F.greatest(F.abs(m["ic"]), F.abs(m["rank_ic"]))  # of those that are known
    hits = F.least(F.greatest(m["positive"] - 0.45, zero) / 0.15, one) * 20
    ic = F.when(best.isNull(), 0.0).otherwise(F.least(F.least(best / 0.04, one) * 50 + held(F.least(m["icir"] / 0.5, one) * 30) + held(hits), F.lit(100.0)))
    gain = steps(m["cumulative"], [(3.0, 30.0), (1.0, 20.0), (0.5, 10.0), (0.1, 5.0)]) + steps(m["mean_spread"], [(0.02, 20.0), (0.01, 15.0), (0.005, 10.0), (0.001, 5.0)]) + steps(m["sharpe"], [(1.5, 50.0), (1.0, 40.0), (0.5, 30.0), (0.2, 20.0), (0.0, 10.0)])
    scaled = F.abs(m["cumulative"]) > 0.01
    relative = F.when(scaled, m["fall"] / F.abs(m["cumulative"]))
    fall = F.when(relative.isNotNull(), (F.greatest(F.lit(-1.0), F.least(relative, zero)) + 1) * 30).when(m["fall"].isNotNull(), (F.greatest(F.lit(-0.5), F.least(m["fall"], zero)) / 0.5 + 1) * 30)
    risk = F.greatest(F.least(50 + held(fall) + held(F.least(F.greatest(m["hit"] - 0.45, zero) / 0.15, one) * 20), F.lit(100.0)), zero)
    cost = F.when(m["turnover"].isNull(), 50.0).otherwise((1 - F.greatest(zero, F.least(m["turnover"], one))) * 100)
    w = m["n_warnings"]
    count = F.when(m["n_obs"] >= 500, 20).when(m["n_obs"] >= 100, 10).otherwise(0)
    penalty = F.when(w > 5, 30).when(w > 2, 20).when(w > 0, 10).otherwise(0) + F.when(m["fallback"], 20).otherwise(0)
    quality = F.when(F.coalesce(m["n_obs"], F.lit(0)) == 0, 0.0).otherwise(F.greatest(F.least((60 + count - penalty).cast("double"), F.lit(100.0)), zero))
    score = ic * 0.30 + gain * 0.30 + risk * 0.20 + cost * 0.10 + quality * 0.10
    rules = [
        (m["n_obs"] == 0, "ERROR", "no observations"), (relative < -1, "REJECT", "spread drawdown exceeds cumulative spread"), (F.abs(m["ic"]) < 0.005, "REJECT", "near-zero IC"),
        (m["turnover"] > 2, "REJECT", "excessive turnover"), ((score >= 70) & ~m["fallback"], "PASS", "strong signal"), (score >= 50, "WATCH", "moderate signal"),
    ]
    chain = lambda at, rest: F.coalesce(*[F.when(r[0], r[at]) for r in rules], F.lit(rest))
    one_place = lambda c: F.bround(c, 1)
    return {"ic_score": one_place(ic), "return_score": one_place(gain), "risk_score": one_place(risk), "cost_score": one_place(cost), "quality_score": one_place(quality), "score": one_place(score), "status": chain(1, "REJECT"), "reason": chain(2, "weak signal")}


def audit_status(score: Column) -> Column:
    return F.when(score >= 60, "pass").when(score >= 30, "warn").otherwise("fail")


def universe_score(mean: Column, std: Column, positive: Column, n: Column) -> Column:
    """From the Sharpe ratios of several universes: steadiness and share above zero; a steady loser gets 30 at most."""
    steady = F.when(F.abs(mean) < 1e-9, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(std / mean))))
    whole = steady * 60 + positive * 40
    return F.when(n < 2, 50.0).otherwise(F.bround(F.when((mean <= 0) | (positive < 0.5), F.least(whole, F.lit(30.0))).otherwise(whole), 2))


def cost_score(net_sharpe: Column, net_return: Column, gross_sharpe: Column, gross_return: Column) -> Column:
    """What a factor keeps of its Sharpe ratio and return at a realistic cost."""
    size = F.greatest(F.abs(F.when((gross_sharpe.isNull()) | (gross_sharpe == 0), 1.0).otherwise(gross_sharpe)), F.lit(0.01))
    kept = F.when(net_sharpe > 0, F.least(net_sharpe / size * 100, F.lit(100.0))).otherwise(0.0)
    survival = F.when(gross_return > 1e-9, F.greatest(F.lit(0.0), F.least(F.lit(1.0), net_return / gross_return))).otherwise(0.0)
    return F.when(gross_return.isNull(), 50.0).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(kept * 0.6 + F.coalesce(survival, F.lit(0.0)) * 40, F.lit(100.0))), 2))


def turnover_score(annual: Column) -> Column:
    """100 without turnover, falling in straight pieces to 0 at ten times a year."""
    line = F.when(annual <= 0, 100.0).when(annual <= 1, 100 - annual * 20).when(annual <= 3, 80 - (annual - 1) * 15).when(annual <= 5, 50 - (annual - 3) * 10).otherwise(F.greatest(F.lit(0.0), 30 - (annual - 5) * 6))
    return F.when(annual.isNull(), 50.0).otherwise(F.bround(line, 2))


def decile_score(corr: Column, spread: Column, n: Column) -> Column:
    """Size of the rank correlation of deciles and returns, more if the spread agrees; an inverse one gets 40 at most."""
    agrees = (F.abs(spread) > 0.001) & (F.signum(spread) == F.signum(corr))
    whole = F.least(F.abs(corr) * 100 + F.when(agrees, 10.0).otherwise(0.0), F.lit(100.0))
    return F.when(corr.isNull() | (n < 5), 50.0).otherwise(F.bround(F.when(corr < 0, F.least(whole, F.lit(40.0))).otherwise(whole), 2))


def decay_score(half_life: Column, short_ic: Column, long_ic: Column, n: Column) -> Column:
    """Bands of the half-life; without one, what of the short horizon's IC the long one keeps."""
    h = half_life
    band = F.when(h >= 40, 100.0).when(h >= 20, 70 + (h - 20) / 20 * 30).when(h >= 10, 40 + (h - 10) / 10 * 30).when(h >= 5, 20 + (h - 5) / 5 * 20).otherwise(F.greatest(F.lit(0.0), h / 5 * 20))
    kept = F.when(F.abs(short_ic) > 1e-9, F.least(F.lit(100.0), F.abs(long_ic) / F.abs(short_ic) * 100))
    return F.when(n < 2, 50.0).otherwise(F.bround(F.when(h.isNotNull(), band).otherwise(F.coalesce(kept, F.lit(50.0))), 2))


#: Weights of the audit's components.
AUDIT = {"fold_consistency": 0.20, "universe_stability": 0.15, "cost_robustness": 0.20, "turnover_quality": 0.15, "decile_monotonicity": 0.15, "ic_persistence": 0.15}


def audit_score(parts: dict[str, Column]) -> Column:
    """Weighted mean of the components that are there."""
    there = sum((F.when(c.isNotNull(), AUDIT[k]).otherwise(0.0) for k, c in parts.items()), F.lit(0.0))
    total = sum((F.coalesce(c, F.lit(0.0)) * AUDIT[k] for k, c in parts.items()), F.lit(0.0))
    return F.bround(F.greatest(F.lit(0.0), F.least(F.coalesce(div(total, there), F.lit(0.0)), F.lit(100.0))), 2)


def stability_label(score: Column, stable: float = 0.70, moderate: float = 0.40, missing: str = "unknown") -> Column:
    return F.when(score.isNull(), missing).when(score >= stable, "stable").when(score >= moderate, "moderate").otherwise("unstable")


def readiness(universe: Column, with_data: Column, history: Column, sectors: Column, ready: Column) -> Column:
    """0 to 100 from the size of a universe, its price coverage, mean history, sectors and factor-ready symbols."""
    share = lambda c, points: F.floor(F.coalesce(F.try_divide(c, universe), F.lit(0.0)) * points)
    whole = F.least(universe, F.lit(20)) + share(with_data, 25) + F.floor(F.least(history / 252, F.lit(1.0)) * 20) + F.least(sectors * 3, F.lit(15)) + share(ready, 20)
    return F.least(F.lit(100), F.greatest(F.lit(0), whole)).cast("int")
