"""Gates before a strategy is relied on: a table of rules against rows of metrics, the worst finding decides.

Metrics are (strategy, gate, metric, subject, value): the subject is what a gate looks at several times in a
strategy, a factor or a regime, else null.  Each rule names a metric, a comparison and a threshold; a
rule's row of metrics in breach of it is a finding.  A gate's status is that of its worst finding, PASS without
one, and a strategy's is that of its worst gate.

The rules are a fixed table of some twenty rows, the one side that may be sent to all tasks; findings stay rows, and
all else is a grouped minimum or count, partial in each task: nothing is collected by strategy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds, gates, rules, and the order of statuses.
CONFIG = {
    "minimum_price_coverage": 0.80,
    "minimum_fundamental_coverage": 0.30,
    "minimum_ic": 0.02,
    "minimum_rank_ic": 0.02,
    "minimum_icir": 0.0,
    "minimum_factor_coverage": 0.30,
    "minimum_factor_history_count": 3,
    "minimum_walk_forward_folds": 3,
    "minimum_test_sharpe": 0.20,
    "maximum_train_test_gap": 0.50,
    "maximum_drawdown": 0.25,
    "maximum_turnover": 5.0,
    "maximum_cost_drag": 0.05,
    "minimum_regime_sample": 30,
    "maximum_factor_count": 8,
    "maximum_parameter_count": 20,
    "reject_on_schema_error": True,
}
STATUSES = ["PASS", "SKIPPED", "WARNING", "FAIL", "REJECTED"]
#: Gates in their order, with the reason they give for a warning (none: the first finding's).
GATES = [
    ("schema_validation", None),
    ("data_quality", None),
    ("factor_history", "WARN_FACTOR_EVIDENCE_WEAK"),
    ("walk_forward", "WARN_WALK_FORWARD_EVIDENCE_WEAK"),
    ("regime_coverage", None),
    ("trading_simulation", None),
    ("complexity", None),
]
#: (gate, metric, comparison that is a breach, threshold, what a missing value is taken for, status, code).  A threshold
#: is a name in the configuration or a number; "absent" asks for a value, whatever it is.
RULES = [
    ("schema_validation", "errors", ">", 0, None, "REJECTED", "STRATEGY_SCHEMA_INVALID"),
    ("schema_validation", "warnings", ">", 0, None, "WARNING", "WARN_STRATEGY_SCHEMA_WARNINGS"),
    ("data_quality", "price_coverage", "<", "minimum_price_coverage", 0.0, "WARNING", "WARN_LOW_PRICE_COVERAGE"),
    ("data_quality", "fundamental_coverage", "<", "minimum_fundamental_coverage", 0.0, "WARNING", "WARN_LOW_FUNDAMENTAL_COVERAGE"),
    ("factor_history", "history_count", "<", "minimum_factor_history_count", 0.0, "WARNING", "WARN_LOW_FACTOR_HISTORY"),
    ("factor_history", "coverage", "<", "minimum_factor_coverage", float("-inf"), "WARNING", "WARN_LOW_FACTOR_COVERAGE"),
    ("factor_history", "ic", "<", "minimum_ic", None, "WARNING", "WARN_WEAK_IC"),
    ("factor_history", "rank_ic", "<", "minimum_rank_ic", None, "WARNING", "WARN_WEAK_RANK_IC"),
    ("factor_history", "icir", "<", "minimum_icir", None, "WARNING", "WARN_WEAK_ICIR"),
    ("walk_forward", "fold_count", "<", "minimum_walk_forward_folds", 0.0, "WARNING", "WARN_LOW_WALK_FORWARD_FOLDS"),
    ("walk_forward", "test_sharpe", "<", "minimum_test_sharpe", None, "WARNING", "WARN_LOW_TEST_SHARPE"),
    ("walk_forward", "train_test_gap", ">", "maximum_train_test_gap", None, "WARNING", "WARN_TRAIN_TEST_GAP"),
    ("regime_coverage", "regime_days", "<", "minimum_regime_sample", 0.0, "WARNING", "WARN_LOW_REGIME_SAMPLE"),
    ("regime_coverage", "factor_regimes", "<", 1, 0.0, "WARNING", "WARN_MISSING_FACTOR_REGIME_HISTORY"),
    ("trading_simulation", "final_equity", "absent", 0, None, "WARNING", "WARN_NO_TRADING_SIMULATION_EVIDENCE"),
    ("trading_simulation", "max_drawdown", ">", "maximum_drawdown", None, "REJECTED", "REJECT_MAX_DRAWDOWN"),
    ("trading_simulation", "turnover", ">", "maximum_turnover", None, "WARNING", "WARN_HIGH_TURNOVER"),
    ("trading_simulation", "cost_drag", ">", "maximum_cost_drag", None, "WARNING", "WARN_HIGH_COST_DRAG"),
    ("complexity", "factor_count", ">", "maximum_factor_count", None, "WARNING", "WARN_HIGH_FACTOR_COUNT"),
    ("complexity", "parameter_count", ">", "maximum_parameter_count", None, "WARNING", "WARN_HIGH_PARAMETER_COUNT"),
]
METRICS = "strategy string, gate string, metric string, subject string, value double"


def rules(spark, config: dict | None = None) -> DataFrame:
    """The rules as a table; ``config`` replaces thresholds by name, and names that there are not are refused."""
    unknown = set(config or {}) - set(CONFIG)
    if unknown:
        raise ValueError(f"no such thresholds: {', '.join(sorted(unknown))}")
    c = {**CONFIG, **(config or {})}
    rows = []
    for n, (gate, metric, how, limit, instead, status, code) in enumerate(RULES):
        if code == "STRATEGY_SCHEMA_INVALID" and not c["reject_on_schema_error"]:
            status = "FAIL"
        rows.append((n, gate, metric, how, float(c[limit] if isinstance(limit, str) else limit), instead, STATUSES.index(status), code))
    return spark.createDataFrame(rows, "rule int, gate string, metric string, how string, threshold double, instead double, severity int, code string")


def findings(metrics: DataFrame, table: DataFrame) -> DataFrame:
    """(strategy, gate, code, metric, subject, value, threshold, rule, severity): the rows in breach of a rule.

    Values that are no number count as missing.  Drawdowns go by their size.
    """
    value = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    value = F.when(F.col("metric") == "max_drawdown", F.abs(value)).otherwise(value)
    d = metrics.select("strategy", "gate", "metric", "subject", value.alias("value")).join(F.broadcast(table), ["gate", "metric"])
    v = F.coalesce("value", "instead")
    breach = F.when(F.col("how") == "<", v < F.col("threshold")).when(F.col("how") == ">", v > F.col("threshold")).otherwise(F.col("value").isNull())
    return d.filter(F.coalesce(breach, F.lit(False))).select("strategy", "gate", "code", "metric", "subject", "value", "threshold", "rule", "severity")


def status_of(severity: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATUSES)), severity + 1)


def gate_results(metrics: DataFrame, found: DataFrame) -> DataFrame:
    """(strategy, gate, ord, status, reason, n_findings): every gate of every strategy in ``metrics``.

    Findings that are less grave than the gate's status are not counted; the reason is the first rule's in breach.
    A gate that no metric reached passes.
    """
    gates = metrics.sparkSession.createDataFrame([(n, g, r) for n, (g, r) in enumerate(GATES)], "ord int, gate string, weak string")
    each = metrics.select("strategy").distinct().select("strategy", F.explode(F.array(*[F.lit(g) for g, _ in GATES])).alias("gate"))
    by_severity = found.groupBy("strategy", "gate", "severity").agg(F.count("*").alias("n"), F.min(F.struct("rule", "code"))["code"].alias("code"))
    worst = by_severity.groupBy("strategy", "gate").agg(F.max("severity").alias("severity"), F.max_by("n", "severity").alias("n"), F.max_by("code", "severity").alias("code"))
    d = each.join(worst, ["strategy", "gate"], "left").join(F.broadcast(gates), "gate").withColumn("severity", F.coalesce("severity", F.lit(0)))
    reason = F.when(F.col("severity") == 0, "PASS").when(F.col("severity") == STATUSES.index("WARNING"), F.coalesce("weak", "code")).otherwise(F.col("code"))
    return d.select("strategy", "gate", "ord", status_of(F.col("severity")).alias("status"), reason.alias("reason"), F.coalesce("n", F.lit(0)).alias("n_findings"), "severity")


def overall(results: DataFrame) -> DataFrame:
    """(strategy, status, first_gate, reason, n_passed, n_warnings, n_rejected): the worst gate decides, the earlier of equals is named."""
    first = F.min(F.struct(-F.col("severity"), "ord", "gate", "reason"))
    count = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    d = results.groupBy("strategy").agg(F.max("severity").alias("severity"), first.alias("x"), count("PASS").alias("n_passed"), count("WARNING").alias("n_warnings"), count("FAIL", "REJECTED").alias("n_rejected"))
    bad = F.col("severity") > 0
    return d.select("strategy", status_of(F.col("severity")).alias("status"), F.when(bad, F.col("x.gate")).alias("first_gate"), F.when(bad, F.col("x.reason")).alias("reason"), "n_passed", "n_warnings", "n_rejected")
