"""Strategy files line by line, and gates at their thresholds."""

import random

import pytest

from quantloom.operators import gates
from quantloom.sources import strategies

KNOWN = ["momentum_20d", "momentum_60d", "roe_quality_factor"]
GOOD = """# a comment
name: alpha one
description: "holds # and : signs"   # then a comment
version: v1
author: 'desk'
created_at: 1996-01-01
tags:
  - research
universe:
  type: custom
  symbols:
    - AAA
    - bb.b
factors:
  - name: momentum_20d
    weight: 0.25
  - name: momentum_60d
    weight: 7.5e-1

regime:
  enabled: true
  preferred_regimes:
    - BULL
portfolio:
  method: risk_parity
  max_position_weight: 1
  cash_buffer: 0
validation:
  require_walk_forward: true
  minimum_regime_sample: 30
"""
JSON = '{"name": "j", "description": "d", "version": 1, "author": "a", "created_at": "x", "universe": {"type": "custom", "symbols": ["AAA", "no good"]}, "factors": [{"name": "momentum_20d"}, {"name": "nothing", "weight": -1}], "execution": {"slippage_bps": "nan"}, "tags": ["t"]}'


def files(spark, **texts):
    return spark.createDataFrame([(k.replace("_json", ".json"), v) for k, v in texts.items()], "file string, text string")


def entries(spark, text):
    return {(r.section, r.item, r.key): (r.line, r.value, r.quoted, r.error) for r in strategies.entries(files(spark, f=text)).collect()}


def problems(spark, text, name="f"):
    d = files(spark, **{name: text})
    return sorted((r.line or 0, r.code, r.detail) for r in strategies.problems(d, strategies.entries(d), KNOWN).collect())


def test_entries_have_their_lines(spark):
    e = entries(spark, GOOD)
    assert e["name", None, None] == (2, "alpha one", False, None)
    assert e["description", None, None] == (3, "holds # and : signs", True, None)
    assert e["author", None, None][:3] == (5, "desk", True)
    assert e["tags", 0, None][:2] == (8, "research")
    assert e["universe", 1, "symbols"][:2] == (13, "bb.b")
    assert e["factors", 0, "weight"][:2] == (16, "0.25") and e["factors", 1, "name"][:2] == (17, "momentum_60d")
    assert e["regime", 0, "preferred_regimes"][:2] == (23, "BULL")
    assert all(v[3] is None for v in e.values())


def test_good_file_has_no_problem(spark):
    assert problems(spark, GOOD) == []
    d = files(spark, f=GOOD)
    assert [(r["name"], r.weight, r.valid) for r in strategies.factors(strategies.entries(d)).orderBy("item").collect()] == [("momentum_20d", 0.25, True), ("momentum_60d", 0.75, True)]


CASES = [
    ("name: alpha one", "", [(0, "MISSING_NAME", None)]),
    ("name: alpha one", "name: null", [(0, "MISSING_NAME", None)]),
    ("version: v1", 'version: ""', [(0, "MISSING_VERSION", None)]),
    ("  type: custom", "  type: moon", [(10, "UNSUPPORTED_UNIVERSE_TYPE", "moon")]),
    ("    - AAA\n    - bb.b", "", [(10, "CUSTOM_UNIVERSE_REQUIRES_SYMBOLS", None)]),
    ("    - bb.b", "    - no good", [(13, "INVALID_SYMBOL", "NO GOOD")]),
    ("momentum_60d", "momentum_20d", [(17, "DUPLICATE_FACTOR", "momentum_20d")]),
    ("momentum_60d", "moon", [(17, "UNSUPPORTED_FACTOR", "moon")]),
    ("weight: 0.25", "weight: -1", [(0, "WARN_FACTOR_WEIGHTS_NORMALIZED", None), (15, "INVALID_FACTOR_WEIGHT", "momentum_20d")]),
    ("weight: 0.25", "weight: x", [(0, "WARN_FACTOR_WEIGHTS_NORMALIZED", None), (15, "INVALID_FACTOR_WEIGHT", "momentum_20d")]),
    ("weight: 0.25", "", [(0, "WARN_FACTOR_WEIGHTS_NORMALIZED", None)]),
    ("weight: 0.25", "weight: 0.2500000005", []),
    ("weight: 0.25", "weight: 0.25000001", [(0, "WARN_FACTOR_WEIGHTS_NORMALIZED", None)]),
    ("weight: 0.25", "color: red", [(0, "WARN_FACTOR_WEIGHTS_NORMALIZED", None), (16, "WARN_UNSUPPORTED_FIELD", "factors.color")]),
    ("  preferred_regimes:\n    - BULL", "", [(21, "WARN_REGIME_ENABLED_WITHOUT_PREFERRED_REGIMES", None)]),
    ("method: risk_parity", "method: luck", [(25, "UNSUPPORTED_PORTFOLIO_METHOD", "luck")]),
    ("max_position_weight: 1", "max_position_weight: 1.01", [(26, "INVALID_MAX_POSITION_WEIGHT", "1.01")]),
    ("max_position_weight: 1", "max_position_weight: 0", [(26, "INVALID_MAX_POSITION_WEIGHT", "0")]),
    ("cash_buffer: 0", "cash_buffer: 1", [(27, "INVALID_CASH_BUFFER", "1")]),
    ("sample: 30", "sample: 30.5", [(30, "INVALID_MINIMUM_REGIME_SAMPLE", "30.5")]),
    ("require_walk_forward: true", "no_lookahead: false", [(29, "NO_LOOKAHEAD_OVERRIDE_NOT_ALLOWED", None), (29, "WARN_UNSUPPORTED_FIELD", "validation.no_lookahead")]),
    ("require_walk_forward: true", "lookahead: 0", [(29, "WARN_UNSUPPORTED_FIELD", "validation.lookahead")]),
    ("validation:", "execution:\n  broker: x\nvalidation:", [(29, "LIVE_TRADING_NOT_SUPPORTED", None), (29, "WARN_UNSUPPORTED_FIELD", "execution.broker")]),
    ("  method: risk_parity", "  method risk_parity", [(25, "UNREADABLE_LINE", "no colon")]),
    ("  method: risk_parity", "  method: 'risk_parity", [(25, "UNREADABLE_LINE", "open quote")]),
    ("  method: risk_parity", "  method: [risk_parity]", [(25, "UNREADABLE_LINE", "collection in a line")]),
    ("  method: risk_parity", "  method: risk_parity\n    deep: 1", [(26, "UNREADABLE_LINE", "under a value")]),
]


def test_each_problem_by_its_line(spark):
    assert all(old in GOOD for old, _, _ in CASES)
    d = files(spark, **{str(n): GOOD.replace(old, new, 1) for n, (old, new, _) in enumerate(CASES)})
    found = strategies.problems(d, strategies.entries(d), KNOWN).collect()
    for n, (old, new, expected) in enumerate(CASES):
        assert (n, sorted((r.line or 0, r.code, r.detail) for r in found if r.file == str(n))) == (n, sorted(expected, key=lambda x: x[:2]))


def test_odd_files(spark):
    missing = {"MISSING_" + s for s in ("NAME", "DESCRIPTION", "VERSION", "AUTHOR", "CREATED_AT", "FACTORS")} | {"WARN_DEFAULT_UNIVERSE_USED"}
    d = files(spark, a="", b=None, c="# only\n\n", d="  name: x")
    found = strategies.problems(d, strategies.entries(d), KNOWN).collect()
    for name in "abcd":
        assert {r.code for r in found if r.file == name} == missing | ({"UNREADABLE_LINE"} if name == "d" else set())
    twice = GOOD + "universe:\n  symbols:\n    - A\n    - B\n    - C\n  symbols:\n    - D\n"
    e = entries(spark, twice)
    assert [k for k in e if k[0] == "universe"] and e["universe", 0, "symbols"][1] == "D" and ("universe", 1, "symbols") not in e and ("universe", None, "type") not in e
    d = spark.createDataFrame([], "file string, text string")
    assert strategies.problems(d, strategies.entries(d), KNOWN).count() == 0


def test_json_and_folder(spark, tmp_path):
    (tmp_path / "one.yaml").write_text(GOOD)
    (tmp_path / "two.json").write_text(JSON)
    (tmp_path / "bad.json").write_text("[1]")
    (tmp_path / "notes.txt").write_text("name: not a strategy")
    d = strategies.read_files(spark, str(tmp_path))
    assert sorted(r.file for r in d.collect()) == ["bad.json", "one.yaml", "two.json"]
    found = strategies.problems(d, strategies.entries(d), KNOWN).collect()
    assert {(r.code, r.detail) for r in found if r.file == "two.json"} == {("INVALID_SYMBOL", "NO GOOD"), ("UNSUPPORTED_FACTOR", "nothing"), ("INVALID_FACTOR_WEIGHT", "nothing"), ("INVALID_SLIPPAGE_BPS", "nan")}
    assert "UNREADABLE_LINE" in {r.code for r in found if r.file == "bad.json"} and not [r for r in found if r.file == "one.yaml"]


def run_gates(spark, rows, config=None):
    m = spark.createDataFrame([("s", *r) for r in rows], gates.METRICS)
    f = gates.findings(m, gates.rules(spark, config))
    r = gates.gate_results(m, f)
    return {(x.gate): (x.status, x.reason, x.n_findings) for x in r.collect()}, gates.overall(r).first()


def test_each_threshold(spark):
    rows, bad_rows = [], set()
    for n, (gate, metric, how, limit, instead, status, code) in enumerate(gates.RULES):
        limit = float(gates.CONFIG[limit] if isinstance(limit, str) else limit)
        step = 1e-6 if how == ">" else -1e-6
        cases = [(None, True), (0.0, False), (float("nan"), True)] if how == "absent" else [(limit, False), (limit + step, True), (limit - step, False), (None, instead is not None)]
        for k, (v, bad) in enumerate(cases):
            rows.append((f"{n}/{k}", gate, metric, None, v))
            if bad:
                bad_rows.add((f"{n}/{k}", n, code, status))
    found = gates.findings(spark.createDataFrame(rows, gates.METRICS), gates.rules(spark)).collect()
    assert {(r.strategy, r.rule, r.code, gates.STATUSES[r.severity]) for r in found} == bad_rows


def test_worst_finding_decides(spark):
    g, o = run_gates(spark, [("trading_simulation", "final_equity", None, 1.0), ("trading_simulation", "max_drawdown", None, -0.3), ("trading_simulation", "turnover", None, 9.0), ("factor_history", "ic", "f", 0.0), ("factor_history", "icir", "f", -1.0)])
    assert g["trading_simulation"] == ("REJECTED", "REJECT_MAX_DRAWDOWN", 1) and g["factor_history"] == ("WARNING", "WARN_FACTOR_EVIDENCE_WEAK", 2)
    assert g["complexity"] == ("PASS", "PASS", 0) and len(g) == 7
    assert (o.status, o.first_gate, o.reason, o.n_passed, o.n_warnings, o.n_rejected) == ("REJECTED", "trading_simulation", "REJECT_MAX_DRAWDOWN", 5, 1, 1)
    g, o = run_gates(spark, [("schema_validation", "errors", None, 1.0), ("trading_simulation", "turnover", None, 9.0)], {"reject_on_schema_error": False, "maximum_turnover": 10.0})
    assert (o.status, o.first_gate, o.n_warnings) == ("FAIL", "schema_validation", 0)
    _, o = run_gates(spark, [("complexity", "factor_count", None, 1.0)])
    assert (o.status, o.first_gate, o.reason) == ("PASS", None, None)
    with pytest.raises(ValueError):
        gates.rules(spark, {"maximum_luck": 1})


def test_against_plain_rules(spark):
    rng = random.Random(5)
    metrics = [(g, m) for g, m, *_ in gates.RULES]
    rows = [(f"s{rng.randrange(9)}", *rng.choice(metrics), rng.choice([None, "a", "b"]), rng.choice([None, float("nan"), rng.uniform(-2, 40), rng.uniform(-1, 1)])) for _ in range(400)]
    expected = {}
    for s, g, m, _, v in rows:
        v = None if v is None or v != v else abs(v) if m == "max_drawdown" else v
        for gate, metric, how, limit, instead, status, code in gates.RULES:
            if (gate, metric) != (g, m):
                continue
            limit = gates.CONFIG[limit] if isinstance(limit, str) else limit
            w = instead if v is None else v
            if v is None if how == "absent" else w is not None and (w < limit if how == "<" else w > limit):
                expected[s, g] = max(expected.get((s, g), "PASS"), status, key=gates.STATUSES.index)
    m = spark.createDataFrame(rows, gates.METRICS)
    got = gates.gate_results(m, gates.findings(m, gates.rules(spark)))
    assert {(r.strategy, r.gate): r.status for r in got.collect() if r.status != "PASS"} == expected
