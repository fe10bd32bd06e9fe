"""Strategies judged from stored reports, against a plain version; documents, legs, scoring modes and rankings."""

import datetime as dt
import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quantloom.operators import alpha, backtest, evaluate, evaluation, factors, markets, scores, series, store
from quantloom.sources import panel, reports
from quantloom.sources.tables import kept

DAY = dt.date(2020, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def factor_report(seed, n=40):
    """A report as a stored document has it, with gaps in legs and returns."""
    r = random.Random(seed)
    periods = []
    for k in range(n):
        names = r.sample(["A", "B", "C", "D", "E", "F"], 4)
        long, short = (names[:2], names[2:]) if r.random() > 0.1 else (names[:2], [])
        lr = r.gauss(0.01, 0.05) if r.random() > 0.05 else None
        sr = r.gauss(0, 0.05) if short else None
        periods.append({
            "signal_date": str(day(7 * k)), "future_date": str(day(7 * k + 20)), "long_symbols": long, "short_symbols": short,
            "long_weights": {s: 1 / len(long) for s in long}, "short_weights": {s: -1 / len(short) for s in short},
            "long_return": lr, "short_return": sr, "long_short_return": None if lr is None or sr is None else lr - sr,
        })
    whole = [p for p in periods if p["long_short_return"] is not None]
    mean = lambda c: statistics.fmean(p[c] for p in whole)
    return {"no_lookahead": seed % 2 == 0, "warnings": ["thin"] * (seed % 3), "turnover": 0.7 + 0.2 * seed, "gross_exposure": 2.0, "net_exposure": 0.0, "long_leg_return": mean("long_return"), "short_leg_return": mean("short_return"), "periods": periods}


def plain_series(dates, rets):
    """Figures of one series, in plain Python."""
    equity, out = 1.0, []
    for r in rets:
        equity *= 1 + r
        out.append(equity)
    peak, low, end = 1.0, math.inf, 0
    for k, e in enumerate(out):
        peak = max(peak, e)
        if e / peak - 1 < low:
            low, end = e / peak - 1, k
    top = max(out[: end + 1])
    start = out.index(top) if top >= 1 else 0
    down = [r for r in rets if r < 0]
    std = statistics.stdev(rets)
    return {
        "n": len(rets), "total_return": equity - 1, "annual_return": equity ** (252 / len(rets)) - 1, "volatility": std * 252**0.5, "sharpe": statistics.fmean(rets) / std * 252**0.5, "sortino": statistics.fmean(rets) / statistics.stdev(down) * 252**0.5,
        "max_drawdown": low, "hit_rate": sum(r > 0 for r in rets) / len(rets), "best_return": max(rets), "worst_return": min(rets), "best_date": dates[rets.index(max(rets))], "worst_date": dates[rets.index(min(rets))],
        "drawdown_start": dates[start], "drawdown_end": dates[end], "drawdown_days": (dates[end] - dates[start]).days,
    }


def plain_parts(report):
    given, moved, sizes, before = {}, {}, {}, None
    for p in report["periods"]:
        for side, sign in (("long", 1), ("short", -1)):
            for s in p[f"{side}_symbols"]:
                if p[f"{side}_return"] is not None:
                    given[s] = given.get(s, 0) + sign * p[f"{side}_return"] / len(p[f"{side}_symbols"])
        now = {**p["long_weights"], **p["short_weights"]}
        for s, w in now.items():
            sizes.setdefault(s, []).append(abs(w))
        if before is not None:
            for s in {*before, *now}:
                moved[s] = moved.get(s, 0) + abs(now.get(s, 0) - before.get(s, 0))
        before = now
    return {s: (given.get(s, 0), 0.0, moved.get(s, 0), statistics.fmean(sizes[s])) for s in sizes}


def close(a, b):
    return a == b or (isinstance(a, float) and a == pytest.approx(b, rel=1e-9, abs=1e-12))


def stored(spark, **texts):
    heads, periods, problems = reports.factor_documents(documents(spark, **texts))
    return kept(heads, "heads"), kept(periods, "periods"), problems


def documents(spark, **texts):
    return spark.createDataFrame([(k, v if isinstance(v, str) or v is None else json.dumps(v)) for k, v in texts.items()], "run string, text string")


def test_factor_reports_against_plain(spark):
    given = {f"r{k}": factor_report(k) for k in range(4)}
    heads, periods, problems = stored(spark, **given)
    assert problems.count() == 0
    e = evaluation.from_periods(heads, periods)
    market = {day(7 * k): random.Random(k).gauss(0, 0.02) for k in range(60)}
    bench = spark.createDataFrame([(d, r) for d, r in market.items()], "date date, ret double")
    rows = {r.run: r for r in evaluation.evaluate(e, bench).collect()}
    assert sorted(rows) == sorted(given)
    for run, report in given.items():
        whole = [p for p in report["periods"] if p["long_short_return"] is not None]
        dates, rets = [dt.date.fromisoformat(p["signal_date"]) for p in whole], [p["long_short_return"] for p in whole]
        for name, want in plain_series(dates, rets).items():
            assert close(rows[run][name], want), (run, name, rows[run][name], want)
        active = [r - market[d] for d, r in zip(dates, rets)]
        assert close(rows[run].information_ratio, statistics.fmean(active) / statistics.stdev(active) * 252**0.5)
        assert close(rows[run].excess_return, math.prod(1 + r for r in rets) - math.prod(1 + r for r in market.values()))
        assert close(rows[run].long_contribution, sum(p["long_return"] for p in whole)) and close(rows[run].short_contribution, -sum(p["short_return"] for p in whole))
        parts = plain_parts(report)
        gains = sorted((c for c, *_ in parts.values() if c > 0), reverse=True)
        assert close(rows[run].top_3_share, sum(gains[:3]) / abs(rows[run].total_return))
        assert ("SOURCE_WARNING" in rows[run].codes) == bool(report["warnings"]) and ("NO_LOOKAHEAD_NOT_MARKED" in rows[run].codes) != report["no_lookahead"]
        assert ("HIGH_TURNOVER" in rows[run].codes) == (report["turnover"] > 1)
        got = {r.symbol: (r.contribution, r.cost, r.turnover, r.weight) for r in e.parts.filter(f"run = '{run}'").collect()}
        assert got.keys() == parts.keys() and all(close(x, y) for s in parts for x, y in zip(got[s], parts[s]))


def test_stated_figures_go_first(spark):
    report = factor_report(1) | {"total_return": -0.5, "sharpe": 1.0, "max_drawdown": 0.3}
    heads, periods, _ = stored(spark, a=report)
    r = evaluation.evaluate(evaluation.from_periods(heads, periods)).first()
    assert (r.total_return, r.sharpe) == (-0.5, 1.0) and "NEGATIVE_COMPOUND_POSITIVE_SHARPE" in r.codes
    assert r.benchmark_return is None and r.information_ratio is None


ACCOUNT = {
    "no_lookahead": True, "initial_cash": 1000.0, "metrics": {"turnover": 0.4},
    "equity_curve": [
        {"date": "2020-01-01", "equity": 1000.0, "cash": 1000.0, "positions": {}}, {"date": "2020-01-02", "equity": 1010.0, "cash": 505.0, "positions": {"A": 303.0, "B": 202.0}},
        {"date": "2020-01-03", "equity": 0.0, "cash": 0.0, "positions": {"A": 1.0}}, {"date": "2020-01-06", "equity": 999.9, "cash": 333.3, "positions": {"A": 666.6}},
    ],
    "trades": [{"date": "2020-01-02", "symbol": "A", "side": "buy", "notional": 300.0, "total_cost": 30.0}, {"date": "2020-01-02", "symbol": "B", "side": "BUY", "notional": 200.0}, {"date": "2020-01-06", "symbol": "B", "side": "SELL", "notional": 260.0, "total_cost": 1.0}],
}


def test_account_reports(spark):
    heads, equity, trades, problems = reports.account_documents(documents(spark, a=ACCOUNT, b=ACCOUNT | {"metrics": {"cash_ratio": 0.25, "total_return": 0.1}, "initial_cash": 0}))
    assert problems.count() == 0
    e = evaluation.from_accounts(heads, equity, trades)
    # the step from zero has no return
    assert [r.ret for r in e.returns.filter("run = 'a'").orderBy("date").collect()] == pytest.approx([0.01, -1.0])
    parts = {r.symbol: r for r in e.parts.filter("run = 'a'").collect()}
    assert (parts["A"].contribution, parts["A"].cost, parts["A"].turnover) == pytest.approx((-0.33, -0.03, 0.3))
    assert (parts["B"].contribution, parts["B"].cost, parts["B"].turnover) == pytest.approx((0.059, -0.001, 0.46))
    assert parts["A"].weight == pytest.approx((0.3 + 666.6 / 999.9) / 2)
    rows = {r.run: r for r in evaluation.evaluate(e).collect()}
    a, b = rows["a"], rows["b"]
    assert a.gross_exposure == pytest.approx((0 + 0.5 + 666.6 / 999.9) / 3) and a.cash_share == pytest.approx((1 + 0.5 + 333.3 / 999.9) / 3)
    assert (a.total_cost, a.cost_drag) == pytest.approx((31.0, -0.031)) and a.codes == ["LOW_OBSERVATION_COUNT", "HIGH_COST_DRAG", "LARGE_DRAWDOWN", "CAPITAL_WIPEOUT_OR_MARGIN_LOSS"]
    assert b.gross_exposure == 0.75 and b.total_return == 0.1 and b.cost_drag == pytest.approx(-31.0)


def test_documents_that_are_none(spark):
    given = dict(bad="{no json", nothing=None, empty="", list="[]", lone={"periods": []}, good=factor_report(0, 3))
    heads, periods, problems = stored(spark, **given)
    found = {r.run: r.problem for r in problems.collect()}
    assert found == {"bad": "unreadable", "nothing": "unreadable", "empty": "unreadable", "list": "unreadable", "lone": "no_periods"}
    assert [r.run for r in heads.collect()] == ["good"] and periods.count() == 3
    short = ACCOUNT | {"equity_curve": ACCOUNT["equity_curve"][:1]}
    no_metrics = {k: v for k, v in ACCOUNT.items() if k != "metrics"}
    problems = reports.account_documents(documents(spark, short=short, none=no_metrics, good=ACCOUNT))[3]
    assert {r.run: r.problem for r in problems.collect()} == {"short": "short_curve", "none": "no_metrics"}


def test_lines_there_and_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.1, {"x": 1 / 3}), ("b", None, None), (None, 1e-300, {})], "run string, v double, m map<string,double>")
    at = reports.write_lines(rows, str(tmp_path / "lines"))
    (tmp_path / "lines" / "part-odd.txt").write_text('\n{"run": "c", "v": 2, "more": 1}\n{"run": \n{"run": "d", "v": "text"}\n')
    got, bad = reports.read_lines(spark, at, rows.schema)
    key = lambda r: (str(r[0]), str(r[1]), str(r[2]))
    assert sorted(map(key, got.collect())) == sorted(map(key, [*rows.collect(), ("c", 2.0, None)]))
    assert sorted(r.line for r in bad.collect()) == ['{"run": ', '{"run": "d", "v": "text"}']


def test_runs_without_returns_and_empty_tables(spark):
    heads, periods, _ = stored(spark, a=factor_report(0, 5))
    for none in (periods.filter("false"), periods.withColumn("long_short_return", periods.long_short_return * float("nan"))):
        r = evaluation.evaluate(evaluation.from_periods(heads, none)).collect()
        assert len(r) == 1 and r[0].n == 0 and r[0].total_return is None and "LOW_OBSERVATION_COUNT" in r[0].codes
    e = evaluation.from_periods(heads.filter("false"), periods.filter("false"))
    assert evaluation.evaluate(e).collect() == [] and evaluation.attribution(e).collect() == [] and evaluation.by_calendar(e.returns, "month").collect() == []


def test_best_and_worst_have_places(spark):
    parts = spark.createDataFrame([("r", s, c, 0.0, 0.0, 0.1) for s, c in [("A", 0.5), ("B", 0.5), ("C", 0.1), ("D", -0.2), ("E", 0.0), ("F", None)]], "run string, symbol string, contribution double, cost double, turnover double, weight double")
    e = evaluation.Evidence(None, parts, None)
    assert {r.symbol: (r.kind, r.place) for r in evaluation.attribution(e, 2).collect()} == {"A": ("contributor", 1), "B": ("contributor", 2), "C": ("contributor", None), "D": ("detractor", 1), "E": (None, None), "F": (None, None)}


def test_legs(spark):
    rows = [(day(0), day(5), s, float(k), r) for k, (s, r) in enumerate([("D", 0.1), ("C", 0.2), ("B", 0.3), ("A", 0.5)])] + [(day(7), day(12), "A", 1.0, 0.4), (day(14), day(19), "A", 1.0, None), (day(14), day(19), "B", 2.0, 0.1)]
    obs = spark.createDataFrame(rows, "signal_date date, future_date date, symbol string, value double, future_return double")
    got = {r.signal_date: r for r in backtest.legs(backtest.assign_quantiles(obs, 2), 2).collect()}
    a, b, c = got[day(0)], got[day(7)], got[day(14)]
    assert (a.long_symbols, a.short_symbols, a.long_weights, a.short_weights) == (["A", "B"], ["C", "D"], {"A": 0.5, "B": 0.5}, {"C": -0.5, "D": -0.5})
    assert (a.net_exposure, a.gross_exposure, a.turnover) == (0.0, 2.0, None) and a.long_short_return == pytest.approx(0.25)
    # one symbol is the short leg: no spread
    assert (b.long_symbols, b.short_symbols, b.net_exposure, b.gross_exposure, b.long_short_return, b.quantile_returns) == ([], ["A"], -1.0, 1.0, None, {"q1": 0.4, "q2": None})
    assert b.turnover == pytest.approx(0.5 * (1.5 + 0.5 + 0.5 + 0.5)) and c.quantile_returns == {"q1": None, "q2": 0.1} and c.long_short_return is None


def test_modes_go_in_their_order(spark):
    R = alpha.Run
    runs = [R("p", "m"), R("w", "m", factor_weights=True), R("f", "m", multi_factor=True, factor_weights=True), R("c", "m", factor_weights=True, pipeline=True)]
    assert [alpha.ranked_by(r) for r in runs] == ["m", "composite_alpha_score", "multi_factor_alpha", "composite_alpha_score"]
    rows = [(day(0), "A", 0.1, 0.9, 0.2, -1.0), (day(0), "B", 0.2, None, 0.2, 1.0)]
    d = spark.createDataFrame(rows, "date date, symbol string, m double, composite_alpha_score double, multi_factor_alpha double, composite_alpha_score_cleaned double")
    got = sorted((r.run, r.symbol, r.rank, r.weight) for r in alpha.targets(alpha.scored(d, runs), 1, 0.6).collect())
    # a tie goes to the smaller symbol; B has no composite and is not ranked by another score instead
    assert got == [("c", "B", 1, 0.6), ("f", "A", 1, 0.6), ("p", "B", 1, 0.6), ("w", "A", 1, 0.6)]
    assert sorted(r.symbol for r in alpha.scored(d, runs).filter("run = 'w'").collect()) == ["A"]


def test_rankings(spark):
    names = "factor_name string, ic double, rank_ic double, icir double, coverage double, consistency double, n_dates long, cumulative double, sharpe double, fall double"
    m = spark.createDataFrame([("a", 0.5, 0.5, 1.0, 1.0, 1.0, 60, 2.0, 2.0, -0.1), ("b", 0.5, 0.5, 1.0, 0.2, 1.0, 60, 2.0, 2.0, -0.1), ("c", *[None] * 9), ("d", 0.5, 0.5, 1.0, 1.0, 1.0, 60, 2.0, 2.0, -0.1)], names)
    folds = spark.createDataFrame([("a", 1.0, 2), ("d", 1.0, 2)], "factor_name string, walk_forward_sharpe double, n_folds long")
    got = {r.factor_name: r for r in scores.ranked_factors(m, folds).collect()}
    assert got["a"].rank_score == pytest.approx((0.75 + 0.75 + 1 + 1 + 1 + 1 + 1 + 0.9) / 8) and (got["a"].grade, got["a"].n_folds) == ("candidate", 2)
    assert (got["b"].grade, got["b"].blocking, got["b"].n_folds) == ("blocked_by_coverage", "LOW_FACTOR_COVERAGE", 0)
    # a metric that is not there counts for confidence alone, which is then zero
    assert got["c"].rank_score == pytest.approx(0.5) and [k for k, r in sorted(got.items(), key=lambda x: x[1].place)] == ["d", "a", "b", "c"]


def test_fold_sharpe(spark):
    rets = [0.1, 0.2, 0.3, None, 0.1, 0.1]
    d = spark.createDataFrame([("f", day(k), r) for k, r in enumerate(rets)], "factor_name string, date date, ret double")
    folds = spark.createDataFrame([(0, day(0), day(2)), (1, day(3), day(5)), (2, day(90), day(99))], "fold int, test_start date, test_end date")
    r = scores.fold_sharpe(d, folds, ["factor_name"]).first()
    assert r.n_folds == 1 and r.walk_forward_sharpe == pytest.approx(0.2 / 0.1 * 252**0.5)


def test_calendar_without_a_month(spark):
    d = spark.createDataFrame([("a", dt.date(2020, 1, 5), 0.1), ("a", dt.date(2020, 1, 9), 0.1), ("a", dt.date(2020, 4, 1), -0.5), ("b", dt.date(2020, 3, 1), 0.2)], "run string, date date, ret double")
    got = sorted((r.run, r.period.month, round(r.ret, 6)) for r in evaluation.by_calendar(d, "month").collect())
    assert got == [("a", 1, 0.21), ("a", 2, 0.0), ("a", 3, 0.0), ("a", 4, -0.5), ("b", 3, 0.2)]
    assert sorted(round(r.ret, 6) for r in series.calendar(d.filter("run = 'a'"), "month").collect()) == [-0.5, 0.0, 0.0, 0.21]


def test_few_days_of_a_regime_warn(spark):
    d = spark.createDataFrame([("BULL", 29), ("BEAR", 30), ("UNKNOWN", 15)], "regime string, n long")
    assert [(r.code, r.regime, r.n) for r in store.regime_warnings(d).orderBy("regime").collect()] == [("WARN_LOW_REGIME_SAMPLE", "BULL", 29), ("WARN_HIGH_UNKNOWN_REGIME_RATIO", "UNKNOWN", 15)]


def test_own_factor(spark):
    own = factors.Factor("range_3d", "volatility", 3, -1)
    frame = lambda: factors.by_symbol().rowsBetween(-2, 0)
    factors.register(own, lambda: F.max("high").over(frame()) / F.min("low").over(frame()) - 1)
    try:
        with pytest.raises(ValueError):
            factors.register(own, lambda: F.lit(1.0))
        bars = spark.createDataFrame([(s, day(k), 10.0 + k, 11.0 + k + (s == "B"), 9.0) for s in "AB" for k in range(8)], "symbol string, date date, close double, high double, low double")
        d = factors.price_factors(bars, ["range_3d", "reversal_5d"])
        assert {(r.symbol, round(r.range_3d, 6)) for r in d.filter(d.date == day(7)).collect()} == {("A", 1.0), ("B", round(19 / 9 - 1, 6))}
        ic = evaluate.daily_ic(evaluate.observations(d, "range_3d", [1], factors.REGISTRY["range_3d"].sign))
        assert ic.count() == 7
    finally:
        factors.unregister("range_3d")
    assert "range_3d" not in factors.REGISTRY
    for name, wrong in (("momentum_20d", own), ("No Name", own), ("x", factors.Factor("x", "f", 1, 2))):
        with pytest.raises(ValueError):
            factors.register(factors.Factor(name, "f", 1, wrong.sign), lambda: F.lit(1.0), replace=True)
    with pytest.raises(ValueError):
        factors.unregister("momentum_20d")


def test_recent_covariance(spark):
    r = random.Random(5)
    days = [day(k) for k in range(40)]
    closes = {s: {d: 100 * math.exp(r.gauss(0, 0.1)) for d in days if r.random() > 0.1} for s in "ABC"} | {"D": {d: 1.0 for d in days[-3:]}}
    bars = spark.createDataFrame([(s, d, c) for s, m in closes.items() for d, c in m.items()] + [("A", day(99), 1.0), ("B", None, 2.0)], "symbol string, date date, close double")
    got = {(x.a, x.b): x.cov for x in markets.recent_covariance(bars, str(days[-1]), lookback=15, shrink=0.25).collect()}
    rets = {}
    for s in "ABC":  # D is too short
        ordered = sorted(closes[s])
        rets[s] = dict([(b, closes[s][b] / closes[s][a] - 1) for a, b in zip(ordered, ordered[1:])][-15:])
    common = sorted(set.intersection(*map(set, rets.values())))
    assert len(common) > 2 and set(got) == {(a, b) for a in "ABC" for b in "ABC"}
    for (a, b), cov in got.items():
        want = statistics.covariance([rets[a][d] for d in common], [rets[b][d] for d in common])
        assert cov == pytest.approx(want * (1 if a == b else 0.75))


def test_history_of_text(spark):
    d = spark.createDataFrame([("A", "1.5"), ("A", "-2"), ("A", "0"), ("A", "x"), ("A", None), ("A", "NaN"), ("A", "")], "symbol string, close string")
    assert sorted(r.close for r in panel.numeric_history(d).collect()) == [-2.0, 0.0, 1.5]
