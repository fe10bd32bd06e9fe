"""What SQL cannot say, against plain versions; sources, sinks and the small helpers."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions.columns import finite
from quantloom.operators import crosssection, markets, multifactor, portfolio, scores, series, store, universe
from quantloom.operators.factors import FUNDAMENTAL, PRICE
from quantloom.sources import panel, registry, reports, statements
from quantloom.streaming.bars import streaming_bars


def cov_rows(spark, c, names):
    return spark.createDataFrame([("all", a, b, float(c[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], "run string, a string, b string, cov double")


def test_optimisers_meet_their_conditions(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (200, 5)) * [1, 2, 3, 1.5, 0.7] + rng.normal(0, 0.8, (200, 1))
    c, names = np.cov(x.T), list("ABCDE")
    rows = cov_rows(spark, c, names)
    got = {m: np.array([r.weight for r in sorted(markets.optimise(rows, m).collect(), key=lambda r: r.symbol)]) for m in ("equal", "risk_adjusted", "min_variance", "risk_parity")}
    assert all(abs(w.sum() - 1) < 1e-5 and (w >= 0).all() for w in got.values())
    assert np.allclose(got["equal"], 0.2)
    inverse = 1 / np.sqrt(np.diag(c))
    assert np.allclose(got["risk_adjusted"], inverse / inverse.sum(), atol=1e-6)
    share = got["risk_parity"] * (c @ got["risk_parity"])
    assert np.abs(share / share.sum() - 0.2).max() < 0.012
    # without short positions to cut, least variance has equal gradients; else no better mix is near
    free = np.linalg.solve(c, np.ones(5))
    free = np.clip(free / free.sum(), 0, None)
    assert np.allclose(got["min_variance"], free / free.sum(), atol=1e-5)
    with pytest.raises(ValueError):
        markets.optimise(rows, "other")


def test_simulation_equals_a_plain_account(spark):
    rng = random.Random(2)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(40)]
    price = {(d, s): round(20 + 5 * i + 3 * math.sin(k / 5 + i) + rng.random(), 4) for k, d in enumerate(days) for i, s in enumerate("XYZ") if not (s == "Z" and k % 9 == 4)}
    targets = {days[k]: {s: round(rng.random() / 3, 3) for s in "XYZ"} for k in range(0, 36, 6)}
    t = spark.createDataFrame([("r", d, s, w) for d, ws in targets.items() for s, w in ws.items()], "run string, date date, symbol string, weight double")
    p = spark.createDataFrame([(d, s, x) for (d, s), x in price.items()], "date date, symbol string, close double")
    got = {r.date: r for r in markets.simulate(t, p, 10_000.0, 0.002).collect()}
    cash, held, last, due = 10_000.0, {}, {}, None
    for d in days:
        here = {s: price[d, s] for s in "XYZ" if (d, s) in price}
        last.update(here)
        cost = 0.0
        if due:
            worth = cash + sum(q * last[s] for s, q in held.items())
            goal = {s: int(worth * w // here[s]) for s, w in due.items() if s in here}
            for s in sorted({*held, *goal}):
                drop = held.get(s, 0) - goal.get(s, 0)
                if s in here and drop > 0:
                    cash, cost, held[s] = cash + drop * here[s] * 0.998, cost + drop * here[s] * 0.002, held[s] - drop
            for s in sorted(goal):
                add = min(goal[s] - held.get(s, 0), int(cash // (here[s] * 1.002)))
                if add > 0:
                    cash, cost, held[s] = cash - add * here[s] * 1.002, cost + add * here[s] * 0.002, held.get(s, 0) + add
            held = {s: q for s, q in held.items() if q}
        due = {s: w for s, w in targets.get(d, {}).items() if s in here}
        assert got[d].cash == pytest.approx(cash, abs=1e-6) and got[d].cost == pytest.approx(cost, abs=1e-6)
        assert got[d].equity == pytest.approx(cash + sum(q * last[s] for s, q in held.items()), abs=1e-6) and got[d].n_positions == len(held)


def test_sma_backtest_equals_a_plain_account(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(160)]
    close = {s: [50 + 10 * math.sin(k / (6 + i)) + 0.02 * k for k in range(160)] for i, s in enumerate("AB")}
    b = spark.createDataFrame([(s, d, c) for s, cs in close.items() for d, c in zip(days, cs)], "symbol string, date date, close double")
    got = {r.symbol: r for r in markets.sma_backtest(markets.sma_signals(b, 5, 20), 1000.0).collect()}
    for s, cs in close.items():
        cash, qty, n = 1000.0, 0, 0
        mean = lambda k, m: sum(cs[k - m + 1:k + 1]) / m if k >= m - 1 else None  # noqa: E731, B023
        for k in range(20, 160):
            a, z, pa, pz = mean(k, 5), mean(k, 20), mean(k - 1, 5), mean(k - 1, 20)
            if pa <= pz and a > z and not qty and cash >= cs[k]:
                qty = int(cash // cs[k])
                cash, n = cash - qty * cs[k], n + 1
            elif pa >= pz and a < z and qty:
                cash, qty, n = cash + qty * cs[k], 0, n + 1
        assert (got[s].position, got[s].trades) == (qty, n) and n > 3
        assert got[s].final_value == pytest.approx(cash + qty * cs[-1])


def test_ledger_rejects_what_cannot_be_paid(spark):
    rows = [("a", 1, "X", "BUY", 10.0, 5.0), ("a", 2, "X", "BUY", 10.0, 7.0), ("a", 3, "Y", "BUY", 1.0, 1000.0), ("a", 4, "X", "SELL", 5.0, 8.0), ("a", 5, "Y", "SELL", 1.0, 1.0), ("b", 1, "X", "BUY", 2.0, 3.0), ("b", 2, "X", "SELL", 2.0, 4.0)]
    t = spark.createDataFrame(rows[::-1], "account string, ord int, symbol string, side string, shares double, price double")
    got = {r.account: r for r in portfolio.ledger(t, 200.0).collect()}
    assert (got["a"].symbol, got["a"].qty, got["a"].avg_cost, got["a"].cash, got["a"].rejected) == ("X", 15.0, 6.0, 120.0, 2)
    assert (got["b"].symbol, got["b"].qty, got["b"].cash, got["b"].rejected) == (None, 0.0, 202.0, 0)


def test_ledger_reads_an_account_in_a_stream(spark):
    rows = [(a, k, "XYZ"[k % 3], "SELL" if k % 4 == 3 else "BUY", float(k % 5 + 1), None if k == 6 else float(k % 11 + 1)) for a in ("a", "b", None) for k in range(60)]
    t = spark.createDataFrame(random.Random(5).sample(rows, len(rows)), "account string, ord int, symbol string, side string, shares double, price double")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        got = {}
        for size in ("1000", "7"):  # an account in one batch, and in many
            spark.conf.set(name, size)
            out = portfolio.ledger(t, 500.0)
            got[size] = sorted(map(str, out.collect()))
        assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    money, held, rejected = 500.0, {}, 0
    for _, _, s, side, n, p in rows[:60]:
        q, c = held.get(s, (0.0, 0.0))
        if p is not None and side == "BUY" and n * p <= money:
            money, held[s] = money - n * p, (q + n, (q * c + n * p) / (q + n))
        elif p is not None and side == "SELL" and q >= n:
            money, held[s] = money + n * p, (q - n, c)
        else:
            rejected += 1
    assert got["7"] == got["1000"] and len(got["7"]) == 3 * sum(q > 0 for q, _ in held.values())
    b = {r.symbol: r for r in out.filter("account = 'b'").collect()}
    assert {s: (r.qty, r.avg_cost, r.cash, r.rejected) for s, r in b.items()} == {s: (q, c, money, rejected) for s, (q, c) in held.items() if q > 0}


def test_rebalance_scales_buys_to_the_cash(spark):
    held = spark.createDataFrame([("A", 10.0), ("B", 0.5)], "symbol string, qty double")
    px = spark.createDataFrame([("A", 10.0), ("B", 20.0), ("C", 7.0)], "symbol string, price double")
    plan = {r.symbol: r for r in portfolio.rebalance(held, spark.createDataFrame([("A", 0.1), ("C", 0.9), ("cash", 0.0)], "symbol string, target_weight double"), px, 50.0).collect()}
    assert plan["A"].action == "SELL" and plan["C"].action == "BUY" and plan["B"].action == "HOLD"
    assert plan["C"].cash_after >= -7.0 and plan["A"].shares == 8
    assert portfolio.reconcile(spark.createDataFrame([("x", 1.0, 3.0), ("y", 1.0, 1.0)], "account string, cash double, equity double"), spark.createDataFrame([("x", 1.0)], "account string, market_value double")).collect()[0].account == "x"


def test_statement_import(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    head = "Symbol,Fiscal Period-End,report_date,fiscal_year,fiscal_quarter,currency,statement_type,revenue,pe_ratio\n"
    good = write("good.csv", head + 'aapl ,2023-12-31,2024-02-01,2023,q4,usd,income,"1,234.5",\nmsft,2023-12-31,2024-01-30,2023,Q4,,metrics,,30\n')
    got = statements.read_csv(spark, good)
    a, m = got["income_statement"].collect()[0], got["fundamental_metrics"].collect()[0]
    assert (a.symbol, a.fiscal_quarter, a.currency, a.revenue, a.report_date) == ("AAPL", "Q4", "USD", 1234.5, dt.date(2024, 2, 1)) and (m.symbol, m.currency, m.pe_ratio) == ("MSFT", None, 30.0)
    assert got["balance_sheet"].count() == 0
    for row, why in ((",2023-12-31,2024-02-01,2023,Q4,USD,income,1,", "symbol"), ("A,2023-13-31,2024-02-01,2023,Q4,USD,income,1,", "invalid date"), ("A,2023-12-31,2024-02-01,2023,Q4,USD,income,x1,", "invalid numeric"), ("A,2023-12-31,2024-02-01,2023,Q4,USD,other,1,", "statement_type"), ("A,2023-12-31,2024-02-01,2023,Q4,USD,income,inf,", "invalid numeric")):
        with pytest.raises(ValueError, match=why):
            statements.read_csv(spark, write("bad.csv", head + row + "\n"))
    with pytest.raises(ValueError, match="missing required columns"):
        statements.read_csv(spark, write("few.csv", "symbol,revenue\nA,1\n"), "income")
    with pytest.raises(ValueError, match="unsupported"):
        statements.read_csv(spark, good, "nothing")
    odd = write("odd.csv", head.replace("pe_ratio", "market_cap,pe_ratoi") + "A,2023-12-31,2024-02-01,2023,Q4,USD,metrics,,5,6\n")
    with pytest.raises(ValueError, match="unknown columns: pe_ratoi"):
        statements.read_csv(spark, odd)
    assert statements.read_csv(spark, odd, ignore_unknown=True)["fundamental_metrics"].first().market_cap == 5.0


def test_merge_keeps_the_later_report(spark):
    row = "symbol string, fiscal_period_end date, fiscal_quarter string, report_date date, v int"
    at = dt.date
    old = spark.createDataFrame([("A", at(2023, 12, 31), "Q4", at(2024, 2, 1), 1), ("B", at(2023, 12, 31), "Q4", None, 2)], row)
    new = spark.createDataFrame([("A", at(2023, 12, 31), "Q4", at(2024, 1, 1), 9), ("B", at(2023, 12, 31), "Q4", at(2020, 1, 1), 8)], row)
    assert sorted((r.symbol, r.v) for r in statements.merge(old, new).collect()) == [("A", 1), ("B", 8)]
    assert sorted((r.symbol, r.v) for r in statements.merge(old, new, force=True).collect()) == [("A", 9), ("B", 8)]


def test_sources(spark, tmp_path):
    assert {"mock", "csv", "tables", "placeholder"} <= set(registry.names())
    m = registry.source(" Mock ")(spark, symbols=["A", "B"], days=30)
    rows = sorted((r.symbol, r.date, r.close) for r in m.collect())
    assert len(rows) == 60 and rows[0] == ("A", dt.date(2024, 1, 1), 100.0) and rows[29][2] == 129.0 and all(r[1].weekday() < 5 for r in rows)
    m.coalesce(1).write.option("header", True).csv(str(tmp_path / "bars"))
    read = registry.csv_first(spark, [str(tmp_path / "none"), str(tmp_path / "bars")], ["b"], "2024-01-02", "2024-01-05")
    assert [(r.symbol, r.close, r.volume) for r in read.orderBy("date").collect()] == [("B", 101.0 + k, 1000) for k in range(4)]
    assert registry.health(spark, "placeholder") == {"name": "placeholder", "ok": False, "message": "NotImplementedError: this source is a placeholder"}
    assert registry.health(spark, "mock")["ok"]
    with pytest.raises(ValueError):
        registry.register("mock", registry.placeholder)
    with pytest.raises(ValueError):
        registry.source("nowhere")
    frame, told = registry.load_timed(lambda: m)
    assert told["rows"] == 60 and told["seconds"] >= 0
    frames, made = registry.Frames(), []
    for _ in range(2):
        frames.get(("f", 20), lambda: made.append(1) or m)
    assert len(made) == 1
    frames.clear()
    frame.unpersist()


def test_sinks(spark, tmp_path):
    now = dt.datetime(2024, 5, 1, 12, 0, 0)
    a = reports.report_path(str(tmp_path / "r"), "ic", now)
    reports.write_report(a, {"x": float("nan"), "d": dt.date(2024, 1, 2), "rows": reports.rows(spark.createDataFrame([(1, "é")], "k int, s string"))})
    assert json.load(open(a, encoding="utf-8")) == {"x": None, "d": "2024-01-02", "rows": [{"k": 1, "s": "é"}]}
    assert reports.report_path(str(tmp_path / "r"), "ic", now).endswith("_1.json")
    with pytest.raises(ValueError):
        reports.rows(spark.range(11), 10)
    w = reports.write_targets(str(tmp_path / "t.json"), spark.createDataFrame([("A", 0.25), ("B", 0.5)], "symbol string, weight double"))
    assert json.load(open(w)) == {"A": 0.25, "B": 0.5, "cash": 0.25}
    store.append(spark.range(2), str(tmp_path / "h"))
    store.append(spark.range(3), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 5
    assert store.missing_keys(spark.range(4), spark.range(2), ["id"]).count() == 2


def test_stream_gives_the_bars_of_a_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"k{i % 2}", t0 + dt.timedelta(hours=5 * i), float(i % 7)) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streaming_bars(stream, "key", "ts", "value").writeStream.format("memory").queryName("bars_out").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("bars_out").collect())) == sorted(map(tuple, streaming_bars(df, "key", "ts", "value").collect()))


def test_small_helpers(spark):
    assert [r.x for r in spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("inf",), (None,)], "s string").select(finite("s").alias("x")).collect()] == [1.5, None, None, None, None]
    d = spark.createDataFrame([("d", "A"), ("d", "B")], "date string, symbol string")
    assert {r.weight for r in crosssection.equal_weights(d, cash=0.2).collect()} == {0.4}
    assert universe.select_factors("price", ["reversal_5d", "none"], 2) == ["reversal_5d", "growth_price_proxy"] and len(universe.select_factors()) == len(PRICE) + len(FUNDAMENTAL)
    asked = spark.createDataFrame([(0, " a"), (1, "B"), (2, "A "), (3, ""), (4, "c"), (5, None)], "ord int, symbol string")
    assert sorted((r.ord, r.symbol) for r in universe.normalise_symbols(asked, ["C"]).collect()) == [(0, "A"), (1, "B")]
    assert [r.ord for r in universe.dedupe_by(asked.filter("ord < 3").withColumn("k", F.upper(F.trim("symbol"))), ["k"], ["ord"]).orderBy("ord").collect()] == [0, 1]
    assert multifactor.family("low_volatility_score") == "LOW_VOL" and multifactor.family("volatility_20d") == "PRICE" and multifactor.family("fundamental_composite_score") == "QUALITY"
    assert multifactor.family_weights(["momentum_20d", "reversal_5d"], {"PRICE": -1.0}) == {"PRICE": 0.5, "REVERSAL": 0.5}
    assert markets.auto_purge(0, 0, 20) == 20 and markets.auto_purge(0, 3, 20) == 0
    day = dt.date(2020, 1, 1)
    folds = markets.windows(day, day + dt.timedelta(days=99), 30, 20, 5, 2)
    assert [f[0] for f in folds] == [0, 1, 2] and folds[1][1:] == tuple(day + dt.timedelta(days=k) for k in (20, 44, 52, 71)) and markets.windows(day, day, 30, 20) == []


def test_scorecard_and_warning_borders(spark):
    keys = ["ic", "rank_ic", "icir", "positive", "cumulative", "mean_spread", "sharpe", "fall", "hit", "turnover", "n_obs", "n_warnings", "fallback"]
    rows = [(0.05, 0.04, 0.6, 0.62, 3.5, 0.03, 2.0, -0.1, 0.65, 0.1, 900, 0, False), (0.05, 0.04, 0.6, 0.62, 3.5, 0.03, 2.0, -0.1, 0.65, 0.1, 900, 0, True), (0.001, 0.0, 0.6, 0.62, 3.5, 0.03, 2.0, -0.1, 0.65, 0.1, 900, 0, False), (0.05, 0.04, 0.6, 0.62, 0.5, 0.03, 2.0, -0.9, 0.65, 0.1, 900, 0, False), (None, None, None, None, None, None, None, None, None, None, 0, 9, False)]
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, ic double, rank_ic double, icir double, positive double, cumulative double, mean_spread double, sharpe double, fall double, hit double, turnover double, n_obs long, n_warnings int, fallback boolean")
    card = scores.scorecard({k: F.col(k) for k in keys})
    got = d.orderBy("k").select(*[c.alias(n) for n, c in card.items()]).collect()
    assert [r.status for r in got] == ["PASS", "WATCH", "REJECT", "REJECT", "ERROR"] and got[0].ic_score == got[0].return_score == 100.0 and got[0].quality_score == 80.0
    n = lambda x: F.lit(x).cast("double")
    codes = spark.range(1).select(scores.warnings(n(50), n(0.1), n(1), n(-0.1), n(0.5), n(0.01), n(1), n(1), cost_drag=n(-0.03), excess=n(-0.01)).alias("c")).first().c
    assert codes == ["HIGH_COST_DRAG", "BENCHMARK_UNDERPERFORMANCE"]
    span = series.drawdown_span(spark.createDataFrame([(dt.date(2024, 1, k + 1), r) for k, r in enumerate([0.1, -0.2, 0.05, -0.1, 0.5])], "date date, ret double")).first()
    assert (span.drawdown_start, span.drawdown_end, span.drawdown_days) == (dt.date(2024, 1, 1), dt.date(2024, 1, 4), 3)
    assert panel.latest_dates(spark.createDataFrame([("A", dt.date(2024, 1, 1))], "symbol string, date date"), spark.createDataFrame([("A",), ("B",)], "symbol string")).filter("last_date is null").count() == 1


def test_allocation_without_positions(spark):
    none, px = spark.createDataFrame([], "symbol string, qty double"), spark.createDataFrame([("A", 10.0)], "symbol string, price double")
    weights = lambda held, **kw: {r.symbol: r.current_weight for r in portfolio.allocation(held, px, 50.0, **kw).collect()}
    assert weights(none) == {"cash": 1.0} and weights(none, cash_alone=False) == {"cash": None}
    held = spark.createDataFrame([("A", 5.0), ("B", 1.0)], "symbol string, qty double")
    assert weights(held) == weights(held, cash_alone=False) == {"A": 0.5, "B": 0.0, "cash": 0.5}
    assert weights(held.filter("symbol = 'B'"), cash_alone=False) == {"B": None, "cash": None}


def whole_weeks(path):
    """A brand with a line in each of seven weeks: no position is left."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("create table part as select 1::bigint as p_partkey, 'Brand#11' as p_brand")
    con.execute("create table lineitem as select k::bigint as l_orderkey, 1::bigint as l_partkey, 1 as l_linenumber, 2.0::double as l_quantity, 90.0::double + k as l_extendedprice, timestamp '1996-01-01' + interval (k) week as l_shipdate from range(7) t(k)")
    for t in ("part", "lineitem"):
        con.execute(f"copy {t} to '{path}/{t}.parquet' (format parquet)")
    return con


def same_as_sql(spark, name, path):
    import __spark_entry__ as entry

    con = whole_weeks(path)
    df = entry.queries()[name](spark, str(path))
    text = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    want = con.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert want and text(df.collect()) == text(want)


def test_allocation_snapshot_without_positions_is_as_in_sql(spark, tmp_path):
    same_as_sql(spark, "allocation_snapshot", tmp_path)


def test_rebalance_plan_without_positions_is_as_in_sql(spark, tmp_path):
    same_as_sql(spark, "rebalance_plan", tmp_path)


def test_rebalance_from_cash_alone(spark):
    none, px = spark.createDataFrame([], "symbol string, qty double"), spark.createDataFrame([("A", 10.0)], "symbol string, price double")
    targets = spark.createDataFrame([("A", 0.5)], "symbol string, target_weight double")
    plan = lambda **kw: portfolio.rebalance(none, targets, px, 1000.0, **kw).collect()[0]
    assert (plan().action, plan().shares) == ("BUY", 49)
    r = plan(cash_alone=False)
    assert (r.action, r.shares, r.current_weight, r.target_value, r.difference, r.cash_after) == ("HOLD", 0, None, None, None, 1000.0)
