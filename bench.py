"""Times the headline queries and the daily and wide panels; prints one JSON line.

The weekly panel of brands hardly grows with the tables, so the flagship (information coefficients of
20-day momentum) is also timed over daily bars of brands and over weekly bars of suppliers (ten times as
many symbols), read from a table that is written once, as a user would keep bars; and the same figures are
computed with pandas and NumPy from the same files on one core, side by side.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from quantloom.operators import evaluate
from quantloom.operators.factors import price_factors
from quantloom.plans import catalog
from quantloom.sources import panel

HEADLINE = ["flagship_ic", "ic_decay_momentum", "factor_quality_price_proxy", "factor_fundamental_composite_score", "quintile_returns", "backtest_summary", "backtest_turnover", "pipeline_stages", "composite_score", "regime_classify", "covariance_matrix", "cost_estimate", "walk_forward_ic", "data_quality", "sma_backtest"]
PANELS = {"daily": {"unit": "day"}, "wide": {"symbol": "l_suppkey", "unit": "week"}}


def timed(run, times: int) -> float:
    """Median of some runs, after one that warms up."""
    took = []
    for _ in range(times + 1):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return round(statistics.median(took[1:]), 3)


def flagship(bars):
    return evaluate.ic_summary(evaluate.daily_ic(evaluate.observations(price_factors(bars, ["momentum_20d"]), "momentum_20d", [20])))


def plain_flagship(folder: str) -> tuple[float, float]:
    """Mean IC and mean rank IC with pandas and NumPy."""
    d = pd.read_parquet(folder, columns=["symbol", "date", "close"]).sort_values(["symbol", "date"])
    close = d.groupby("symbol")["close"]
    d["x"], d["y"] = d["close"] / close.shift(20) - 1, close.shift(-20) / d["close"] - 1
    d = d.dropna()
    ics, ranks = [], []
    for _, g in d.groupby("date"):
        x, y = g["x"].to_numpy(), g["y"].to_numpy()
        if len(x) > 1 and x.std() > 0 and y.std() > 0:
            ics.append(np.corrcoef(x, y)[0, 1])
            ranks.append(np.corrcoef(g["x"].rank(), g["y"].rank())[0, 1])
    return float(np.mean(ics)), float(np.mean(ranks))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    run = catalog.queries()
    took = {name: timed(lambda name=name: run[name](spark, sf).write.format("noop").mode("overwrite").save(), 1) for name in HEADLINE}
    beside, rows, gap = {}, {}, 0.0
    with tempfile.TemporaryDirectory() as folder:
        for name, kind in PANELS.items():
            at = f"{folder}/{name}"
            took[f"write_bars_{name}"] = timed(lambda at=at, kind=kind: panel.clean(panel.bars(spark, sf, **kind)).select("symbol", "date", "close").write.mode("overwrite").parquet(at), 1)
            bars = spark.read.parquet(at)
            rows[name] = bars.count()
            took[f"flagship_ic_{name}"] = timed(lambda bars=bars: flagship(bars).collect(), 5)
            beside[f"flagship_ic_{name}"] = timed(lambda at=at: plain_flagship(at), 5)
            ours, plain = flagship(bars).first(), plain_flagship(at)
            gap = max(gap, abs(ours.ic_mean - plain[0]), abs(ours.rank_ic_mean - plain[1]))
    print(json.dumps({"metric": "headline_queries_warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "pandas_one_core": beside, "panel_rows": rows, "largest_difference": gap}))
    spark.stop()


if __name__ == "__main__":
    main()
