import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()
SOME = ["flagship_ic", "factor_momentum_60d", "asof_fundamentals", "quintile_returns", "backtest_turnover", "regime_classify", "alpha_targets", "research_ranking", "return_quality", "strategy_warnings", "execution_batches", "universe_filter", "alpha_eligibility", "multi_factor_scores", "factor_scorecard", "store_rank", "rebalance_plan", "fundamental_merge", "event_bars", "matrix_cache_growth", "store_upsert_runs", "covariance_matrix", "covariance_tiles", "factors_in_buckets", "asof_in_buckets", "rank_ic_wide", "quantiles_wide", "statements_csv", "regime_asof_join", "strategy_problems", "strategy_gates", "strategy_status", "validation_run", "matrix_ordered", "symbol_versions", "symbols_by_sector", "sector_closes_as_of", "restated_stream", "backtest_legs", "strategy_evaluation", "strategy_attribution", "strategy_evaluation_accounts", "account_attribution", "account_calendar", "factor_rankings", "alpha_modes", "history_normalised", "covariance_recent", "pipeline_scores", "rebalance_plan", "strategy_calendar"]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    text = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    assert text(df.select(*cols).collect()) == text(con.execute(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall())
