"""Registered queries equal their DuckDB oracles on the smallest fixture."""
import os

import duckdb
import pytest

from conftest import SF_SMALL

FAST = ["customers_scan", "transactions_scan", "invoices_scan", "enriched", "erv_candidates", "risk_scores",
        "risk_signals", "baseline_results", "rules_results", "optimizer_results", "strategy_summary", "audit_scan",
        "kpis", "batch_resume", "history", "validation_report", "erv_ranked", "distributions", "policy_violations",
        "transaction_360", "edge_results", "edge_state", "edge_360", "stream_two_runs", "stream_attempt_state",
        "stage_latency_nulls", "run_overwrite", "audit_append", "prompt_requests", "response_valid", "outcome_join",
        "diagnosed", "model_contribution", "stream_diagnosed", "ordered_history", "stored_360", "observed_run", "csv_quarantine", "trail_positions", "audit_trail_timeline", "stored_pairs", "pending_batch", "filtered_head", "audit_timeline"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["customer", "orders"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    import __spark_entry__ as E
    from check_oracles import frame_hash
    s = E.queries()[name](spark, SF_SMALL).toPandas()
    o = con.execute(E.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert len(s) == len(o)
    assert frame_hash(s) == frame_hash(o)


def test_entry_runs(spark):
    import __spark_entry__ as E
    rows = E.entry(spark).collect()
    assert len(rows) == 3
