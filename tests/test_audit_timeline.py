"""The audit timeline holds every row, and numbers executions over all runs."""
from datetime import datetime
from decimal import Decimal as D

import duckdb

from conftest import SF_SMALL
from dunning.operators import audit as AU
from dunning.operators import views as VW
from dunning.schemas import AUDIT


def test_positions_over_runs(spark):
    def row(day, n, no, stage, action, result=None):
        return ("s", "T", n, no, datetime(2026, 1, day), stage, action, "APPROVED", result, D("0"), None, 0)
    rows = [row(2, 1, 4, "execution", "create_payment_link", "SUCCESS"), row(2, 1, 3, "policy_guardrail", "create_payment_link"),
            row(1, 2, 4, "execution", "schedule_retry", "FAILURE"), row(1, 1, 4, "execution", "retry_payment", "FAILURE")]
    got = VW.audit_timeline(AU.execution_attempt_numbers(spark.createDataFrame(rows, AUDIT))).collect()
    assert [(r.agent_action, r.stage, r.execution_no) for r in got] == [
        ("retry_payment", "execution", 1), ("schedule_retry", "execution", 2),
        ("create_payment_link", "policy_guardrail", None), ("create_payment_link", "execution", 3)]


def test_whole_trail(spark):
    import __spark_entry__ as E
    from tools.check_oracles import frame_hash
    con = duckdb.connect()
    for t in ["customer", "orders"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = E.queries()["audit_trail_timeline"](spark, SF_SMALL).toPandas()
    want = con.execute(E.oracle_sql()["audit_trail_timeline"]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert frame_hash(got) == frame_hash(want)
    assert (got["tool_result"] == "FAILURE").any() and set(got["stage"]) == {
        "risk_evaluation", "root_cause_analysis", "policy_guardrail", "execution"}
