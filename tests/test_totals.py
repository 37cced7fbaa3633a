"""Published-style totals on the derived fixture (FIXTURES part C)."""
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from dunning.operators import metrics as M
from dunning.operators.enrich import enrich
from dunning.operators.strategies import evaluate, results
from dunning.sources.fixtures import load_inputs


@pytest.fixture(scope="module")
def wide(spark):
    inp = load_inputs(spark, SF_SMALL)
    return evaluate(enrich(inp.transactions, inp.customers, inp.invoices)).cache()


def test_part_c_totals(wide):
    s = {r["strategy"]: r for r in M.strategy_summary(results(wide)).collect()}
    expect = {"baseline": (441, 5398288.03, 1349, 0.8993), "rules": (763, 9277774.39, 39360, 1.4127),
              "optimizer": (979, 12072663.14, 53456, 1.6280)}
    for k, (n, rev, cost, avg) in expect.items():
        assert s[k]["transactions_recovered"] == n
        assert s[k]["revenue_recovered"] == pytest.approx(rev, abs=0.005)
        assert s[k]["operational_cost"] == cost
        assert s[k]["avg_attempts_per_tx"] == pytest.approx(avg, abs=5e-5)


def test_decision_changes(wide):
    assert M.decision_changes(wide).first()["decision_changes_count"] == 1181


def test_final_action_mix(wide):
    r = results(wide)
    got = {(x["strategy"], x["final_action"]): x["count"] for x in r.groupBy("strategy", "final_action").count().collect()}
    assert got[("optimizer", "schedule_retry")] == 526 and got[("optimizer", "escalate_to_human")] == 521
    assert got[("rules", "stop_recovery")] == 352 and got[("baseline", "stop_recovery")] == 151


def test_properties(wide):
    """The five consequences of the rule tables."""
    o = wide.select("transaction_id", "amount", "risk_flag", "preference", "optimizer", "rules")
    bad = o.where(~F.col("optimizer.recovery_status_after").isin("RECOVERED", "ESCALATED")).count()
    assert bad == 0
    for s in ("optimizer", "rules"):
        assert o.where(F.col(f"{s}.execution_count") > 3).count() == 0
        assert o.where(F.col(f"{s}.automated_attempts") > 2).count() == 0
        hv = o.where((F.col("amount") >= 25000) | F.col("risk_flag"))
        assert hv.where((F.col(f"{s}.execution_count") != 1) | (F.col(f"{s}.final_action") != "escalate_to_human")
                        | (F.col(f"{s}.amount_recovered") != 0)).count() == 0
        assert o.where((F.col(f"{s}.amount_recovered") != 0) & (F.col(f"{s}.amount_recovered") != F.col("amount"))
                       ).count() == 0
        contacted = o.select("preference", F.explode(f"{s}.trail").alias("t")).where(
            (F.col("preference") == "none") & F.col("t.final_action").isin("send_payment_reminder", "create_payment_link"))
        assert contacted.count() == 0
        dup = o.select(F.col(f"{s}.trail.final_action").alias("a")).where(
            F.size(F.array_distinct("a")) != F.size("a"))
        assert dup.count() == 0
