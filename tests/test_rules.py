"""Hand-written cases (the reference's unit tests, as DataFrames)."""
from decimal import Decimal as D

from pyspark.sql import functions as F

from dunning.functions.erv import candidates, prepare
from dunning.functions.risk import risk
from dunning.operators.strategies import evaluate
from helpers import cust, enriched, inv, tx


def _risk(spark, txs, custs=(), invs=()):
    e = enriched(spark, txs, custs, invs)
    return {r["transaction_id"]: r["r"] for r in e.select(
        "transaction_id", risk(F.col("amount"), F.col("failure_code"), F.col("retry_count"), F.col("risk_rate"),
                               F.col("risk_flag"), F.col("days_overdue")).alias("r")).collect()}


def test_risk_cases(spark):
    r = _risk(spark, [tx("LOW", 1000, "BANK_TIMEOUT", cust="C1"),
                      tx("MED", 15000, "INSUFFICIENT_FUNDS", retry=1, cust="C2"),
                      tx("CRIT", 50000, "CARD_EXPIRED", retry=2, cust="C3"),
                      tx("NULL", None, None, retry=None, cust="NOPE"),
                      tx("NEG", -500, "BANK_TIMEOUT", retry=-2, cust="NOPE")],
              [cust("C1", rate=0.98), cust("C2", rate=0.85), cust("C3", rate=0.45, flag=True)],
              [inv("I2", "C2", days=5), inv("I3", "C3", days=35)])
    assert r["LOW"]["risk_level"] == "LOW" and 0 <= r["LOW"]["risk_score"] <= 30
    assert r["MED"]["risk_score"] == 37 and r["MED"]["risk_level"] == "MEDIUM"
    assert r["CRIT"]["risk_score"] == 100 and r["CRIT"]["risk_level"] == "CRITICAL"
    assert "Customer account has active fraud/risk flag" in r["CRIT"]["signals"]
    assert r["NULL"]["risk_score"] == 0 and r["NULL"]["risk_level"] == "LOW"
    assert r["NEG"]["risk_score"] == 5


def test_documented_case_score(spark):
    r = _risk(spark, [tx("TX14", "11094.49", "BANK_TIMEOUT")], [cust("C1", rate=0.85)])
    assert r["TX14"]["risk_score"] == 17 and r["TX14"]["risk_level"] == "LOW"


def _cands(spark, amount, code, rate=0.85, ltv=0):
    e = prepare(enriched(spark, [tx("T", amount, code)], [cust("C1", rate=rate, ltv=ltv)]))
    row = e.select(candidates(e).alias("c")).first()["c"]
    return {c["action"]: c for c in row}


def test_erv_values(spark):
    c = _cands(spark, 10000, "BANK_TIMEOUT")
    assert c["retry_payment"]["probability"] == D("0.70") and c["retry_payment"]["expected_net"] == D("6999.00")
    assert c["escalate_to_human"]["probability"] == D("0.80") and c["escalate_to_human"]["expected_net"] == D("7900.00")
    assert len(c) == 7
    assert _cands(spark, 0, "BANK_TIMEOUT")["retry_payment"]["expected_net"] == D("-1.00")
    z = _cands(spark, 1000, "CARD_EXPIRED")["retry_payment"]
    assert z["probability"] == D("0.00") and z["expected_net"] == D("-1.00")
    assert _cands(spark, 100000, "BANK_TIMEOUT", ltv=60000)["escalate_to_human"]["probability"] == D("0.95")
    assert _cands(spark, 5, "INSUFFICIENT_FUNDS", rate=0.60)["escalate_to_human"]["expected_net"] == D("-96.00")
    s = _cands(spark, 5000, "BANK_TIMEOUT")["stop_recovery"]
    assert (s["probability"], s["cost"], s["expected_net"]) == (D("0.00"), D("0.0"), D("0.00"))


def _first(spark, txs, custs, strategy="optimizer"):
    w = evaluate(enriched(spark, txs, custs), which=(strategy,))
    return {r["transaction_id"]: r[strategy] for r in w.select("transaction_id", strategy).collect()}


def test_best_action_and_policy(spark):
    r = _first(spark, [tx("INS", 5000, "INSUFFICIENT_FUNDS", u_bp=0), tx("HV", 35000, "BANK_TIMEOUT", cust="C2"),
                       tx("OPT", 1000, "INSUFFICIENT_FUNDS", cust="C3")],
               [cust("C1", rate=0.85), cust("C2"), cust("C3", pref="none")])
    assert r["INS"]["trail"][0]["recommended_action"] == "create_payment_link"
    assert r["INS"]["trail"][0]["expected_net"] == D("3248.00")
    assert r["HV"]["final_action"] == "escalate_to_human" and r["HV"]["policy_result"] == "ESCALATE"
    assert r["HV"]["execution_count"] == 1 and r["HV"]["amount_recovered"] == 0
    assert r["OPT"]["trail"][0]["recommended_action"] not in ("send_payment_reminder", "create_payment_link")


def test_rules_flows(spark):
    r = _first(spark, [tx("OK", 1500, "BANK_TIMEOUT", u_bp=0), tx("LOSE", 1000, "BANK_TIMEOUT", cust="C2"),
                       tx("OPTOUT", 1000, "INSUFFICIENT_FUNDS", cust="C3"),
                       tx("EXP", 1000, "CARD_EXPIRED", cust="C2")],
               [cust("C1", rate=0.85), cust("C2"), cust("C3", pref="none")], strategy="rules")
    ok = r["OK"]
    assert (ok["final_action"], ok["status"], ok["recovery_status_after"], ok["amount_recovered"]) == \
        ("retry_payment", "SUCCESS", "RECOVERED", D("1500.00"))
    lose = r["LOSE"]
    assert [t["final_action"] for t in lose["trail"]] == ["retry_payment", "create_payment_link"]
    assert lose["final_action"] == "escalate_to_human" and lose["execution_count"] == 3
    assert lose["automated_attempts"] == 2 and lose["status"] == "FAILURE"
    assert r["OPTOUT"]["final_action"] == "stop_recovery" and r["OPTOUT"]["trail"][0]["policy_rule"] == \
        "COMMUNICATION_OPT_OUT"
    # expired card: link, then the same link again is a duplicate -> stop
    assert [t["policy_rule"] for t in r["EXP"]["trail"]] == ["POLICY_APPROVED", "DUPLICATE_ACTION"]
    assert r["EXP"]["final_action"] == "stop_recovery"


def test_rerun_skips_terminal(spark):
    from dunning.operators.enrich import enrich
    from dunning.schemas import AUDIT
    from helpers import TX_SCHEMA
    from dunning.schemas import CUSTOMERS, INVOICES
    t = spark.createDataFrame([tx("T1", 1000, "BANK_TIMEOUT")], TX_SCHEMA)
    c = spark.createDataFrame([cust()], CUSTOMERS)
    i = spark.createDataFrame([], INVOICES)
    from datetime import datetime
    prior = spark.createDataFrame([
        ("p", "T1", n, 4, datetime(2026, 1, 1), "execution", a, "APPROVED", "FAILURE", D("0"), None, 0)
        for n, a in [(1, "retry_payment"), (2, "create_payment_link"), (3, "escalate_to_human")]], AUDIT)
    w = evaluate(enrich(t, c, i, prior_audit=prior), which=("rules",))
    r = w.select("rules").first()["rules"]
    assert r["status"] == "SKIPPED" and r["execution_count"] == 3
