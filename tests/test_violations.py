"""Audit checks count planted violations (a zero means something)."""
from datetime import datetime
from decimal import Decimal as D

from dunning.operators import audit as AU
from dunning.schemas import AUDIT, CUSTOMERS
from helpers import TX_SCHEMA, cust, tx


def test_planted_violations(spark):
    t = spark.createDataFrame([tx("HV", 30000, "BANK_TIMEOUT"), tx("FR", 100, "BANK_TIMEOUT", cust="C2"),
                               tx("OO", 100, "BANK_TIMEOUT", cust="C3"), tx("DU", 100, "BANK_TIMEOUT")], TX_SCHEMA)
    c = spark.createDataFrame([cust(), cust("C2", flag=True), cust("C3", pref="none")], CUSTOMERS)

    def ex(tid, n, a):
        return ("s", tid, n, 4, datetime(2026, 1, 1), "execution", a, "APPROVED", "FAILURE", D("0"), None, 0)
    a = spark.createDataFrame([ex("HV", 1, "retry_payment"), ex("FR", 1, "retry_payment"),
                               ex("OO", 1, "send_payment_reminder"), ex("DU", 1, "retry_payment"),
                               ex("DU", 2, "retry_payment"), ex("DU", 3, "schedule_retry")], AUDIT)
    v = AU.policy_violations(a, t, c).first()
    assert (v["high_value"], v["fraud_flag"], v["opt_out"], v["duplicate"]) == (1, 1, 1, 1)
    s = AU.stopping_violations(a).first()
    assert s["stopping_rule_violations"] == 1 and s["max_automated_attempts"] == 3
