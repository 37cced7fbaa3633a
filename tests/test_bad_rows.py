"""Invalid and finished transactions are reported, not decided."""
from dunning.operators import metrics as M
from dunning.operators import state as ST
from dunning.operators.strategies import evaluate, results
from helpers import cust, enriched, tx


def test_invalid_and_finished_rows(spark):
    rows = [tx("NUL", None, "BANK_TIMEOUT"), tx("NEG", -500, "BANK_TIMEOUT"), tx("RET", 100, "BANK_TIMEOUT", retry=-1),
            tx("REC", 100, "BANK_TIMEOUT", rec="RECOVERED"), tx("LEG", 100, "BANK_TIMEOUT", rec="success"),
            tx("OK", 100, "BANK_TIMEOUT", u_bp=0), tx("TWO", 100, "BANK_TIMEOUT", retry=2, u_bp=0)]
    wide = evaluate(enriched(spark, rows, [cust()]))
    got = {(r["strategy"], r["transaction_id"]): r for r in results(wide).collect()}
    for s in ("baseline", "rules", "optimizer"):
        for t, reason in (("NUL", "Invalid transaction amount: None."), ("NEG", "Invalid transaction amount: -500.0."),
                          ("RET", "Invalid retry count: -1.")):
            r = got[s, t]
            assert (r["status"], r["final_action"], r["description"]) == ("ERROR", None, reason)
            assert r["amount_recovered"] == 0 and r["execution_count"] == 0
        for t in ("REC", "LEG"):
            assert got[s, t]["status"] == "SKIPPED" and got[s, t]["final_action"] is None
        for t in ("OK", "TWO"):
            assert got[s, t]["status"] == "SUCCESS"
    after = {r["transaction_id"]: r["recovery_status"] for r in ST.snapshot_after(wide, "optimizer").collect()}
    assert after["REC"] == "RECOVERED" and after["LEG"] == "success" and after["OK"] == "RECOVERED" and after["NEG"] == "UNRECOVERED"
    total = {r["strategy"]: r for r in M.strategy_summary(results(wide)).collect()}
    assert all(r["revenue_at_risk"] == 500.0 - 100.0 for r in total.values())  # RET is left out, too
    gates = {r["transaction_id"]: r["gate_status"] for r in ST.gate(enriched(spark, rows, [cust()])).collect()}
    assert gates["NUL"] == "INVALID" and gates["REC"] == "ALREADY_RECOVERED" and gates["OK"] == "PENDING"
