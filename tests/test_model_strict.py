"""Model responses: strict JSON, the latest of several, and a cause that re-ranks."""
from pyspark.sql import functions as F

from dunning.functions.diagnosis import with_parsed
from dunning.operators import model_io as MI
from dunning.operators.strategies import evaluate
from helpers import cust, enriched, tx

GOOD = ('{"root_cause": "%s", "confidence": 0.5, "recommended_action": "retry_payment", "reason": "a", '
        '"why_not_alternatives": "b"}')


def test_strictness(spark):
    ok = GOOD % "insufficient_funds"
    texts = {ok: True, f"\n```json\n{ok}\n```\n": True, f"\t {ok} ": True, ok.replace('"', "'"): False, ok + " more": False,
             ok + ok: False, ok.replace('"a"', "5"): False, "[1]": False, "": False, "{": False, ok.replace("0.5", "null"): False}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r[0]: r[1] for r in with_parsed(df, "t", "p").select("t", "p.valid").collect()}
    assert got == texts


def test_latest_response_and_changed_cause(spark):
    e = enriched(spark, [tx("A", 100, "BANK_TIMEOUT"), tx("B", 100, "BANK_TIMEOUT")], [cust()])
    answers = spark.createDataFrame(
        [("A", 1, 2, GOOD % "expired_card"), ("A", 1, 1, "zzz"), ("A", 2, 1, GOOD % "insufficient_funds")],
        "transaction_id string, attempt_no int, recorded_seq int, response_text string")
    wide = evaluate(MI.attach_responses(e, answers), model=True, which=("optimizer",))
    trail = {r["transaction_id"]: r["t"] for r in wide.select("transaction_id", F.col("optimizer.trail").alias("t")).collect()}
    assert [t["root_cause"] for t in trail["A"]] == ["expired_card", "insufficient_funds"]
    assert [t["diagnosis_source"] for t in trail["A"]] == ["model", "model"]
    assert {t["diagnosis_source"] for t in trail["B"]} == {"fallback"}
    changed = {r["diagnosis_source"]: r["cause_changed"] for r in MI.model_contribution(wide).collect()}
    assert changed["model"] == 2
