"""Streaming rounds of model answers: in time, late, never, and more than one."""
import datetime as dt

from dunning.operators.model_io import attach_responses
from dunning.streaming import model_stream as MS
from helpers import enriched, tx
from pyspark.sql import functions as F
from test_generated_code import largest_method

T0 = dt.datetime(2026, 1, 1, 12)


def test_answers_in_time(spark, tmp_path):
    sec = lambda s: T0 + dt.timedelta(seconds=s)
    requests = [("A", 1, sec(0)), ("B", 1, sec(1)), ("C", 1, sec(2)), ("D", 1, sec(3)), ("E", 2, sec(4))]
    told = [("A", 1, "first", sec(5)), ("A", 1, "second", sec(12)), ("B", 1, "late", sec(14)), ("C", 2, "other attempt", sec(3)),
            ("E", 2, "before it was asked", sec(3)), ("X", 1, "never asked", sec(2))]
    paths = [str(tmp_path / x) for x in ("requests", "told", "out", "ckpt")]
    spark.createDataFrame(requests, MS.REQUESTS).write.parquet(paths[0])
    spark.createDataFrame(told, MS.RESPONSES).write.parquet(paths[1])
    MS.close_input(spark, *paths[:2])
    got = sorted((r.transaction_id, r.attempt_no, r.response_text or "") for r in MS.run_round(spark, *paths).collect())
    assert got == [("A", 1, "first"), ("A", 1, "second"), ("B", 1, ""), ("C", 1, ""), ("D", 1, ""), ("E", 2, "")]
    again = MS.run_round(spark, *paths)  # a restart gives nothing out twice
    assert again.count() == 6


def test_rounds_in_batches(spark, tmp_path):
    """What comes late, waits over several batches, or has no time or id; nothing lies in a state store."""
    sec = lambda s: T0 + dt.timedelta(seconds=s)
    paths = [str(tmp_path / x) for x in ("requests", "told", "out", "ckpt")]
    steps = [([("A", 1, sec(0)), ("A", 1, sec(0)), ("B", 1, sec(1)), (None, 1, sec(2)), ("C", 1, None)], [("A", 1, "early", sec(3)), (None, 1, "no id", sec(3))]),
             ([("D", 1, sec(60)), ("E", 1, sec(62))], [("A", 1, "again", sec(9)), ("F", 1, "before its request", sec(55))]),
             ([("F", 1, sec(50)), ("Z", 1, sec(300))], [("E", 1, "later", sec(70)), ("Y", 1, "moves the watermark", sec(300))]),
             ([("G", 1, sec(310)), ("H", 1, sec(239))], [("D", 1, "too late", sec(71)), ("G", 1, "in time", sec(322)), ("B", 1, "late", sec(2))])]
    given = []
    for asked, told in steps:
        spark.createDataFrame(asked, MS.REQUESTS).coalesce(1).write.mode("append").parquet(paths[0])
        spark.createDataFrame(told, MS.RESPONSES).coalesce(1).write.mode("append").parquet(paths[1])
        given.append(sorted((r.transaction_id, r.response_text or "") for r in MS.run_round(spark, *paths).collect()))
    first, second = [("A", "early")] * 2, [("A", "again")] * 2 + [("A", "early")] * 2
    third = sorted(second + [("B", ""), ("D", ""), ("E", "later"), ("F", "before its request")])  # a row without an id is not read back
    assert given[:2] == [first, second] and given[2] == third
    assert given[3] == sorted(third + [("G", "in time")])  # H, D's and B's answers are behind the watermark
    MS.close_input(spark, *paths[:2])
    assert sorted((r.transaction_id, r.response_text or "") for r in MS.run_round(spark, *paths).collect()) == sorted(third + [("G", "in time"), ("Z", "")])
    assert not (tmp_path / "ckpt" / "state").exists()


def test_settled_by_the_first_answers(spark, tmp_path, monkeypatch):
    """Only transactions whose second attempt asks are decided again, each row by itself."""
    rows = enriched(spark, [tx("T1", 1500, "BANK_TIMEOUT", u_bp=0), tx("T2", 1500, "BANK_TIMEOUT"), tx("T2", 1500, "BANK_TIMEOUT", u_bp=0),
                            tx("T0", 1500, "CARD_EXPIRED"), tx("T3", 35000, "CARD_EXPIRED"), tx("T4", None, None)])
    rows = rows.withColumn("transaction_id", F.expr("nullif(transaction_id, 'T0')"))
    answer = '{"root_cause": "%s", "confidence": 0.9, "recommended_action": "retry_payment", "reason": "r", "why_not_alternatives": "w"}'
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    told = [("T1", 1, answer % "expired_card", at(3)), ("T2", 1, answer % "limit_exceeded", at(12)), ("T2", 2, answer % "expired_card", at(3605)),
            ("T3", 1, "{", at(1)), ("T1", 2, answer % "limit_exceeded", at(3601))]
    spark.createDataFrame(told, MS.RESPONSES).write.parquet(str(tmp_path / "told"))
    sizes = []
    real = MS.evaluate
    monkeypatch.setattr(MS, "evaluate", lambda df, **k: (sizes.append(df.count()), real(df, **k))[1])
    answers = spark.createDataFrame(told, MS.RESPONSES).drop("answered_at")
    view = lambda w: sorted(map(str, w.select("transaction_id", "optimizer").collect()))
    want = view(real(attach_responses(rows, answers), model=True, which=("optimizer",)))
    assert view(MS.two_phase_diagnosis(rows, str(tmp_path / "told"), str(tmp_path / "a"))) == want
    assert sizes == [6, 2]
    got = MS.two_phase_diagnosis(rows, str(tmp_path / "told"), str(tmp_path / "b"), columns=("transaction_id", "optimizer"))
    assert view(got) == want and "net_retry_payment" not in got._jdf.queryExecution().analyzed().output().toString()
    assert largest_method(got) < 8000
