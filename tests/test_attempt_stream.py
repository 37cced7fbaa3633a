"""Keyed attempt state: history counts, restarts go on, the output holds each key once."""
from dunning.streaming import attempt_stream as AS
from test_positions import _rows

ROWS = "transaction_id string, attempt_no int, agent_action string"


def test_state_over_restarts(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    prior = _rows(spark, [("a", "A", 1, 0, "execution", "retry_payment"), ("a", "P", 1, 0, "execution", "schedule_retry")])
    batches = [[("A", 2, "schedule_retry"), ("N", 1, "retry_payment")], [("N", 3, "escalate_to_human"), ("N", 2, "retry_payment")], [("M", 1, "odd")]]
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(src)
        AS.resume_attempt_state(spark, src, spark.createDataFrame([], ROWS).schema, prior, out, ckpt)
        seen.append({r.transaction_id: tuple(r)[1:] for r in AS.current_state(spark, out).collect()})
    a, p = (2, 2, False, "retry_payment,schedule_retry"), (1, 1, False, "schedule_retry")
    assert seen[0] == {"A": a, "P": p, "N": (1, 1, False, "retry_payment")}
    assert seen[1] == {"A": a, "P": p, "N": (3, 2, True, "retry_payment,escalate_to_human")}
    assert seen[2] == seen[1] | {"M": (1, 0, False, "")}
    assert sum(spark.read.parquet(f"{out}/slot={k}").count() for k in (0, 1)) <= 2 * 4
