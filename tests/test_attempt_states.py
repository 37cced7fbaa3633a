"""Attempt states are added up by Spark's aggregates, without a Python call per key, and a batch can be replayed."""
from dunning.streaming import attempt_stream as AS

ROWS = "transaction_id string, attempt_no int, agent_action string"


def test_a_batch_joins_the_states_before_it(spark):
    old = spark.createDataFrame([("A", 2, 1, False, "retry_payment"), ("B", 1, 0, True, "stop_recovery")], AS.OUTPUT)
    batch = spark.createDataFrame([("A", 4, "retry_payment"), ("A", 3, "schedule_retry"), ("A", 5, None), ("C", 2, "escalate_to_human"),
                                   ("C", 1, "odd"), (None, 1, "schedule_retry"), (None, None, "retry_payment")], ROWS)
    new = AS.next_states(old, batch)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    got = {r.transaction_id: tuple(r)[1:] for r in new.collect()}
    assert got == {"A": (5, 3, False, "retry_payment,schedule_retry"), "B": (1, 0, True, "stop_recovery"),
                   "C": (2, 0, True, "escalate_to_human"), None: (2, 2, False, "retry_payment,schedule_retry")}
