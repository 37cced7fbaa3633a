"""Positions in groups that cross partitions, and ordered histories."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dunning import catalog as C
from dunning.operators.enrich import attempt_history, history
from dunning.operators.metrics import ranked_counts
from dunning.operators.positions import with_positions
from dunning.schemas import AUDIT

T0 = datetime(2026, 1, 1)


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_positions(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice(["HOT", "HOT", "HOT", f"K{rng.randrange(30)}", None]), rng.randrange(10**9), rng.random() < 0.7, "x") for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, o long, counted boolean, _part string").repartition(5)
    got = with_positions(df, "k", ["o"], "place", F.col("counted"), partitions).collect()
    want = {}
    for k, o, c, _ in sorted(rows, key=lambda r: r[1]):
        if c:
            want.setdefault(k, []).append(o)
    assert len(got) == 900 and all((r.place is None) != r.counted for r in got)
    assert {(r.k, r.o): r.place for r in got if r.counted} == {(k, o): i for k, v in want.items() for i, o in enumerate(v, 1)}


def test_hot_group_is_spread(spark):
    df = spark.range(4000).selectExpr("IF(id % 3 > 0, 'HOT', CAST(id AS STRING)) AS k", "id AS o")
    placed = with_positions(df, "k", ["o"], "place", partitions=8)
    hot = placed.where("k = 'HOT'").orderBy("o").collect()
    assert [r.place for r in hot] == list(range(1, len(hot) + 1))
    sizes = [r["count"] for r in df.repartitionByRange(8, "k", "o").where("k = 'HOT'").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 3 and max(sizes) < len(hot) / 2
    assert with_positions(df.where("false"), "k", ["o"], "place").count() == 0


def _rows(spark, rows):
    return spark.createDataFrame([(run, t, n, 4, T0 + timedelta(minutes=m), stage, a, "APPROVED", "FAILURE", None, None, 0)
                                  for run, t, n, m, stage, a in rows], AUDIT)


def test_histories(spark):
    ex, r, s, p = "execution", "retry_payment", "schedule_retry", "mark_promise_to_pay"
    rows = _rows(spark, [("b", "A", 1, 9, ex, r), ("a", "A", 2, 5, ex, s), ("a", "A", 1, 3, ex, p), ("a", "A", 1, 3, ex, p), ("a", "A", 1, 1, "risk_evaluation", None),
                         ("b", "A", 2, 11, ex, s), ("c", "A", 1, 20, ex, C.ESCALATE), ("a", "B", 1, 0, ex, "unknown_action")])
    h = {x.transaction_id: x for x in attempt_history(rows, 2).collect()}
    assert h["A"].executions == 5 and h["A"].n_schedule_retry == 2 and h["B"].executions == 1
    assert h["A"].first_actions == [f"a:1:{p}:FAILURE", f"a:2:{s}:FAILURE"] and h["A"].last_actions == [f"b:2:{s}:FAILURE", f"c:1:{C.ESCALATE}:FAILURE"]
    tried = {x.transaction_id: x for x in history(rows).collect()}
    assert tried["A"].prior_actions == [p, s, r, C.ESCALATE] and tried["A"].prior_last_action == C.ESCALATE and tried["A"].prior_terminal
    assert tried["B"].prior_actions == []


def test_prompt_names_earlier_runs_in_order(spark):
    from dunning.operators import model_io as MI
    from dunning.operators.strategies import evaluate
    from dunning.operators.enrich import with_context, customer_context
    from dunning.schemas import CUSTOMERS, INVOICES
    from helpers import TX_SCHEMA, cust, tx
    prior = _rows(spark, [("a", "T", 1, 3, "execution", "schedule_retry")])
    e = with_context(spark.createDataFrame([tx("T", 100, "BANK_TIMEOUT")], TX_SCHEMA),
                     customer_context(spark.createDataFrame([cust()], CUSTOMERS), spark.createDataFrame([], INVOICES)), prior_audit=prior)
    prompts = MI.prompt_requests(evaluate(e, which=("optimizer",))).collect()
    assert ["Tried so far: schedule_retry failed" in p.prompt for p in prompts] == [True]


def test_ranked_counts(spark):
    df = spark.createDataFrame([("s", v) for v in "bbbaaacd"] + [("s", None), ("t", None)], "strategy string, v string")
    got = [(r.strategy, r.value, r.n, r.place) for r in ranked_counts(df, ["strategy"], "v").orderBy("strategy", "place").collect()]
    assert got == [("s", "a", 3, 1), ("s", "b", 3, 2), ("s", "c", 1, 3), ("s", "d", 1, 4), ("s", None, 1, 5), ("t", None, 1, 1)]
    assert ranked_counts(df, ["strategy"], "v", 2).count() == 3
