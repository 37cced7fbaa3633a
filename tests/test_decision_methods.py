"""Each generated method of the decision pass stays below the 8000 bytes of bytecode that the JVM compiles."""
from dunning.operators.strategies import evaluate
from dunning.plans import queries as Q
from helpers import enriched, tx
from test_generated_code import SF, largest_method


def test_decisions_are_compiled(spark):
    for name in ("strategy_summary", "distributions", "funnel", "report", "rules_results", "optimizer_results", "diagnosed", "model_quota"):
        assert largest_method(Q.QUERIES[name](spark, SF)) < 8000, name


def test_cuts_move_no_rows(spark):
    rows = enriched(spark, [tx(f"T{i}", 1500, "BANK_TIMEOUT") for i in range(40)]).repartition(7, "transaction_id")
    wide = evaluate(rows)
    assert wide.rdd.getNumPartitions() == rows.rdd.getNumPartitions() and wide.count() == 40
    assert {len(r.trail) for r in wide.select("optimizer.trail").collect()} == {2}
    assert all(len(r.trail) == 0 for r in evaluate(enriched(spark, [tx("T1", None, None)])).select("optimizer.trail").collect())
