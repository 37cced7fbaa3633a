"""The JVM leaves methods over 8000 bytes of bytecode interpreted; the queries that render texts stay below,
and decide once what they read several times."""
import re

from dunning.operators.audit import audit_rows
from dunning.operators.strategies import evaluate
from dunning.plans import queries as Q
from dunning.session import materialized
from helpers import enriched, tx
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def largest_method(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(df._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(-?[0-9]+)", text))


def decided(spark):
    rows = [tx("T1", 1500, "BANK_TIMEOUT", u_bp=0), tx("T2", 1500, "BANK_TIMEOUT"), tx("T3", 35000, "CARD_EXPIRED"), tx("T4", None, None), tx("T2", 1500, None)]
    return materialized(evaluate(enriched(spark, rows), which=("rules", "optimizer")), "decided")


def test_audit_rows_and_policy_matrix_are_compiled(spark):
    assert largest_method(audit_rows(decided(spark), "optimizer")) < 8000
    assert largest_method(Q.policy_matrix(spark, SF)) < 8000


def test_texts_that_nobody_reads_are_not_rendered(spark):
    a = audit_rows(decided(spark), "optimizer").groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    assert "format_number" not in a._jdf.queryExecution().optimizedPlan().toString()


def test_escalation_rows(spark):
    a = audit_rows(decided(spark), "rules").where("transaction_id = 'T2' AND tool_result = 'FAILURE'")
    assert {r.agent_action for r in a.collect()} >= {"retry_payment", "escalate_to_human"}
    extra = audit_rows(decided(spark), "rules").where("attempt_no = 3").orderBy("stage_no").collect()
    assert [(r.stage, r.tool_result) for r in extra if r.transaction_id == "T2"][:1] == [("policy_guardrail", None)]


def test_decisions_are_read_back(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan(Q.transaction_360(spark, SF))
    seen = []
    keep = lambda f, at: lambda *a, **k: (seen.append(plan(a[at])), f(*a, **k))[1]
    monkeypatch.setattr(Q.AU, "audit_rows", keep(Q.AU.audit_rows, 0))
    monkeypatch.setattr(Q.IO, "write_runs", keep(Q.IO.write_runs, 0))
    assert Q.audit_append(spark, SF).count() == 8 and Q.run_overwrite(spark, SF).count() == 4500
    assert len(seen) == 5 and not any("o_orderkey" in p for p in seen)
