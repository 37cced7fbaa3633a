"""Audit trail assembly and audit-derived checks (SO-04, WN-02/03/06, AG-05,
AG-06, AG-15, AG-18..AG-21).

Rows are generated per transaction from the strategy's ``trail`` (executed
attempts) with one ``explode``, so the decision pass runs once: up to four stage
rows per attempt plus the guardrail and execution rows of a budget escalation.  The key
``(transaction_id, attempt_no, stage_no)`` orders a trail without any global
sequence or sort.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.policy import reason_text, result_of
from ..functions.erv import eval_cost_of
from ..functions.outcome import describe, recovered
from ..functions.risk import risk_level
from ..functions.text import money_text, template
from .joins import lookup_join
from .positions import with_positions

LatencyFn = Callable[[Column, Column], Column]


def _zero_latency(tx: Column, stage_no: Column) -> Column:
    return F.lit(0).cast("long")


def _diag_reason(t: Column, code: Column) -> Column:
    src = t["diagnosis_source"]
    reason = (F.when(src == "rules", template(C.RULES_REASON, code=code))
              .when(src == "erv", template(C.OPTIMIZER_REASON, net=money_text(t["expected_net"]),
                                           cause=t["root_cause"]))
              .otherwise(t["model_reason"]))
    why = (F.when(src == "rules", F.lit(C.RULES_WHY_NOT))
           .when(src == "erv", F.lit(C.OPTIMIZER_WHY_NOT))
           .otherwise(t["model_why"]))
    return template(C.DIAGNOSIS_AUDIT_REASON, cause=t["root_cause"], reason=reason, why_not=why)


def audit_rows(wide: DataFrame, strategy: str, run_ts: str | None = None,
               latency: LatencyFn | None = None) -> DataFrame:
    """Audit rows written by one strategy run (SO-04, SK-03).

    The explode gives a number per row and its trail entry only; texts are rendered from
    these after it, each once in the generated code, and not at all where a query does
    not read them."""
    latency = latency or _zero_latency
    ts = (F.lit(run_ts).cast("timestamp_ntz") if run_ts
          else F.current_timestamp().cast("timestamp_ntz"))
    s = F.col(strategy)
    null = F.lit(None).cast("string")
    stages = {no: stage for stage, no in C.STAGE_NO.items()}
    numbers = ", ".join(str(n) for n in stages)
    risk_no, cause_no, policy_no, execution_no = (C.STAGE_NO[x] for x in ("risk_evaluation", "root_cause_analysis", "policy_guardrail", "execution"))
    base = wide.select("transaction_id", "amount", "failure_code", s["trail"].alias("trail"),
                       s["escalated"].alias("escalated"), s["execution_count"].alias("execution_count"))
    entries = base.select("transaction_id", "amount", "failure_code", "execution_count", F.explode(F.concat(
        F.col("trail"), F.when(F.col("escalated"), F.array(F.lit(None).cast(base.schema["trail"].dataType.elementType)))
        .otherwise(F.slice("trail", 1, 0)))).alias("t"))
    entries = entries.select("*", result_of(F.col("t.policy_rule")).alias("result"),
                             reason_text(F.col("t.policy_rule"), F.col("t.recommended_action"), F.col("transaction_id"), F.col("amount")).alias("policy_reason"))
    rows = entries.select("*", F.explode(F.expr(f"CASE WHEN t IS NULL THEN array({policy_no}, {execution_no}) ELSE array({numbers}) END")).alias("stage_no"))
    t, no, extra = F.col("t"), F.col("stage_no"), F.col("t").isNull()   # the entry of a budget escalation is NULL
    executed = no == execution_no
    stage = F.when(no == risk_no, stages[risk_no]).when(no == cause_no, stages[cause_no]).when(no == policy_no, stages[policy_no]).otherwise(stages[execution_no])
    action = (F.when(extra, F.lit(C.ESCALATE)).when(executed, t["final_action"])
              .when(no.isin(cause_no, policy_no), t["recommended_action"]))
    policy = (F.when(extra | executed, F.lit("APPROVED")).when(no == policy_no, F.col("result")))
    reason = (F.when(extra, F.when(executed, F.lit(C.OUTCOME_ESCALATED)).otherwise(F.lit(C.BUDGET_ESCALATION_REASON)))
              .when(no == risk_no, template(C.RISK_AUDIT_REASON, score=t["risk_score"], level=risk_level(t["risk_score"]),
                                            attempts=t["attempts_before"]))
              .when(no == cause_no, _diag_reason(t, F.col("failure_code")))
              .when(no == policy_no, F.col("policy_reason"))
              .otherwise(describe(t["final_action"], t["success"], F.col("amount"), t["probability"])))
    return rows.select(
        F.lit(strategy).alias("strategy"), "transaction_id",
        F.when(extra, F.col("execution_count")).otherwise(t["attempt_no"]).cast("int").alias("attempt_no"), "stage_no",  # the escalation is the last execution
        ts.alias("timestamp"), stage.alias("stage"), action.alias("agent_action"), policy.alias("policy_result"),
        F.when(executed, F.when(t["success"], "SUCCESS").otherwise("FAILURE")).otherwise(null).alias("tool_result"),
        F.when(executed & ~extra, recovered(t["success"], F.col("amount"))).otherwise(F.lit(0)).cast("decimal(18,2)").alias("amount_recovered"),
        reason.alias("reason"),
        latency(F.col("transaction_id"), no).cast("long").alias("latency_us"),
    )


def actions_breakdown(audit: DataFrame) -> DataFrame:
    """Execution rows by action (AG-05); NULL actions are kept as a group."""
    return (audit.where(F.col("stage") == "execution").groupBy("agent_action")
            .agg(F.count(F.lit(1)).alias("n")))


def policy_breakdown(audit: DataFrame) -> DataFrame:
    """Guardrail rows by result (AG-06), empty / NULL results dropped (PF-11)."""
    return (audit.where((F.col("stage") == "policy_guardrail") & F.col("policy_result").isNotNull()
                        & (F.col("policy_result") != ""))
            .groupBy("policy_result").agg(F.count(F.lit(1)).alias("n")))


def stage_latency(audit: DataFrame) -> DataFrame:
    """avg / max / count of latency by stage in ms, 3 decimals (AG-15)."""
    g = audit.groupBy("stage").agg(
        F.coalesce(F.avg(F.col("latency_us").cast("double")), F.lit(0.0)).alias("avg_us"),
        F.coalesce(F.max("latency_us"), F.lit(0)).alias("max_us"),
        F.count(F.lit(1)).alias("invocations"))
    return g.select(
        "stage",
        F.initcap(F.regexp_replace("stage", "_", " ")).alias("stage_title"),
        (F.floor(F.col("avg_us") + 0.5) / 1000.0).alias("avg_latency_ms"),
        (F.col("max_us").cast("double") / 1000.0).alias("max_latency_ms"),
        F.col("invocations").cast("long").alias("invocations"),
    )


def policy_violations(audit: DataFrame, transactions: DataFrame, customers: DataFrame) -> DataFrame:
    """Executed automated actions that the guardrail forbids (AG-18), per rule.

    Execution rows are counted per (transaction, action) first, then joined once
    to their transaction and customer; a duplicate is a second execution of the
    same automated action for one transaction.
    """
    ex = (audit.where((F.col("stage") == "execution") & F.col("agent_action").isin(*C.AUTOMATED))
          .groupBy("transaction_id", "agent_action").agg(F.count(F.lit(1)).alias("k")))
    cust = customers.select("customer_id", F.col("risk_flag").alias("c_flag"),
                            F.lower(F.coalesce(F.col("contact_preference"), F.lit("email"))).alias("c_pref"))
    tx = transactions.select("transaction_id", "customer_id", "amount")
    j = lookup_join(ex.join(tx, "transaction_id", "left"), cust, "customer_id", "left")

    def total(cond, n=F.col("k")):
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long")

    return j.agg(
        total(F.coalesce(F.col("amount"), F.lit(0)) >= C.HIGH_VALUE_THRESHOLD).alias("high_value"),
        total(F.coalesce(F.col("c_flag"), F.lit(False))).alias("fraud_flag"),
        total(F.col("agent_action").isin(*C.CONTACT_ACTIONS) & (F.col("c_pref") == "none")).alias("opt_out"),
        total(F.lit(True), F.col("k") - 1).alias("duplicate"),
    ).withColumn("policy_violations", F.col("high_value") + F.col("fraud_flag") + F.col("opt_out") + F.col("duplicate"))


def stopping_violations(audit: DataFrame) -> DataFrame:
    """Transactions with more than MAX_ATTEMPTS automated executions (AG-19)."""
    per_tx = (audit.where((F.col("stage") == "execution") & F.col("agent_action").isin(*C.AUTOMATED))
              .groupBy("transaction_id").agg(F.count(F.lit(1)).alias("automated")))
    return per_tx.agg(
        F.count_if(F.col("automated") > C.MAX_ATTEMPTS).cast("long").alias("stopping_rule_violations"),
        F.coalesce(F.max("automated"), F.lit(0)).cast("long").alias("max_automated_attempts"))


def all_attempt_cost(audit: DataFrame) -> DataFrame:
    """Evaluation cost over every execution, per strategy (AG-21)."""
    ex = audit.where(F.col("stage") == "execution")
    return ex.groupBy("strategy").agg(
        F.count(F.lit(1)).cast("long").alias("executions"),
        F.sum(eval_cost_of(F.col("agent_action"))).cast("double").alias("all_attempt_cost"))


def latest_diagnosis(audit: DataFrame) -> DataFrame:
    """Last root-cause row per transaction (WN-03) as a partial max_by."""
    rc = audit.where(F.col("stage") == "root_cause_analysis")
    return rc.groupBy("strategy", "transaction_id").agg(
        F.max_by(F.struct("agent_action", "reason"), F.struct("attempt_no", "stage_no")).alias("x")
    ).select("strategy", "transaction_id", F.col("x.agent_action").alias("selected_action"),
             F.col("x.reason").alias("reasoning"))


def execution_attempt_numbers(audit: DataFrame) -> DataFrame:
    """All audit rows, execution rows with their position ``execution_no`` among
    their transaction's executions (WN-02), over all runs in ``audit``: earlier
    runs first, then by the composite key.  Other rows have NULL.  A transaction of
    any length is spread over tasks."""
    return with_positions(audit, "transaction_id", ["timestamp", "attempt_no", "stage_no"], "execution_no", F.col("stage") == "execution")
