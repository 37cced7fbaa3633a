"""KPIs and strategy comparison (AG-01..AG-04, AG-07..AG-14, AG-16, AG-17,
AG-22, AG-23, SO-02, SO-03).

Every metric is a partial aggregate over a low-cardinality key (strategy,
stage, action), so hot keys are combined map-side before the shuffle.  Money
sums stay exact in decimal and are cast to double only at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import catalog as C
from ..functions import sqltext as S
from ..functions.text import pct2

RECOVERED_STATUSES = ("RECOVERED", "SUCCESS")


def kpis(transactions: DataFrame) -> DataFrame:
    """Transaction KPIs (AG-01..04); recovered means recovery_status
    RECOVERED (or legacy SUCCESS), since execution never changes ``status``."""
    rec = F.upper(F.coalesce(F.col("recovery_status"), F.lit(""))).isin(*RECOVERED_STATUSES)
    g = transactions.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.coalesce(F.sum("amount"), F.lit(0)).alias("revenue_at_risk"),
        F.count_if(rec).alias("recovered_transactions"),
        F.coalesce(F.sum(F.when(rec, F.col("amount"))), F.lit(0)).alias("recovered_revenue"),
    )
    at_risk = F.col("revenue_at_risk").cast("double")
    total = F.col("total_transactions").cast("double")
    return g.select(
        F.col("total_transactions").cast("long"),
        at_risk.alias("revenue_at_risk"),
        F.col("recovered_transactions").cast("long"),
        F.col("recovered_revenue").cast("double"),
        F.when(at_risk > 0, pct2(F.col("recovered_revenue").cast("double") / at_risk * 100))
        .otherwise(F.lit(0.0)).alias("recovery_rate_percentage"),
        F.when(total > 0, pct2(F.col("recovered_transactions").cast("double") / total * 100))
        .otherwise(F.lit(0.0)).alias("transaction_recovery_rate_percentage"),
    )


def failure_breakdown(transactions: DataFrame) -> DataFrame:
    """Transactions by failure code, NULL / empty codes dropped (AG-07)."""
    return (transactions.where(F.col("failure_code").isNotNull() & (F.col("failure_code") != ""))
            .groupBy("failure_code").agg(F.count(F.lit(1)).cast("long").alias("n")))


def strategy_summary(results: DataFrame) -> DataFrame:
    """One row per strategy (AG-08..AG-10, AG-13, AG-14).

    ``operational_cost`` charges the final action only (the published
    convention); ``automated_attempts`` counts true automated executions.
    """
    ok = F.col("status") == "SUCCESS"
    g = results.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum(F.when(F.col("status") != "ERROR", F.col("amount"))).alias("revenue_at_risk"),
        F.count_if(ok).alias("transactions_recovered"),
        F.coalesce(F.sum(F.when(ok, F.col("amount_recovered"))), F.lit(0)).alias("revenue_recovered"),
        F.coalesce(F.sum("cost"), F.lit(0)).alias("operational_cost"),
        F.count_if(F.col("final_action") == C.ESCALATE).alias("escalated_cases"),
        F.count_if(F.col("final_action") == C.STOP).alias("stopped_cases"),
        F.sum("execution_count").alias("executions"),
        F.sum("automated_attempts").alias("automated_attempts"),
    )
    n = F.col("transactions").cast("double")
    risk = F.col("revenue_at_risk").cast("double")
    return g.select(
        "strategy",
        F.col("transactions").cast("long"),
        F.col("revenue_at_risk").cast("double"),
        F.col("transactions_recovered").cast("long"),
        F.when(n > 0, pct2(F.col("transactions_recovered") / n * 100)).otherwise(0.0)
        .alias("transaction_recovery_rate"),
        F.col("revenue_recovered").cast("double"),
        F.when(risk > 0, pct2(F.col("revenue_recovered").cast("double") / risk * 100)).otherwise(0.0)
        .alias("revenue_recovery_rate"),
        F.col("operational_cost").cast("double"),
        (F.col("revenue_recovered") - F.col("operational_cost")).cast("double").alias("net_recovery"),
        F.col("escalated_cases").cast("long"),
        F.col("stopped_cases").cast("long"),
        (F.col("executions").cast("double") / n).alias("avg_attempts_per_tx"),
        F.col("automated_attempts").cast("long"),
    )


def uplift(summary: DataFrame) -> DataFrame:
    """Optimizer vs baseline and vs rules, gross and net (AG-11), from the
    3-row summary by a pivot."""
    p = (summary.groupBy().pivot("strategy", ["baseline", "rules", "optimizer"])
         .agg(F.first("revenue_recovered").alias("g"), F.first("net_recovery").alias("n"),
              F.first("revenue_at_risk").alias("r")))
    risk = F.col("optimizer_r")

    def pct(x):
        return F.when(risk > 0, pct2(x / risk * 100)).otherwise(0.0)
    return p.select(
        (F.col("optimizer_g") - F.col("baseline_g")).alias("gross_uplift_vs_baseline"),
        pct(F.col("optimizer_g") - F.col("baseline_g")).alias("gross_uplift_vs_baseline_pct"),
        (F.col("optimizer_g") - F.col("rules_g")).alias("gross_uplift_vs_rules"),
        pct(F.col("optimizer_g") - F.col("rules_g")).alias("gross_uplift_vs_rules_pct"),
        (F.col("optimizer_n") - F.col("baseline_n")).alias("net_uplift_vs_baseline"),
        (F.col("optimizer_n") - F.col("rules_n")).alias("net_uplift_vs_rules"),
    )


def decision_changes(wide: DataFrame, left: str = "rules", right: str = "optimizer") -> DataFrame:
    """Pairs with a different final action, and their share (AG-12).

    Both strategies sit in the same row, so no join is needed (JN-06 for
    stored results is :func:`dunning.operators.strategies.pair`)."""
    changed = ~F.col(f"{left}.final_action").eqNullSafe(F.col(f"{right}.final_action"))
    g = wide.agg(F.count(F.lit(1)).alias("n"), F.count_if(changed).alias("changed"))
    return g.select(
        F.col("changed").cast("long").alias("decision_changes_count"),
        F.when(F.col("n") > 0, pct2(F.col("changed") / F.col("n").cast("double") * 100))
        .otherwise(0.0).alias("decision_change_rate"),
    )


def value_counts(results: DataFrame, column: str) -> DataFrame:
    """``value_counts`` of one column per strategy (AG-16)."""
    return ranked_counts(results, ["strategy"], column)


def ranked_counts(rows: DataFrame, by: list[str], column: str, k: int | None = None) -> DataFrame:
    """How often each value occurs within ``by``, and its ``place`` (from 1, most frequent
    first, equal counts by value with NULL last); with ``k``, the k most frequent, cut
    in each task before the shuffle too.  What is ordered is the counts, never the rows."""
    counts = rows.groupBy(*by, F.col(column).alias("value")).agg(F.count(F.lit(1)).cast("long").alias("n"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), F.asc_nulls_last("value"))
    placed = counts.withColumn("place", F.row_number().over(order).cast("long"))
    return placed if k is None else placed.where(F.col("place") <= k)


def funnel(results: DataFrame) -> DataFrame:
    """Five recovery stages per strategy, stacked into rows (AG-17, SO-02)."""
    g = results.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("ingested"),
        F.count_if(F.col("risk_score").isNotNull() | (F.col("strategy") == "baseline")).alias("evaluated"),
        F.count_if(F.col("final_action").isNotNull()).alias("selected"),
        F.count_if(F.col("status") == "SUCCESS").alias("recovered"),
        F.count_if(F.col("final_action") == C.ESCALATE).alias("escalated"),
    )
    return g.select("strategy", F.expr(
        "stack(5, 1, '1. Total Ingested Transactions', ingested,"
        " 2, '2. Evaluated for Recovery', evaluated,"
        " 3, '3. Intervention Selected', selected,"
        " 4, '4. Successfully Recovered', recovered,"
        " 5, '5. Escalated to Operations Queue', escalated) as (stage_no, stage, n)")
    ).select("strategy", F.col("stage_no").cast("long"), "stage", F.col("n").cast("long"))


def report(summary: DataFrame) -> DataFrame:
    """Metric rows x strategy columns (SO-03): unpivot then pivot."""
    metrics = ["transactions_recovered", "revenue_recovered", "operational_cost", "net_recovery",
               "escalated_cases", "avg_attempts_per_tx"]
    long = summary.select("strategy", *[F.col(m).cast("double").alias(m) for m in metrics]) \
        .unpivot(["strategy"], metrics, "metric", "value")
    return (long.groupBy("metric").pivot("strategy", ["baseline", "rules", "optimizer"])
            .agg(F.first("value")))


def run_observations(strategy: str) -> dict[str, Column]:
    """AG-18, AG-19, AG-22 as aggregates over the wide results of a run, so that the pass
    that writes them yields them: the batch summary, and the guardrail and stopping
    rule violations read from each row's trail and context."""
    s = F.col(strategy)
    ok = s["status"] == "SUCCESS"
    automated = F.expr(f"filter(transform({strategy}.trail, x -> x.final_action), x -> x IN {S.names(C.AUTOMATED)})")
    contacts = F.size(F.filter(automated, lambda a: a.isin(*C.CONTACT_ACTIONS)))
    many = F.size(automated)

    def total(cond, n=many):
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long")

    return {
        "total_processed": F.count(F.lit(1)),
        "successful_recovery": F.count_if(ok),
        "amount_recovered": F.coalesce(F.sum(F.when(ok, s["amount_recovered"])), F.lit(0)).cast("double"),
        "escalated_count": F.count_if(s["final_action"] == C.ESCALATE),
        "stopped_count": F.count_if(s["final_action"] == C.STOP),
        "high_value": total(F.coalesce(F.col("amount"), F.lit(0)) >= C.HIGH_VALUE_THRESHOLD),
        "fraud_flag": total(F.col("risk_flag")),
        "opt_out": total(F.col("preference") == "none", contacts),
        "duplicate": total(F.lit(True), many - F.size(F.array_distinct(automated))),
        "stopping_rule_violations": F.count_if(many > C.MAX_ATTEMPTS),
    }


def batch_summary(results: DataFrame) -> DataFrame:
    """Trigger-batch response (AG-22): processed, successful, amount,
    escalated, stopped."""
    ok = F.col("status") == "SUCCESS"
    g = results.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if(ok).alias("successful_recovery"),
        F.coalesce(F.sum(F.when(ok, F.col("amount_recovered"))), F.lit(0)).alias("amount_recovered"),
        F.count_if(F.col("final_action") == C.ESCALATE).alias("escalated_count"),
        F.count_if(F.col("final_action") == C.STOP).alias("stopped_count"),
    )
    return g.select(F.col("total_processed").cast("long"), F.col("successful_recovery").cast("long"),
                    F.col("amount_recovered").cast("double"), F.col("escalated_count").cast("long"),
                    F.col("stopped_count").cast("long"))
