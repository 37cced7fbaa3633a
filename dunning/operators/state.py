"""Run state: snapshots after a run, invoice resolution, validation, terminal
gating and resumable batches (SK-04..SK-06, PF-08, PF-09, JN-07, JN-08,
ST-04, TK-01, TK-02, WN-05).

Inputs are never updated in place: a run produces a new transactions /
invoices snapshot (written with dynamic partition overwrite by the caller).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.risk import risk
from ..functions.validity import is_recovered, row_error
from .joins import lookup_join

PRIOR_COLUMNS = ["prior_executions", "prior_automated", "prior_terminal", "prior_success", "prior_last_action", "prior_actions"]
TERMINAL = ("RECOVERED", "SUCCESS", "ESCALATED", "STOPPED")


def snapshot_after(wide: DataFrame, strategy: str) -> DataFrame:
    """Transactions after a strategy run (SK-04), from the wide form: same
    rows, so no join.  ``status`` is never changed."""
    s = F.col(strategy)
    ran = s["status"].isin("SUCCESS", "FAILURE")
    return wide.select(
        "transaction_id", "customer_id", "amount", "payment_method", "status", "failure_code",
        F.coalesce(s["retry_count_after"], F.col("retry_count")).alias("retry_count"),
        "timestamp",
        F.when(ran, s["recovery_status_after"]).otherwise(F.col("recovery_status")).alias("recovery_status"),
        F.when(s["status"] == "SUCCESS", F.col("amount")).otherwise(F.col("recovered_amount"))
        .cast("decimal(18,2)").alias("recovered_amount"),
    )


def resolve_invoices(invoices: DataFrame, wide: DataFrame, strategy: str) -> DataFrame:
    """SK-05 / JN-07: a success clears days_overdue on all of the customer's
    invoices, and sets promise_to_pay when the action was mark_promise_to_pay.
    Per-customer flags are a partial aggregate, then one keyed join."""
    s = F.col(strategy)
    ok = s["status"] == "SUCCESS"
    per_c = (wide.groupBy("customer_id")
             .agg(F.bool_or(ok).alias("recovered"),
                  F.bool_or(ok & (s["final_action"] == "mark_promise_to_pay")).alias("promised")))
    j = lookup_join(invoices, per_c, "customer_id", "left")
    return j.select(
        "invoice_id", "customer_id", "amount_due", "due_date",
        F.when(F.coalesce(F.col("recovered"), F.lit(False)), F.lit(0)).otherwise(F.col("days_overdue")).cast("int").alias("days_overdue"),
        (F.col("promise_to_pay") | F.coalesce(F.col("promised"), F.lit(False))).alias("promise_to_pay"),
    )


def validate(requests: DataFrame, transactions: DataFrame) -> DataFrame:
    """PF-08: error class per requested id, in order: missing id, not found,
    NULL / negative amount, negative retry_count.  Valid rows have NULL error."""
    t = transactions.select("transaction_id", "amount", "retry_count", F.lit(True).alias("_found"))
    j = requests.join(t, "transaction_id", "left")
    tid = F.col("transaction_id")
    err = (F.when(tid.isNull() | (tid == ""), F.lit("Invalid or missing transaction ID."))
           .when(F.col("_found").isNull(), F.concat(F.lit("Transaction '"), tid, F.lit("' not found.")))
           .otherwise(row_error(F.col("amount"), F.col("retry_count"))))
    return j.select(tid.alias("transaction_id"), F.when(err.isNull(), "VALID").otherwise("ERROR").alias("status"),
                    err.alias("error_reason"))


def gate(enriched: DataFrame) -> DataFrame:
    """PF-09 / JN-08: what the resumable batch does with each transaction."""
    rec = F.upper(F.coalesce(F.col("recovery_status"), F.lit("UNRECOVERED")))
    g = (F.when(row_error(F.col("amount"), F.col("retry_count")).isNotNull(), "INVALID")
         .when(is_recovered(F.col("recovery_status"), F.col("status")), "ALREADY_RECOVERED")
         .when(F.col("prior_terminal"), "TERMINAL")
         .when(rec.isin("ESCALATED", "STOPPED"), "TERMINAL")
         .when(F.col("prior_executions") >= C.MAX_ATTEMPTS, "BUDGET_USED")
         .otherwise("PENDING"))
    return enriched.withColumn("gate_status", g)


def pending(enriched: DataFrame, n: int | None = None) -> DataFrame:
    """Rows a resumable batch may act on (ST-04): valid, not terminal, budget
    left; ``n``: the first n of them by id (TK-02).  Without ``n`` rows with a used
    budget stay in (they report SKIPPED, as the loop does)."""
    gated = gate(enriched)
    if n is None:
        return gated.where(F.col("gate_status").isin("PENDING", "BUDGET_USED"))
    return first_n(gated.where(F.col("gate_status") == "PENDING"), n)


def first_n(df: DataFrame, n: int, key: str = "transaction_id") -> DataFrame:
    """TK-01 / TK-02: the first ``n`` rows by key (top-k, the feature)."""
    return df.orderBy(key).limit(n)


def sequential_overdue(results_wide: DataFrame, strategy: str) -> DataFrame:
    """WN-05: days overdue seen by each transaction when a run processes
    transactions in id order and every success clears the customer's
    invoices.  A transaction sees 0 when an earlier transaction (lower id) of
    the same customer was recovered.

    Expressed as "first recovered id per customer" (a partial min aggregate)
    joined back, instead of an ordered window, so a customer with a huge
    share of the rows is never sorted in one task.
    """
    s = F.col(strategy)
    first_ok = (results_wide.groupBy("customer_id")
                .agg(F.min(F.when(s["status"] == "SUCCESS", F.col("transaction_id"))).alias("first_recovered_id")))
    j = lookup_join(results_wide, first_ok, "customer_id", "left")
    cleared = F.col("first_recovered_id").isNotNull() & (F.col("first_recovered_id") < F.col("transaction_id"))
    days = F.when(cleared & F.col("days_overdue").isNotNull(), F.lit(0)).otherwise(F.col("days_overdue"))
    return j.withColumn("days_overdue_seq", days).withColumn("cleared_by_earlier", cleared)


def sequential_risk(seq: DataFrame) -> Column:
    return risk(F.col("amount"), F.col("failure_code"), F.col("retry_count"), F.col("risk_rate"),
                F.col("risk_flag"), F.col("days_overdue_seq"))


def state_from_audit(transactions: DataFrame, audit: DataFrame) -> DataFrame:
    """SK-04 from an audit trail: the recovery state each transaction is in
    after the recorded executions (success wins, then the last exit).  The
    history columns stay on the row, so enrichment need not join them again."""
    from .enrich import history
    j = transactions.join(history(audit), "transaction_id", "left")  # unique on both sides
    st = (F.when(F.col("prior_success"), "RECOVERED")
          .when(F.col("prior_last_action") == C.ESCALATE, "ESCALATED")
          .when(F.col("prior_last_action") == C.STOP, "STOPPED")
          .when(F.col("prior_executions") > 0, "FAILED"))
    return j.select(
        *[c for c in transactions.columns if c not in ("recovery_status", "recovered_amount", "retry_count", *PRIOR_COLUMNS)],
        F.coalesce(F.col("retry_count") + F.when(F.array_contains(F.col("prior_actions"), "retry_payment"), 1)
                   .otherwise(0), F.col("retry_count")).cast("int").alias("retry_count"),
        F.coalesce(st, F.col("recovery_status")).alias("recovery_status"),
        F.when(F.col("prior_success"), F.col("amount")).otherwise(F.col("recovered_amount"))
        .cast("decimal(18,2)").alias("recovered_amount"),
        *PRIOR_COLUMNS,
    )
