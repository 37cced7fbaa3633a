"""Context enrichment: transaction -> customer, first invoice, outcome draw and
execution history (JN-01..03, JN-09, PF-10, WN-01, AG-20)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import catalog as C
from .joins import lookup_join


def first_invoice(invoices: DataFrame) -> DataFrame:
    """One invoice per customer, the lowest ``invoice_id`` (WN-01).

    ``min_by`` is a partial aggregate: each map task keeps one candidate per
    customer, so a customer with millions of invoices costs one row of shuffle
    per task.
    """
    inv = F.struct("invoice_id", "amount_due", "due_date", "days_overdue", "promise_to_pay")
    return (invoices.groupBy("customer_id")
            .agg(F.min_by(inv, F.col("invoice_id")).alias("inv"))
            .select("customer_id",
                    F.col("inv.invoice_id").alias("invoice_id"),
                    F.col("inv.amount_due").alias("invoice_amount_due"),
                    F.col("inv.days_overdue").alias("invoice_days_overdue"),
                    F.col("inv.promise_to_pay").alias("invoice_promise_to_pay")))


def customer_context(customers: DataFrame, invoices: DataFrame) -> DataFrame:
    """Customer attributes plus first invoice, one row per customer id.

    Invoices link to customers only (never to a transaction), and a customer
    id may have invoices but no customer row, hence the full outer join of two
    inputs that are both keyed (and partitioned) by ``customer_id``.
    """
    cust = customers.select(
        "customer_id",
        F.lit(True).alias("has_customer"),
        F.col("customer_type"),
        F.col("lifetime_value"),
        F.col("previous_payment_success_rate").alias("stored_rate"),
        F.col("contact_preference"),
        F.col("risk_flag").alias("stored_risk_flag"),
    )
    return cust.join(first_invoice(invoices), "customer_id", "full")


def history(audit: DataFrame) -> DataFrame:
    """Execution history per transaction (AG-20), as bounded columns.

    Everything is a partial aggregate (count, bool_or, max_by), so a
    transaction with a huge trail still shuffles one row per map task.  The catalog
    actions tried come in the order of their first use, from one minimal place
    per action; :func:`attempt_history` gives the executions themselves.
    """
    ex = audit.where(F.col("stage") == "execution")
    aggs = [
        F.count(F.lit(1)).alias("prior_executions"),
        F.count_if(F.col("agent_action").isin(*C.AUTOMATED)).alias("prior_automated"),
        F.coalesce(F.bool_or(F.col("agent_action").isin(*C.EXITS)), F.lit(False)).alias("prior_terminal"),
        F.coalesce(F.bool_or(F.col("tool_result") == "SUCCESS"), F.lit(False)).alias("prior_success"),
        F.max_by("agent_action", F.struct("timestamp", "attempt_no", "stage_no")).alias("prior_last_action"),
    ]
    for a in C.ACTION_NAMES:
        aggs.append(F.min(F.when(F.col("agent_action") == a, F.struct("timestamp", "attempt_no", "stage_no"))).alias(f"at_{a}"))
    h = ex.groupBy("transaction_id").agg(*aggs)
    used = ", ".join(f"CASE WHEN at_{a} IS NOT NULL THEN named_struct('at', at_{a}, 'no', {i}, 'action', '{a}') END" for i, a in enumerate(C.ACTION_NAMES))
    tried = F.expr(f"transform(array_sort(array_compact(array({used}))), x -> x.action)")
    return h.select("transaction_id", "prior_executions", "prior_automated", "prior_terminal",
                    "prior_success", "prior_last_action", tried.alias("prior_actions"))


def attempt_history(audit: DataFrame, k: int = 4) -> DataFrame:
    """AG-20 / JN-03: executions of each transaction over all runs: their number, how
    often each catalog action ran, and the first and last ``k`` in order (by time, attempt,
    stage, then run), as ``run:attempt:action:result``.

    A row repeated in the log (same run, attempt, stage and time) counts once.  Ranks up to
    ``k`` are limited before the shuffle as well as after, so of a long history no
    more than k rows from either end leave a task."""
    place = ["timestamp", "attempt_no", "stage_no", "strategy"]
    rows = (audit.where(F.col("stage") == "execution").groupBy("transaction_id", *place)
            .agg(F.max(F.struct("agent_action", "tool_result")).alias("x")).select("transaction_id", *place, "x.*"))
    counts = rows.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("executions"),
                                                *[F.count_if(F.col("agent_action") == a).alias(f"n_{a}") for a in C.ACTION_NAMES])

    def end(name: str, order: list) -> DataFrame:
        near = (rows.withColumn("r", F.row_number().over(Window.partitionBy("transaction_id").orderBy(*order))).where(F.col("r") <= k))
        text = F.concat_ws(":", "strategy", F.col("attempt_no").cast("string"), "agent_action", "tool_result")
        own = near.groupBy("transaction_id").agg(F.sort_array(F.collect_list(F.struct(*place, text.alias("t")))).alias("l"))
        return own.select("transaction_id", F.transform("l", lambda x: x["t"]).alias(name))

    return (counts.join(end("first_actions", place), "transaction_id")
            .join(end("last_actions", [F.desc(c) for c in place]), "transaction_id"))


def enrich(transactions: DataFrame, customers: DataFrame, invoices: DataFrame,
           outcomes: DataFrame | None = None, prior_audit: DataFrame | None = None) -> DataFrame:
    """One row per transaction with every input the decision needs.

    Draws: if ``transactions`` already carries ``u_bp`` no outcome join is
    made; otherwise ``outcomes(transaction_id, u_bp)`` is left-joined, and a
    transaction without a draw fails its attempts.  The same holds for the
    ``prior_*`` history columns and ``prior_audit``.
    """
    return with_context(transactions, customer_context(customers, invoices), outcomes, prior_audit)


def with_context(transactions: DataFrame, ctx: DataFrame, outcomes: DataFrame | None = None,
                 prior_audit: DataFrame | None = None) -> DataFrame:
    """:func:`enrich` with a prepared :func:`customer_context`."""
    tx = transactions
    if "u_bp" not in tx.columns:
        if outcomes is None:
            tx = tx.withColumn("u_bp", F.lit(None).cast("int"))
        else:
            tx = tx.join(outcomes.select("transaction_id", "u_bp"), "transaction_id", "left")
    df = lookup_join(tx, ctx, "customer_id", "left")
    if "prior_executions" in df.columns:
        pass  # the caller's rows carry their history already
    elif prior_audit is not None:
        df = df.join(history(prior_audit), "transaction_id", "left")  # unique on both sides
    else:
        df = (df.withColumn("prior_executions", F.lit(0).cast("long"))
              .withColumn("prior_automated", F.lit(0).cast("long"))
              .withColumn("prior_terminal", F.lit(False))
              .withColumn("prior_success", F.lit(False))
              .withColumn("prior_last_action", F.lit(None).cast("string"))
              .withColumn("prior_actions", F.array().cast("array<string>")))
    has = "coalesce(has_customer, false)"
    default_rate = f"CAST({C.DEFAULT_RATE} AS DECIMAL(5,2))"
    no_actions = "CAST(array() AS ARRAY<STRING>)"
    return df.selectExpr(
        "transaction_id", "customer_id", "amount", "payment_method", "status", "failure_code",
        "retry_count", "timestamp", "recovery_status", "recovered_amount", "u_bp",
        f"{has} AS has_customer",
        "customer_type", "lifetime_value", "contact_preference", "stored_rate",
        "invoice_id", "invoice_amount_due", "invoice_promise_to_pay",
        # the risk score reads a missing customer, and a rate of 0 or NULL, as 1.0
        f"CASE WHEN {has} THEN coalesce(nullif(stored_rate, CAST(0 AS DECIMAL(5,2))), CAST(1 AS DECIMAL(5,2))) ELSE CAST(1 AS DECIMAL(5,2)) END AS risk_rate",
        f"CASE WHEN {has} THEN coalesce(stored_rate, {default_rate}) ELSE {default_rate} END AS erv_rate",
        f"CASE WHEN {has} THEN coalesce(lifetime_value, CAST(0 AS DECIMAL(18,2))) ELSE CAST(0 AS DECIMAL(18,2)) END AS ltv",
        f"{has} AND coalesce(stored_risk_flag, false) AS risk_flag",
        f"CASE WHEN {has} THEN lower(coalesce(contact_preference, 'email')) ELSE 'email' END AS preference",
        "invoice_days_overdue AS days_overdue",
        "CAST(coalesce(prior_executions, 0) AS BIGINT) AS prior_executions",
        "CAST(coalesce(prior_automated, 0) AS BIGINT) AS prior_automated",
        "coalesce(prior_terminal, false) AS prior_terminal",
        "coalesce(prior_success, false) AS prior_success",
        "prior_last_action",
        f"coalesce(prior_actions, {no_actions}) AS prior_actions",
    )
