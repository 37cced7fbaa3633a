"""Operator-facing tables: lookups, filters, control-room rows, the 360 view
and display formats (PF-01..PF-07, PF-12, JN-05, AG-23, SX-19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C


def label(col: Column, labels: dict[str, str]) -> Column:
    """``LABELS.get(x, x)`` as a literal map lookup (PF-12); no join."""
    m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(m[col], col)


def lookup(ids: DataFrame, transactions: DataFrame) -> DataFrame:
    """PF-01 for a set of ids: every requested id with a ``found`` flag."""
    t = transactions.select("transaction_id", "customer_id", "amount", "status", F.lit(True).alias("_f"))
    return (ids.join(t, "transaction_id", "left")
            .withColumn("found", F.coalesce(F.col("_f"), F.lit(False))).drop("_f"))


def list_view(transactions: DataFrame) -> DataFrame:
    """PF-05: the 8-column list projection (no recovery columns)."""
    return transactions.select("transaction_id", "customer_id", "amount", "payment_method", "status",
                               "failure_code", "retry_count", "timestamp")


def control_room(transactions: DataFrame) -> DataFrame:
    """PF-07: initial status FAILED, recovery status defaulted with legacy
    SUCCESS read as RECOVERED, recovered amount defaulted, failure label."""
    rs = F.coalesce(F.col("recovery_status"), F.lit("UNRECOVERED"))
    return transactions.select(
        "transaction_id", "customer_id", "amount", "payment_method",
        F.lit("FAILED").alias("initial_status"),
        F.when(rs == "SUCCESS", "RECOVERED").otherwise(rs).alias("recovery_status"),
        F.coalesce(F.col("recovered_amount"), F.lit(0).cast("decimal(18,2)")).alias("recovered_amount"),
        "failure_code",
        label(F.col("failure_code"), C.FAILURE_LABELS).alias("failure_reason"),
        "retry_count", "timestamp",
    )


def faceted(rows: DataFrame, status: str = "All", reason: str = "All", search: str = "") -> DataFrame:
    """PF-03 / PF-04: composable equality facets ("All" = no filter) and a
    case-insensitive search on the id (regex, as typed)."""
    out = rows
    if status != "All":
        out = out.where(F.col("recovery_status") == status)
    if reason != "All":
        out = out.where(F.col("failure_reason") == reason)
    if search:
        out = out.where(F.col("transaction_id").rlike("(?i)" + search))
    return out


def failure_reasons(rows: DataFrame) -> DataFrame:
    """AG-23: distinct non-null failure reasons for the facet."""
    return rows.where(F.col("failure_reason").isNotNull()).select("failure_reason").distinct()


def transaction_360(wide: DataFrame, strategy: str, run_ts: str | None = None) -> DataFrame:
    """JN-05: every transaction with its customer, first invoice and trail, one row
    per trail entry (long form, so a long trail is never one value); a
    transaction without trail has one row with NULL trail columns.  The wide
    row holds the context already, so the only join is the one on the unique
    transaction id."""
    from .audit import audit_rows
    context = wide.select("transaction_id", "customer_id", "amount", "failure_code", "recovery_status", "customer_type",
                          "lifetime_value", "contact_preference", "invoice_id", "invoice_amount_due", "days_overdue")
    trail = audit_rows(wide, strategy, run_ts=run_ts).select(
        "transaction_id", "attempt_no", "stage_no", "stage", "timestamp", "agent_action", "policy_result", "tool_result",
        "amount_recovered", "reason")
    return context.join(trail, "transaction_id", "left")


def nested_360(context: DataFrame, trail: DataFrame) -> DataFrame:
    """JN-05, nested: every transaction of ``context`` with its trail as one ordered array
    (a run writes at most ten rows of a transaction; for trails of many runs use the long
    form).  Both inputs bucketed by transaction id: no exchange."""
    entry = F.struct("attempt_no", "stage_no", "stage", "agent_action", "policy_result", "tool_result", "amount_recovered", "reason")
    own = trail.groupBy("transaction_id").agg(F.sort_array(F.collect_list(entry)).alias("trail"))
    return context.join(own, "transaction_id", "left")


def audit_timeline(audit: DataFrame) -> DataFrame:
    """TK-03: audit rows in the order of their time, then of their key."""
    return audit.orderBy("timestamp", "transaction_id", "attempt_no", "stage_no")


def filtered_head(rows: DataFrame, n: int = 100, **facets) -> DataFrame:
    """TK-04: the first ``n`` rows by id of the filtered view."""
    return faceted(rows, **facets).orderBy("transaction_id").limit(n)


def formatted_kpis(summary: DataFrame) -> DataFrame:
    """SX-19: display texts of the strategy summary (lakh scaling, thousands
    separators, percent text)."""
    return summary.select(
        "strategy",
        F.concat(F.lit("₹"), F.format_number(F.col("net_recovery") / 1e5, 2), F.lit("L")).alias("net_lakh"),
        F.concat(F.lit("INR "), F.format_number(F.col("revenue_recovered"), 2)).alias("revenue_text"),
        F.concat(F.format_number(F.col("revenue_recovery_rate"), 2), F.lit("%")).alias("rate_text"),
    )
