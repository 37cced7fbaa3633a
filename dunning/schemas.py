"""Declared schemas of the domain tables (no inference at read time)."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
RATE = T.DecimalType(5, 2)
PROB = T.DecimalType(3, 2)

CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("customer_type", T.StringType(), False),
    T.StructField("lifetime_value", MONEY, True),
    T.StructField("previous_payment_success_rate", RATE, True),
    T.StructField("contact_preference", T.StringType(), True),
    T.StructField("risk_flag", T.BooleanType(), True),
])

TRANSACTIONS = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("customer_id", T.StringType(), True),
    T.StructField("amount", MONEY, True),
    T.StructField("payment_method", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("failure_code", T.StringType(), True),
    T.StructField("retry_count", T.IntegerType(), True),
    T.StructField("timestamp", T.TimestampNTZType(), True),
    T.StructField("recovery_status", T.StringType(), True),
    T.StructField("recovered_amount", MONEY, True),
])

INVOICES = T.StructType([
    T.StructField("invoice_id", T.StringType(), False),
    T.StructField("customer_id", T.StringType(), True),
    T.StructField("amount_due", MONEY, True),
    T.StructField("due_date", T.DateType(), True),
    T.StructField("days_overdue", T.IntegerType(), True),
    T.StructField("promise_to_pay", T.BooleanType(), True),
])

OUTCOMES = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("u_bp", T.IntegerType(), False),
])

# Audit rows: the composite key (transaction_id, run_attempt, attempt_no,
# stage_no) replaces an autoincrement id, so assembly needs no global sort.
AUDIT = T.StructType([
    T.StructField("strategy", T.StringType(), False),
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("attempt_no", T.IntegerType(), False),
    T.StructField("stage_no", T.IntegerType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), True),
    T.StructField("stage", T.StringType(), False),
    T.StructField("agent_action", T.StringType(), True),
    T.StructField("policy_result", T.StringType(), True),
    T.StructField("tool_result", T.StringType(), True),
    T.StructField("amount_recovered", MONEY, True),
    T.StructField("reason", T.StringType(), True),
    T.StructField("latency_us", T.LongType(), True),
])

RESPONSES = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("attempt_no", T.IntegerType(), False),
    T.StructField("response_text", T.StringType(), True),
])

# Per-strategy result rows (one schema for every strategy; nullable columns).
RESULT_COLUMNS = [
    "strategy", "transaction_id", "amount", "failure_code", "risk_score", "risk_level",
    "root_cause", "recommended_action", "policy_result", "final_action", "status",
    "amount_recovered", "execution_count", "automated_attempts", "description", "cost",
]
