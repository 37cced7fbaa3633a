"""Domain tables derived from the TPC-H-style driver tables.

The domain has customers, transactions, invoices and recorded outcome draws.
The test data ships TPC-H ``customer`` and ``orders``; these views map them to
the domain deterministically (integer arithmetic on keys, decimals for money),
so Spark and the SQL oracle derive identical rows.  All work stays in Spark and
grows with ``orders`` / ``customer``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions import sqltext as S
from ..schemas import MONEY
from ..session import spread_small


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pad(k: str, prefix: str) -> Column:
    return F.expr(f"concat('{prefix}', lpad(CAST({k} AS STRING), 10, '0'))")


def customers_view(customer: DataFrame, orders: DataFrame) -> DataFrame:
    stats = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.count_if(F.col("o_orderstatus") != "P").alias("n_ok"),
        F.expr("sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END)").alias("f_total"),
    )
    c = customer.select("c_custkey", "c_acctbal").join(
        stats, customer.c_custkey == stats.o_custkey, "left")
    is_new = "(c_custkey * 17 + 5) % 11 < 4"
    rate = "CAST(CAST(floor(n_ok * 100 / n_orders) AS DECIMAL(5,0)) * 0.01 AS DECIMAL(5,2))"
    return c.select(
        _pad("c_custkey", "C").alias("customer_id"),
        F.expr(f"CASE WHEN {is_new} THEN 'new' ELSE 'returning' END").alias("customer_type"),
        F.expr(f"CAST(CASE WHEN {is_new} OR n_orders IS NULL THEN CAST(0 AS DECIMAL(18,2)) ELSE round(f_total * 0.05, 2) END AS DECIMAL(18,2))")
        .alias("lifetime_value"),
        F.expr(f"CASE WHEN {is_new} OR n_orders IS NULL THEN CAST(1 AS DECIMAL(5,2)) ELSE {rate} END").alias("previous_payment_success_rate"),
        F.expr("CASE WHEN (c_custkey * 5 + 3) % 13 < 8 THEN 'email' WHEN (c_custkey * 5 + 3) % 13 < 12 THEN 'sms' ELSE 'none' END")
        .alias("contact_preference"),
        F.expr("c_acctbal < -780").alias("risk_flag"),
    )


def _failure_code(k: str) -> Column:
    b = f"(({k} * 37 + 17) % 100)"
    return F.expr(f"CASE WHEN {b} < 20 THEN 'BANK_TIMEOUT' WHEN {b} < 40 THEN 'TEMPORARY_BANK_ERROR' WHEN {b} < 70 THEN 'INSUFFICIENT_FUNDS' "
                  f"WHEN {b} < 85 THEN 'CARD_EXPIRED' WHEN {b} < 95 THEN 'LIMIT_EXCEEDED' WHEN {b} < 98 THEN 'CUSTOMER_DECLINED' "
                  f"WHEN {b} = 98 THEN 'UNKNOWN_ERROR' END")


def _draw(k: str) -> Column:
    return F.expr(f"CAST(((({k} * 48271 + 11) % 2147483647) * 69621) % 2147483647 % 10000 AS INT)")


def _amount(k: str) -> Column:
    factor = f"CAST(CASE WHEN ({k} * 31 + 7) % 23 = 0 THEN 0.160 ELSE 0.049 END AS DECIMAL(4,3))"
    return F.expr(f"CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * {factor}, 2) AS DECIMAL(18,2))")


def transactions_view(orders: DataFrame, with_draw: bool = False) -> DataFrame:
    """Transactions; ``with_draw`` also keeps the recorded draw ``u_bp`` of the
    same order row, so callers that need both avoid a self-join."""
    k = "o_orderkey"
    method = (f"CASE WHEN ({k} * 37 + 17) % 100 BETWEEN 70 AND 84 THEN 'CARD' WHEN {k} % 3 = 0 THEN 'UPI' WHEN {k} % 3 = 1 THEN 'CARD' "
              "ELSE 'NETBANKING' END")
    cols = [
        _pad(k, "TX").alias("transaction_id"),
        _pad("o_custkey", "C").alias("customer_id"),
        _amount(k).alias("amount"),
        F.expr(method).alias("payment_method"),
        F.lit("FAILED").alias("status"),
        _failure_code(k).alias("failure_code"),
        F.lit(0).alias("retry_count"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp"),
        F.lit("UNRECOVERED").alias("recovery_status"),
        F.lit(0).cast(MONEY).alias("recovered_amount"),
    ]
    if with_draw:
        cols.append(_draw(k).alias("u_bp"))
    return orders.select(*cols)


def edge_transactions_view(orders: DataFrame) -> DataFrame:
    """Transactions with shapes that clean input lacks, by key % 11: 0 NULL amount;
    1 negative amount; 2 negative retry count; 3 RECOVERED; 4 legacy SUCCESS;
    5 NULL customer; 6 and 7 one and two retries before; otherwise as usual."""
    t = transactions_view(orders, with_draw=True)
    tg = F.substring("transaction_id", 3, 10).cast("long") % 11
    return t.withColumns({
        "amount": F.when(tg == 0, F.lit(None)).when(tg == 1, -F.col("amount")).otherwise(F.col("amount")).cast(MONEY),
        "retry_count": F.when(tg == 2, -1).when(tg == 6, 1).when(tg == 7, 2).otherwise(F.col("retry_count")).cast("int"),
        "recovery_status": F.when(tg == 3, "RECOVERED").when(tg == 4, "SUCCESS").otherwise(F.col("recovery_status")),
        "recovered_amount": F.when(tg.isin(3, 4), F.col("amount")).otherwise(F.col("recovered_amount")).cast(MONEY),
        "customer_id": F.when(tg != 5, F.col("customer_id")),
    })


def outcomes_view(orders: DataFrame) -> DataFrame:
    return orders.select(_pad("o_orderkey", "TX").alias("transaction_id"), _draw("o_orderkey").alias("u_bp"))


def invoices_view(orders: DataFrame) -> DataFrame:
    k = "o_orderkey"
    days = f"CAST(({k} * 29 + 3) % 46 AS INT)"
    return (orders
            .where(F.expr(f"(({k} * 37 + 17) % 100 BETWEEN 40 AND 69) OR (({k} * 37 + 17) % 100 BETWEEN 95 AND 97) OR ({k} * 3 + 1) % 7 = 0"))
            .select(
                _pad(k, "INV").alias("invoice_id"),
                _pad("o_custkey", "C").alias("customer_id"),
                _amount(k).alias("amount_due"),
                F.expr(f"date_sub(to_date(o_orderdate), {days})").alias("due_date"),
                F.expr(days).alias("days_overdue"),
                F.lit(False).alias("promise_to_pay"),
            ))


def prior_audit_view(orders: DataFrame) -> DataFrame:
    """Execution rows of an earlier run (resume / history input).

    key % 17: 0 -> schedule_retry FAILURE; 1 -> schedule_retry then
    create_payment_link, both FAILURE; 2 -> escalate_to_human; 3 ->
    retry_payment SUCCESS; otherwise no row.
    """
    k = F.col("o_orderkey")
    g = k % 17
    rows = F.when(g == 0, F.array(F.struct(F.lit(1).alias("n"), F.lit("schedule_retry").alias("a"), F.lit("FAILURE").alias("r")))) \
        .when(g == 1, F.array(F.struct(F.lit(1).alias("n"), F.lit("schedule_retry").alias("a"), F.lit("FAILURE").alias("r")),
                              F.struct(F.lit(2).alias("n"), F.lit("create_payment_link").alias("a"), F.lit("FAILURE").alias("r")))) \
        .when(g == 2, F.array(F.struct(F.lit(1).alias("n"), F.lit("escalate_to_human").alias("a"), F.lit("FAILURE").alias("r")))) \
        .when(g == 3, F.array(F.struct(F.lit(1).alias("n"), F.lit("retry_payment").alias("a"), F.lit("SUCCESS").alias("r"))))
    base = orders.select(k, _pad("o_orderkey", "TX").alias("transaction_id"),
                         _amount("o_orderkey").alias("amount"),
                         F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp"),
                         rows.alias("rows")).filter(F.col("rows").isNotNull())
    e = base.select("transaction_id", "amount", "timestamp", F.explode("rows").alias("x"))
    return e.select(
        F.lit("prior").alias("strategy"),
        "transaction_id",
        F.col("x.n").cast("int").alias("attempt_no"),
        F.lit(4).alias("stage_no"),
        "timestamp",
        F.lit("execution").alias("stage"),
        F.col("x.a").alias("agent_action"),
        F.lit("APPROVED").alias("policy_result"),
        F.col("x.r").alias("tool_result"),
        F.when(F.col("x.r") == "SUCCESS", F.col("amount")).otherwise(F.lit(0).cast(MONEY)).alias("amount_recovered"),
        F.lit(None).cast("string").alias("reason"),
        F.lit(0).cast("long").alias("latency_us"),
    )


def audit_runs_view(orders: DataFrame) -> DataFrame:
    """Execution rows of three runs, out of order in time, some written twice.  Order k has
    k % 6 executions; those of every third order belong to the one transaction TXHOT."""
    rows = orders.select(F.col("o_orderkey").alias("k"), "o_orderdate").where("k % 6 > 0").select(
        "k", "o_orderdate", F.explode(F.sequence(F.lit(1), (F.col("k") % 6).cast("int"))).alias("i"))
    actions = ", ".join(S.quoted(a) for a in C.ACTION_NAMES)
    twice = F.explode(F.expr("CASE WHEN (k + i) % 4 = 0 THEN array(0, 1) ELSE array(0) END")).alias("copy")
    return rows.select("*", twice).select(
        F.expr("concat('run', CAST(i % 3 AS STRING))").alias("strategy"),
        F.when(F.col("k") % 3 == 0, "TXHOT").otherwise(_pad("k", "TX")).alias("transaction_id"),
        F.expr("CAST(CASE WHEN k % 3 = 0 THEN k * 6 + i ELSE i END AS INT)").alias("attempt_no"), F.lit(4).alias("stage_no"),
        F.expr("CAST(o_orderdate AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, CAST((i * 37 + k) % 50 AS INT), 0)").alias("timestamp"),
        F.lit("execution").alias("stage"), F.expr(f"element_at(array({actions}), CAST((k * 7 + i * 5) % 7 AS INT) + 1)").alias("agent_action"),
        F.lit("APPROVED").alias("policy_result"), F.expr("CASE WHEN (k + i) % 9 = 0 THEN 'SUCCESS' ELSE 'FAILURE' END").alias("tool_result"),
        F.lit(0).cast(MONEY).alias("amount_recovered"), F.lit(None).cast("string").alias("reason"), F.lit(0).cast("long").alias("latency_us"))


def responses_view(orders: DataFrame) -> DataFrame:
    """Recorded model responses, and how long they took (``delay_s``, 0 to 19 seconds).

    Attempt 1, by key % 5: 0 valid JSON; 1 the same in a code fence; 2 malformed JSON;
    3 a cause outside the allowed set; 4 no row.  Valid ones name the code's cause, but
    where key % 3 = 0 the cause of number (key div 3) % 6.  Attempt 2, by key % 4: 0 and 1
    valid, with the cause of number (key div 7) % 6; 2 malformed; 3 no row."""
    classes = [*C.CODE_CLASSES, "OTHER"]
    array = lambda values: f"array({', '.join(values)})"
    causes = array([S.quoted(c) for c in C.ROOT_CAUSES])
    code_class = S.lookup("code", {code: str(i) for i, c in enumerate(classes[:-1]) for code in C.CODE_CLASSES[c]}, str(len(classes) - 1))
    body = ("to_json(named_struct('root_cause', {cause}, 'confidence', conf, 'recommended_action', action, "
            "'reason', 'Recorded model diagnosis.', 'why_not_alternatives', 'Alternatives have lower expected value.'))")
    bad = ("to_json(named_struct('root_cause', 'network_glitch', 'confidence', 0.7D, 'recommended_action', 'retry_payment', "
           "'reason', 'Recorded model diagnosis.', 'why_not_alternatives', 'n/a'))")
    broken = S.quoted('{"root_cause": "insufficient_funds", "confidence": ')
    rows = orders.select(F.col("o_orderkey").alias("k"), _failure_code("o_orderkey").alias("code"))
    rows = rows.withColumn("c", F.expr(code_class))
    rows = rows.withColumns({
        "cause": F.expr(f"element_at({array([S.quoted(C.CLASS_TO_CAUSE[c]) for c in classes])}, c + 1)"),
        "conf": F.expr(f"element_at({array([f'{C.FALLBACK[c][1]}D' for c in classes])}, c + 1)"),
        "action": F.expr(f"element_at({array([S.quoted(C.FALLBACK[c][2][0]) for c in classes])}, c + 1)")})
    first = body.format(cause=f"CASE WHEN k % 3 = 0 THEN element_at({causes}, CAST(k div 3 % 6 AS INT) + 1) ELSE cause END")
    second = body.format(cause=f"element_at({causes}, CAST(k div 7 % 6 AS INT) + 1)")
    rows = rows.withColumns({"good": F.expr(first), "other": F.expr(second)})
    rows = rows.withColumns({
        "first": F.expr(f"CASE k % 5 WHEN 0 THEN good WHEN 1 THEN concat('```json\n', good, '\n```') WHEN 2 THEN {broken} WHEN 3 THEN {bad} END"),
        "second": F.expr(f"CASE WHEN k % 4 < 2 THEN other WHEN k % 4 = 2 THEN {broken} END")})
    both = F.expr("explode(array(named_struct('n', 1, 'text', first, 'delay', k % 20), named_struct('n', 2, 'text', second, 'delay', k * 7 % 20)))")
    return (rows.select(_pad("k", "TX").alias("transaction_id"), both.alias("x")).where("x.text IS NOT NULL")
            .select("transaction_id", F.col("x.n").alias("attempt_no"), F.col("x.text").alias("response_text"),
                    F.col("x.delay").cast("int").alias("delay_s")))


@dataclass
class Inputs:
    customers: DataFrame
    transactions: DataFrame   # carries u_bp (recorded draw) as an extra column
    invoices: DataFrame
    orders: DataFrame


def load_inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    orders = _read(spark, sf_dir, "orders")
    customer = _read(spark, sf_dir, "customer")
    return Inputs(
        customers=customers_view(customer, orders),
        transactions=transactions_view(spread_small(orders), with_draw=True),
        invoices=invoices_view(orders),
        orders=orders,
    )
