"""DuckDB SQL oracles for the registered queries.

Written independently of the Spark code path: the attempt loop is expressed
as ranks over a candidate table (attempt 1 = best approved candidate, attempt
2 = the second best, since the only state change between them is the history
of one action) and static CASE tables for the rules strategy.  Rule values come
from :mod:`dunning.catalog` as VALUES lists.
"""

from __future__ import annotations

from .. import catalog as C


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(xs) -> str:
    return "(" + ", ".join(_q(x) for x in xs) + ")"


def _prob_values() -> str:
    rows = []
    for a, order, rc, ec, kind in C.ACTIONS:
        if kind != "automated":
            continue
        table, up, down, floor = C.PROBABILITY[a]
        for cls in list(C.CODE_CLASSES) + ["OTHER"]:
            rows.append(f"({_q(a)}, {order}, {rc}, {ec}, {_q(cls)}, {table[cls]}, {up}, {down}, {floor})")
    return ("SELECT * FROM (VALUES " + ", ".join(rows)
            + ") AS v(action, ord, rank_cost, eval_cost, cls, base, up, down, floor)")


def _eval_cost_case(col: str) -> str:
    parts = " ".join(f"WHEN {col} = {_q(a)} THEN {ec}" for a, _, _, ec, _ in C.ACTIONS)
    return f"CAST(CASE {parts} ELSE {C.UNKNOWN_ACTION_EVAL_COST} END AS DOUBLE)"


CLS_CASE = (
    "CASE WHEN upper(coalesce(failure_code, '')) IN ('BANK_TIMEOUT', 'TEMPORARY_BANK_ERROR') THEN 'BANK' "
    "WHEN upper(coalesce(failure_code, '')) = 'INSUFFICIENT_FUNDS' THEN 'INSUFF' "
    "WHEN upper(coalesce(failure_code, '')) = 'CARD_EXPIRED' THEN 'EXPIRED' "
    "WHEN upper(coalesce(failure_code, '')) = 'LIMIT_EXCEEDED' THEN 'LIMIT' "
    "WHEN upper(coalesce(failure_code, '')) = 'CUSTOMER_DECLINED' THEN 'DECLINED' ELSE 'OTHER' END"
)

BASE = f"""
ostats AS (
  SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'P') AS ok,
         sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS f_total
  FROM orders GROUP BY o_custkey),
customers AS (
  SELECT 'C' || lpad(CAST(c.c_custkey AS VARCHAR), 10, '0') AS customer_id,
         CASE WHEN (c.c_custkey * 17 + 5) % 11 < 4 THEN 'new' ELSE 'returning' END AS customer_type,
         CAST(CASE WHEN (c.c_custkey * 17 + 5) % 11 < 4 OR s.n IS NULL THEN 0
                   ELSE round(s.f_total * CAST(0.05 AS DECIMAL(2,2)), 2) END AS DECIMAL(18,2)) AS lifetime_value,
         CASE WHEN (c.c_custkey * 17 + 5) % 11 < 4 OR s.n IS NULL THEN CAST(1 AS DECIMAL(5,2))
              ELSE CAST(CAST((100 * s.ok) // s.n AS DECIMAL(5,0)) * CAST(0.01 AS DECIMAL(2,2)) AS DECIMAL(5,2))
         END AS previous_payment_success_rate,
         CASE WHEN (c.c_custkey * 5 + 3) % 13 < 8 THEN 'email' WHEN (c.c_custkey * 5 + 3) % 13 < 12 THEN 'sms'
              ELSE 'none' END AS contact_preference,
         c.c_acctbal < -780 AS risk_flag
  FROM customer c LEFT JOIN ostats s ON c.c_custkey = s.o_custkey),
ob AS (SELECT o_orderkey AS k, o_custkey, o_totalprice, o_orderdate, (o_orderkey * 37 + 17) % 100 AS b FROM orders),
tx0 AS (
  SELECT k, 'TX' || lpad(CAST(k AS VARCHAR), 10, '0') AS transaction_id,
         'C' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS customer_id,
         CAST(round(CAST(o_totalprice AS DECIMAL(18,2))
              * CAST(CASE WHEN (k * 31 + 7) % 23 = 0 THEN 0.160 ELSE 0.049 END AS DECIMAL(4,3)), 2) AS DECIMAL(18,2)) AS amount,
         CASE WHEN b < 20 THEN 'BANK_TIMEOUT' WHEN b < 40 THEN 'TEMPORARY_BANK_ERROR' WHEN b < 70 THEN 'INSUFFICIENT_FUNDS'
              WHEN b < 85 THEN 'CARD_EXPIRED' WHEN b < 95 THEN 'LIMIT_EXCEEDED' WHEN b < 98 THEN 'CUSTOMER_DECLINED'
              WHEN b = 98 THEN 'UNKNOWN_ERROR' END AS failure_code,
         CAST(o_orderdate AS TIMESTAMP) AS ts,
         CAST((((k * 48271 + 11) % 2147483647) * 69621) % 2147483647 % 10000 AS INTEGER) AS u_bp
  FROM ob),
transactions AS (
  SELECT k, transaction_id, customer_id, amount,
         CASE WHEN failure_code = 'CARD_EXPIRED' THEN 'CARD' WHEN k % 3 = 0 THEN 'UPI' WHEN k % 3 = 1 THEN 'CARD'
              ELSE 'NETBANKING' END AS payment_method,
         'FAILED' AS status, failure_code, 0 AS retry_count, ts AS "timestamp", 'UNRECOVERED' AS recovery_status,
         CAST(0 AS DECIMAL(18,2)) AS recovered_amount, u_bp
  FROM tx0),
invoices AS (
  SELECT 'INV' || substr(transaction_id, 3) AS invoice_id, customer_id, amount AS amount_due,
         CAST(CAST("timestamp" AS DATE) - CAST((k * 29 + 3) % 46 AS INTEGER) AS DATE) AS due_date,
         CAST((k * 29 + 3) % 46 AS INTEGER) AS days_overdue, false AS promise_to_pay
  FROM transactions
  WHERE failure_code IN ('INSUFFICIENT_FUNDS', 'CUSTOMER_DECLINED') OR (k * 3 + 1) % 7 = 0),
fi AS (SELECT customer_id, min(invoice_id) AS invoice_id, arg_min(days_overdue, invoice_id) AS days_overdue
       FROM invoices GROUP BY customer_id),
e AS MATERIALIZED (
  SELECT t.*, c.customer_id IS NOT NULL AS has_customer,
         CASE WHEN c.customer_id IS NULL THEN CAST(0.85 AS DECIMAL(5,2))
              ELSE coalesce(c.previous_payment_success_rate, CAST(0.85 AS DECIMAL(5,2))) END AS erv_rate,
         CASE WHEN c.customer_id IS NULL THEN CAST(0 AS DECIMAL(18,2)) ELSE coalesce(c.lifetime_value, 0) END AS ltv,
         coalesce(c.risk_flag, false) AS risk_flag,
         CASE WHEN c.customer_id IS NULL THEN 'email' ELSE lower(coalesce(c.contact_preference, 'email')) END AS preference,
         CASE WHEN c.customer_id IS NULL THEN CAST(1 AS DECIMAL(5,2))
              ELSE coalesce(nullif(c.previous_payment_success_rate, 0), CAST(1 AS DECIMAL(5,2))) END AS risk_rate,
         f.invoice_id, f.days_overdue,
         {CLS_CASE} AS cls,
         coalesce(t.amount, 0) >= {C.HIGH_VALUE_THRESHOLD} AS hv
  FROM transactions t LEFT JOIN customers c ON t.customer_id = c.customer_id
  LEFT JOIN fi f ON t.customer_id = f.customer_id),
pt AS ({_prob_values()}),
cand AS MATERIALIZED (
  SELECT e.transaction_id, pt.action, pt.ord, CAST(pt.rank_cost AS DECIMAL(5,1)) AS rank_cost,
         CAST(CASE WHEN e.erv_rate >= 0.90 THEN least(CAST({C.BAND_CAP} AS DECIMAL(3,2)), pt.base + pt.up)
                   WHEN e.erv_rate < 0.70 THEN greatest(CAST(pt.floor AS DECIMAL(3,2)), pt.base - pt.down)
                   ELSE pt.base END AS DECIMAL(3,2)) AS p
  FROM e JOIN pt ON pt.cls = e.cls
  UNION ALL
  SELECT transaction_id, 'escalate_to_human', 6, CAST(100 AS DECIMAL(5,1)),
         CAST(CASE WHEN ltv >= {C.HIGH_LTV} THEN {C.ESCALATE_PROB_HIGH_LTV} ELSE {C.ESCALATE_PROB} END AS DECIMAL(3,2))
  FROM e
  UNION ALL
  SELECT transaction_id, 'stop_recovery', 7, CAST(0 AS DECIMAL(5,1)), CAST(0 AS DECIMAL(3,2)) FROM e),
cv AS MATERIALIZED (
  SELECT c.*, e.amount,
         CAST(round(coalesce(e.amount, 0) * c.p, 2) AS DECIMAL(18,2)) AS expected_gross,
         CAST(round(coalesce(e.amount, 0) * c.p - c.rank_cost, 2) AS DECIMAL(18,2)) AS expected_net
  FROM cand c JOIN e USING (transaction_id)),
risk AS (
  SELECT transaction_id,
         CASE WHEN upper(coalesce(failure_code, '')) IN ('CARD_EXPIRED', 'LIMIT_EXCEEDED') THEN 20
              WHEN upper(coalesce(failure_code, '')) IN ('CUSTOMER_DECLINED', 'UNKNOWN_ERROR') THEN 15
              WHEN upper(coalesce(failure_code, '')) = 'INSUFFICIENT_FUNDS' THEN 10
              WHEN upper(coalesce(failure_code, '')) IN ('BANK_TIMEOUT', 'TEMPORARY_BANK_ERROR') THEN 5 ELSE 0 END AS sev,
         CAST(round(least(greatest(coalesce(amount, 0), 0), 50000) * CAST(0.0006 AS DECIMAL(4,4)), 1) AS DECIMAL(10,1)) AS af,
         CASE WHEN risk_flag THEN 25 WHEN risk_rate < 0.5 THEN 25 WHEN risk_rate < 0.8 THEN 15
              WHEN risk_rate < 0.95 THEN 5 ELSE 0 END AS hf,
         CASE WHEN greatest(coalesce(days_overdue, 0), 0) > 30 THEN 10 WHEN greatest(coalesce(days_overdue, 0), 0) > 10 THEN 7
              WHEN greatest(coalesce(days_overdue, 0), 0) > 0 THEN 3 ELSE 0 END AS odf
  FROM e),
rb AS (SELECT transaction_id, CAST(sev + af + hf + odf AS DECIMAL(10,1)) AS base, sev, af, hf, odf FROM risk)
"""


def _score(base: str, retry_factor: str) -> str:
    return f"CAST(least(round_even({base} + {retry_factor}, 0), 100) AS BIGINT)"


def _level(score: str) -> str:
    return (f"CASE WHEN {score} <= 30 THEN 'LOW' WHEN {score} <= 60 THEN 'MEDIUM' "
            f"WHEN {score} <= 80 THEN 'HIGH' ELSE 'CRITICAL' END")


def _money(x: str) -> str:
    return f"format('{{:,.2f}}', CAST({x} AS DOUBLE))"


def _describe(action: str, ok: str, p: str) -> str:
    return (f"CASE WHEN {action} = 'escalate_to_human' THEN {_q(C.OUTCOME_ESCALATED)} "
            f"WHEN {action} = 'stop_recovery' THEN {_q(C.OUTCOME_STOPPED)} "
            f"WHEN {ok} THEN 'Action ''' || {action} || ''' executed successfully. Recovered INR ' || {_money('amount')} || '.' "
            f"ELSE 'Action ''' || {action} || ''' executed but failed to recover funds (probability ' "
            f"|| CAST(CAST({p} * 100 AS INTEGER) AS VARCHAR) || '%).' END")


AUTOMATED = _in(C.AUTOMATED)
EXITS = _in(C.EXITS)
CONTACT = _in(C.CONTACT_ACTIONS)

# Optimizer with empty history: attempt k takes the k-th best approved
# automated candidate; the policy gate at attempt 1 and 2 is the same except
# for the duplicate rule, which removes exactly the first pick.
OPT = """,
ranked AS MATERIALIZED (
  SELECT cv.transaction_id, cv.action, cv.ord, cv.p, cv.expected_net,
         row_number() OVER (PARTITION BY cv.transaction_id ORDER BY cv.expected_net DESC, cv.ord) AS rn
  FROM cv JOIN e USING (transaction_id)
  WHERE cv.ord <= 5 AND NOT e.hv AND NOT e.risk_flag
    AND NOT (cv.action IN {contact} AND e.preference = 'none')),
opt0 AS (
  SELECT e.transaction_id, e.amount, e.failure_code, e.u_bp, e.hv OR e.risk_flag AS blocked, rb.base,
         r1.action AS a1, r1.p AS p1, r1.expected_net AS n1, r2.action AS a2, r2.p AS p2
  FROM e JOIN rb USING (transaction_id)
  LEFT JOIN ranked r1 ON r1.transaction_id = e.transaction_id AND r1.rn = 1
  LEFT JOIN ranked r2 ON r2.transaction_id = e.transaction_id AND r2.rn = 2),
opt1 AS (
  SELECT *, NOT blocked AND u_bp < p1 * 10000 AS ok1, NOT blocked AND u_bp < p2 * 10000 AS ok2 FROM opt0),
opt AS MATERIALIZED (
  SELECT transaction_id, amount, failure_code,
         CASE WHEN blocked OR ok1 THEN {s1} ELSE {s2} END AS risk_score,
         CASE WHEN blocked THEN 'stop_recovery' WHEN ok1 THEN a1 ELSE a2 END AS recommended_action,
         CASE WHEN blocked THEN 'ESCALATE' ELSE 'APPROVED' END AS policy_result,
         CASE WHEN blocked THEN 'escalate_to_human' WHEN ok1 THEN a1 WHEN ok2 THEN a2 ELSE 'escalate_to_human' END AS final_action,
         CASE WHEN NOT blocked AND (ok1 OR ok2) THEN 'SUCCESS' ELSE 'FAILURE' END AS status,
         CASE WHEN NOT blocked AND (ok1 OR ok2) THEN amount ELSE 0 END AS amount_recovered,
         CASE WHEN blocked OR ok1 THEN 1 WHEN ok2 THEN 2 ELSE 3 END AS execution_count,
         CASE WHEN blocked THEN 0 WHEN ok1 THEN 1 ELSE 2 END AS automated_attempts,
         p1, p2, ok1, ok2, blocked, a1, n1, a2
  FROM opt1)
""".format(contact=CONTACT,
           s1=_score("base", "0"),
           s2=_score("base", "CASE WHEN a1 = 'retry_payment' THEN 10 ELSE 0 END"))

# Rules strategy: two static picks, the guardrail as CASE.
RULES = """,
r0 AS (
  SELECT e.transaction_id, e.amount, e.failure_code, e.u_bp, e.hv, e.risk_flag, e.preference, rb.base,
         CASE e.cls {first} END AS rec1, CASE e.cls {later} END AS rec2
  FROM e JOIN rb USING (transaction_id)),
r1 AS (
  SELECT r0.*,
         CASE WHEN hv OR risk_flag THEN 'ESCALATE' WHEN rec1 IN {exits} THEN 'APPROVED'
              WHEN rec1 IN {contact} AND preference = 'none' THEN 'REJECTED' ELSE 'APPROVED' END AS pol1
  FROM r0),
r2 AS (
  SELECT r1.*, CASE WHEN pol1 = 'ESCALATE' THEN 'escalate_to_human' WHEN pol1 = 'REJECTED' THEN 'stop_recovery'
                    ELSE rec1 END AS fin1 FROM r1),
r3 AS (
  SELECT r2.*, c1.p AS p1, fin1 IN {automated} AND u_bp < c1.p * 10000 AS ok1
  FROM r2 LEFT JOIN cand c1 ON c1.transaction_id = r2.transaction_id AND c1.action = r2.fin1),
r4 AS (
  SELECT r3.*, fin1 IN {automated} AND NOT ok1 AS run2,
         CASE WHEN rec2 IN {exits} THEN 'APPROVED' WHEN rec2 = fin1 THEN 'REJECTED'
              WHEN rec2 IN {contact} AND preference = 'none' THEN 'REJECTED' ELSE 'APPROVED' END AS pol2
  FROM r3),
r5 AS (
  SELECT r4.*, CASE WHEN pol2 = 'REJECTED' THEN 'stop_recovery' ELSE rec2 END AS fin2 FROM r4),
r6 AS (
  SELECT r5.*, c2.p AS p2, fin2 IN {automated} AND u_bp < c2.p * 10000 AS ok2
  FROM r5 LEFT JOIN cand c2 ON c2.transaction_id = r5.transaction_id AND c2.action = r5.fin2),
rules AS MATERIALIZED (
  SELECT transaction_id, amount, failure_code,
         CASE WHEN run2 THEN {s2} ELSE {s1} END AS risk_score,
         CASE WHEN run2 THEN rec2 ELSE rec1 END AS recommended_action,
         CASE WHEN NOT run2 THEN pol1 WHEN fin2 IN {exits} OR ok2 THEN pol2 ELSE 'APPROVED' END AS policy_result,
         CASE WHEN NOT run2 THEN fin1 WHEN fin2 IN {exits} OR ok2 THEN fin2 ELSE 'escalate_to_human' END AS final_action,
         CASE WHEN (NOT run2 AND ok1) OR (run2 AND ok2) THEN 'SUCCESS' ELSE 'FAILURE' END AS status,
         CASE WHEN (NOT run2 AND ok1) OR (run2 AND ok2) THEN amount ELSE 0 END AS amount_recovered,
         CASE WHEN NOT run2 THEN 1 WHEN fin2 IN {exits} OR ok2 THEN 2 ELSE 3 END AS execution_count,
         (CASE WHEN fin1 IN {automated} THEN 1 ELSE 0 END) + (CASE WHEN run2 AND fin2 IN {automated} THEN 1 ELSE 0 END)
           AS automated_attempts,
         p1, p2, ok1, ok2, run2, fin1, fin2
  FROM r6)
""".format(
    first=" ".join(f"WHEN {_q(k)} THEN {_q(v[0])}" for k, v in C.RULES_ACTION.items()),
    later=" ".join(f"WHEN {_q(k)} THEN {_q(v[1])}" for k, v in C.RULES_ACTION.items()),
    exits=EXITS, contact=CONTACT, automated=AUTOMATED,
    s1=_score("base", "0"),
    s2=_score("base", "CASE WHEN fin1 = 'retry_payment' THEN 10 ELSE 0 END"))

BASELINE = """,
bl AS (
  SELECT e.transaction_id, e.amount, e.failure_code,
         NOT e.hv AND e.preference <> 'none' AS eligible, c.p,
         NOT e.hv AND e.preference <> 'none' AND e.u_bp < c.p * 10000 AS ok
  FROM e JOIN cand c ON c.transaction_id = e.transaction_id AND c.action = 'retry_payment'),
baseline AS MATERIALIZED (
  SELECT transaction_id, amount, failure_code, CAST(NULL AS BIGINT) AS risk_score, CAST(NULL AS VARCHAR) AS risk_level,
         CAST(NULL AS VARCHAR) AS recommended_action, CAST(NULL AS VARCHAR) AS policy_result,
         CASE WHEN eligible THEN 'retry_payment' ELSE 'stop_recovery' END AS final_action,
         CASE WHEN NOT eligible THEN 'FAILED' WHEN ok THEN 'SUCCESS' ELSE 'FAILURE' END AS status,
         CASE WHEN ok THEN amount ELSE 0 END AS amount_recovered,
         CASE WHEN eligible THEN 1 ELSE 0 END AS execution_count,
         CASE WHEN eligible THEN 1 ELSE 0 END AS automated_attempts,
         CASE WHEN eligible THEN {desc} ELSE {stopped} END AS description
  FROM bl)
""".format(desc=_describe("'retry_payment'", "ok", "p"), stopped=_q(C.BASELINE_STOPPED))


def _with(*parts: str) -> str:
    return "WITH " + BASE + "".join(parts)


def _result_select(src: str, desc: str) -> str:
    return f"""
SELECT transaction_id, CAST(amount AS DOUBLE) AS amount, failure_code, CAST(risk_score AS DOUBLE) AS risk_score,
       {_level('risk_score')} AS risk_level, recommended_action, policy_result, final_action, status,
       CAST(amount_recovered AS DOUBLE) AS amount_recovered, CAST(execution_count AS BIGINT) AS execution_count,
       CAST(automated_attempts AS BIGINT) AS automated_attempts, {_eval_cost_case('final_action')} AS cost,
       {desc} AS description
FROM {src}"""


def _final_desc() -> str:
    return (f"CASE WHEN final_action = 'escalate_to_human' THEN {_q(C.OUTCOME_ESCALATED)} "
            f"WHEN final_action = 'stop_recovery' THEN {_q(C.OUTCOME_STOPPED)} "
            f"WHEN status = 'SUCCESS' THEN 'Action ''' || final_action || ''' executed successfully. Recovered INR ' "
            f"|| {_money('amount')} || '.' ELSE NULL END")


UNION3 = """,
allres AS MATERIALIZED (
  SELECT 'baseline' AS strategy, transaction_id, amount, failure_code, risk_score, final_action, status,
         amount_recovered, execution_count, automated_attempts, policy_result FROM baseline
  UNION ALL SELECT 'rules', transaction_id, amount, failure_code, risk_score, final_action, status,
         amount_recovered, execution_count, automated_attempts, policy_result FROM rules
  UNION ALL SELECT 'optimizer', transaction_id, amount, failure_code, risk_score, final_action, status,
         amount_recovered, execution_count, automated_attempts, policy_result FROM opt)
"""

SUMMARY = """,
summ AS (
  SELECT strategy, count(*) AS transactions, sum(amount) AS revenue_at_risk,
         count(*) FILTER (WHERE status = 'SUCCESS') AS recovered,
         coalesce(sum(amount_recovered) FILTER (WHERE status = 'SUCCESS'), 0) AS revenue_recovered,
         sum({cost}) AS operational_cost,
         count(*) FILTER (WHERE final_action = 'escalate_to_human') AS escalated,
         count(*) FILTER (WHERE final_action = 'stop_recovery') AS stopped,
         sum(execution_count) AS executions, sum(automated_attempts) AS automated
  FROM allres GROUP BY strategy)
""".format(cost=_eval_cost_case("final_action").replace("AS DOUBLE", "AS DECIMAL(6,1)"))


def _pct(x: str, base: str) -> str:
    return f"CASE WHEN {base} > 0 THEN floor(CAST({x} AS DOUBLE) / CAST({base} AS DOUBLE) * 100 * 100 + 0.5) / 100 ELSE 0.0 END"


def oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["customers_scan"] = _with() + """
SELECT customer_id, customer_type, CAST(lifetime_value AS DOUBLE) AS lifetime_value,
       CAST(previous_payment_success_rate AS DOUBLE) AS previous_payment_success_rate, contact_preference, risk_flag
FROM customers"""
    o["transactions_scan"] = _with() + """
SELECT transaction_id, customer_id, CAST(amount AS DOUBLE) AS amount, payment_method, status, failure_code,
       CAST(retry_count AS BIGINT) AS retry_count, CAST("timestamp" AS VARCHAR) AS "timestamp", recovery_status,
       CAST(recovered_amount AS DOUBLE) AS recovered_amount
FROM transactions"""
    o["invoices_scan"] = _with() + """
SELECT invoice_id, customer_id, CAST(amount_due AS DOUBLE) AS amount_due, CAST(due_date AS VARCHAR) AS due_date,
       CAST(days_overdue AS BIGINT) AS days_overdue, promise_to_pay
FROM invoices"""
    o["enriched"] = _with() + """
SELECT transaction_id, customer_id, has_customer, CAST(erv_rate AS DOUBLE) AS erv_rate, CAST(ltv AS DOUBLE) AS ltv,
       risk_flag, preference, CAST(risk_rate AS DOUBLE) AS risk_rate, invoice_id,
       CAST(days_overdue AS DOUBLE) AS days_overdue
FROM e"""
    o["erv_candidates"] = _with() + """
SELECT transaction_id, action, CAST(ord AS BIGINT) AS catalog_order, CAST(p AS DOUBLE) AS probability,
       CAST(rank_cost AS DOUBLE) AS cost, CAST(expected_gross AS DOUBLE) AS expected_gross,
       CAST(expected_net AS DOUBLE) AS expected_net
FROM cv"""
    o["erv_ranked"] = _with() + """
SELECT transaction_id,
       CAST(row_number() OVER (PARTITION BY transaction_id ORDER BY expected_net DESC, ord) AS BIGINT) AS erv_rank,
       action, CAST(expected_net AS DOUBLE) AS expected_net
FROM cv"""
    o["best_action"] = _with(OPT) + f"""
SELECT transaction_id, CASE WHEN blocked THEN 'stop_recovery' ELSE a1 END AS best_action,
       CAST(CASE WHEN blocked THEN 0 ELSE n1 END AS DOUBLE) AS expected_net,
       CASE WHEN blocked THEN (CASE WHEN e.hv THEN 'HIGH_VALUE_THRESHOLD' ELSE 'CUSTOMER_FRAUD_FLAG' END)
            ELSE 'POLICY_APPROVED' END AS policy_rule,
       CASE WHEN blocked THEN 'escalate_to_human' ELSE a1 END AS executed_action
FROM opt JOIN e USING (transaction_id)"""
    o["risk_scores"] = _with() + f"""
SELECT transaction_id, {_score('base', '0')} AS risk_score, {_level(_score('base', '0'))} AS risk_level,
       CAST(sev AS BIGINT) AS failure_severity, CAST(af AS DOUBLE) AS amount_factor,
       CAST(hf AS BIGINT) AS customer_history_factor, CAST(0 AS BIGINT) AS retry_factor,
       CAST(odf AS BIGINT) AS overdue_factor,
       'Severity: ' || sev || ' (' || CASE WHEN upper(coalesce(failure_code, '')) = '' THEN 'UNKNOWN'
                                           ELSE upper(failure_code) END || '), '
       || 'Amount: ' || CAST(af AS VARCHAR) || ' (₹' || {_money('greatest(coalesce(amount, 0), 0)')} || '), '
       || 'History: ' || hf || ' (Success rate ' || format('{{:.2f}}', CAST(risk_rate AS DOUBLE)) || '), '
       || 'Retry: 0 (Count 0), '
       || 'Overdue: ' || odf || ' (' || greatest(coalesce(days_overdue, 0), 0) || ' days overdue)' AS reason
FROM rb JOIN e USING (transaction_id)"""
    sig = C.RISK_SIGNALS
    o["risk_signals"] = _with() + f"""
, s AS (
  SELECT transaction_id, list_filter([
    CASE WHEN upper(coalesce(failure_code, '')) IN ('CARD_EXPIRED', 'LIMIT_EXCEEDED') THEN 'High severity failure category: ' || upper(failure_code)
         WHEN upper(coalesce(failure_code, '')) IN ('CUSTOMER_DECLINED', 'UNKNOWN_ERROR') THEN 'Moderate severity failure category: ' || upper(failure_code)
         WHEN upper(coalesce(failure_code, '')) = 'INSUFFICIENT_FUNDS' THEN {_q(sig['sev_liquidity'])}
         WHEN upper(coalesce(failure_code, '')) IN ('BANK_TIMEOUT', 'TEMPORARY_BANK_ERROR') THEN {_q(sig['sev_transient'])} END,
    CASE WHEN greatest(coalesce(amount, 0), 0) >= 25000 THEN 'High value transaction amount: ₹' || {_money('greatest(coalesce(amount, 0), 0)')} END,
    CASE WHEN risk_flag THEN {_q(sig['fraud'])}
         WHEN risk_rate < 0.5 THEN 'Low customer historical success rate: ' || CAST(CAST(risk_rate * 100 AS INTEGER) AS VARCHAR) || '%'
         WHEN risk_rate < 0.8 THEN 'Sub-optimal customer success rate: ' || CAST(CAST(risk_rate * 100 AS INTEGER) AS VARCHAR) || '%' END,
    CAST(NULL AS VARCHAR),
    CASE WHEN greatest(coalesce(days_overdue, 0), 0) > 30 THEN 'Severely overdue customer invoice (' || days_overdue || ' days)'
         WHEN greatest(coalesce(days_overdue, 0), 0) > 10 THEN 'Moderately overdue invoice (' || days_overdue || ' days)'
         WHEN greatest(coalesce(days_overdue, 0), 0) > 0 THEN 'Recently overdue invoice (' || days_overdue || ' days)' END
  ], lambda x: x IS NOT NULL) AS sigs FROM e)
SELECT transaction_id, CAST(len(sigs) AS BIGINT) AS n_signals, array_to_string(sigs, ' | ') AS signals FROM s"""
    first = " ".join(f"WHEN {_q(k)} THEN {_q(v[0])}" for k, v in C.RULES_ACTION.items())
    later = " ".join(f"WHEN {_q(k)} THEN {_q(v[1])}" for k, v in C.RULES_ACTION.items())
    cause = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in C.CLASS_TO_CAUSE.items())
    fb_first = " ".join(f"WHEN {_q(k)} THEN {_q(v[2][0])}" for k, v in C.FALLBACK.items())
    fb_conf = " ".join(f"WHEN {_q(k)} THEN {v[1]}" for k, v in C.FALLBACK.items())
    fb_reason = " ".join(f"WHEN {_q(k)} THEN {_q(v[2][1])}" for k, v in C.FALLBACK.items())
    # flipping actions tried in the fixture history: retry_payment, send_payment_reminder
    fb_after = " ".join(
        f"WHEN {_q(k)} THEN {_q((v[3] if v[0] in ('retry_payment', 'send_payment_reminder') and v[3] else v[2])[0])}"
        for k, v in C.FALLBACK.items())
    fb_after_why = " ".join(
        f"WHEN {_q(k)} THEN {_q((v[3] if v[0] in ('retry_payment', 'send_payment_reminder') and v[3] else v[2])[2])}"
        for k, v in C.FALLBACK.items())
    o["diagnosis_rules"] = _with() + f"""
, d AS (SELECT transaction_id, cls, CASE cls {cause} END AS root_cause FROM e)
SELECT transaction_id, root_cause,
       CASE WHEN root_cause LIKE '%temporary_bank_failure%' OR root_cause LIKE '%bank_timeout%'
                 OR root_cause LIKE '%temporary_bank_error%' THEN 'BANK_TIMEOUT'
            WHEN root_cause LIKE '%insufficient%' THEN 'INSUFFICIENT_FUNDS'
            WHEN root_cause LIKE '%expired%' THEN 'CARD_EXPIRED'
            WHEN root_cause LIKE '%limit%' THEN 'LIMIT_EXCEEDED'
            WHEN root_cause LIKE '%decline%' THEN 'CUSTOMER_DECLINED' ELSE 'UNKNOWN' END AS rank_code,
       CASE cls {first} END AS rules_first, CASE cls {later} END AS rules_later,
       CASE cls {fb_first} END AS fallback_first, CAST(CASE cls {fb_conf} END AS DOUBLE) AS fallback_confidence,
       CASE cls {fb_reason} END AS fallback_reason,
       CASE cls {fb_after} END AS fallback_after_tried, CASE cls {fb_after_why} END AS fallback_after_tried_why
FROM d"""
    reasons = C.POLICY_REASONS
    o["policy_matrix"] = _with() + f"""
, g AS (
  SELECT e.transaction_id, e.amount, e.hv, e.risk_flag, e.preference = 'none' AS optout, e.status, e.recovery_status,
         a.action, n.attempts, h.tried
  FROM e, (SELECT unnest({[a for a in C.ACTION_NAMES] + ['unauthorized_action_xyz']}) AS action) a,
       (SELECT unnest([0, 1, 2]) AS attempts) n, (SELECT unnest([false, true]) AS tried) h),
r AS (
  SELECT g.*, CASE
      WHEN upper(coalesce(status, '')) = 'SUCCESS' OR upper(coalesce(recovery_status, 'UNRECOVERED')) IN ('RECOVERED', 'SUCCESS') THEN 'ALREADY_SUCCESSFUL'
      WHEN hv THEN 'HIGH_VALUE_THRESHOLD'
      WHEN risk_flag THEN 'CUSTOMER_FRAUD_FLAG'
      WHEN attempts >= {C.MAX_ATTEMPTS} AND action NOT IN {EXITS} THEN 'MAX_ATTEMPTS_EXHAUSTED'
      WHEN tried AND action NOT IN {EXITS} THEN 'DUPLICATE_ACTION'
      WHEN action IN {CONTACT} AND optout THEN 'COMMUNICATION_OPT_OUT'
      WHEN action IN {EXITS} THEN 'SAFETY_EXIT'
      WHEN action NOT IN {AUTOMATED} THEN 'UNSUPPORTED_ACTION'
      ELSE 'POLICY_APPROVED' END AS policy_rule
  FROM g),
v AS (
  SELECT r.*, CASE policy_rule {" ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in C.POLICY_RESULTS.items())} END AS result
  FROM r)
SELECT transaction_id, action, CAST(attempts AS BIGINT) AS attempts, tried, result = 'APPROVED' AS allowed, result,
       policy_rule,
       CASE policy_rule
         WHEN 'ALREADY_SUCCESSFUL' THEN {_q(reasons['ALREADY_SUCCESSFUL'])}
         WHEN 'HIGH_VALUE_THRESHOLD' THEN 'Amount (₹' || {_money('coalesce(amount, 0)')} || ') meets or exceeds high-value threshold (₹25,000.00). Escalating for human operations review.'
         WHEN 'CUSTOMER_FRAUD_FLAG' THEN {_q(reasons['CUSTOMER_FRAUD_FLAG'])}
         WHEN 'MAX_ATTEMPTS_EXHAUSTED' THEN {_q(reasons['MAX_ATTEMPTS_EXHAUSTED'])}
         WHEN 'DUPLICATE_ACTION' THEN 'Action ''' || action || ''' was already executed for transaction ''' || transaction_id || '''. Duplicate action blocked.'
         WHEN 'COMMUNICATION_OPT_OUT' THEN 'Action ''' || action || ''' rejected. Customer contact preference is set to ''none'' (opted out of communications).'
         WHEN 'SAFETY_EXIT' THEN 'Action ''' || action || ''' is a default safety exit action and is allowed.'
         WHEN 'UNSUPPORTED_ACTION' THEN 'Action ''' || action || ''' is not in the list of allowed bounded recovery actions.'
         ELSE 'Action ''' || action || ''' approved under current deterministic policy limits.' END AS reason,
       CASE WHEN result = 'ESCALATE' THEN 'escalate_to_human' WHEN result IN ('REJECTED', 'STOP') THEN 'stop_recovery'
            ELSE action END AS final_action
FROM v"""
    o["baseline_results"] = _with(BASELINE) + """
SELECT transaction_id, CAST(amount AS DOUBLE) AS amount, failure_code, CAST(risk_score AS DOUBLE) AS risk_score,
       risk_level, recommended_action,
       policy_result, final_action, status, CAST(amount_recovered AS DOUBLE) AS amount_recovered,
       CAST(execution_count AS BIGINT) AS execution_count, CAST(automated_attempts AS BIGINT) AS automated_attempts,
       """ + _eval_cost_case("final_action") + """ AS cost, description
FROM baseline"""
    o["rules_results"] = _with(RULES) + _result_select("rules", _final_desc())
    o["optimizer_results"] = _with(OPT) + _result_select("opt", _final_desc())
    o["strategy_summary"] = _with(BASELINE, RULES, OPT, UNION3, SUMMARY) + f"""
SELECT strategy, CAST(transactions AS BIGINT) AS transactions, CAST(revenue_at_risk AS DOUBLE) AS revenue_at_risk,
       CAST(recovered AS BIGINT) AS transactions_recovered, {_pct('recovered', 'transactions')} AS transaction_recovery_rate,
       CAST(revenue_recovered AS DOUBLE) AS revenue_recovered,
       {_pct('revenue_recovered', 'revenue_at_risk')} AS revenue_recovery_rate,
       CAST(operational_cost AS DOUBLE) AS operational_cost,
       CAST(revenue_recovered - operational_cost AS DOUBLE) AS net_recovery,
       CAST(escalated AS BIGINT) AS escalated_cases, CAST(stopped AS BIGINT) AS stopped_cases,
       CAST(executions AS DOUBLE) / CAST(transactions AS DOUBLE) AS avg_attempts_per_tx,
       CAST(automated AS BIGINT) AS automated_attempts
FROM summ"""
    o["uplift"] = _with(BASELINE, RULES, OPT, UNION3, SUMMARY) + f"""
, p AS (
  SELECT max(revenue_recovered) FILTER (WHERE strategy = 'baseline') AS bg,
         max(revenue_recovered) FILTER (WHERE strategy = 'rules') AS rg,
         max(revenue_recovered) FILTER (WHERE strategy = 'optimizer') AS og,
         max(revenue_recovered - operational_cost) FILTER (WHERE strategy = 'baseline') AS bn,
         max(revenue_recovered - operational_cost) FILTER (WHERE strategy = 'rules') AS rn,
         max(revenue_recovered - operational_cost) FILTER (WHERE strategy = 'optimizer') AS onet,
         max(revenue_at_risk) FILTER (WHERE strategy = 'optimizer') AS risk
  FROM summ)
SELECT CAST(og AS DOUBLE) - CAST(bg AS DOUBLE) AS gross_uplift_vs_baseline,
       {_pct('CAST(og AS DOUBLE) - CAST(bg AS DOUBLE)', 'risk')} AS gross_uplift_vs_baseline_pct,
       CAST(og AS DOUBLE) - CAST(rg AS DOUBLE) AS gross_uplift_vs_rules,
       {_pct('CAST(og AS DOUBLE) - CAST(rg AS DOUBLE)', 'risk')} AS gross_uplift_vs_rules_pct,
       CAST(onet AS DOUBLE) - CAST(bn AS DOUBLE) AS net_uplift_vs_baseline,
       CAST(onet AS DOUBLE) - CAST(rn AS DOUBLE) AS net_uplift_vs_rules
FROM p"""
    o["decision_changes"] = _with(RULES, OPT) + f"""
, d AS (SELECT count(*) AS n, count(*) FILTER (WHERE r.final_action IS DISTINCT FROM o.final_action) AS changed
        FROM rules r JOIN opt o USING (transaction_id))
SELECT CAST(changed AS BIGINT) AS decision_changes_count, {_pct('changed', 'n')} AS decision_change_rate FROM d"""
    o["distributions"] = _with(BASELINE, RULES, OPT, UNION3) + """
, vc AS (
  SELECT 'final_action' AS dimension, strategy, final_action AS value, CAST(count(*) AS BIGINT) AS n FROM allres GROUP BY ALL
  UNION ALL SELECT 'failure_code', strategy, failure_code, CAST(count(*) AS BIGINT) FROM allres GROUP BY ALL
  UNION ALL SELECT 'policy_result', strategy, policy_result, CAST(count(*) AS BIGINT) FROM allres GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY dimension, strategy ORDER BY n DESC, value NULLS LAST) AS BIGINT) AS place FROM vc"""
    o["funnel"] = _with(BASELINE, RULES, OPT, UNION3) + """
, f AS (
  SELECT strategy, count(*) AS ingested,
         count(*) FILTER (WHERE risk_score IS NOT NULL OR strategy = 'baseline') AS evaluated,
         count(*) FILTER (WHERE final_action IS NOT NULL) AS selected,
         count(*) FILTER (WHERE status = 'SUCCESS') AS recovered,
         count(*) FILTER (WHERE final_action = 'escalate_to_human') AS escalated
  FROM allres GROUP BY strategy)
SELECT strategy, CAST(1 AS BIGINT) AS stage_no, '1. Total Ingested Transactions' AS stage, CAST(ingested AS BIGINT) AS n FROM f
UNION ALL SELECT strategy, 2, '2. Evaluated for Recovery', evaluated FROM f
UNION ALL SELECT strategy, 3, '3. Intervention Selected', selected FROM f
UNION ALL SELECT strategy, 4, '4. Successfully Recovered', recovered FROM f
UNION ALL SELECT strategy, 5, '5. Escalated to Operations Queue', escalated FROM f"""
    o.update(_audit_oracles())
    from .oracles_state import edge_oracles, extra_oracles, model_stream_oracles, state_oracles
    o.update(state_oracles())
    o.update(model_stream_oracles())
    o["json_summary_roundtrip"] = o["strategy_summary"]
    o.update(extra_oracles())
    o.update(edge_oracles())
    return o


# Audit rows of the optimizer run, from the rank formulation.
AUDIT = """,
att AS (
  SELECT o.transaction_id, o.amount, o.blocked, o.ok1, o.ok2, o.a1, o.a2, o.p1, o.p2, o.n1,
         r2.expected_net AS n2, e.cls, rb.base, e.hv, e.k
  FROM opt o JOIN e USING (transaction_id) JOIN rb USING (transaction_id)
  LEFT JOIN ranked r2 ON r2.transaction_id = o.transaction_id AND r2.rn = 2),
steps AS (
  SELECT transaction_id, amount, k, 1 AS attempt_no, 0 AS before, {s1} AS score, cls,
         CASE WHEN blocked THEN 'stop_recovery' ELSE a1 END AS rec,
         CASE WHEN blocked THEN CAST(0 AS DECIMAL(18,2)) ELSE n1 END AS net,
         CASE WHEN blocked THEN (CASE WHEN hv THEN 'HIGH_VALUE_THRESHOLD' ELSE 'CUSTOMER_FRAUD_FLAG' END)
              ELSE 'POLICY_APPROVED' END AS rule,
         CASE WHEN blocked THEN 'escalate_to_human' ELSE a1 END AS fin,
         CASE WHEN blocked THEN CAST(0 AS DECIMAL(3,2)) ELSE p1 END AS p, coalesce(ok1, false) AS ok
  FROM att
  UNION ALL
  SELECT transaction_id, amount, k, 2, 1, {s2}, cls, a2, n2, 'POLICY_APPROVED', a2, p2, coalesce(ok2, false)
  FROM att WHERE NOT blocked AND NOT ok1),
stage_rows AS (
  SELECT transaction_id, attempt_no, 1 AS stage_no, 'risk_evaluation' AS stage, CAST(NULL AS VARCHAR) AS agent_action,
         CAST(NULL AS VARCHAR) AS policy_result, CAST(NULL AS VARCHAR) AS tool_result, CAST(0 AS DOUBLE) AS amount_recovered,
         'Risk Score: ' || score || ' (' || {level} || '). Attempts count: ' || before || '.' AS reason, k
  FROM steps
  UNION ALL
  SELECT transaction_id, attempt_no, 2, 'root_cause_analysis', rec, NULL, NULL, 0,
         'Diagnosed cause: ' || cause || '. Reason: ERV optimizer selected action with highest Expected Net Recovery (₹'
         || {net} || ') based on cause: ' || cause || '. | Alternatives reasoning: ' || {why}, k
  FROM (SELECT *, CASE cls {cause_case} END AS cause FROM steps)
  UNION ALL
  SELECT transaction_id, attempt_no, 3, 'policy_guardrail', rec,
         CASE WHEN rule = 'POLICY_APPROVED' THEN 'APPROVED' ELSE 'ESCALATE' END,
         NULL, 0,
         CASE rule WHEN 'POLICY_APPROVED' THEN 'Action ''' || rec || ''' approved under current deterministic policy limits.'
                   WHEN 'HIGH_VALUE_THRESHOLD' THEN 'Amount (₹' || {amt} || ') meets or exceeds high-value threshold (₹25,000.00). Escalating for human operations review.'
                   ELSE {fraud} END, k
  FROM steps
  UNION ALL
  SELECT transaction_id, attempt_no, 4, 'execution', fin, 'APPROVED', CASE WHEN ok THEN 'SUCCESS' ELSE 'FAILURE' END,
         CASE WHEN ok THEN CAST(amount AS DOUBLE) ELSE 0 END,
         CASE WHEN fin = 'escalate_to_human' THEN {esc}
              WHEN ok THEN 'Action ''' || fin || ''' executed successfully. Recovered INR ' || {amt} || '.'
              ELSE 'Action ''' || fin || ''' executed but failed to recover funds (probability '
                   || CAST(CAST(p * 100 AS INTEGER) AS VARCHAR) || '%).' END, k
  FROM steps
  UNION ALL
  SELECT transaction_id, 3, 3, 'policy_guardrail', 'escalate_to_human', 'APPROVED', NULL, 0, {budget}, k
  FROM att WHERE NOT blocked AND NOT ok1 AND NOT ok2
  UNION ALL
  SELECT transaction_id, 3, 4, 'execution', 'escalate_to_human', 'APPROVED', 'FAILURE', 0, {esc}, k
  FROM att WHERE NOT blocked AND NOT ok1 AND NOT ok2)
""".format(
    s1=_score("base", "0"),
    s2=_score("base", "CASE WHEN a1 = 'retry_payment' THEN 10 ELSE 0 END"),
    level=_level("score"),
    net=_money("net"),
    why=_q(C.OPTIMIZER_WHY_NOT),
    cause_case=" ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in C.CLASS_TO_CAUSE.items()),
    amt=_money("amount"),
    fraud=_q(C.POLICY_REASONS["CUSTOMER_FRAUD_FLAG"]),
    esc=_q(C.OUTCOME_ESCALATED),
    budget=_q(C.BUDGET_ESCALATION_REASON),
)


def _audit_oracles() -> dict[str, str]:
    w = _with(OPT, AUDIT)
    return {
        "audit_scan": w + """
SELECT transaction_id, CAST(attempt_no AS BIGINT) AS attempt_no, CAST(stage_no AS BIGINT) AS stage_no,
       '2026-01-01 00:00:00' AS "timestamp", stage, agent_action, policy_result, tool_result,
       CAST(amount_recovered AS DOUBLE) AS amount_recovered, reason
FROM stage_rows""",
        "actions_breakdown": w + """
SELECT agent_action, CAST(count(*) AS BIGINT) AS n FROM stage_rows WHERE stage = 'execution' GROUP BY agent_action""",
        "policy_breakdown": w + """
SELECT policy_result, CAST(count(*) AS BIGINT) AS n FROM stage_rows
WHERE stage = 'policy_guardrail' AND policy_result IS NOT NULL AND policy_result <> '' GROUP BY policy_result""",
        "stage_latency": w + """
, l AS (SELECT stage, avg(CAST((k * 13 + stage_no * 7) % 1000 AS DOUBLE)) AS avg_us,
               max((k * 13 + stage_no * 7) % 1000) AS max_us, count(*) AS n FROM stage_rows GROUP BY stage)
SELECT stage, array_to_string(list_transform(string_split(stage, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS stage_title,
       floor(avg_us + 0.5) / 1000.0 AS avg_latency_ms, CAST(max_us AS DOUBLE) / 1000.0 AS max_latency_ms,
       CAST(n AS BIGINT) AS invocations
FROM l""",
    }
