"""DuckDB oracles for run state, views, audit checks and resumable batches."""

from __future__ import annotations

from .. import catalog as C
from .oracles import (AUDIT, AUTOMATED, BASELINE, CONTACT, OPT, RULES, SUMMARY, UNION3, _eval_cost_case, _pct,
                      _q, _score, _with)

# Snapshot after the optimizer run, from the rank formulation.
SNAP = """,
snap AS (
  SELECT t.transaction_id, t.customer_id, t.amount, t.payment_method, t.status, t.failure_code, t."timestamp",
         CASE WHEN NOT o.blocked AND (o.a1 = 'retry_payment' OR (NOT o.ok1 AND o.a2 = 'retry_payment')) THEN 1 ELSE 0 END
           AS retry_count,
         CASE WHEN o.status = 'SUCCESS' THEN 'RECOVERED' WHEN o.final_action = 'escalate_to_human' THEN 'ESCALATED'
              WHEN o.final_action = 'stop_recovery' THEN 'STOPPED' ELSE 'FAILED' END AS recovery_status,
         CASE WHEN o.status = 'SUCCESS' THEN t.amount ELSE CAST(0 AS DECIMAL(18,2)) END AS recovered_amount
  FROM transactions t JOIN opt o USING (transaction_id))
"""

PRIOR = """,
prior AS (
  SELECT transaction_id, k % 17 AS g, amount FROM transactions WHERE k % 17 IN (0, 1, 2, 3)),
hist AS (
  SELECT transaction_id,
         CASE g WHEN 1 THEN 2 ELSE 1 END AS prior_executions,
         CASE g WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END AS prior_automated,
         g = 2 AS prior_terminal, g = 3 AS prior_success,
         CASE g WHEN 0 THEN 'schedule_retry' WHEN 1 THEN 'create_payment_link' WHEN 2 THEN 'escalate_to_human'
                ELSE 'retry_payment' END AS prior_last_action,
         CASE g WHEN 0 THEN 'schedule_retry' WHEN 1 THEN 'schedule_retry,create_payment_link'
                WHEN 2 THEN 'escalate_to_human' ELSE 'retry_payment' END AS prior_actions, g
  FROM prior)
"""


def _label_case(col: str) -> str:
    return ("CASE " + " ".join(f"WHEN {col} = {_q(k)} THEN {_q(v)}" for k, v in C.FAILURE_LABELS.items())
            + f" ELSE {col} END")


def state_oracles() -> dict[str, str]:
    o = {}
    w = _with(OPT, SNAP)
    lab = _label_case("failure_code")
    o["kpis"] = w + f"""
, g AS (SELECT count(*) AS n, sum(amount) AS risk,
               count(*) FILTER (WHERE recovery_status IN ('RECOVERED', 'SUCCESS')) AS rec,
               coalesce(sum(amount) FILTER (WHERE recovery_status IN ('RECOVERED', 'SUCCESS')), 0) AS rev FROM snap)
SELECT CAST(n AS BIGINT) AS total_transactions, CAST(risk AS DOUBLE) AS revenue_at_risk,
       CAST(rec AS BIGINT) AS recovered_transactions, CAST(rev AS DOUBLE) AS recovered_revenue,
       {_pct('rev', 'risk')} AS recovery_rate_percentage, {_pct('rec', 'n')} AS transaction_recovery_rate_percentage
FROM g"""
    o["failure_breakdown"] = _with() + """
SELECT failure_code, CAST(count(*) AS BIGINT) AS n FROM transactions
WHERE failure_code IS NOT NULL AND failure_code <> '' GROUP BY failure_code"""
    o["control_room_rows"] = w + f"""
SELECT transaction_id, customer_id, CAST(amount AS DOUBLE) AS amount, payment_method, 'FAILED' AS initial_status,
       recovery_status, CAST(recovered_amount AS DOUBLE) AS recovered_amount, failure_code,
       {lab} AS failure_reason, CAST(retry_count AS BIGINT) AS retry_count,
       CAST("timestamp" AS VARCHAR) AS "timestamp"
FROM snap"""
    o["failure_reasons"] = _with() + f"""
SELECT DISTINCT {lab} AS failure_reason FROM transactions WHERE failure_code IS NOT NULL"""
    o["faceted_filter"] = w + f"""
SELECT transaction_id, recovery_status, {lab} AS failure_reason, CAST(recovered_amount AS DOUBLE) AS recovered_amount
FROM snap WHERE recovery_status = 'RECOVERED' AND {lab} = 'Bank Timeout'"""
    o["search_ids"] = _with() + f"""
SELECT transaction_id, {lab} AS failure_reason FROM transactions WHERE regexp_matches(transaction_id, 'tx0+12', 'i')"""
    o["lookup_ids"] = _with() + """
, ids AS (SELECT transaction_id FROM transactions UNION ALL SELECT 'TX9999999999' UNION ALL SELECT 'TXMISSING')
SELECT i.transaction_id, t.transaction_id IS NOT NULL AS found, CAST(t.amount AS DOUBLE) AS amount
FROM ids i LEFT JOIN transactions t USING (transaction_id)"""
    o["failed_filter"] = w + """
SELECT transaction_id, customer_id, CAST(amount AS DOUBLE) AS amount, payment_method, status, failure_code,
       CAST(retry_count AS BIGINT) AS retry_count, CAST("timestamp" AS VARCHAR) AS "timestamp"
FROM snap WHERE status = 'FAILED'"""
    o["first_n"] = _with() + """
SELECT transaction_id, customer_id, CAST(amount AS DOUBLE) AS amount, payment_method, status, failure_code,
       CAST(retry_count AS BIGINT) AS retry_count, CAST("timestamp" AS VARCHAR) AS "timestamp"
FROM transactions ORDER BY transaction_id LIMIT 1000"""
    o["state_apply"] = w + """
SELECT transaction_id, status, CAST(retry_count AS BIGINT) AS retry_count, recovery_status,
       CAST(recovered_amount AS DOUBLE) AS recovered_amount FROM snap"""
    o["invoice_resolution"] = w + """
, pc AS (SELECT s.customer_id, bool_or(s.recovery_status = 'RECOVERED') AS rec,
                bool_or(s.recovery_status = 'RECOVERED' AND o.final_action = 'mark_promise_to_pay') AS prom
         FROM snap s JOIN opt o USING (transaction_id) GROUP BY s.customer_id)
SELECT i.invoice_id, i.customer_id,
       CAST(CASE WHEN coalesce(pc.rec, false) THEN 0 ELSE i.days_overdue END AS BIGINT) AS days_overdue,
       i.promise_to_pay OR coalesce(pc.prom, false) AS promise_to_pay
FROM invoices i LEFT JOIN pc USING (customer_id)"""
    a = _with(OPT, AUDIT)
    optout = f"agent_action IN {CONTACT} AND has_customer AND preference = 'none'"
    o["policy_violations"] = a + f"""
, ex AS (SELECT s.transaction_id, s.agent_action, e.amount, e.risk_flag, e.has_customer, e.preference
         FROM stage_rows s JOIN e USING (transaction_id)
         WHERE s.stage = 'execution' AND s.agent_action IN {AUTOMATED}),
dd AS (SELECT coalesce(sum(k - 1), 0) AS dup
       FROM (SELECT transaction_id, agent_action, count(*) AS k FROM ex GROUP BY transaction_id, agent_action)),
c AS (SELECT count(*) FILTER (WHERE amount >= 25000) AS hv, count(*) FILTER (WHERE risk_flag) AS fr,
             count(*) FILTER (WHERE {optout}) AS oo FROM ex)
SELECT CAST(hv AS BIGINT) AS high_value, CAST(fr AS BIGINT) AS fraud_flag, CAST(oo AS BIGINT) AS opt_out,
       CAST(dup AS BIGINT) AS duplicate, CAST(hv + fr + oo + dup AS BIGINT) AS policy_violations
FROM c, dd"""
    o["stopping_violations"] = a + f"""
, p AS (SELECT transaction_id, count(*) AS n FROM stage_rows WHERE stage = 'execution' AND agent_action IN {AUTOMATED}
        GROUP BY transaction_id)
SELECT CAST(count(*) FILTER (WHERE n > 2) AS BIGINT) AS stopping_rule_violations,
       CAST(coalesce(max(n), 0) AS BIGINT) AS max_automated_attempts FROM p"""
    o["all_attempt_cost"] = a + f"""
SELECT 'optimizer' AS strategy, CAST(count(*) AS BIGINT) AS executions,
       sum({_eval_cost_case('agent_action')}) AS all_attempt_cost
FROM stage_rows WHERE stage = 'execution'"""
    o["latest_diagnosis"] = a + """
SELECT transaction_id, arg_max(agent_action, attempt_no) AS selected_action, arg_max(reason, attempt_no) AS reasoning
FROM stage_rows WHERE stage = 'root_cause_analysis' GROUP BY transaction_id"""
    o["transaction_360"] = a + """
SELECT s.transaction_id, CAST(s.attempt_no AS BIGINT) AS attempt_no, CAST(s.stage_no AS BIGINT) AS stage_no, s.stage,
       s.agent_action, CAST(e.amount AS DOUBLE) AS amount, c.customer_type, e.invoice_id, e.recovery_status
FROM stage_rows s JOIN e USING (transaction_id) LEFT JOIN customers c ON c.customer_id = e.customer_id"""
    o["history"] = _with(PRIOR) + """
SELECT transaction_id, CAST(prior_executions AS BIGINT) AS prior_executions,
       CAST(prior_automated AS BIGINT) AS prior_automated, prior_terminal, prior_success, prior_last_action,
       prior_actions
FROM hist"""
    o["terminal_gate"] = _with(PRIOR) + """
SELECT t.transaction_id,
       CASE h.g WHEN 3 THEN 'RECOVERED' WHEN 2 THEN 'ESCALATED' WHEN 0 THEN 'FAILED' WHEN 1 THEN 'FAILED'
                ELSE t.recovery_status END AS recovery_status,
       CAST(coalesce(h.prior_executions, 0) AS BIGINT) AS prior_executions,
       CASE h.g WHEN 3 THEN 'ALREADY_RECOVERED' WHEN 2 THEN 'TERMINAL' WHEN 1 THEN 'BUDGET_USED' ELSE 'PENDING' END
         AS gate_status
FROM transactions t LEFT JOIN hist h USING (transaction_id)"""
    resume = _with(OPT, PRIOR) + f""",
r0 AS (
  SELECT cv.transaction_id, cv.action, cv.p,
         row_number() OVER (PARTITION BY cv.transaction_id ORDER BY cv.expected_net DESC, cv.ord) AS rn
  FROM cv JOIN e USING (transaction_id)
  WHERE cv.ord <= 5 AND cv.action <> 'schedule_retry' AND NOT e.hv AND NOT e.risk_flag
    AND NOT (cv.action IN {CONTACT} AND e.preference = 'none')),
g0 AS (
  SELECT e.transaction_id, e.amount, e.hv OR e.risk_flag AS blocked, r.action AS a, r.p,
         NOT (e.hv OR e.risk_flag) AND e.u_bp < r.p * 10000 AS ok
  FROM e JOIN hist h ON h.transaction_id = e.transaction_id AND h.g = 0
  LEFT JOIN r0 r ON r.transaction_id = e.transaction_id AND r.rn = 1),
res AS (
  SELECT transaction_id, final_action, status, amount_recovered, execution_count, automated_attempts
  FROM opt WHERE transaction_id NOT IN (SELECT transaction_id FROM hist)
  UNION ALL
  SELECT transaction_id, CASE WHEN blocked THEN 'escalate_to_human' WHEN ok THEN a ELSE 'escalate_to_human' END,
         CASE WHEN ok THEN 'SUCCESS' ELSE 'FAILURE' END, CASE WHEN ok THEN amount ELSE 0 END,
         CASE WHEN blocked OR ok THEN 2 ELSE 3 END, CASE WHEN blocked THEN 1 ELSE 2 END
  FROM g0
  UNION ALL
  SELECT transaction_id, CAST(NULL AS VARCHAR), 'SKIPPED', 0, 2, 2 FROM hist WHERE g = 1)
"""
    o["batch_resume"] = resume + """
SELECT transaction_id, final_action, status, CAST(amount_recovered AS DOUBLE) AS amount_recovered,
       CAST(execution_count AS BIGINT) AS execution_count, CAST(automated_attempts AS BIGINT) AS automated_attempts
FROM res"""
    o["batch_summary"] = resume + """
SELECT CAST(count(*) AS BIGINT) AS total_processed,
       CAST(count(*) FILTER (WHERE status = 'SUCCESS') AS BIGINT) AS successful_recovery,
       CAST(coalesce(sum(amount_recovered) FILTER (WHERE status = 'SUCCESS'), 0) AS DOUBLE) AS amount_recovered,
       CAST(count(*) FILTER (WHERE final_action = 'escalate_to_human') AS BIGINT) AS escalated_count,
       CAST(count(*) FILTER (WHERE final_action = 'stop_recovery') AS BIGINT) AS stopped_count
FROM res"""
    o["validation_report"] = _with() + """
, tx AS (SELECT transaction_id, amount, retry_count FROM transactions
         UNION ALL SELECT 'TXBAD0000001', NULL, 0 UNION ALL SELECT 'TXBAD0000002', -500.00, 0
         UNION ALL SELECT 'TXBAD0000003', 100.00, -1),
req AS (SELECT transaction_id FROM tx UNION ALL SELECT '' UNION ALL SELECT NULL UNION ALL SELECT 'TXMISSING'),
j AS (SELECT r.transaction_id, t.transaction_id IS NOT NULL AS found, t.amount, t.retry_count
      FROM req r LEFT JOIN tx t ON r.transaction_id = t.transaction_id),
v AS (SELECT transaction_id,
        CASE WHEN transaction_id IS NULL OR transaction_id = '' THEN 'Invalid or missing transaction ID.'
             WHEN NOT found THEN 'Transaction ''' || transaction_id || ''' not found.'
             WHEN amount IS NULL THEN 'Invalid transaction amount: None.'
             WHEN amount < 0 THEN 'Invalid transaction amount: ' || CAST(CAST(amount AS DOUBLE) AS VARCHAR) || '.'
             WHEN retry_count < 0 THEN 'Invalid retry count: ' || retry_count || '.' END AS error_reason FROM j)
SELECT transaction_id, CASE WHEN error_reason IS NULL THEN 'VALID' ELSE 'ERROR' END AS status, error_reason FROM v"""
    hf = ("(CASE WHEN risk_flag THEN 25 WHEN risk_rate < 0.5 THEN 25 WHEN risk_rate < 0.8 THEN 15 "
          "WHEN risk_rate < 0.95 THEN 5 ELSE 0 END)")
    odf = ("(CASE WHEN greatest(coalesce(dseq, 0), 0) > 30 THEN 10 WHEN greatest(coalesce(dseq, 0), 0) > 10 THEN 7 "
           "WHEN greatest(coalesce(dseq, 0), 0) > 0 THEN 3 ELSE 0 END)")
    o["risk_sequential"] = _with(OPT) + f"""
, s AS (SELECT e.transaction_id, e.customer_id, e.days_overdue, o.status = 'SUCCESS' AS ok, rb.sev, rb.af, e.risk_flag,
               e.risk_rate FROM e JOIN opt o USING (transaction_id) JOIN rb USING (transaction_id)),
w AS (SELECT s.*, coalesce(bool_or(ok) OVER (PARTITION BY customer_id ORDER BY transaction_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS cleared FROM s),
d AS (SELECT w.*, CASE WHEN cleared AND days_overdue IS NOT NULL THEN 0 ELSE days_overdue END AS dseq FROM w)
SELECT transaction_id, CAST(dseq AS DOUBLE) AS days_overdue_seq,
       {_score(f"CAST(sev + af + {hf} + {odf} AS DECIMAL(10,1))", "0")} AS risk_score_seq
FROM d"""
    o["report"] = _with(BASELINE, RULES, OPT, UNION3, SUMMARY) + """
, m AS (
  SELECT strategy, CAST(recovered AS DOUBLE) AS transactions_recovered,
         CAST(revenue_recovered AS DOUBLE) AS revenue_recovered, CAST(operational_cost AS DOUBLE) AS operational_cost,
         CAST(revenue_recovered - operational_cost AS DOUBLE) AS net_recovery, CAST(escalated AS DOUBLE) AS escalated_cases,
         CAST(executions AS DOUBLE) / CAST(transactions AS DOUBLE) AS avg_attempts_per_tx
  FROM summ),
u AS (UNPIVOT m ON transactions_recovered, revenue_recovered, operational_cost, net_recovery, escalated_cases,
      avg_attempts_per_tx INTO NAME metric VALUE value)
SELECT metric, max(value) FILTER (WHERE strategy = 'baseline') AS baseline,
       max(value) FILTER (WHERE strategy = 'rules') AS rules,
       max(value) FILTER (WHERE strategy = 'optimizer') AS optimizer
FROM u GROUP BY metric"""
    return o


def _action_set(col: str) -> str:
    """Comma list of the catalog actions seen in ``col`` (catalog order)."""
    parts = ", ".join(f"CASE WHEN bool_or({col} = {_q(a)}) THEN {_q(a)} END" for a in C.ACTION_NAMES)
    return f"concat_ws(',', {parts})"


_CLASS_OF_CAUSE = " ".join(f"WHEN {_q(v)} THEN {_q(k)}" for k, v in C.CLASS_TO_CAUSE.items())
_CAUSE_OF_CLASS = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in C.CLASS_TO_CAUSE.items())

# Recorded responses, read like JSON text; then the optimizer with their causes: attempt k
# ranks the candidates of the class its cause names, attempt 2 without attempt 1's action.
RESP = """,
resp AS (
  SELECT e.transaction_id, n AS attempt_no, e.k, e.cls,
         CASE WHEN n = 2 THEN CASE e.k % 4 WHEN 3 THEN 4 WHEN 2 THEN 2 ELSE 0 END ELSE e.k % 5 END AS g,
         CASE WHEN n = 2 THEN {causes}[(e.k // 7) % 6 + 1] WHEN e.k % 3 = 0 THEN {causes}[(e.k // 3) % 6 + 1]
              ELSE CASE e.cls {cause} END END AS told,
         CASE WHEN n = 2 THEN e.k * 7 % 20 ELSE e.k % 20 END AS delay,
         CASE e.cls {conf} END AS fb_conf, CASE e.cls {act} END AS fb_act
  FROM e, (VALUES (1), (2)) t(n)),
rtext AS (
  SELECT transaction_id, attempt_no, g, delay,
         CASE WHEN g IN (0, 1) THEN CAST(json_object('root_cause', told, 'confidence', CAST(fb_conf AS DOUBLE),
                                          'recommended_action', fb_act, 'reason', 'Recorded model diagnosis.',
                                          'why_not_alternatives', 'Alternatives have lower expected value.') AS VARCHAR)
              WHEN g = 2 THEN '{{"root_cause": "insufficient_funds", "confidence": '
              ELSE CAST(json_object('root_cause', 'network_glitch', 'confidence', 0.7, 'recommended_action',
                                    'retry_payment', 'reason', 'Recorded model diagnosis.',
                                    'why_not_alternatives', 'n/a') AS VARCHAR) END AS body
  FROM resp WHERE g <> 4),
rclean AS (
  SELECT transaction_id, attempt_no, delay,
         CASE WHEN g = 1 THEN '```json' || chr(10) || body || chr(10) || '```' ELSE body END AS raw
  FROM rtext),
rparsed AS (
  SELECT transaction_id, attempt_no, delay,
         CASE WHEN starts_with(trim(raw), '```')
              THEN trim(array_to_string(list_slice(string_split(trim(raw), chr(10)), 2, -2), chr(10)))
              ELSE trim(raw) END AS c
  FROM rclean),
rv AS (
  SELECT transaction_id, attempt_no, delay,
         CASE WHEN json_valid(c) THEN json_extract_string(c, '$.root_cause') END AS root_cause,
         CASE WHEN json_valid(c) THEN TRY_CAST(json_extract_string(c, '$.confidence') AS DOUBLE) END AS confidence,
         CASE WHEN json_valid(c) THEN json_extract_string(c, '$.recommended_action') END AS rec,
         CASE WHEN json_valid(c) THEN json_extract_string(c, '$.reason') END AS reason,
         CASE WHEN json_valid(c) THEN json_extract_string(c, '$.why_not_alternatives') END AS why
  FROM rparsed),
rvalid AS (
  SELECT rv.*, coalesce(root_cause IN {causes} AND rec IN {actions} AND confidence IS NOT NULL
                        AND reason IS NOT NULL AND why IS NOT NULL, false) AS valid
  FROM rv)
""".format(
    cause=_CAUSE_OF_CLASS,
    conf=" ".join(f"WHEN {_q(k)} THEN {v[1]}" for k, v in C.FALLBACK.items()),
    act=" ".join(f"WHEN {_q(k)} THEN {_q(v[2][0])}" for k, v in C.FALLBACK.items()),
    causes="[" + ", ".join(_q(x) for x in C.ROOT_CAUSES) + "]",
    actions="[" + ", ".join(_q(x) for x in C.ACTION_NAMES) + "]",
)


def _model(usable: str = "true") -> str:
    """``mopt``: results with the model; ``usable``: condition on an answer."""
    return RESP + f""",
ask AS (
  SELECT e.transaction_id, n AS attempt_no, coalesce(v.valid AND {usable}, false) AS told,
         CASE WHEN coalesce(v.valid AND {usable}, false) THEN v.root_cause ELSE CASE e.cls {_CAUSE_OF_CLASS} END END AS cause
  FROM e CROSS JOIN (VALUES (1), (2)) t(n) LEFT JOIN rvalid v ON v.transaction_id = e.transaction_id AND v.attempt_no = n),
lines AS (
  SELECT a.transaction_id, a.attempt_no, pt.action, pt.ord,
         CAST(round(coalesce(e.amount, 0) * CAST(CASE WHEN e.erv_rate >= 0.90 THEN least(CAST({C.BAND_CAP} AS DECIMAL(3,2)), pt.base + pt.up)
                   WHEN e.erv_rate < 0.70 THEN greatest(CAST(pt.floor AS DECIMAL(3,2)), pt.base - pt.down)
                   ELSE pt.base END AS DECIMAL(3,2)) - CAST(pt.rank_cost AS DECIMAL(5,1)), 2) AS DECIMAL(18,2)) AS net
  FROM ask a JOIN e USING (transaction_id) JOIN pt ON pt.cls = CASE a.cause {_CLASS_OF_CAUSE} END
  WHERE NOT e.hv AND NOT e.risk_flag AND NOT (pt.action IN {CONTACT} AND e.preference = 'none')),
pick1 AS (SELECT transaction_id, action FROM lines WHERE attempt_no = 1
          QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY net DESC, ord) = 1),
pick2 AS (SELECT l.transaction_id, l.action FROM lines l JOIN pick1 p USING (transaction_id) WHERE l.attempt_no = 2 AND l.action <> p.action
          QUALIFY row_number() OVER (PARTITION BY l.transaction_id ORDER BY l.net DESC, l.ord) = 1),
mopt AS (
  SELECT *, CASE WHEN blocked THEN 'escalate_to_human' WHEN ok1 THEN a1 WHEN ok2 THEN a2 ELSE 'escalate_to_human' END AS final_action,
         CASE WHEN ok1 OR ok2 THEN 'SUCCESS' ELSE 'FAILURE' END AS status
  FROM (SELECT e.transaction_id, e.cls, e.hv OR e.risk_flag AS blocked, p1.action AS a1, p2.action AS a2,
               coalesce(e.u_bp < c1.p * 10000, false) AS ok1, coalesce(e.u_bp < c2.p * 10000, false) AS ok2,
               k1.told AS told1, k1.cause AS cause1, k2.told AS told2, k2.cause AS cause2
        FROM e JOIN ask k1 ON k1.transaction_id = e.transaction_id AND k1.attempt_no = 1
        JOIN ask k2 ON k2.transaction_id = e.transaction_id AND k2.attempt_no = 2
        LEFT JOIN pick1 p1 ON p1.transaction_id = e.transaction_id LEFT JOIN pick2 p2 ON p2.transaction_id = e.transaction_id
        LEFT JOIN cand c1 ON c1.transaction_id = e.transaction_id AND c1.action = p1.action
        LEFT JOIN cand c2 ON c2.transaction_id = e.transaction_id AND c2.action = p2.action))
"""


_DIAGNOSED = """
SELECT transaction_id, CASE WHEN told1 THEN 'model' ELSE 'fallback' END AS diagnosis_source, cause1 AS root_cause,
       CASE WHEN NOT blocked AND NOT ok1 THEN CASE WHEN told2 THEN 'model' ELSE 'fallback' END END AS second_source,
       CASE WHEN NOT blocked AND NOT ok1 THEN cause2 END AS second_cause,
       CASE WHEN NOT blocked AND NOT ok1 THEN a2 END AS second_action, final_action, status
FROM mopt"""


def model_stream_oracles() -> dict[str, str]:
    from .oracles import _final_desc, _result_select
    o = {}
    o["response_valid"] = _with(RESP) + """
SELECT transaction_id, CAST(attempt_no AS BIGINT) AS attempt_no, valid, root_cause, confidence FROM rvalid"""
    o["diagnosed"] = _with(_model()) + _DIAGNOSED
    o["stream_diagnosed"] = _with(_model("v.delay <= 12")) + _DIAGNOSED
    o["model_contribution"] = _with(_model()) + f"""
, att AS (
  SELECT told1 AS told, cause1 AS cause, cls FROM mopt
  UNION ALL SELECT told2, cause2, cls FROM mopt WHERE NOT blocked AND NOT ok1)
SELECT CASE WHEN told THEN 'model' ELSE 'fallback' END AS diagnosis_source, CAST(count(*) AS BIGINT) AS attempts,
       CAST(count(*) FILTER (cause <> CASE cls {_CAUSE_OF_CLASS} END) AS BIGINT) AS cause_changed
FROM att GROUP BY told"""
    o["csv_roundtrip"] = _with(OPT) + _result_select("opt", _final_desc())
    o["stream_recovery"] = o["csv_roundtrip"]
    from .oracles import oracles as _base  # noqa: F401  (summary SQL reused below)
    o["run_overwrite"] = _with(BASELINE, RULES, OPT, UNION3) + """
SELECT strategy, transaction_id, final_action, status FROM allres"""
    o["formatted_kpis"] = _with(BASELINE, RULES, OPT, UNION3, SUMMARY) + f"""
, s AS (SELECT strategy, CAST(revenue_recovered - operational_cost AS DOUBLE) AS net,
               CAST(revenue_recovered AS DOUBLE) AS rev, {_pct('revenue_recovered', 'revenue_at_risk')} AS rate FROM summ)
SELECT strategy, '₹' || format('{{:,.2f}}', net / 1e5) || 'L' AS net_lakh,
       'INR ' || format('{{:,.2f}}', rev) AS revenue_text, format('{{:,.2f}}', rate) || '%' AS rate_text
FROM s"""
    a = _with(OPT, AUDIT)
    o["stream_attempt_state"] = a + f"""
SELECT transaction_id, CAST(count(*) AS BIGINT) AS executions,
       CAST(count(*) FILTER (WHERE agent_action IN {AUTOMATED}) AS BIGINT) AS automated,
       bool_or(agent_action IN ('escalate_to_human', 'stop_recovery')) AS terminal,
       {_action_set('agent_action')} AS actions
FROM stage_rows WHERE stage = 'execution' GROUP BY transaction_id"""
    o["stream_dedupe"] = a + """
SELECT DISTINCT transaction_id, agent_action FROM stage_rows WHERE stage = 'execution'"""
    return o


def extra_oracles() -> dict[str, str]:
    o = {}
    o["audit_append"] = _with(RULES, OPT, AUDIT) + f"""
, ra AS (SELECT CASE WHEN run2 THEN 2 ELSE 1 END AS n_att,
                CASE WHEN run2 AND fin2 IN {AUTOMATED} AND NOT ok2 THEN 1 ELSE 0 END AS esc FROM rules),
rc AS (SELECT 'rules' AS strategy, 'risk_evaluation' AS stage, sum(n_att) AS n FROM ra
       UNION ALL SELECT 'rules', 'root_cause_analysis', sum(n_att) FROM ra
       UNION ALL SELECT 'rules', 'policy_guardrail', sum(n_att + esc) FROM ra
       UNION ALL SELECT 'rules', 'execution', sum(n_att + esc) FROM ra
       UNION ALL SELECT 'optimizer', stage, count(*) FROM stage_rows GROUP BY stage)
SELECT strategy, stage, CAST(n AS BIGINT) AS n FROM rc"""
    o["model_quota"] = _with(OPT, _model()) + """
, q AS (SELECT transaction_id, row_number() OVER (ORDER BY transaction_id) <= 2 AS in_quota FROM e)
SELECT o.transaction_id, q.in_quota, CASE WHEN NOT q.in_quota THEN 'erv' WHEN m.told1 THEN 'model' ELSE 'fallback' END AS diagnosis_source,
       CASE WHEN q.in_quota THEN m.final_action ELSE o.final_action END AS final_action
FROM opt o JOIN q USING (transaction_id) JOIN mopt m USING (transaction_id)"""
    return o


def _edge_base(replace: str) -> str:
    """BASE over transactions with replaced columns (invoices stay those of the plain rows)."""
    head, tail = _with().split("fi AS (", 1)
    head = head.replace("transactions AS (", "transactions0 AS (", 1)
    head = head.replace("FROM transactions\n  WHERE failure_code", "FROM transactions0\n  WHERE failure_code", 1)
    return f"{head}transactions AS (SELECT * REPLACE ({replace}) FROM transactions0),\nfi AS ({tail}"


EDGE = """CASE WHEN k % 11 = 0 THEN NULL WHEN k % 11 = 1 THEN -amount ELSE amount END AS amount,
  CASE k % 11 WHEN 2 THEN -1 WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE retry_count END AS retry_count,
  CASE k % 11 WHEN 3 THEN 'RECOVERED' WHEN 4 THEN 'SUCCESS' ELSE recovery_status END AS recovery_status,
  CASE WHEN k % 11 IN (3, 4) THEN amount ELSE recovered_amount END AS recovered_amount,
  CASE WHEN k % 11 <> 5 THEN customer_id END AS customer_id"""


def edge_oracles() -> dict[str, str]:
    o = {}
    rows = """SELECT o.transaction_id, CASE WHEN t.k % 11 >= 5 THEN o.final_action END AS final_action,
       CASE WHEN t.k % 11 < 3 THEN 'ERROR' WHEN t.k % 11 < 5 THEN 'SKIPPED' ELSE o.status END AS status,
       CASE WHEN t.k % 11 < 5 THEN 0.0 ELSE CAST(o.amount_recovered AS DOUBLE) END AS amount_recovered,
       CAST(CASE WHEN t.k % 11 < 5 THEN 0 ELSE o.execution_count END AS BIGINT) AS execution_count,{more}
       CASE t.k % 11 WHEN 0 THEN 'Invalid transaction amount: None.'
                     WHEN 1 THEN 'Invalid transaction amount: ' || CAST(CAST(t.amount AS DOUBLE) AS VARCHAR) || '.'
                     WHEN 2 THEN 'Invalid retry count: -1.' END AS error_reason
FROM opt o JOIN transactions t USING (transaction_id) JOIN baseline b USING (transaction_id)"""
    edge = _edge_base(EDGE)
    o["edge_results"] = edge + BASELINE + OPT + rows.format(more="""
       CASE WHEN t.k % 11 < 3 THEN 'ERROR' WHEN t.k % 11 < 5 THEN 'SKIPPED' ELSE b.status END AS baseline_status,""")
    o["stream_two_runs"] = edge + BASELINE + OPT + rows.format(more="""
       CAST(CASE WHEN t.k % 11 < 5 THEN 0 ELSE o.execution_count END AS BIGINT) AS audited,""")
    o["edge_state"] = edge + OPT + SNAP + """
SELECT s.transaction_id, CASE WHEN t.k % 11 < 5 THEN t.recovery_status ELSE s.recovery_status END AS recovery_status,
       CAST(CASE WHEN t.k % 11 < 5 THEN t.recovered_amount ELSE s.recovered_amount END AS DOUBLE) AS recovered_amount
FROM snap s JOIN transactions t USING (transaction_id)"""
    o["edge_360"] = edge + OPT + AUDIT + """
, n AS (SELECT transaction_id, count(*) AS n FROM stage_rows GROUP BY transaction_id)
SELECT t.transaction_id, CAST(CASE WHEN t.k % 11 < 5 THEN 0 ELSE n.n END AS BIGINT) AS trail_rows, c.customer_type
FROM transactions t LEFT JOIN n USING (transaction_id) LEFT JOIN customers c ON c.customer_id = t.customer_id"""
    o["pending_batch"] = f"""SELECT transaction_id, gate_status, prior_executions FROM ({state_oracles()["terminal_gate"]}) g
WHERE gate_status = 'PENDING' ORDER BY transaction_id LIMIT 500"""
    a = _with(OPT, AUDIT)
    o["audit_timeline"] = a + """
SELECT transaction_id, CAST(attempt_no AS BIGINT) AS attempt_no, agent_action FROM stage_rows
WHERE stage = 'execution' AND tool_result = 'SUCCESS'"""
    o["audit_trail_timeline"] = _with(OPT, AUDIT, PRIOR) + f"""
, left0 AS (
  SELECT cv.transaction_id, cv.action, cv.p,
         row_number() OVER (PARTITION BY cv.transaction_id ORDER BY cv.expected_net DESC, cv.ord) AS rn
  FROM cv JOIN e USING (transaction_id)
  WHERE cv.ord <= 5 AND cv.action <> 'schedule_retry' AND NOT (cv.action IN {CONTACT} AND e.preference = 'none')),
second AS (
  SELECT e.transaction_id, e.hv OR e.risk_flag AS blocked, l.action AS a,
         NOT (e.hv OR e.risk_flag) AND coalesce(e.u_bp < l.p * 10000, false) AS ok
  FROM e JOIN hist h ON h.transaction_id = e.transaction_id AND h.g = 0
  LEFT JOIN left0 l ON l.transaction_id = e.transaction_id AND l.rn = 1),
log AS (
  SELECT 0 AS run, transaction_id, n AS attempt_no, 4 AS stage_no, 'execution' AS stage,
         CASE WHEN g = 3 THEN 'retry_payment' WHEN g = 2 THEN 'escalate_to_human' WHEN n = 2 THEN 'create_payment_link'
              ELSE 'schedule_retry' END AS agent_action,
         'APPROVED' AS policy_result, CASE g WHEN 3 THEN 'SUCCESS' ELSE 'FAILURE' END AS tool_result
  FROM hist JOIN (VALUES (1), (2)) v(n) ON n <= prior_executions
  UNION ALL
  SELECT 1, transaction_id, attempt_no, stage_no, stage, agent_action, policy_result, tool_result
  FROM stage_rows WHERE transaction_id NOT IN (SELECT transaction_id FROM hist)
  UNION ALL
  SELECT 1, transaction_id, 2, 1, 'risk_evaluation', NULL, NULL, NULL FROM second
  UNION ALL
  SELECT 1, transaction_id, 2, 2, 'root_cause_analysis', CASE WHEN blocked THEN 'stop_recovery' ELSE a END, NULL, NULL FROM second
  UNION ALL
  SELECT 1, transaction_id, 2, 3, 'policy_guardrail', CASE WHEN blocked THEN 'stop_recovery' ELSE a END,
         CASE WHEN blocked THEN 'ESCALATE' ELSE 'APPROVED' END, NULL FROM second
  UNION ALL
  SELECT 1, transaction_id, 2, 4, 'execution', CASE WHEN blocked THEN 'escalate_to_human' ELSE a END, 'APPROVED',
         CASE WHEN ok THEN 'SUCCESS' ELSE 'FAILURE' END FROM second
  UNION ALL
  SELECT 1, transaction_id, 3, 3, 'policy_guardrail', 'escalate_to_human', 'APPROVED', NULL FROM second WHERE NOT blocked AND NOT ok
  UNION ALL
  SELECT 1, transaction_id, 3, 4, 'execution', 'escalate_to_human', 'APPROVED', 'FAILURE' FROM second WHERE NOT blocked AND NOT ok)
SELECT CASE run WHEN 0 THEN 'prior' ELSE 'optimizer' END AS strategy, transaction_id, CAST(attempt_no AS BIGINT) AS attempt_no,
       CAST(stage_no AS BIGINT) AS stage_no, stage, agent_action, policy_result, tool_result,
       CASE WHEN stage = 'execution' THEN CAST(count(*) FILTER (WHERE stage = 'execution') OVER (
         PARTITION BY transaction_id ORDER BY run, attempt_no, stage_no ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS execution_no
FROM log"""
    runs = f"""WITH r AS (
  SELECT DISTINCT 'run' || i % 3 AS strategy, CASE WHEN k % 3 = 0 THEN 'TXHOT' ELSE 'TX' || lpad(CAST(k AS VARCHAR), 10, '0') END AS transaction_id,
         CASE WHEN k % 3 = 0 THEN k * 6 + i ELSE i END AS attempt_no, CAST(d AS TIMESTAMP) + to_minutes((i * 37 + k) % 50) AS ts,
         [{", ".join(_q(a) for a in C.ACTION_NAMES)}][(k * 7 + i * 5) % 7 + 1] AS agent_action,
         CASE WHEN (k + i) % 9 = 0 THEN 'SUCCESS' ELSE 'FAILURE' END AS tool_result
  FROM (SELECT o_orderkey AS k, o_orderdate AS d, unnest(range(1, o_orderkey % 6 + 1)) AS i FROM orders)),
t AS (SELECT *, concat_ws(':', strategy, attempt_no, agent_action, tool_result) AS t FROM r)
"""
    counts = ", ".join(f"CAST(count(*) FILTER (agent_action = {_q(a)}) AS BIGINT) AS n_{a}" for a in C.ACTION_NAMES)
    o["ordered_history"] = runs + f"""
SELECT transaction_id, CAST(count(*) AS BIGINT) AS executions, {counts},
       array_to_string(list(t ORDER BY ts, attempt_no, strategy)[:3], ' ') AS first_actions,
       array_to_string(list(t ORDER BY ts, attempt_no, strategy)[-3:], ' ') AS last_actions
FROM t GROUP BY transaction_id"""
    o["trail_positions"] = runs + """
SELECT strategy, transaction_id, CAST(attempt_no AS BIGINT) AS attempt_no, agent_action,
       CAST(row_number() OVER (PARTITION BY transaction_id ORDER BY ts, attempt_no, strategy) AS BIGINT) AS position
FROM t"""
    log = o["audit_trail_timeline"]
    o["stream_state_resumed"] = f"""WITH l AS ({log}), x AS (SELECT * FROM l WHERE stage = 'execution'),
f AS (SELECT transaction_id, agent_action, min(execution_no) AS place FROM x GROUP BY transaction_id, agent_action),
a AS (SELECT transaction_id, string_agg(agent_action, ',' ORDER BY place) AS actions FROM f GROUP BY transaction_id)
SELECT transaction_id, CAST(count(*) AS BIGINT) AS executions, CAST(count(*) FILTER (agent_action IN {AUTOMATED}) AS BIGINT) AS automated,
       bool_or(agent_action IN ('escalate_to_human', 'stop_recovery')) AS terminal, any_value(actions) AS actions
FROM x JOIN a USING (transaction_id) GROUP BY transaction_id"""
    o["filtered_head"] = _with(OPT, SNAP) + """
SELECT transaction_id, recovery_status, CAST(recovered_amount AS DOUBLE) AS recovered_amount FROM snap
WHERE recovery_status = 'RECOVERED' ORDER BY transaction_id LIMIT 100"""
    o["outcome_join"] = _edge_base("CASE WHEN transaction_id NOT LIKE '%3' THEN u_bp END AS u_bp") + OPT + """
SELECT transaction_id, final_action, status FROM opt"""
    o["stored_pairs"] = _with(RULES, OPT) + """
SELECT transaction_id, r.final_action AS left_action, o.final_action AS right_action
FROM rules r JOIN opt o USING (transaction_id) WHERE r.final_action IS DISTINCT FROM o.final_action"""
    o["stored_360"] = a + """
SELECT transaction_id, CAST(any_value(e.amount) AS DOUBLE) AS amount, any_value(c.customer_type) AS customer_type, any_value(e.invoice_id) AS invoice_id,
       CAST(count(*) AS BIGINT) AS entries,
       string_agg(concat_ws('.', attempt_no, s.stage, coalesce(agent_action, '-')), ' ' ORDER BY attempt_no, stage_no) AS trail
FROM stage_rows s JOIN e USING (transaction_id) LEFT JOIN customers c ON c.customer_id = e.customer_id GROUP BY transaction_id"""
    s = state_oracles()
    o["incremental_kpis"] = s["kpis"].replace("FROM snap)", "FROM mixed)").replace(", g AS (", """
, mixed AS (SELECT t.transaction_id, t.amount, CASE WHEN t.k % 16 < 12 THEN n.recovery_status ELSE t.recovery_status END AS recovery_status
            FROM transactions t JOIN snap n USING (transaction_id)),
g AS (""")
    o["observed_run"] = _with(OPT) + f"""
SELECT CAST(count(*) AS BIGINT) AS total_processed, CAST(count(*) FILTER (status = 'SUCCESS') AS BIGINT) AS successful_recovery,
       CAST(coalesce(sum(amount_recovered) FILTER (status = 'SUCCESS'), 0) AS DOUBLE) AS amount_recovered,
       CAST(count(*) FILTER (final_action = 'escalate_to_human') AS BIGINT) AS escalated_count,
       CAST(count(*) FILTER (final_action = 'stop_recovery') AS BIGINT) AS stopped_count,
       any_value(v.high_value) AS high_value, any_value(v.fraud_flag) AS fraud_flag, any_value(v.opt_out) AS opt_out, any_value(v.duplicate) AS duplicate,
       any_value(p.stopping_rule_violations) AS stopping_rule_violations
FROM opt, ({s["policy_violations"]}) v, ({s["stopping_violations"]}) p"""
    o["csv_quarantine"] = _with(BASELINE) + """
SELECT 'good' AS reason, CAST(count(*) AS BIGINT) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM baseline
UNION ALL SELECT CASE k % 150 WHEN 0 THEN 'bad amount' WHEN 50 THEN 'wrong number of fields' ELSE 'missing transaction_id' END, count(*), NULL
FROM e WHERE k % 50 = 0 GROUP BY 1"""
    o["stage_latency_nulls"] = a + """
, v AS (SELECT stage, CASE WHEN stage_no <> 2 AND k % 4 <> 1 THEN (k * 13 + stage_no * 7) % 1000 END AS us FROM stage_rows),
l AS (SELECT stage, coalesce(avg(CAST(us AS DOUBLE)), 0) AS avg_us, coalesce(max(us), 0) AS max_us, count(*) AS n
      FROM v GROUP BY stage)
SELECT stage, array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(stage, '_')], ' ') AS stage_title,
       floor(avg_us + 0.5) / 1000.0 AS avg_latency_ms, CAST(max_us AS DOUBLE) / 1000.0 AS max_latency_ms,
       CAST(n AS BIGINT) AS invocations
FROM l"""
    o["prompt_requests"] = a + f"""
, opts AS (SELECT transaction_id, string_agg(action || ': ' || CAST(p AS VARCHAR) || ', ' || CAST(rank_cost AS VARCHAR) || ', '
                  || CAST(expected_net AS VARCHAR), '; ' ORDER BY ord) AS options FROM cv GROUP BY transaction_id)
SELECT s.transaction_id, CAST(s.attempt_no AS BIGINT) AS attempt_no, {_q(C.PROMPT_SYSTEM)} AS system_text,
       'Failed payment ' || s.transaction_id || ': INR ' || CAST(e.amount AS VARCHAR) || ' by ' || e.payment_method || ', code '
       || coalesce(e.failure_code, 'none') || chr(10) || 'Customer ' || e.customer_id || ': ' || coalesce(c.customer_type, 'new')
       || ', lifetime value ' || CAST(CAST(e.ltv AS DECIMAL(18,2)) AS VARCHAR) || ', success rate ' || CAST(e.erv_rate AS VARCHAR)
       || ', contact by ' || e.preference || ', flagged ' || CASE WHEN e.risk_flag THEN 'yes' ELSE 'no' END || chr(10)
       || 'Open invoice: ' || CASE WHEN e.invoice_id IS NULL THEN 'none' ELSE e.invoice_id || ', INR ' || CAST(i.amount_due AS VARCHAR)
                                   || ', ' || i.days_overdue || ' days late' END || chr(10)
       || 'Tried so far: ' || CASE WHEN s.attempt_no = 1 THEN 'none' ELSE o.a1 || ' failed' END || chr(10)
       || 'Options (action: chance, cost, expected net): ' || opts.options || chr(10) || {_q(C.PROMPT_ANSWER)} AS prompt
FROM steps s JOIN e USING (transaction_id) JOIN opt o USING (transaction_id) JOIN opts USING (transaction_id)
LEFT JOIN customers c ON c.customer_id = e.customer_id LEFT JOIN invoices i ON i.invoice_id = e.invoice_id"""
    return o
