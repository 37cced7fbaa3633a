"""The recovery attempt loop over whole tables (ST-05, ST-06, ST-07).

Per transaction: up to ``MAX_ATTEMPTS`` rounds of risk -> diagnosis / action
selection -> policy -> execution against the recorded draw, stopping on
success or an exit action; an unrecovered transaction whose last action was
automated is then escalated.

The loop is unrolled into a fixed number of steps on one DataFrame.  The state
of a row is small: a bit set of the automated actions tried, the number of
attempts, the retry count.  What an attempt does depends on that state, the code
class, the customer band and the amount, so it is looked up in a small broadcast
table made from the catalog (:mod:`dunning.functions.envelope`): no shuffle, no
UDF, and short generated code, as the joins also keep the optimizer from
inlining one attempt into the next.  Texts (reasons, descriptions) are rendered
once, from the per-attempt columns, where a table shows them.

Selectors:
* ``rules``     static action by failure code and attempt number (SX-11);
* ``optimizer`` best expected net among policy-approved automated actions
  (TK-05), ranked on the diagnosed cause; with ``model=True`` attempt k reads
  the recorded model response ``answer{k}`` when ``in_quota`` (MI-04).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions import envelope as EN
from ..functions import sqltext as S
from ..functions.erv import COST_T, MONEY_T, PROB_T, net_text
from ..functions.validity import row_error

_EXITS, _AUTOMATED = S.names(C.EXITS), S.names(C.AUTOMATED)
_CAUSE = S.lookup("code_cls", {k: S.quoted(v) for k, v in C.CLASS_TO_CAUSE.items()})
_RANK_CLASS = {code: cls for cls, codes in C.CODE_CLASSES.items() for code in codes}
_AMOUNT = f"coalesce(amount, CAST(0 AS {MONEY_T}))"
#: More partitions than a table has, so that ``coalesce`` joins none of them.
_ALL_PARTITIONS = 1 << 20


def own_method(df: DataFrame) -> DataFrame:
    """What follows is compiled apart from what comes before.

    Projections and broadcast joins in a row become one method of generated code; the JVM
    leaves one of more than 8000 bytes interpreted, some ten times slower.  A ``coalesce``
    to more partitions than there are moves no row and ends the method."""
    return df.coalesce(_ALL_PARTITIONS)


def _with(df: DataFrame, **cols: str) -> DataFrame:
    return df.withColumns({c: F.expr(e) for c, e in cols.items()})


def _score(retry: str) -> str:
    return (f"least(CAST(bround(risk_base + CAST(CASE WHEN coalesce({retry}, 0) = 1 THEN 10 WHEN coalesce({retry}, 0) >= 2 THEN 15 ELSE 0 END "
            "AS DECIMAL(10,1)), 0) AS INT), 100)")


def _level(score: str) -> str:
    return f"CASE WHEN {score} <= 30 THEN 'LOW' WHEN {score} <= 60 THEN 'MEDIUM' WHEN {score} <= 80 THEN 'HIGH' ELSE 'CRITICAL' END"


def _succeeded(fin: str, prob: str) -> str:
    return f"coalesce({fin} NOT IN {_EXITS} AND u_bp < {prob} * 10000, false)"


def _describe(fin: str, ok: str, prob: str) -> str:
    return S.case([(f"{fin} = {S.quoted(C.ESCALATE)}", S.quoted(C.OUTCOME_ESCALATED)), (f"{fin} = {S.quoted(C.STOP)}", S.quoted(C.OUTCOME_STOPPED)),
                   (ok, S.filled(C.OUTCOME_SUCCESS, action=fin, amount=f"format_number({_AMOUNT}, 2)"))],
                  S.filled(C.OUTCOME_FAILURE, action=fin, pct=f"CAST({prob} * 100 AS INT)"))


def _eval_cost(action: str) -> str:
    return f"CAST({S.lookup(action, {a: str(c) for a, c in C.EVAL_COST.items()}, str(C.UNKNOWN_ACTION_EVAL_COST))} AS {COST_T})"


def _fallback(part: int, hist: str) -> str:
    """Reason (1) or alternatives (2) text of the fallback diagnosis (SX-12)."""
    out = {}
    for cls, (flip, _, first, second) in C.FALLBACK.items():
        out[cls] = S.quoted(first[part]) if second is None else (
            f"CASE WHEN {hist} & {EN.BIT[flip]} <> 0 THEN {S.quoted(second[part])} ELSE {S.quoted(first[part])} END")
    return S.lookup("code_cls", out)


def _rank_class(cause: str) -> str:
    """Class number that a diagnosed cause ranks by (SX-10): substring rules in order."""
    rules = [(" OR ".join(f"contains(lower({cause}), {S.quoted(n)})" for n in needles), str(EN.CLASSES.index(_RANK_CLASS[code])))
             for needles, code in C.CAUSE_TEXT_RULES]
    return S.case(rules, str(EN.CLASSES.index("OTHER")))


def _model_cols(q: str, k: int, hist: str) -> dict[str, str]:
    """Cause, source and reason texts of attempt k with a model (MI-04)."""
    answer = f"answer{k}"
    use = f"(in_quota AND coalesce({answer}.parsed.valid, false))"
    err = S.case([(f"{answer}.text IS NULL", "'no recorded response'"),
                  (f"{answer}.parsed.root_cause IS NULL AND {answer}.parsed.reason IS NULL", "'malformed response JSON'")],
                 "'response failed schema validation'")
    return {
        f"{q}cause": f"CASE WHEN {use} THEN {answer}.parsed.root_cause ELSE {_CAUSE} END",
        f"{q}src": f"CASE WHEN {use} THEN 'model' WHEN in_quota THEN 'fallback' ELSE 'erv' END",
        f"{q}mreason": f"CASE WHEN {use} THEN {answer}.parsed.reason WHEN in_quota THEN "
                       f"concat({_fallback(1, hist)}, ' (LLM Error: ', substring({err}, 1, {C.MODEL_ERROR_SUFFIX_CHARS}), ')') END",
        f"{q}mwhy": f"CASE WHEN {use} THEN {answer}.parsed.why_not_alternatives WHEN in_quota THEN {_fallback(2, hist)} END",
    }


def _attempt(df: DataFrame, s: str, k: int, selector: str, model: bool) -> DataFrame:
    """One attempt: the columns of the row's state after it and of its trail entry."""
    q, t = f"{s}{k}_", f"{s}{k}_t_"
    att, hist, retry = f"{s}att", f"{s}hist", f"{s}retry"
    first = {f"{q}run": f"{s}active AND {att} < {C.MAX_ATTEMPTS}", f"{q}att": att, f"{q}score": _score(retry)}
    if model:
        df = own_method(_with(df, **first, **_model_cols(q, k, hist)))
        rank = _rank_class(f"{q}cause")
    else:
        first |= {f"{q}cause": _CAUSE, f"{q}src": "'rules'" if selector == "rules" else "'erv'"}
        df, rank = _with(df, **first), "cls_no"

    # what this state does, from the decision table
    stopped = [("hv", "'HIGH_VALUE_THRESHOLD'"), ("risk_flag", "'CUSTOMER_FRAUD_FLAG'")]
    if selector == "rules":
        key = EN.rules_key("cls_no", "band_no", "CAST(optout AS INT)", hist, f"CASE WHEN {att} = 0 THEN 0 ELSE 1 END")
        df = EN.rules_action(_with(df, **{f"{q}key": key}), f"{q}key", t)
        recact, rule, done, net = f"{t}action", S.case(stopped, f"{t}rule"), f"{t}done", f"CAST(NULL AS {MONEY_T})"
    else:
        allowed = f"CASE WHEN hv OR risk_flag THEN 0 ELSE (CASE WHEN optout THEN {EN.NO_CONTACT} ELSE {EN.ALL_ACTIONS} END) & ~{hist} END"
        key = EN.envelope_key("cls_no", f"({rank})", "band_no", f"({allowed})")
        df = EN.best_action(_with(df, **{f"{q}key": key}), f"{q}key", "cents", t)
        recact = done = f"coalesce({t}action, {S.quoted(C.STOP)})"
        rule = S.case(stopped + [(f"{t}action IS NULL", "'SAFETY_EXIT'")], "'POLICY_APPROVED'")
        net = f"coalesce({net_text('amount', f'{t}rank_p', f'{t}rank_cost')}, CAST(0 AS {MONEY_T}))"
    df = _with(df, **{f"{q}recact": recact, f"{q}rule": rule, f"{q}net": net,
                      f"{q}fin": f"CASE WHEN hv OR risk_flag THEN {S.quoted(C.ESCALATE)} ELSE {done} END"})
    fin, run, prob = f"{q}fin", f"{q}run", f"{q}prob"
    df = _with(df, **{prob: f"CASE WHEN {fin} = {S.quoted(C.ESCALATE)} THEN p_escalate_to_human ELSE coalesce({t}p, CAST(0 AS {PROB_T})) END"})
    df = _with(df, **{f"{q}ok": _succeeded(fin, prob)})

    # the state after it (ST-07: retry_payment raises the retry counter)
    return _with(df, **{
        att: f"CASE WHEN {run} THEN {att} + 1 ELSE {att} END",
        hist: f"CASE WHEN {run} THEN {hist} | {S.lookup(fin, {a: str(b) for a, b in EN.BIT.items()}, '0')} ELSE {hist} END",
        retry: f"CASE WHEN {run} AND {fin} = 'retry_payment' THEN coalesce({retry}, 0) + 1 ELSE {retry} END",
        f"{s}active": f"{run} AND NOT {q}ok AND {fin} NOT IN {_EXITS}",
    })


def _entry(q: str, model: bool) -> str:
    """An executed attempt, as audit rows are rendered from it."""
    none = "CAST(NULL AS STRING)"
    return (f"named_struct('attempt_no', {q}att + 1, 'attempts_before', {q}att, 'risk_score', {q}score, 'root_cause', {q}cause, 'diagnosis_source', {q}src, "
            f"'recommended_action', {q}recact, 'expected_net', {q}net, 'policy_rule', {q}rule, 'final_action', {q}fin, 'probability', {q}prob, "
            f"'success', {q}ok, 'model_reason', {f'{q}mreason' if model else none}, 'model_why', {f'{q}mwhy' if model else none})")


def decide(df: DataFrame, selector: str, name: str, model: bool = False) -> DataFrame:
    """Adds struct column ``name`` with the strategy's result for each row.

    ``df`` is :func:`dunning.functions.erv.prepare` output (and, for
    ``model=True``, carries ``in_quota``, ``answer1``, ``answer2``).  The struct
    also holds ``trail``, the executed attempts in order (attempt k runs only if
    k-1 ran), from which audit rows are rendered.
    """
    if selector not in ("rules", "optimizer"):
        raise ValueError(selector)
    model = model and selector == "optimizer"
    s = f"_{name}_"
    inputs = df.columns
    df = _with(df, **{f"{s}att": "CAST(prior_executions AS INT)", f"{s}hist": "prior_mask", f"{s}retry": "retry_count",
                      f"{s}active": "NOT prior_terminal AND NOT done_before AND NOT invalid"})
    qs = [f"{s}{k}_" for k in range(1, C.MAX_ATTEMPTS + 1)]
    for k in range(1, C.MAX_ATTEMPTS + 1):
        df = own_method(_attempt(df, s, k, selector, model))

    last = {x: S.case([(f"{q}run", f"{q}{x}") for q in reversed(qs)]) for x in ("fin", "ok", "prob", "score", "cause", "recact", "rule")}
    entries = [_entry(q, model) for q in qs]
    executed = S.case([(f"{qs[i]}run", str(i + 1)) for i in reversed(range(len(qs)))], "0")
    trail = f"slice(array({', '.join(entries)}), 1, {executed})"
    df = own_method(_with(df, **{f"{s}trail": trail}))
    df = _with(df, **{f"{s}{x}": e for x, e in last.items()}, **{
        f"{s}n": " + ".join(f"CAST({q}run AS INT)" for q in qs),
        f"{s}automated": " + ".join(f"CASE WHEN {q}run AND {q}fin IN {_AUTOMATED} THEN 1 ELSE 0 END" for q in qs),
    })
    n, fin, ok, esc = f"{s}n", f"{s}fin", f"{s}ok", f"{s}esc"
    df = own_method(df.withColumns({esc: F.expr(f"coalesce({n} > 0 AND NOT {ok} AND {fin} NOT IN {_EXITS}, false)"),
                                    f"{s}error": row_error(F.col("amount"), F.col("retry_count"))}))
    escalate = S.quoted(C.ESCALATE)
    final = f"CASE WHEN {esc} THEN {escalate} ELSE {fin} END"
    zero = f"CAST(0 AS {MONEY_T})"
    fields = {
        "strategy": S.quoted(name),
        "risk_score": f"{s}score",
        "risk_level": _level(f"{s}score"),
        "root_cause": f"{s}cause",
        "recommended_action": f"{s}recact",
        "policy_result": f"CASE WHEN {esc} THEN 'APPROVED' ELSE {S.lookup(f'{s}rule', {k: S.quoted(v) for k, v in C.POLICY_RESULTS.items()})} END",
        "final_action": final,
        "status": S.case([("invalid", "'ERROR'"), (esc, "'FAILURE'"), (f"{n} = 0", "'SKIPPED'"), (ok, "'SUCCESS'")], "'FAILURE'"),
        "amount_recovered": f"CASE WHEN NOT {esc} AND {n} > 0 AND {ok} THEN {_AMOUNT} ELSE {zero} END",
        "execution_count": f"CAST(prior_executions + {n} + CAST({esc} AS INT) AS BIGINT)",
        "automated_attempts": f"CAST(prior_automated + {s}automated AS BIGINT)",
        "description": S.case([("invalid", f"{s}error"), (esc, S.quoted(C.OUTCOME_ESCALATED)),
                               (f"{n} = 0 AND (prior_terminal OR done_before)", S.quoted(C.SKIPPED_TERMINAL)),
                               (f"{n} = 0", S.quoted(C.SKIPPED_NO_ATTEMPT))], _describe(fin, ok, f"{s}prob")),
        "cost": f"CASE WHEN {n} > 0 THEN {_eval_cost(final)} END",
        "trail": f"{s}trail",
        "escalated": esc,
        "recovery_status_after": S.case([(esc, "'ESCALATED'"), (f"{n} = 0", "recovery_status"), (ok, "'RECOVERED'"), (f"{fin} = {escalate}", "'ESCALATED'"),
                                         (f"{fin} = {S.quoted(C.STOP)}", "'STOPPED'")], "'FAILED'"),
        "retry_count_after": f"{s}retry",
    }
    df = own_method(_with(df, **{f"{s}out_{k}": v for k, v in fields.items()}))
    packed = ", ".join(f"{S.quoted(k)}, {s}out_{k}" for k in fields)
    return own_method(df.select(*inputs, F.expr(f"named_struct({packed})").alias(name)))


def baseline(df: DataFrame, name: str = "baseline") -> DataFrame:
    """Naive strategy (ST-01): one retry_payment when amount < 25,000 and the
    customer has not opted out; otherwise stop.  Writes no audit rows and
    ignores the fraud flag."""
    inputs = df.columns
    df = df.withColumns({"_b_error": row_error(F.col("amount"), F.col("retry_count")), "_b_untouched": F.expr("invalid OR done_before"),
                         "_b_eligible": F.expr("NOT hv AND NOT optout AND NOT invalid AND NOT done_before")})
    df = _with(df, _b_ok=f"_b_eligible AND {_succeeded(S.quoted('retry_payment'), 'p_retry_payment')}")
    action = f"CASE WHEN _b_untouched THEN CAST(NULL AS STRING) WHEN _b_eligible THEN 'retry_payment' ELSE {S.quoted(C.STOP)} END"
    none = "CAST(NULL AS STRING)"
    fields = {
        "strategy": S.quoted(name), "risk_score": "CAST(NULL AS INT)", "risk_level": none, "root_cause": none, "recommended_action": none,
        "policy_result": none, "final_action": action,
        "status": S.case([("invalid", "'ERROR'"), ("_b_untouched", "'SKIPPED'"), ("NOT _b_eligible", "'FAILED'"), ("_b_ok", "'SUCCESS'")], "'FAILURE'"),
        "amount_recovered": f"CASE WHEN _b_ok THEN {_AMOUNT} ELSE CAST(0 AS {MONEY_T}) END",
        "execution_count": "CAST(_b_eligible AS BIGINT)", "automated_attempts": "CAST(_b_eligible AS BIGINT)",
        "description": S.case([("invalid", "_b_error"), ("_b_untouched", S.quoted(C.SKIPPED_TERMINAL)),
                               ("_b_eligible", _describe("'retry_payment'", "_b_ok", "p_retry_payment"))], S.quoted(C.BASELINE_STOPPED)),
        "cost": f"CASE WHEN NOT _b_untouched THEN {_eval_cost(action)} END",
    }
    packed = ", ".join(f"{S.quoted(k)}, {v}" for k, v in fields.items())
    return own_method(df.select(*inputs, F.expr(f"named_struct({packed})").alias(name)))
