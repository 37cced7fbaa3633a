"""Success probability and expected recovery value (SX-13, SX-14, TK-05).

The probability table in :mod:`dunning.catalog` is turned into CASE
expressions over two small per-row columns, the failure-code class and the
customer band; :func:`prepare` gives one probability and one expected-net
column per action, for reports and candidate lists.  The attempt loop looks its
action up in :mod:`dunning.functions.envelope` instead, which tests compare
with :func:`best_allowed`.  The candidate set is an ``array<struct>`` built per
row, so ranking needs no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from . import envelope as EN
from . import sqltext as S
from .risk import norm_code, risk_base
from .validity import is_invalid, is_recovered

PROB_T = "decimal(3,2)"
MONEY_T = "decimal(18,2)"
COST_T = "decimal(5,1)"


def code_class(code: Column) -> Column:
    c = norm_code(code)
    e = None
    for name, codes in C.CODE_CLASSES.items():
        e = (F.when(c.isin(*codes), name) if e is None else e.when(c.isin(*codes), name))
    return e.otherwise("OTHER")


def net_text(amount: str, prob: str, cost: str) -> str:
    """SQL text of the expected net, rounded half-up to 2 decimals from the exact product
    (``amount*p - cost``)."""
    return f"CAST(round(coalesce({amount}, CAST(0 AS {MONEY_T})) * {prob} - {cost}, 2) AS {MONEY_T})"


def prepare(df: DataFrame) -> DataFrame:
    """Per-row decision constants, evaluated once:

    ``invalid`` / ``done_before`` (rows the loop must not touch),
    ``code_cls``, ``band`` and their numbers, the amount in ``cents``, policy flags
    ``hv`` / ``optout``, the bit set ``prior_mask`` of automated actions tried before, the
    attempt-independent risk score part ``risk_base``, ``p_<action>`` (probability under the raw code,
    used for outcomes) and ``net_<action>`` (expected net under the ranking
    code, which for a code-derived cause is the same class).
    """
    cls = S.case([(f"upper(coalesce(failure_code, '')) IN {S.names(codes)}", S.quoted(c)) for c, codes in C.CODE_CLASSES.items()], "'OTHER'")
    df = df.withColumns({
        "code_cls": F.expr(cls),
        "band": F.expr(f"CASE WHEN erv_rate >= {C.BAND_HI} THEN 'hi' WHEN erv_rate < {C.BAND_LO} THEN 'lo' ELSE 'mid' END"),
        "hv": F.expr(f"coalesce(amount, 0) >= {C.HIGH_VALUE_THRESHOLD}"),
        "optout": F.expr("preference = 'none'"),
        "risk_base": risk_base(F.col("amount"), F.col("failure_code"), F.col("risk_rate"),
                               F.col("risk_flag"), F.col("days_overdue")),
        "invalid": is_invalid(F.col("amount"), F.col("retry_count")),
        "done_before": is_recovered(F.col("recovery_status"), F.col("status")),
        "cents": F.expr(f"CAST(coalesce(amount, CAST(0 AS {MONEY_T})) * 100 AS BIGINT)"),
        "prior_mask": F.expr(" + ".join(f"CASE WHEN array_contains(prior_actions, {S.quoted(a)}) THEN {b} ELSE 0 END" for a, b in EN.BIT.items())),
    })
    df = df.withColumns({
        "cls_no": F.expr(S.lookup("code_cls", {c: str(i) for i, c in enumerate(EN.CLASSES)})),
        "band_no": F.expr(S.lookup("band", {b: str(i) for i, b in enumerate(EN.BANDS)})),
    })
    cols = {}
    for action in C.ACTION_NAMES:
        if action in EN.BIT:
            by_state = ", ".join(str(EN.probability(action, c, b)) for c in EN.CLASSES for b in EN.BANDS)
            p = f"element_at(CAST(array({by_state}) AS ARRAY<{PROB_T}>), cls_no * {len(EN.BANDS)} + band_no + 1)"
        elif action == C.ESCALATE:
            p = f"CAST(CASE WHEN ltv >= {C.HIGH_LTV} THEN {C.ESCALATE_PROB_HIGH_LTV} ELSE {C.ESCALATE_PROB} END AS {PROB_T})"
        else:
            p = f"CAST(0 AS {PROB_T})"
        cols[f"p_{action}"] = F.expr(p)
    df = df.withColumns(cols)
    return df.withColumns({f"net_{a}": F.expr(net_text("amount", f"p_{a}", f"CAST({cost} AS {COST_T})")) for a, _, cost, _, _ in C.ACTIONS})


def candidates(df: DataFrame) -> Column:
    """``array<struct>`` of the 7 catalog actions in catalog order (JN-04),
    from the prepared per-row ``p_*`` / ``net_*`` columns."""
    items = []
    for action, order, rank_cost, eval_cost, kind in C.ACTIONS:
        p = F.col(f"p_{action}")
        gross = F.round(F.coalesce(F.col("amount"), F.lit(0).cast(MONEY_T)) * p, 2).cast(MONEY_T)
        items.append(F.struct(
            F.lit(action).alias("action"),
            F.lit(order).alias("catalog_order"),
            p.alias("probability"),
            F.lit(str(rank_cost)).cast(COST_T).alias("cost"),
            gross.alias("expected_gross"),
            F.col(f"net_{action}").alias("expected_net"),
            F.lit(kind == "automated").alias("automated"),
        ))
    return F.array(*items)


def eval_cost_of(action: Column) -> Column:
    """Evaluation cost of an action; 1.0 for an action outside the catalog."""
    e = None
    for a, _, _, ec, _ in C.ACTIONS:
        v = F.lit(str(ec)).cast(COST_T)
        e = F.when(action == a, v) if e is None else e.when(action == a, v)
    return e.otherwise(F.lit(str(C.UNKNOWN_ACTION_EVAL_COST)).cast(COST_T))


def best_allowed(nets: dict[str, Column], allowed_fn) -> Column:
    """Argmax of expected net over the automated actions that ``allowed_fn``
    approves; ties keep catalog order; ``stop_recovery`` when none (TK-05).

    ``nets``: action -> expected-net Column; ``allowed_fn(action) -> Column``.
    """
    items = []
    for action, order, _, _, kind in C.ACTIONS:
        if kind != "automated":
            continue
        items.append(F.when(allowed_fn(action),
                            F.struct(nets[action].alias("net"), F.lit(-order).alias("neg_order"),
                                     F.lit(action).alias("action"))))
    # greatest() skips NULLs and orders structs field by field; unlike an
    # array filter it stays inside whole-stage code generation.
    best = F.greatest(*items)
    return F.coalesce(best["action"], F.lit(C.STOP))
