"""Ordered policy guardrail (SX-15) and its mapping to the executed action (SX-16).

The decision part (rule code) is a small CASE over boolean columns; the reason
text is rendered separately, only where a table shows it (audit rows, the
policy matrix), so the attempt loop carries no text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalog as C
from .text import money_text, template


@dataclass
class PolicyContext:
    """Per-row inputs of the policy (all Columns)."""
    done: Column          # status SUCCESS or recovery_status RECOVERED/SUCCESS
    high_value: Column    # amount >= 25,000
    fraud: Column         # customer exists and is flagged
    opted_out: Column     # contact preference (defaulted, lower-cased) == 'none'
    attempts: Column      # executions so far
    history: Column       # array<string> of executed actions


def done_flag(status: Column, recovery_status: Column) -> Column:
    s = F.upper(F.coalesce(status, F.lit("")))
    r = F.upper(F.coalesce(recovery_status, F.lit("UNRECOVERED")))
    return (s == "SUCCESS") | r.isin("RECOVERED", "SUCCESS")


def _conditions(action: Column, ctx: PolicyContext) -> list[tuple[str, Column]]:
    is_exit = F.coalesce(action.isin(*C.EXITS), F.lit(False))
    return [
        ("ALREADY_SUCCESSFUL", ctx.done),
        ("HIGH_VALUE_THRESHOLD", ctx.high_value),
        ("CUSTOMER_FRAUD_FLAG", ctx.fraud),
        ("MAX_ATTEMPTS_EXHAUSTED", (ctx.attempts >= C.MAX_ATTEMPTS) & ~is_exit),
        ("DUPLICATE_ACTION", F.coalesce(F.array_contains(ctx.history, action), F.lit(False)) & ~is_exit),
        ("COMMUNICATION_OPT_OUT", F.coalesce(action.isin(*C.CONTACT_ACTIONS), F.lit(False)) & ctx.opted_out),
        ("SAFETY_EXIT", is_exit),
        ("UNSUPPORTED_ACTION", ~F.coalesce(action.isin(*C.AUTOMATED), F.lit(False))),
    ]


def policy_rule(action: Column, ctx: PolicyContext) -> Column:
    """Rule code of the first matching outcome (``POLICY_APPROVED`` if none)."""
    e = None
    for rule, cond in _conditions(action, ctx):
        e = F.when(cond, rule) if e is None else e.when(cond, rule)
    return e.otherwise("POLICY_APPROVED")


def result_of(rule: Column) -> Column:
    e = None
    for code, res in C.POLICY_RESULTS.items():
        e = F.when(rule == code, res) if e is None else e.when(rule == code, res)
    return e


def reason_text(rule: Column, action: Column, transaction_id: Column, amount: Column) -> Column:
    e = None
    for code, tpl in C.POLICY_REASONS.items():
        parts = {}
        if "{action}" in tpl:
            parts["action"] = action
        if "{tx}" in tpl:
            parts["tx"] = transaction_id
        if "{amount}" in tpl:
            parts["amount"] = money_text(F.coalesce(amount, F.lit(0)))
        txt = template(tpl, **parts) if parts else F.lit(tpl)
        e = F.when(rule == code, txt) if e is None else e.when(rule == code, txt)
    return e


def policy_verdict(action: Column, ctx: PolicyContext, transaction_id: Column, amount: Column) -> Column:
    """Struct(allowed, action, result, reason, policy_rule); first match wins."""
    rule = policy_rule(action, ctx)
    result = result_of(rule)
    return F.struct(
        (result == "APPROVED").alias("allowed"),
        action.alias("action"),
        result.alias("result"),
        reason_text(rule, action, transaction_id, amount).alias("reason"),
        rule.alias("policy_rule"),
    )


def approves(action: str, ctx: PolicyContext) -> Column:
    """True when the policy approves a fixed catalog automated action."""
    if action not in C.AUTOMATED:
        raise ValueError(action)
    blocked = ctx.done | ctx.high_value | ctx.fraud | (ctx.attempts >= C.MAX_ATTEMPTS) \
        | F.coalesce(F.array_contains(ctx.history, F.lit(action)), F.lit(False))
    if action in C.CONTACT_ACTIONS:
        blocked = blocked | ctx.opted_out
    return ~blocked


def final_action(result: Column, action: Column) -> Column:
    """ESCALATE -> escalate_to_human; REJECTED / STOP -> stop_recovery."""
    return (F.when(result == "ESCALATE", F.lit(C.ESCALATE))
            .when(result.isin("REJECTED", "STOP"), F.lit(C.STOP))
            .otherwise(action))
