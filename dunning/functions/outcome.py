"""Outcome of an executed action against the recorded draw (JN-09, SX-17).

The outcome table holds one draw ``u_bp`` in basis points per transaction,
shared by every attempt and strategy (common random numbers).  An automated
action succeeds iff ``u_bp < probability * 10000``; exits never recover.  A
missing draw counts as a failed attempt.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalog as C
from .text import money_text, template


def succeeded(action: Column, prob: Column, u_bp: Column) -> Column:
    is_exit = F.coalesce(action.isin(*C.EXITS), F.lit(False))
    return F.coalesce(~is_exit & (u_bp < prob * 10000), F.lit(False))


def describe(action: Column, ok: Column, amount: Column, prob: Column) -> Column:
    """Outcome description text of an executed action."""
    amt = F.coalesce(amount, F.lit(0).cast("decimal(18,2)"))
    return (F.when(action == C.ESCALATE, F.lit(C.OUTCOME_ESCALATED))
            .when(action == C.STOP, F.lit(C.OUTCOME_STOPPED))
            .when(ok, template(C.OUTCOME_SUCCESS, action=action, amount=money_text(amt)))
            .otherwise(template(C.OUTCOME_FAILURE, action=action, pct=(prob * 100).cast("int"))))


def recovered(ok: Column, amount: Column) -> Column:
    return F.when(ok, F.coalesce(amount, F.lit(0).cast("decimal(18,2)"))).otherwise(F.lit(0).cast("decimal(18,2)"))


def outcome(action: Column, amount: Column, prob: Column, u_bp: Column) -> Column:
    """Struct(status, amount_recovered, description, success)."""
    ok = succeeded(action, prob, u_bp)
    return F.struct(
        F.when(ok, "SUCCESS").otherwise("FAILURE").alias("status"),
        recovered(ok, amount).alias("amount_recovered"),
        describe(action, ok, amount, prob).alias("description"),
        ok.alias("success"),
    )


def recovery_status_after(action: Column, ok: Column) -> Column:
    """State written by an execution (the original ``status`` never changes)."""
    return (F.when(ok, "RECOVERED").when(action == C.ESCALATE, "ESCALATED")
            .when(action == C.STOP, "STOPPED").otherwise("FAILED"))
