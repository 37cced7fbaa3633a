"""Risk score, level, signals, breakdown and reason (SX-01..SX-08).

All pieces are Column expressions evaluated per row inside whole-stage
codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalog as C
from .text import money_text, template

_D1 = "decimal(10,1)"


def norm_code(code: Column) -> Column:
    return F.upper(F.coalesce(code, F.lit("")))


def failure_severity(code: Column) -> Column:
    c = norm_code(code)
    return (F.when(c.isin("CARD_EXPIRED", "LIMIT_EXCEEDED"), 20)
            .when(c.isin("CUSTOMER_DECLINED", "UNKNOWN_ERROR"), 15)
            .when(c == "INSUFFICIENT_FUNDS", 10)
            .when(c.isin(*C.BANK_CODES), 5)
            .otherwise(0))


def clipped_amount(amount: Column) -> Column:
    return F.greatest(F.coalesce(amount, F.lit(0).cast("decimal(18,2)")), F.lit(0).cast("decimal(18,2)"))


def amount_factor(amount: Column) -> Column:
    """``min(amount/50000, 1) * 30`` to one decimal, exact on decimals."""
    a = F.least(clipped_amount(amount), F.lit(50000).cast("decimal(18,2)"))
    return F.round(a * F.lit("0.0006").cast("decimal(4,4)"), 1).cast(_D1)


def history_factor(rate: Column, flag: Column) -> Column:
    return (F.when(flag, 25).when(rate < 0.5, 25).when(rate < 0.8, 15)
            .when(rate < 0.95, 5).otherwise(0))


def clipped_retries(retry_count: Column) -> Column:
    return F.greatest(F.coalesce(retry_count, F.lit(0)), F.lit(0))


def retry_factor(retry_count: Column) -> Column:
    r = clipped_retries(retry_count)
    return F.when(r == 1, 10).when(r >= 2, 15).otherwise(0)


def clipped_overdue(days: Column) -> Column:
    return F.greatest(F.coalesce(days, F.lit(0)), F.lit(0))


def overdue_factor(days: Column) -> Column:
    d = clipped_overdue(days)
    return F.when(d > 30, 10).when(d > 10, 7).when(d > 0, 3).otherwise(0)


def risk_level(score: Column) -> Column:
    return (F.when(score <= 30, "LOW").when(score <= 60, "MEDIUM")
            .when(score <= 80, "HIGH").otherwise("CRITICAL"))


def risk_signals(amount: Column, code: Column, retry_count: Column, rate: Column,
                 flag: Column, days: Column) -> Column:
    c = norm_code(code)
    s = C.RISK_SIGNALS
    a = clipped_amount(amount)
    r = clipped_retries(retry_count)
    d = clipped_overdue(days)
    pct = (rate * 100).cast("int")
    items = [
        F.when(c.isin("CARD_EXPIRED", "LIMIT_EXCEEDED"), template(s["sev_high"], code=c))
        .when(c.isin("CUSTOMER_DECLINED", "UNKNOWN_ERROR"), template(s["sev_moderate"], code=c))
        .when(c == "INSUFFICIENT_FUNDS", F.lit(s["sev_liquidity"]))
        .when(c.isin(*C.BANK_CODES), F.lit(s["sev_transient"])),
        F.when(a >= 25000, template(s["high_value"], amount=money_text(a))),
        F.when(flag, F.lit(s["fraud"]))
        .when(rate < 0.5, template(s["rate_low"], pct=pct))
        .when(rate < 0.8, template(s["rate_sub"], pct=pct)),
        F.when(r == 1, F.lit(s["retry_one"])).when(r >= 2, template(s["retry_many"], n=r)),
        F.when(d > 30, template(s["overdue_severe"], d=d))
        .when(d > 10, template(s["overdue_moderate"], d=d))
        .when(d > 0, template(s["overdue_recent"], d=d)),
    ]
    empty = F.array().cast("array<string>")
    return F.flatten(F.array(*[F.when(i.isNotNull(), F.array(i)).otherwise(empty) for i in items]))


def risk(amount: Column, code: Column, retry_count: Column, rate: Column,
         flag: Column, days: Column) -> Column:
    """Struct(score, level, signals, breakdown, reason).

    ``rate`` is the risk-side rate (see :func:`risk_rate`), ``flag`` a
    non-null boolean, ``days`` the first invoice's days overdue (NULL = none).
    """
    sev = failure_severity(code)
    amt = amount_factor(amount)
    hist = history_factor(rate, flag)
    ret = retry_factor(retry_count)
    ovd = overdue_factor(days)
    raw = sev.cast(_D1) + amt + hist.cast(_D1) + ret.cast(_D1) + ovd.cast(_D1)
    score = F.least(F.bround(raw, 0).cast("int"), F.lit(100))
    c = norm_code(code)
    reason = F.concat_ws(
        ", ",
        template("Severity: {s} ({c})", s=sev, c=F.when(c == "", "UNKNOWN").otherwise(c)),
        template("Amount: {f} (₹{a})", f=amt, a=money_text(clipped_amount(amount))),
        template("History: {h} (Success rate {r})", h=hist, r=F.format_number(rate, 2)),
        template("Retry: {f} (Count {n})", f=ret, n=clipped_retries(retry_count)),
        template("Overdue: {f} ({d} days overdue)", f=ovd, d=clipped_overdue(days)),
    )
    return F.struct(
        score.alias("risk_score"),
        risk_level(score).alias("risk_level"),
        risk_signals(amount, code, retry_count, rate, flag, days).alias("signals"),
        F.struct(sev.alias("failure_severity"), amt.alias("amount_factor"),
                 hist.alias("customer_history_factor"), ret.alias("retry_factor"),
                 ovd.alias("overdue_factor")).alias("breakdown"),
        reason.alias("reason"),
    )


def risk_base(amount: Column, code: Column, rate: Column, flag: Column, days: Column) -> Column:
    """Score parts that do not change between attempts (all but the retry
    factor), as decimal(10,1)."""
    return (failure_severity(code).cast(_D1) + amount_factor(amount)
            + history_factor(rate, flag).cast(_D1) + overdue_factor(days).cast(_D1))
