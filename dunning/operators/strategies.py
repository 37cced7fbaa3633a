"""Strategy runs and their comparison (ST-01..03, ST-08, SO-01, JN-06).

All three strategies are computed side by side on the same enriched row (the
same draw, the same context), so comparing them needs no join: the wide form
has one struct per strategy, the long form (SO-01) is an ``explode`` of those
structs, and every summary is a partial aggregate over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.erv import prepare
from ..schemas import RESULT_COLUMNS
from .attempts import baseline, decide, own_method

STRATEGIES = ["baseline", "rules", "optimizer"]
_COMMON = [c for c in RESULT_COLUMNS if c not in ("transaction_id", "amount", "failure_code")]


def plan_barrier(df: DataFrame) -> DataFrame:
    """Re-emit every row through a one-element ``explode``.

    The decision columns are deep expressions over the loop state.  A filter
    or projection placed on them later (``status = 'SUCCESS'``, a facet) would
    otherwise be pushed down by substituting those expressions, re-inlining
    the whole decision logic into every predicate.  Generate is not crossed
    by predicate pushdown or projection collapsing, so downstream plans stay
    small; the cost is one map-side row copy.
    """
    return df.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("_row")) \
        .select("_row.*")


def evaluate(enriched: DataFrame, model: bool = False, which=tuple(STRATEGIES), shape=None) -> DataFrame:
    """Wide form: one row per transaction, one result struct per strategy.

    ``shape`` (DataFrame to DataFrame) says what is read of it: columns that it leaves out
    are not computed, which a selection behind the barrier cannot bring about."""
    df = own_method(prepare(own_method(enriched)))
    if "baseline" in which:
        df = baseline(df)
    if "rules" in which:
        df = decide(df, "rules", "rules")
    if "optimizer" in which:
        df = decide(df, "optimizer", "optimizer", model=model)
    return plan_barrier(df if shape is None else shape(df))


def results(wide: DataFrame, which=tuple(STRATEGIES)) -> DataFrame:
    """Long form (SO-01): one row per (strategy, transaction)."""
    packed = F.array(*[F.struct(*[F.col(f"{s}.{c}").alias(c) for c in _COMMON]) for s in which])
    return (wide.select("transaction_id", "amount", "failure_code", F.explode(packed).alias("r"))
            .select("transaction_id", "amount", "failure_code", "r.*")
            .select(*RESULT_COLUMNS))


def pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """JN-06 for stored result tables: match two strategies per transaction.

    (Results computed here already share a row; this is for tables read back
    from storage.)"""
    l = left.select("transaction_id", F.col("final_action").alias("left_action"))
    r = right.select("transaction_id", F.col("final_action").alias("right_action"))
    return l.join(r, "transaction_id", "inner")
