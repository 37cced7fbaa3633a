"""Row validity (PF-08): the reason why a transaction cannot be recovered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_error(amount: Column, retry_count: Column) -> Column:
    """NULL for a valid row; NULL / negative amount, then negative retry count."""
    shown = F.coalesce(amount.cast("double").cast("string"), F.lit("None"))
    return (F.when(amount.isNull() | (amount < 0), F.concat(F.lit("Invalid transaction amount: "), shown, F.lit(".")))
            .when(retry_count < 0, F.concat(F.lit("Invalid retry count: "), retry_count.cast("string"), F.lit("."))))


def is_invalid(amount: Column, retry_count: Column) -> Column:
    return F.coalesce((amount < 0) | (retry_count < 0), F.lit(False)) | amount.isNull()


def is_recovered(recovery_status: Column, status: Column) -> Column:
    """Already recovered (RECOVERED, or legacy SUCCESS): nothing is left to do."""
    return F.coalesce(F.upper(recovery_status).isin("RECOVERED", "SUCCESS"), F.lit(False)) \
        | F.coalesce(F.upper(status) == "SUCCESS", F.lit(False))
