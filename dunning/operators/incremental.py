"""KPIs kept up to date by changes (AG-01..AG-04, AG-07).

A state table holds additive measures per (failure code, recovery status): transactions,
amount, recovered amount.  A changed snapshot is a set of replaced partitions; their old
rows are subtracted and their new rows added, so an update reads what changed and a KPI
read reads the state, never all transactions.  Sums are exact decimals, so any number of
updates equals a recomputation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import pct2
from .metrics import RECOVERED_STATUSES

GROUP = ["failure_code", "recovery_status"]
MEASURES = ["transactions", "amount", "recovered_amount"]
_SUM = "decimal(38,2)"


def _measured(rows: DataFrame, sign: int) -> DataFrame:
    """Measures of rows, counted ``sign`` times; combined map-side."""
    done = F.upper(F.coalesce("recovery_status", F.lit(""))).isin(*RECOVERED_STATUSES)
    return rows.groupBy(*GROUP).agg(
        (F.count(F.lit(1)) * sign).alias("transactions"),
        (F.coalesce(F.sum("amount"), F.lit(0)) * sign).cast(_SUM).alias("amount"),
        (F.coalesce(F.sum(F.when(done, F.col("amount"))), F.lit(0)) * sign).cast(_SUM).alias("recovered_amount"))


def kpi_state(rows: DataFrame) -> DataFrame:
    """The state of a whole snapshot."""
    return _measured(rows, 1)


def changed_state(state: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The state after the rows ``old`` became ``new`` (either may be empty: rows that come
    or go); groups without transactions leave it."""
    both = state.unionByName(_measured(old, -1)).unionByName(_measured(new, 1))
    return (both.groupBy(*GROUP).agg(*[F.sum(m).cast("long" if m == "transactions" else _SUM).alias(m) for m in MEASURES])
            .where("transactions <> 0"))


def kpis(state: DataFrame) -> DataFrame:
    """Totals and rates as ``metrics.kpis`` has them, from the state alone."""
    done = F.upper(F.coalesce("recovery_status", F.lit(""))).isin(*RECOVERED_STATUSES)
    zero = lambda c: F.coalesce(c, F.lit(0))
    t = state.agg(zero(F.sum("transactions")).alias("n"), zero(F.sum("amount")).alias("risk"),
                  zero(F.sum(F.when(done, F.col("transactions")))).alias("done"), zero(F.sum("recovered_amount")).alias("revenue"))
    rate = lambda x, base: F.when(F.col(base) > 0, pct2(F.col(x).cast("double") / F.col(base).cast("double") * 100)).otherwise(F.lit(0.0))
    return t.select(F.col("n").cast("long").alias("total_transactions"), F.col("risk").cast("double").alias("revenue_at_risk"),
                    F.col("done").cast("long").alias("recovered_transactions"), F.col("revenue").cast("double").alias("recovered_revenue"),
                    rate("revenue", "risk").alias("recovery_rate_percentage"), rate("done", "n").alias("transaction_recovery_rate_percentage"))


def failure_breakdown(state: DataFrame) -> DataFrame:
    """Transactions by failure code, without a missing one."""
    return (state.where("failure_code IS NOT NULL AND failure_code <> ''").groupBy("failure_code")
            .agg(F.sum("transactions").cast("long").alias("n")))


def replace_parts(snapshot_dir: str, part: str, parts: list, new: DataFrame, state: DataFrame) -> DataFrame:
    """Replace some partitions of a stored snapshot and return the state after it.  Only
    these partitions are read; ``state`` must be that of the stored snapshot."""
    spark = new.sparkSession
    old = spark.read.parquet(snapshot_dir).where(F.col(part).isin(*parts))
    after = changed_state(state, old, new)
    after = spark.createDataFrame(after.collect(), after.schema)  # one row per code and status: bounded by the catalog
    (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(snapshot_dir))
    return after
