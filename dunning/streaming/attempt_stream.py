"""SM-02 as keyed state in a table: attempts of a transaction over all time.

The state of a transaction (executions, automated ones, whether an exit was reached, the
catalog actions tried in the order of their first use) starts from the batch history, and
grows neither with the number of rows nor of batches.  Every batch is added up per
transaction and joined with the states before it, by Spark's own aggregates and joins, so no
row or key passes through Python.  The new states are written to one of two folders that take turns,
so the output holds each transaction once (twice on disk, at most); the states before a
batch are kept until the next one, so a replayed batch writes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as C
from ..operators.enrich import history
from .recovery_stream import read_stream, run_stream

STATE = "executions long, automated long, terminal boolean, actions string"
OUTPUT = "transaction_id string, " + STATE


def _added(batch: DataFrame) -> DataFrame:
    """What the executions of a batch add to each transaction: counts, and the catalog actions
    by their first use, in the order of attempt number."""
    action, named = F.col("agent_action"), F.struct("attempt_no")
    firsts = [F.min(F.when(action == a, named)).alias(f"at_{a}") for a in C.ACTION_NAMES]
    used = ", ".join(f"CASE WHEN at_{a} IS NOT NULL THEN named_struct('at', at_{a}, 'no', {i}, 'action', '{a}') END" for i, a in enumerate(C.ACTION_NAMES))
    rows = batch.groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("more"), F.count_if(action.isin(*C.AUTOMATED)).alias("more_automated"),
        F.coalesce(F.bool_or(action.isin(*C.EXITS)), F.lit(False)).alias("exited"), *firsts)
    return rows.select(F.col("transaction_id").alias("id"), "more", "more_automated", "exited",
                       F.expr(f"transform(array_sort(array_compact(array({used}))), x -> x.action)").alias("used"))


def next_states(states: DataFrame, batch: DataFrame) -> DataFrame:
    """The states after the executions of a batch; one row per transaction (a NULL id is one)."""
    new = "filter(coalesce(used, CAST(array() AS ARRAY<STRING>)), x -> NOT array_contains(split(coalesce(actions, ''), ','), x))"
    return states.join(_added(batch), F.col("transaction_id").eqNullSafe(F.col("id")), "full").selectExpr(
        "coalesce(transaction_id, id) AS transaction_id", "coalesce(executions, 0) + coalesce(more, 0) AS executions",
        "coalesce(automated, 0) + coalesce(more_automated, 0) AS automated", "coalesce(terminal, false) OR coalesce(exited, false) AS terminal",
        f"concat_ws(',', nullif(actions, ''), {new}) AS actions")


def initial_states(audit: DataFrame) -> DataFrame:
    """The state that earlier executions leave."""
    return history(audit).select("transaction_id", F.col("prior_executions").cast("long").alias("executions"),
                                 F.col("prior_automated").cast("long").alias("automated"), F.col("prior_terminal").alias("terminal"),
                                 F.array_join("prior_actions", ",").alias("actions"))


def _slot(out_dir: str, batch_id: int) -> str:
    return f"{out_dir.rstrip('/')}/slot={batch_id % 2}"


def resume_attempt_state(spark: SparkSession, executions_dir: str, schema, prior_audit: DataFrame, out_dir: str, checkpoint_dir: str,
                         files_per_batch: int | None = None) -> None:
    """Go on with the executions in files not seen yet; :func:`current_state` reads the
    outcome.  ``prior_audit`` counts when the checkpoint is new, and must stay the same."""
    start = initial_states(prior_audit)

    def replace(batch: DataFrame, batch_id: int) -> None:
        old = start if batch_id == 0 else batch.sparkSession.read.schema(OUTPUT).parquet(_slot(out_dir, batch_id - 1))
        next_states(old, batch).withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(_slot(out_dir, batch_id))

    run_stream(read_stream(spark, executions_dir, schema, files_per_batch), replace, checkpoint_dir)


def current_state(spark: SparkSession, out_dir: str) -> DataFrame:
    """The state of every transaction after the last batch."""
    both = spark.read.schema(OUTPUT + ", batch long").parquet(*[_slot(out_dir, k) for k in (0, 1) if _written(spark, _slot(out_dir, k))])
    last = both.agg(F.max("batch").alias("last"))
    return both.join(F.broadcast(last), F.col("batch") == F.col("last")).drop("batch", "last")


def _written(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
