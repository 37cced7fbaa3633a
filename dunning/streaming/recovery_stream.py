"""Structured Streaming forms of the recovery state (SM-01..SM-03).

* :func:`incremental_recovery` (SM-01): new failed transactions arrive as files;
  each micro-batch is gated (every id is decided once, over all runs), enriched
  against a customer context prepared once per run, decided, and its result and
  audit rows written.  The checkpoint and output folders are the caller's and
  stay the same between runs, so a second run goes on after the files the first
  has seen.  Outputs are partitioned by the stream (a name derived from the
  checkpoint folder) and the batch id, with dynamic partition overwrite: a
  replayed batch leaves one copy, and two streams cannot touch each other's rows.
* :func:`attempt_state` (SM-02): state per transaction over a stream of execution
  rows (attempts used, automated actions tried, terminal flag) as a streaming
  aggregate in update mode; the batch twin is ``enrich.history``.  With a history to
  start from, use :mod:`dunning.streaming.attempt_stream`.
* :func:`dedupe_actions` (SM-03): each (transaction, action) acted on once.
  No watermark: the domain never expires history, so state grows with the
  number of distinct pairs; bound it with a watermark on event time where the
  business allows forgetting.

All folders belong on storage that the whole cluster shares.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as C
from ..operators.audit import audit_rows
from ..operators.enrich import customer_context, with_context
from ..operators.strategies import evaluate, results


def stream_name(checkpoint_dir: str) -> str:
    return hashlib.sha256(checkpoint_dir.rstrip("/").encode()).hexdigest()[:16]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _write_batch(df: DataFrame, path: str, stream: str, batch_id: int) -> None:
    (df.withColumn("stream", F.lit(stream)).withColumn("batch_id", F.lit(batch_id))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("stream", "batch_id").parquet(path))


def run_stream(reader: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint_dir: str, mode: str = "append") -> None:
    q = (reader.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(path)


def incremental_recovery(spark: SparkSession, source_dir: str, schema, customers: DataFrame, invoices: DataFrame,
                         out_dir: str, checkpoint_dir: str, strategy: str = "optimizer",
                         prior_audit: DataFrame | None = None, files_per_batch: int | None = None) -> tuple[str, str]:
    """Decide every transaction in files not seen yet; returns the folders of all
    result and audit rows so far.  An id that was decided before, by any stream
    into ``out_dir``, is left out; of an id repeated in a batch one row is taken.
    Invalid and finished transactions get ERROR and SKIPPED results."""
    out_dir, stream = out_dir.rstrip("/"), stream_name(checkpoint_dir)
    result_dir, audit_dir = f"{out_dir}/results", f"{out_dir}/audit"
    context_dir, decided_dir = f"{out_dir}/context/{stream}", f"{out_dir}/decided/{stream}"
    customer_context(customers, invoices).write.mode("overwrite").parquet(context_dir)
    context = spark.read.parquet(context_dir)

    def decide_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        new = batch.dropDuplicates(["transaction_id"])
        if _exists(session, result_dir):
            done = (session.read.parquet(result_dir)
                    .where(~((F.col("stream") == stream) & (F.col("batch_id") == batch_id)))  # a replay of this batch
                    .select("transaction_id"))
            new = new.join(done, "transaction_id", "left_anti")
        # decided once for both writes
        evaluate(with_context(new, context, prior_audit=prior_audit), which=(strategy,)).select(
            "transaction_id", "amount", "failure_code", strategy).write.mode("overwrite").parquet(decided_dir)
        wide = session.read.parquet(decided_dir)
        _write_batch(results(wide, which=(strategy,)), result_dir, stream, batch_id)
        _write_batch(audit_rows(wide, strategy), audit_dir, stream, batch_id)

    run_stream(read_stream(spark, source_dir, schema, files_per_batch), decide_batch, checkpoint_dir)
    return result_dir, audit_dir


def attempt_state(spark: SparkSession, executions_dir: str, schema, out_dir: str, checkpoint_dir: str,
                  files_per_batch: int | None = None) -> DataFrame:
    """SM-02 over execution rows arriving as files; returns the state of each
    transaction after all batches so far (the last update of each key)."""
    tried = [F.bool_or(F.col("agent_action") == a).alias(f"tried_{a}") for a in C.ACTION_NAMES]
    state = read_stream(spark, executions_dir, schema, files_per_batch).groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("executions"),
        F.count_if(F.col("agent_action").isin(*C.AUTOMATED)).alias("automated"),
        F.coalesce(F.bool_or(F.col("agent_action").isin(*C.EXITS)), F.lit(False)).alias("terminal"), *tried)
    stream = stream_name(checkpoint_dir)
    run_stream(state, lambda batch, batch_id: _write_batch(batch, out_dir, stream, batch_id), checkpoint_dir, mode="update")
    fields = ["executions", "automated", "terminal", *[f"tried_{a}" for a in C.ACTION_NAMES]]
    last = (spark.read.parquet(out_dir).where(F.col("stream") == stream).groupBy("transaction_id")
            .agg(F.max_by(F.struct(*fields), "batch_id").alias("s")).select("transaction_id", "s.*"))
    actions = F.concat_ws(",", *[F.when(F.col(f"tried_{a}"), F.lit(a)) for a in C.ACTION_NAMES])
    return last.select("transaction_id", "executions", "automated", "terminal", actions.alias("actions"))


def dedupe_actions(spark: SparkSession, executions_dir: str, schema, out_dir: str, checkpoint_dir: str,
                   files_per_batch: int | None = None) -> DataFrame:
    """SM-03: first occurrence of each (transaction, action); the file sink commits
    each batch once."""
    q = (read_stream(spark, executions_dir, schema, files_per_batch)
         .dropDuplicates(["transaction_id", "agent_action"])
         .writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_dir)
