"""Model diagnosis as two streaming rounds (MI-04, MI-05, JN-10).

An attempt that asks the model writes a request with the time it was asked; the service
writes its answers, in any order, with the time they came.  A round joins the two streams:
an answer counts if it came within the time limit, and a request whose limit has passed by
the watermark goes on without one, to the fallback.  Each micro-batch is an ordinary join of
its rows with those still waiting (:func:`timed_answers`); only requests and answers inside
the limit and the watermark's delay wait, in one of two folders that take turns, so what
came and was settled in the same batch never enters a state store.

:func:`two_phase_diagnosis` runs the rounds: the requests of all first attempts; then
the requests of those that failed, which are known only when the first answers are;
then the decision with both.  All folders belong on storage that the cluster shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.model_io import attach_responses, parsed_responses
from ..operators.strategies import evaluate
from .recovery_stream import run_stream

TIME_LIMIT = "12 seconds"
DELAY = "1 minute"
#: Id of the row that ends a finite input; it moves the watermark past every limit.
CLOSING = "(end of input)"
REQUESTS = "transaction_id string, attempt_no int, asked_at timestamp"
RESPONSES = "transaction_id string, attempt_no int, response_text string, answered_at timestamp"
JOINED = "transaction_id string, attempt_no int, asked_at timestamp, response_text string, answered_at timestamp"
_MARKS = "asked timestamp, answered timestamp"


def timed_answers(requests: DataFrame, responses: DataFrame, watermark: str, limit: str = TIME_LIMIT) -> DataFrame:
    """What a batch gives out: one row per answer in time, and one without text (and
    ``answered_at``) per request that got none and whose limit has passed by ``watermark``.

    Both inputs hold what waited and, marked ``fresh``, what the batch brought; a pair that
    waited together was given out before.  An answer waits no shorter than its request, so a
    request without a pair here never had one."""
    q, r = requests.alias("q"), responses.alias("r")
    in_time = F.expr(f"q.transaction_id = r.transaction_id AND q.attempt_no = r.attempt_no "
                     f"AND r.answered_at >= q.asked_at AND r.answered_at <= q.asked_at + INTERVAL {limit}")
    given = f"CASE WHEN r.answered_at IS NULL THEN {_passed('q.asked_at', watermark, limit)} ELSE q.fresh OR r.fresh END"
    return q.join(r, in_time, "left_outer").where(given).select(
        "q.transaction_id", "q.attempt_no", "q.asked_at", "r.response_text", "r.answered_at")


def _passed(time: str, watermark: str, limit: str) -> str:
    return f"coalesce({time} + INTERVAL {limit} <= {watermark}, false)"


def close_input(spark: SparkSession, requests_dir: str, responses_dir: str) -> None:
    """Append the closing row to both inputs, a year after the last request and answer."""
    for path, time in ((requests_dir, "asked_at"), (responses_dir, "answered_at")):
        rows = spark.read.schema(REQUESTS if time == "asked_at" else RESPONSES).parquet(path)
        last = rows.agg(F.max(time).alias("t")).select((F.coalesce("t", F.expr("timestamp_seconds(0)")) + F.expr("INTERVAL 366 DAYS")).alias("t"))
        mark = last.select(*[F.lit(CLOSING).alias(c) if c == "transaction_id" else F.lit(0).alias(c) if c == "attempt_no"  # join keys: not null
                             else F.col("t").alias(c) if c == time else F.lit(None).cast("string").alias(c) for c in rows.columns])
        mark.coalesce(1).write.mode("append").parquet(path)


def run_round(spark: SparkSession, requests_dir: str, responses_dir: str, out_dir: str, checkpoint_dir: str,
              limit: str = TIME_LIMIT, delay: str = DELAY, files_per_batch: int | None = None) -> DataFrame:
    """Join what both folders hold so far; returns all rows given out yet.

    As with any two-sided watermark, it is the lesser of the latest request and the latest
    answer, less ``delay``; a row that comes at or before the watermark of the batches
    before it is left out, and one without a time can neither match nor time out.  Every
    batch writes folders of its own, and the rows that waited before it stay until the
    next one is done: a replayed batch leaves the same rows, once."""
    out_dir, waiting_dir = out_dir.rstrip("/"), f"{checkpoint_dir.rstrip('/')}-waiting"
    places = {"asked_at": (requests_dir, REQUESTS), "answered_at": (responses_dir, RESPONSES)}

    def stream(time: str) -> DataFrame:
        path, schema = places[time]
        reader = spark.readStream.schema(schema)
        rows = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)
        return rows.withColumn("request", F.lit(time == "asked_at"))

    def settle(batch: DataFrame, batch_id: int) -> None:
        session, slot = batch.sparkSession, lambda n: f"{waiting_dir}/slot={n % 2}"
        old = session.read.schema(_MARKS).parquet(f"{slot(batch_id - 1)}/marks") if batch_id else session.createDataFrame([], _MARKS)
        seen = batch.select(F.col("asked_at").alias("asked"), F.col("answered_at").alias("answered")).unionByName(old)
        marks = seen.agg(F.max("asked").alias("asked"), F.max("answered").alias("answered"))
        marks.write.mode("overwrite").parquet(f"{slot(batch_id)}/marks")
        before, after = (_watermark(rows, delay) for rows in (old, session.read.schema(_MARKS).parquet(f"{slot(batch_id)}/marks")))
        both = {}
        for time, (_, schema) in places.items():
            new = (batch.where(F.col("request") if time == "asked_at" else ~F.col("request")).where(f"{time} > coalesce({before}, {time} - INTERVAL 1 SECOND)")
                   .select(*[c.split()[0] for c in schema.split(", ")], F.lit(True).alias("fresh")))
            both[time] = new
            if batch_id:
                kept = session.read.schema(schema).parquet(f"{slot(batch_id - 1)}/{time}")
                both[time] = new.unionByName(kept.withColumn("fresh", F.lit(False)))
            both[time].where(f"NOT {_passed(time, after, limit)}").drop("fresh").write.mode("overwrite").parquet(f"{slot(batch_id)}/{time}")
        timed_answers(both["asked_at"], both["answered_at"], after, limit).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    run_stream(stream("asked_at").unionByName(stream("answered_at"), allowMissingColumns=True), settle, checkpoint_dir)
    out = spark.read.schema(JOINED).parquet(out_dir).drop("batch")
    return out.where(F.col("transaction_id") != CLOSING)


def _watermark(marks: DataFrame, delay: str) -> str:
    """The watermark of one row of :data:`_MARKS`, as a literal; NULL until both inputs had rows."""
    row = marks.selectExpr(f"unix_micros(CASE WHEN asked IS NOT NULL AND answered IS NOT NULL THEN least(asked, answered) END - INTERVAL {delay}) AS at").first()
    return f"timestamp_micros({row.at})" if row and row.at is not None else "CAST(NULL AS TIMESTAMP)"


def _answers(joined: DataFrame) -> DataFrame:
    """Answers in time, the latest of several last."""
    return joined.where("response_text IS NOT NULL").select("transaction_id", "attempt_no", "response_text",
                                                            F.unix_micros("answered_at").alias("recorded_seq"))


def two_phase_diagnosis(enriched: DataFrame, responses_dir: str, work_dir: str, asked_at=None, second_after: str = "1 hour",
                        strategy: str = "optimizer", columns=None) -> DataFrame:
    """The wide results of a run whose attempts ask the model (``columns`` of them, if given).
    ``responses_dir`` holds the service's answers; requests, their outcome and the streams'
    checkpoints go below ``work_dir``.  First attempts ask at ``asked_at`` (default: the
    transaction's time), second ones ``second_after`` later.

    A transaction that the first answers settle is decided once; the others are stored as
    they came and decided again with both answers."""
    spark = enriched.sparkSession
    at = (F.col("timestamp") if asked_at is None else asked_at).cast("timestamp")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{work_dir}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work_dir}/{name}")

    def answers(k: int, requests: DataFrame) -> DataFrame:
        requests_dir, told_dir = f"{work_dir}/requests-{k}", f"{work_dir}/told-{k}"
        requests.write.parquet(requests_dir)
        spark.read.schema(RESPONSES).parquet(responses_dir).where(F.col("attempt_no") == k).write.parquet(told_dir)
        close_input(spark, requests_dir, told_dir)
        joined = run_round(spark, requests_dir, told_dir, f"{work_dir}/answers-{k}", f"{work_dir}/checkpoint-{k}")
        return stored(parsed_responses(_answers(joined)), f"read-{k}")

    def decided(rows: DataFrame, told: DataFrame, shape) -> DataFrame:
        return evaluate(attach_responses(rows, told), model=True, which=(strategy,), shape=shape)

    def kept(df: DataFrame) -> list[str]:
        return list(columns or df.columns)

    def split(df: DataFrame) -> DataFrame:
        again = F.coalesce(F.array_contains(f"{strategy}.trail.attempts_before", 1), F.lit(False))  # its second attempt asks
        return (df.withColumn("again", again)
                .select("again", F.when(F.col("again"), F.struct(*enriched.columns)).alias("row"),
                        F.when(~F.col("again"), F.struct(*kept(df))).alias("done")))

    told = answers(1, enriched.where("NOT prior_terminal").select("transaction_id", F.lit(1).alias("attempt_no"), at.alias("asked_at")))
    first = stored(decided(enriched, told, split), "first")
    rows = first.where("again").select("row.*")
    second = answers(2, rows.select("transaction_id", F.lit(2).alias("attempt_no"), (at + F.expr(f"INTERVAL {second_after}")).alias("asked_at")))
    both = decided(rows, told.unionByName(second), lambda df: df.select(*kept(df)))
    return first.where("NOT again").select("done.*").unionByName(both)
