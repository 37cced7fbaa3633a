"""Readers and writers with declared schemas (SC-01..SC-07, SK-01..SK-03, SK-06).

No schema inference at read time; writes are idempotent (overwrite of a
whole folder or, for run tables, of the partitions a run produced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..session import materialized

RESULTS_CSV = T.StructType([
    T.StructField("strategy", T.StringType()),
    T.StructField("transaction_id", T.StringType()),
    T.StructField("amount", S.MONEY),
    T.StructField("failure_code", T.StringType()),
    T.StructField("risk_score", T.IntegerType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("root_cause", T.StringType()),
    T.StructField("recommended_action", T.StringType()),
    T.StructField("policy_result", T.StringType()),
    T.StructField("final_action", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("amount_recovered", S.MONEY),
    T.StructField("execution_count", T.LongType()),
    T.StructField("automated_attempts", T.LongType()),
    T.StructField("description", T.StringType()),
    T.StructField("cost", T.DecimalType(5, 1)),
])

SUMMARY_JSON = T.StructType([
    T.StructField("strategy", T.StringType()),
    T.StructField("transactions", T.StructType([
        T.StructField("total", T.LongType()), T.StructField("recovered", T.LongType()),
        T.StructField("escalated", T.LongType()), T.StructField("stopped", T.LongType()),
        T.StructField("automated_attempts", T.LongType())])),
    T.StructField("money", T.StructType([
        T.StructField("revenue_at_risk", T.DoubleType()), T.StructField("revenue_recovered", T.DoubleType()),
        T.StructField("operational_cost", T.DoubleType()), T.StructField("net_recovery", T.DoubleType())])),
    T.StructField("rates", T.StructType([
        T.StructField("transaction_recovery_rate", T.DoubleType()),
        T.StructField("revenue_recovery_rate", T.DoubleType()),
        T.StructField("avg_attempts_per_tx", T.DoubleType())])),
])


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """SC-01..SC-04 / SC-07: a domain table with its declared schema."""
    r = spark.read.schema(schema)
    if fmt == "csv":
        return r.option("header", True).csv(path)
    if fmt == "json":
        return r.json(path)
    return r.format(fmt).load(path)


def write_results_csv(results: DataFrame, path: str) -> None:
    """SK-01: result rows as CSV with a header (one folder per run)."""
    results.select(*[F.col(f.name).cast(f.dataType) for f in RESULTS_CSV.fields]) \
        .write.mode("overwrite").option("header", True).csv(path)


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """SC-05: result CSVs read back with the declared schema."""
    return spark.read.schema(RESULTS_CSV).option("header", True).csv(path)


def write_summary_json(summary: DataFrame, path: str) -> None:
    """SK-02: the strategy summary as nested JSON (one object per strategy)."""
    nested = summary.select(
        "strategy",
        F.struct(F.col("transactions").alias("total"), F.col("transactions_recovered").alias("recovered"),
                 F.col("escalated_cases").alias("escalated"), F.col("stopped_cases").alias("stopped"),
                 "automated_attempts").alias("transactions"),
        F.struct("revenue_at_risk", "revenue_recovered", "operational_cost", "net_recovery").alias("money"),
        F.struct("transaction_recovery_rate", "revenue_recovery_rate", "avg_attempts_per_tx").alias("rates"),
    )
    nested.coalesce(1).write.mode("overwrite").json(path)


def read_summary_json(spark: SparkSession, path: str) -> DataFrame:
    """SC-06: nested summary back to flat summary columns."""
    j = spark.read.schema(SUMMARY_JSON).option("multiLine", False).json(path)
    return j.select(
        "strategy",
        F.col("transactions.total").alias("transactions"),
        F.col("money.revenue_at_risk").alias("revenue_at_risk"),
        F.col("transactions.recovered").alias("transactions_recovered"),
        F.col("rates.transaction_recovery_rate").alias("transaction_recovery_rate"),
        F.col("money.revenue_recovered").alias("revenue_recovered"),
        F.col("rates.revenue_recovery_rate").alias("revenue_recovery_rate"),
        F.col("money.operational_cost").alias("operational_cost"),
        F.col("money.net_recovery").alias("net_recovery"),
        F.col("transactions.escalated").alias("escalated_cases"),
        F.col("transactions.stopped").alias("stopped_cases"),
        F.col("rates.avg_attempts_per_tx").alias("avg_attempts_per_tx"),
        F.col("transactions.automated_attempts").alias("automated_attempts"),
    )


def write_runs(results: DataFrame, path: str) -> None:
    """SK-06: replace only the strategy partitions present in ``results``."""
    (results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("strategy").parquet(path))


def append_audit(audit: DataFrame, path: str, run_id: str) -> None:
    """SK-03: add a run's audit rows, partitioned by strategy and run; a retried
    append of the same run replaces its own rows only."""
    (audit.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("strategy", "run_id").parquet(path))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """SC-04: audit rows with the declared schema (strategy from the folder)."""
    return spark.read.schema(S.AUDIT).parquet(path)


# ---------------------------------------------------------------- malformed input
def read_checked(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """SC-05 / SC-06 with a quarantine: (good rows with ``schema``, bad records).

    A record that the schema cannot read, or without a ``required`` field, is kept as
    ``file``, ``record`` (as it was written) and ``reason``: the first field whose value does
    not fit, a missing required field, ``not JSON``, or ``wrong number of fields``.  The
    files are read once, both results come from that copy."""
    whole = T.StructType([*schema.fields, T.StructField("_record", T.StringType())])
    reader = spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_record")
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)
    rows = materialized(df.select("*", F.col("_metadata.file_path").alias("_file")), "checked")
    absent = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]
    lacking = F.coalesce(*absent) if absent else F.lit(None).cast("string")
    good = rows.where(F.col("_record").isNull() & lacking.isNull()).select(*schema.names)
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    as_text = (F.from_csv("_record", ", ".join(f"`{n}` string" for n in schema.names)) if fmt == "csv" else F.from_json("_record", texts))
    misfits = [F.when(F.col(f"t.{f.name}").isNotNull() & F.col(f"t.{f.name}").try_cast(f.dataType).isNull(), F.lit(f"bad {f.name}"))
               for f in schema.fields if not isinstance(f.dataType, (T.StringType, T.StructType))]
    other = "wrong number of fields" if fmt == "csv" else "not JSON"
    broken = (rows.where(F.col("_record").isNotNull()).select("_file", F.col("_record").alias("record"), as_text.alias("t"))
              .select(F.col("_file").alias("file"), "record", F.coalesce(*misfits, F.lit(other)).alias("reason")))
    partial = rows.where(F.col("_record").isNull() & lacking.isNotNull()).select(
        F.col("_file").alias("file"), F.to_json(F.struct(*schema.names)).alias("record"), lacking.alias("reason"))
    return good, broken.unionByName(partial)


# ---------------------------------------------------------------- stored tables
def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> None:
    """A catalog table in ``path``, bucketed and sorted by ``key``: joins and aggregates on it
    between such tables need no exchange.  Rows are dealt to the buckets first, so there
    is one file a bucket."""
    (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
     .option("path", path).format("parquet").saveAsTable(table))


def write_observed(df: DataFrame, path: str, metrics: dict[str, Column]) -> DataFrame:
    """Write ``df`` and compute ``metrics`` (aggregates over it) in the same pass; one row."""
    seen = Observation()
    df.observe(seen, *[c.alias(n) for n, c in metrics.items()]).write.mode("overwrite").parquet(path)
    values = seen.get
    types = df.select(*[c.alias(n) for n, c in metrics.items()]).schema
    return df.sparkSession.createDataFrame([tuple(values[n] for n in metrics)], types)
