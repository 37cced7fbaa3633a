"""Session helpers: scale-oriented SQL settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a job of this library expects.  They only steer the planner (AQE
# re-planning, skew splitting, partition coalescing); none changes results.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
}


# The decision projections compile to large methods; the JVM leaves methods
# over 8000 bytes of bytecode interpreted unless this is switched off.  Set the
# same option on executors of a cluster.
JVM_OPTS = "-XX:-DontCompileHugeMethods"


def apply_scale_conf(spark: SparkSession) -> None:
    for k, v in SCALE_CONF.items():
        spark.conf.set(k, v)


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "dunning") -> SparkSession:
    """Session for tests, bench and the smoke entry (local mode only)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.extraJavaOptions", JVM_OPTS)
        .config("spark.executor.extraJavaOptions", JVM_OPTS)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    apply_scale_conf(spark)
    return spark


def spread_small(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its source has fewer splits than there are cores (a file of
    one row group is one split); a larger source stays as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: what follows sees
    the same rows however often it is computed.  Removed when the session ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must be present (a shared file system path); a
    private temporary folder is used only when running in local mode and the
    setting is absent, as in tests.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = spark.sparkContext.getCheckpointDir()
        if d:
            return d
        d = tempfile.mkdtemp(prefix="dunning-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d
