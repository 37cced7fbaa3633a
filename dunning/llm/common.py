"""Shared helpers of the training-data operators.

Every operator starts from :func:`texts` or :func:`staged`, which select only
the columns it needs under private names, so extra columns of the input, even
ones called like an internal column, cannot clash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint_dir

WHITESPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text`` (null becomes empty) and ``th`` (a 64-bit hash of the
    text).  (doc_id, th) names a row; rows equal in both are repeats of one."""
    t = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("th"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()`` but in columnar files, which survive the
    loss of any executor.  Removed when the session ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """crc32 of the id's text modulo ``parts`` is ``part``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def task_count(spark: SparkSession, n_bytes: int, each: int = 16 << 20, least: int = 48) -> int:
    """Partitions for ``n_bytes`` of text so that each has about ``each`` bytes."""
    return max(least, -(-int(n_bytes) // each))


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2000 rows and about 8 MB, so that very long texts
    do not pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def whole_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` (all columns as one struct, so no name can clash), ``id`` and ``th``."""
    th = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), th.alias("th"))


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` named by ``kept`` (doc_id, th), one for each name, with
    all their columns."""
    names = kept.select(F.col("doc_id").alias("kept_id"), F.col("th").alias("kept_th"))
    both = whole_rows(docs, id_col, text_col).join(
        names, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("th") == F.col("kept_th")))
    one = Window.partitionBy("kept_id", "kept_th").orderBy(F.lit(1))
    return both.withColumn("r", F.row_number().over(one)).where("r = 1").select("row.*")
