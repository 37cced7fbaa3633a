"""Corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet under the shared checkpoint folder and reads it again for the next one.  All
stages but the last return the columns of their input.

Empty tables, null texts, repeated rows and extra columns pass as the operators define
it; a document that the suffix stage leaves without text goes, one that had none stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunning.llm import compression_quality, exact_dedup, minhash_dedup, packing, suffix_dedup
from dunning.llm.common import bounded_batches, read, staged

#: Bytes of a repeated passage to cut: one of over 50 words in prose has more, of short words it may have less.
REPEAT_BYTES = 240


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts (score of 0.5 or more)."""
    bounded_batches(spark)
    model = compression_quality.fit(docs, read(spark, sf_dir, "labels"), compression_quality.teaching_rows())
    return compression_quality.accepted(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of those that are equal but for white space."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity 0.8)."""
    return minhash_dedup.keep_one(docs, words=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in several places are cut out of the texts."""
    kept = suffix_dedup.cut_texts(docs, length=REPEAT_BYTES, drop_emptied=True)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(F.coalesce("text", F.lit("")))).cast(docs.schema["n_chars"].dataType))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("suffix_dedup", repeats), ("packing", sequences)]
ORACLE_SQL = None  # classifier and tokenizer are not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
