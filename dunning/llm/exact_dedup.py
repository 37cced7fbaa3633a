"""Operator 2: exact dedup with a heavy-hitter split.

A Misra-Gries pass over the text digests finds the few digests that may hold a
large share of all rows.  Their exact counts and the row that stays come from a
map-side combined aggregate; these at most ``counters`` rows are broadcast, and
the hot rows are marked without a shuffle.  All other digests are grouped by an
ordinary shuffle, where no group is larger than about 2 / counters of the rows.

Defined results: a null text counts as empty; empty texts form a group; of
equal texts the longest original stays, then the smallest id (null ids last),
then one of the repeated rows, so every group keeps exactly one row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WHITESPACE, keep_rows, staged

COUNTERS = 1024


def digest(text: Column) -> Column:
    """Hex SHA-256 of the text without white space."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITESPACE, "").cast("binary"), 256)


def misra_gries(values: Iterator[pd.Series], counters: int) -> pd.Series:
    """Counters of a stream: every value with more than n / (counters + 1)
    occurrences is in it; a counter is at most the true count."""
    held = pd.Series(dtype="int64")
    for v in values:
        held = held.add(v.value_counts(), fill_value=0).astype("int64")
        if len(held) > counters:
            least = held.nlargest(counters + 1).iloc[-1]
            held = held[held > least] - least
    return held


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` values of the column ``sha``, among them every one that
    holds more than 2 / counters of the rows: the summaries of the partitions are
    added up, and the largest sums are taken."""
    def summary(batches):
        held = misra_gries((b["sha"] for b in batches), counters)
        yield pd.DataFrame({"sha": held.index.astype(str), "n": held.to_numpy("int64")})

    parts = digests.select("sha").mapInPandas(summary, "sha string, n long")
    return (parts.groupBy("sha").agg(F.sum("n").alias("n")).where("n > 1")
            .orderBy(F.desc("n"), "sha").limit(counters).select("sha"))


def _marked(docs: DataFrame, id_col: str, text_col: str, counters: int) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = staged(docs.select(F.col(f"`{id_col}`").alias("doc_id"), digest(text).alias("sha"), F.length(text).alias("n_cp"),
                              F.xxhash64(text).alias("th"), F.monotonically_increasing_id().alias("rid")), "op2-digests")
    place = F.struct((-F.col("n_cp")).alias("short"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    hot = F.broadcast(staged(frequent(rows, counters), "op2-frequent"))
    winners = F.broadcast(staged(
        rows.join(hot, "sha").groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), F.min(place).alias("first")),
        "op2-winners"))
    marked_hot = rows.join(winners, "sha")
    by_digest = Window.partitionBy("sha")
    marked = (rows.join(winners, "sha", "left_anti")
              .withColumn("group_size", F.count(F.lit(1)).over(by_digest))
              .withColumn("first", F.min(place).over(by_digest)))
    return marked_hot.unionByName(marked).withColumn("kept", F.col("rid") == F.col("first.rid"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    return _marked(docs, id_col, text_col, counters).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", "kept", F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return keep_rows(docs, _marked(docs, id_col, text_col, counters).where("kept"), id_col, text_col)
