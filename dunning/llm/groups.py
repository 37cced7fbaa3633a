"""Groups of sorted rows inside an Arrow task, and their blocks.

A group that could be large is dealt as pairs of blocks: rows get a block number by
hash, each pair of blocks is a group of its own, and a row goes to every pair that
its block is in.  So all pairs of rows meet once and no task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_blocks(rows: DataFrame, keys: list[str], row_id: str, size: int) -> DataFrame:
    """``rows`` of groups with more than one row, with the columns block, one and two
    (one <= two, the pair of blocks), sorted by group and pair within partitions."""
    sizes = (rows.groupBy(keys).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
             .select(*keys, F.ceil(F.col("m") / size).cast("int").alias("blocks")))
    pairs = keys + ["one", "two"]
    return (rows.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64(row_id), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).drop("blocks", "other")
            .repartition(*pairs).sortWithinPartitions(*pairs))


def group_tables(batches, names: list[str]) -> Iterator[pa.Table]:
    """One table for each run of rows that are equal in the integer columns ``names``."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        g = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in names], axis=1)
        cuts = np.concatenate(([0], np.nonzero((g[1:] != g[:-1]).any(axis=1))[0] + 1, [len(g)]))
        for i, j in zip(cuts[:-1], cuts[1:]):
            now = tuple(g[i])
            if now != key and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            key = now
    if held:
        yield pa.Table.from_batches(held)
