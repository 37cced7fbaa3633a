"""Positions in ordered groups by a distributed prefix count (WN-02, TK-03).

``row_number`` over a group sorts the whole group in one task, so a transaction with a
large share of the rows is not shared out.  Here rows are range-partitioned by group and
order, which cuts a large group at will; each partition numbers its own part of a group,
and a group that fills several partitions gets the counts of its earlier parts added.
Only groups that cross a partition boundary need that, so the table of offsets has at most
two rows a partition and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialized


def with_positions(df: DataFrame, key: str, order: list[str], name: str, counted: Column | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` with the long ``name``: the place (from 1) among the counted rows of the same
    ``key`` by ``order``; NULL where a row is not counted.  Rows equal in key and order get
    different places, in any order."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = [f"o{i}" for i in range(len(order))]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{key}`").alias("k"),
                     (F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))).alias("counts"),
                     *[F.col(f"`{c}`").alias(o) for c, o in zip(order, places)])
    rows = rows.repartitionByRange(n, "k", *places).sortWithinPartitions("k", *places)
    rows = materialized(rows.select("row", "k", "counts", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "positions")
    local = Window.partitionBy("part", "k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("place", F.sum(F.col("counts").cast("long")).over(local))
    parts = rows.groupBy("k", "part").agg(F.count_if("counts").alias("n"))
    several = parts.groupBy("k").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select(F.col("k").alias("k1"))
    before = Window.partitionBy("k1").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (parts.join(several, F.col("k").eqNullSafe(F.col("k1")))
               .select("k1", F.col("part").alias("part1"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    offsets = materialized(offsets, "offsets")
    if offsets.count() > 2 * n:
        raise RuntimeError("more group parts than partition boundaries allow")
    found = numbered.join(F.broadcast(offsets), (F.col("part") == F.col("part1")) & F.col("k").eqNullSafe(F.col("k1")), "left")
    return found.select("row.*", F.when(F.col("counts"), F.col("place") + F.coalesce(F.col("before"), F.lit(0))).alias(name))
