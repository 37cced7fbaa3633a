"""Operator 1: embedding near-dedup by random-hyperplane sign hashing.

Equal vectors of a label are one class, found by an aggregate over 128 bits of hash
and combined before the shuffle; one vector stands for a class, and its links count
by the sizes of the classes at their other ends, so copies are never paired.  Each of
several tables hashes a class's vector to the signs of its products with random
hyperplanes; vectors of one label (and one length) that share a table's bucket
are compared by cosine in double precision.  The number of signs grows with the
logarithm of the rows, which keeps buckets at about ``BUCKET`` rows, and the
number of tables is then chosen so that a pair exactly at the threshold shares
no bucket with a probability of at most ``MISS``.

A bucket of more than ``BLOCK`` rows is split into blocks and each pair of blocks is a
group of its own, so no task ever needs a whole hot bucket and no pair is left
out.  Pairs are never written: a group gives, for each vector, a count of its
links and one edge to the least vector it reaches inside the group.  A pair that
shares several buckets counts in the first of them only, as each row carries its
signs of all tables.  The edges go to the distributed connected components.

Defined results: a vector that is null, empty, zero, or holds a null or
non-finite component, and one with a null label, has no links and is its own
component; repeated rows are linked like any others; vectors of different
length are never linked; a null id sorts last; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, staged
from .components import connected_components
from .groups import group_tables

BUCKET, BLOCK, MISS = 128, 1024, 1e-6
_GROUP = ["label", "dim", "table", "bits", "one", "two"]


def plan_tables(rows: int, cosine: float, miss: float = MISS) -> tuple[int, int]:
    """(signs in a table, tables) for this many rows."""
    signs = min(30, max(4, math.ceil(math.log2(max(rows, 1) / BUCKET))))
    same = (1 - math.acos(cosine) / math.pi) ** signs
    return signs, math.ceil(math.log(miss) / math.log(1 - same))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _signs(signs: int, tables: int):
    weights = (1 << np.arange(signs, dtype=np.int64))

    def run(batches):
        planes = {}
        for batch in batches:
            lengths = np.asarray(batch.column("dim"))
            keys = np.zeros((batch.num_rows, tables), np.int32)
            for d in np.unique(lengths):
                at = np.nonzero(lengths == d)[0]
                if d not in planes:
                    planes[d] = np.random.default_rng([7, int(d)]).standard_normal((int(d), signs * tables))
                above = _matrix(batch.column("vec").take(pa.array(at))) @ planes[d] > 0
                keys[at] = above.reshape(len(at), tables, signs) @ weights
            where = np.arange(batch.num_rows + 1, dtype=np.int32) * tables
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("rid", "label", "dim", "copies", "vec")]
                + [pa.ListArray.from_arrays(pa.array(where), pa.array(keys.reshape(-1)))],
                names=["rid", "label", "dim", "copies", "vec", "keys"])
    return run


def local_links(rid, block, vec, keys, copies, table: int, one: int, two: int, cosine: float):
    """Of one group: link counts (rid, n: copies at the other ends) and edges (rid, least
    rid) of the vectors linked in it, by pairs that share no earlier table."""
    x = vec / np.linalg.norm(vec, axis=1)[:, None]
    left, right = np.nonzero(block == one)[0], np.nonzero(block == two)[0]
    near = x[left] @ x[right].T >= cosine
    if one == two:
        near = np.triu(near, 1)
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    if table and len(a):
        first = np.concatenate([~(keys[a[i:i + 262144], :table] == keys[b[i:i + 262144], :table]).any(axis=1)
                                for i in range(0, len(a), 262144)])
        a, b = a[first], b[first]
    if not len(a):
        return None
    n = np.zeros(len(rid), np.int64)
    np.add.at(n, a, copies[b])
    np.add.at(n, b, copies[a])
    order = np.argsort(rid, kind="stable")
    rank = np.empty(len(rid), np.int64)
    rank[order] = np.arange(len(rid))
    least, a, b = np.arange(len(rid)), rank[a], rank[b]
    while True:
        old = least.copy()
        np.minimum.at(least, a, least[b])
        np.minimum.at(least, b, least[a])
        least = least[least]
        if (least == old).all():
            break
    linked = np.nonzero(n)[0]
    return rid[linked], n[linked], rid[order[least[rank[linked]]]]


def _groups(cosine: float):
    def emit(found):
        arrays = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found)]
        return pa.RecordBatch.from_arrays(arrays, names=["rid", "n", "least"])

    def run(batches):
        found, size = [], 0
        for t in group_tables(batches, _GROUP):
            if t.num_rows < 2:
                continue
            col = lambda c: t.column(c).to_numpy()  # noqa: E731, B023
            vec, keys = (_matrix(t.column(c).combine_chunks()) for c in ("vec", "keys"))
            got = local_links(col("rid"), col("block"), vec, keys, col("copies"), int(col("table")[0]), int(col("one")[0]), int(col("two")[0]), cosine)
            if got is not None:
                found.append(got)
                size += len(got[0])
            if size > 50_000:
                yield emit(found)
                found, size = [], 0
        if found:
            yield emit(found)
    return run


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    cosine: float = 0.98, block: int = BLOCK) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    spark = table.sparkSession
    bounded_batches(spark)
    v = F.col(f"`{vector_col}`")
    kind = table.schema[vector_col].dataType
    if not isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        v, kind = v.cast("array<double>"), T.ArrayType(T.DoubleType())
    rows = staged(table.select(F.col(f"`{id_col}`").alias("vec_id"), v.alias("vec"), F.col(f"`{label_col}`").alias("name"),
                               F.monotonically_increasing_id().alias("rid")), "op1-rows")
    proper = (F.col("name").isNotNull() & (F.size("vec") > 0)
              & ~F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("vec", lambda c: c != 0))
    label = F.col("name").cast("long") if isinstance(table.schema[label_col].dataType, T.IntegralType) else F.xxhash64("name")
    good = rows.where(F.coalesce(proper, F.lit(False))).select(
        "rid", "vec_id", label.alias("label"), F.size("vec").alias("dim"), F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"), "vec")
    same = ["label", "dim", "h1", "h2"]
    classes = staged(good.groupBy(same).agg(F.min("rid").alias("cid"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")), "op1-classes")
    signs, tables = plan_tables(classes.count(), cosine)
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("label", T.LongType()), T.StructField("dim", T.IntegerType()),
                           T.StructField("copies", T.LongType()), T.StructField("vec", kind), T.StructField("keys", T.ArrayType(T.IntegerType()))])
    hashed = staged(classes.select(F.col("cid").alias("rid"), "label", "dim", "copies", "vec").mapInArrow(_signs(signs, tables), schema), "op1-signs")
    place = ["label", "dim", "table", "bits"]
    narrow = hashed.select("rid", "label", "dim", F.posexplode("keys").alias("table", "bits"))
    blocks = (narrow.groupBy(place).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
              .select(*place, F.ceil(F.col("m") / block).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    dealt = (narrow.join(blocks, place).withColumn("block", own)
             .select("rid", F.struct(*[F.col(c) for c in ("table", "bits", "block", "blocks")]).alias("g"))
             .groupBy("rid").agg(F.collect_list("g").alias("groups")))  # at most one for each table
    pairs = (hashed.join(dealt, "rid").select("rid", "label", "dim", "copies", "vec", "keys", F.explode("groups").alias("g"))
             .select("rid", "label", "dim", "copies", "vec", "keys", "g.*")
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("rid", "label", "dim", "copies", "vec", "keys", "table", "bits", "block",
                     F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")))
    found = staged(pairs.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
                   .mapInArrow(_groups(cosine), "rid long, n long, least long"), "op1-links")
    counts = found.groupBy("rid").agg(F.sum("n").alias("n")).select(F.col("rid").alias("cid"), "n")
    roots = connected_components(found.select(F.col("rid").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("cid"), "root")
    by_class = (classes.select(*same, "cid", "copies").join(counts, "cid", "left").join(roots, "cid", "left")
                .select(*same, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root"))
                .where("n_links > 0"))
    linked = staged(good.select("rid", "vec_id", *same).join(by_class, same).select("rid", "vec_id", "n_links", "root"), "op1-linked")
    first = linked.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = linked.join(first, "root").select("rid", "n_links", "component_id")
    return (rows.select("rid", "vec_id").join(named, "rid", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
