"""Operator 9: MinHash near-dedup with fast similarity sketching.

A sketch has ``BANDS * ROWS`` coordinates.  In round i every shingle is hashed to
one random coordinate and offers (i, hash) there; the least offer stays.  From
round ``BANDS * ROWS`` on, every shingle offers to one fixed coordinate in each
round, so all coordinates are filled at the latest after twice as many rounds,
and a text drops out as soon as it is full.  Like plain MinHash, two sketches
agree in a coordinate with the similarity's probability, well concentrated, but
a text of n shingles costs about n + t log t offers and not n * t.

Banding: texts that agree in all ``ROWS`` coordinates of a band are candidates.
At similarity 0.8 a band agrees with probability 0.8**7 = 0.21, so one of 48
agrees with probability 1 - 1.2e-5.

Texts with equal sets are one class from the start.  Candidates are confirmed
on the full sets without all pairs of a bucket: first each class against the
least class of its bucket, and the links found are joined into components.  Then,
only in buckets that still hold several components, in blocks, the classes outside
the main component are held against all others by sketch, and pairs of different
components that agree in about as many coordinates as similar sets do (5.5 standard
deviations below the threshold at least) are confirmed on the full sets.  A pair that
shares several bands counts in the first, and a class gives one link to each
component, so pairs are never written out.  Pairs within a component need no check,
as components are all that is asked for.

Defined results: null text counts as empty; a row without words has an empty set
and is linked with nothing; repeated rows are in one component; a null id sorts
last, and is its own component_id where it stands alone; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, keep_rows, staged, texts
from .components import connected_components
from .groups import group_tables, in_blocks
from .words import chunks, flat, mix, shingle_sets, tidy

BANDS, ROWS = 48, 7
BLOCK = 512


def sketches(shingle: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """One row of ``size`` coordinates for each set (all ones for an empty set)."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(at) - 1, size), empty, np.uint64)
    active = np.nonzero(np.diff(at))[0]
    element, owner = shingle, np.repeat(np.arange(len(active)), np.diff(at)[active])
    part = out[active]
    for i in range(2 * size):
        if not len(active):
            break
        x = mix(element + np.uint64(0x632BE59BD9B4E019 * (i + 1) & 0xFFFFFFFFFFFFFFFF))
        offer = (np.uint64(i) << np.uint64(53)) | (x >> np.uint64(11))
        place = (mix(x) % np.uint64(size)).astype(np.int64) if i < size else i - size
        np.minimum.at(part.reshape(-1), owner * size + place, offer)
        full = ~(part == empty).any(axis=1)
        if full.any():
            out[active[full]] = part[full]
            stay = ~full[owner]
            element, owner = element[stay], (np.cumsum(~full) - 1)[owner[stay]]
            active, part = active[~full], part[~full]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketch), bands)).copy()
    for k in range(rows):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + sketch[:, k::rows])
    return key


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
    return total[at[1:]] - total[at[:-1]]


def _describe(size: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            data, at = flat(batch.column("text"))
            for i, j in chunks(at):
                shingle, own = shingle_sets(data[at[i]:at[j]], at[i:j + 1] - at[i], size)
                n = np.diff(own)
                sketch = sketches(shingle, own, bands * rows)[n > 0]
                key = band_keys(sketch, bands, rows)
                where = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0)))).astype(np.int32)
                low = pa.py_buffer(sketch.astype(np.uint8).tobytes())  # the last byte of each coordinate
                short = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((where * rows).astype(np.int32).tobytes()), low])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(i, j - i) for c in ("doc_id", "th", "rid")]
                    + [pa.array(n, pa.int64()), pa.array(_sums(mix(shingle), own).view(np.int64)),
                       pa.array(_sums(mix(shingle ^ np.uint64(0x5851F42D4C957F2D)), own).view(np.int64)),
                       pa.ListArray.from_arrays(pa.array(where), pa.array(key.reshape(-1).view(np.int64))), short],
                    names=["doc_id", "th", "rid", "n", "d1", "d2", "bands", "sketch"])
    return run


def _confirm(size: int, percent: int):
    def run(batches):
        for batch in batches:
            sides = [flat(batch.column(c)) for c in ("text_a", "text_b")]
            both = (sides[0][1][1:] - sides[0][1][:1]) + (sides[1][1][1:] - sides[1][1][:1])
            keep = np.zeros(batch.num_rows, bool)
            for i, j in chunks(np.concatenate(([0], both))):
                (sa, pa_), (sb, pb) = (shingle_sets(d[at[i]:at[j]], at[i:j + 1] - at[i], size) for d, at in sides)
                for k in range(j - i):
                    x, y = sa[pa_[k]:pa_[k + 1]], sb[pb[k]:pb[k + 1]]
                    if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        keep[i + k] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))
    return run


def _confirmed(pairs: DataFrame, text: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of row numbers whose whole sets are similar enough."""
    first = text.select(F.col("rid").alias("a"), F.col("text").alias("text_a"))
    second = text.select(F.col("rid").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")
    return staged(both.mapInArrow(tidy(_confirm(size, percent)), "a long, b long"), "op9-links")


def _compared(size: int, percent: int):
    """Links (a, b) between different components in each pair of blocks of a bucket.

    Pairs that share an earlier band are left to it.  Of the others, those whose sketches
    agree in nearly as many coordinates as similar sets do are confirmed on the full
    sets.  One link of a class to each component is enough."""
    def run(batches):
        for t in group_tables(batches, ["key", "one", "two"]):
            cid, n, root, block = (t.column(c).to_numpy() for c in ("cid", "n", "root", "block"))
            sketch = np.stack([np.frombuffer(x.as_py(), np.uint8) for x in t.column("sketch")])
            bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(cid), -1)
            earlier = int(np.nonzero(bands[0] == t.column("key")[0].as_py())[0][0])
            p = percent / 100
            least = sketch.shape[1] * p - 5.5 * np.sqrt(sketch.shape[1] * p * (1 - p))
            across = t.column("one")[0] != t.column("two")[0]
            values, counts = np.unique(root, return_counts=True)
            other = np.nonzero(root != values[counts.argmax()])[0]  # every pair asked for has one of these
            todo = {}
            for i in other.tolist():
                near = np.nonzero((root != root[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & ((block != block[i]) | (not across)))[0]
                near = near[(sketch[near] == sketch[i]).sum(axis=1) >= least]
                near = near[~(bands[near, :earlier] == bands[i, :earlier]).any(axis=1)]
                if len(near):
                    todo[i] = near
            if not todo:
                continue
            used = np.unique(np.concatenate([*todo.values(), np.array(list(todo))]))
            data, at = flat(t.column("text").combine_chunks().take(pa.array(used)))
            sets = [shingle_sets(data[at[i]:at[j]], at[i:j + 1] - at[i], size) for i, j in chunks(at)]
            shingle = np.concatenate([x for x, _ in sets])
            lengths = np.concatenate([np.diff(x) for _, x in sets])
            begin = np.concatenate(([0], np.cumsum(lengths)))
            local = np.unique(shingle, return_inverse=True)[1]
            mark = np.zeros(local.max() + 1, np.int32)
            links = []
            for i, near in todo.items():
                k, rows = int(np.searchsorted(used, i)), np.searchsorted(used, near)
                own = local[begin[k]:begin[k + 1]]
                mark[own] = 1
                common = np.array([mark[local[begin[r]:begin[r + 1]]].sum() for r in rows.tolist()])
                mark[own] = 0
                linked = near[100 * common >= percent * (lengths[k] + lengths[rows] - common)]
                for j in linked[np.unique(root[linked], return_index=True)[1]].tolist():
                    links.append((cid[i], cid[j]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.array(links, np.int64).T], names=["a", "b"])
    return run


def _linked(members: DataFrame, text: DataFrame, sketch: DataFrame, size: int, percent: int) -> DataFrame:
    """Components (node, root) of the classes in ``members`` (key, cid, hub)."""
    stars = staged(members.where("cid != hub").select(F.col("cid").alias("a"), F.col("hub").alias("b")).distinct(), "op9-pairs")
    roots = connected_components(_confirmed(stars, text, size, percent))
    placed = (members.select("key", "cid").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
              .withColumn("root", F.coalesce("root", "cid")))
    mixed = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    apart = staged(placed.join(mixed, "key", "left_semi").select("key", "cid", "root"), "op9-open")
    rows = in_blocks(apart.join(sketch, "cid").join(text.withColumnRenamed("rid", "cid"), "cid"), ["key"], "cid", BLOCK)
    links = staged(rows.mapInArrow(tidy(_compared(size, percent)), "a long, b long"), "op9-links")
    return connected_components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                    percent: int = 80, bands: int = BANDS, band_rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, and further
    keeper (exactly one row of each component) and th."""
    bounded_batches(docs.sparkSession)
    source = texts(docs, id_col, text_col)
    id_type = source.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type)] + [T.StructField(c, T.LongType()) for c in ("th", "rid", "n", "d1", "d2")]
                          + [T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])
    rows = staged(source.select("doc_id", "th", F.monotonically_increasing_id().alias("rid"), F.col("text").cast("binary").alias("text"))
                  .mapInArrow(tidy(_describe(words, bands, band_rows)), schema), "op9-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first")
    classes = staged(rows.where("n > 0").groupBy("d1", "d2").agg(F.min("rid").alias("cid"), first, F.first("n").alias("n")), "op9-classes")
    buckets = (rows.join(classes.select(F.col("cid").alias("rid")), "rid", "left_semi")
               .select(F.explode("bands").alias("key"), F.col("rid").alias("cid")))
    shared = buckets.groupBy("key").agg(F.min("cid").alias("hub"), F.max("cid").alias("top")).where("hub < top").select("key", "hub")
    members = staged(buckets.join(shared, "key").select("key", "cid", "hub"), "op9-members")
    used = members.select(F.col("cid").alias("rid")).distinct()
    names = rows.select("rid", F.col("doc_id").alias("name"), F.col("th").alias("name_th")).join(used, "rid")
    text = staged(source.join(names, F.col("doc_id").eqNullSafe(F.col("name")) & (F.col("th") == F.col("name_th")))
                  .select("rid", F.col("text").cast("binary").alias("text")), "op9-texts")
    sketch = rows.select(F.col("rid").alias("cid"), "n", "sketch", "bands")
    roots = _linked(members, text, sketch, words, percent)

    located = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    groups = located.groupBy("root").agg(F.min("first").alias("least"))
    named = located.select("d1", "d2", "root").join(groups, "root").select("d1", "d2", "least")
    return (rows.select("doc_id", "th", "rid", "n", F.when(F.col("n") > 0, F.col("d1")).alias("d1"), "d2")
            .join(named, ["d1", "d2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
                    F.when(F.col("least").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("least.doc_id"))).alias("kept"),
                    F.when(F.col("least").isNull(), F.lit(True)).otherwise(F.col("rid") == F.col("least.rid")).alias("keeper"), "th"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """One row of each component, with all its columns."""
    return keep_rows(docs, near_duplicates(docs, id_col, text_col, **parameters).where("keeper"), id_col, text_col)
