"""Operator 3: suffix-array dedup of repeated byte strings.

Every byte covered by a ``length``-byte string that also starts anywhere else, in
the same text or another, is found.

1. The window starts of each text are cut into ranges of one minimiser
   (:func:`minimiser_ranges`); equal windows share the minimiser, so a minimiser
   that occurs once in the whole corpus settles its windows.  Only these narrow
   rows (about one for 140 bytes) are shuffled to count.
2. The bytes of the ranges whose minimiser occurs again are fetched, once for
   each distinct content; copies are carried as a flag, so a passage that a third
   of all texts share is one segment.
3. Segments are dealt by minimiser, and each task sorts the suffixes of its
   segments in two stages, a few MB at a time: those smaller than their
   successors are sorted directly, the others are induced by scanning the buckets.
   Neighbours with a common prefix of ``length`` bytes mark repeated windows.
4. A minimiser with more than ``SPLIT`` distinct segments (texts that share a
   passage, each with other words around it) would be one task's work; its windows
   are told apart one by one by two 64-bit hashes in an ordinary aggregate instead.
5. The marked windows go back to all texts that hold the segment, and are merged
   into spans.

Defined results: null text counts as empty; a text shorter than ``length`` keeps
all its bytes; of equal texts, repeated rows included, every row loses all it
shares with the others; a row with a null id is treated like any other; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, staged, texts, whole_rows
from .suffix_array import minimiser_ranges, repeated_starts, runs
from .words import chunks, flat, mix, prefix_sums, span_hashes, tidy as _tidy

LENGTH = 400
SPLIT = 4096
PIECE, GROUP = 1 << 20, 1 << 20
_LONG = T.LongType()


def _pieces(at: np.ndarray, length: int):
    """(row, start, end) so that every window lies in one piece of bounded size."""
    for row in range(len(at) - 1):
        n = int(at[row + 1] - at[row])
        for start in range(0, max(n, 1), PIECE):
            yield row, start, min(n, start + PIECE + length - 1)
            if start + PIECE + length - 1 >= n:
                break


def _describe(length: int, gram: int):
    def run(batches):
        for batch in batches:
            data, at = flat(batch.column("text"))
            raw = data.tobytes()
            sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            found = [[] for _ in range(6)]
            row, start, end = (np.array(x, np.int64) for x in zip(*_pieces(at, length))) if len(at) > 1 else [np.zeros(0, np.int64)] * 3
            edges = np.concatenate(([0], np.cumsum(end - start)))
            for i, j in chunks(edges, 64 << 10):
                part = np.concatenate([data[at[row[k]] + start[k]:at[row[k]] + end[k]] for k in range(i, j)])
                own, lo, hi, key, places, name = minimiser_ranges(part, edges[i:j + 1] - edges[i], length, gram)
                for to, x in zip(found, (row[i + own], lo + start[i + own], hi + start[i + own], key.view(np.int64), places, name.view(np.int64))):
                    to.append(x)
            found = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]
            many = np.bincount(found[0], minlength=batch.num_rows)
            where = pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32))
            ranges = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in found[1:]], names=["lo", "hi", "key", "places", "name"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "th", "rid")]
                + [pa.array(np.diff(at)), pa.array(sha), pa.ListArray.from_arrays(where, ranges)],
                names=["doc_id", "th", "rid", "n_bytes", "sha", "ranges"])
    return run


def _spans(key, name, flags):
    """Arrow rows (key, name, from, to): runs of marked window starts in a segment."""
    first, last, owner = [], [], []
    for k, f in enumerate(flags):
        a, b = runs(f)
        first.append(a)
        last.append(b)
        owner.append(np.full(len(a), k))
    owner = np.concatenate(owner)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(key, np.int64)[owner]), pa.array(np.asarray(name, np.int64)[owner]),
         pa.array(np.concatenate(first).astype(np.int64)), pa.array(np.concatenate(last).astype(np.int64))],
        names=["key", "name", "first", "last"])


def _sorted_groups(length: int):
    """Input in the order of (key, name); whole keys are gathered up to GROUP bytes."""
    def run(batches):
        keys, names, segments, several, size = [], [], [], [], 0
        for batch in batches:
            col = [batch.column(c).to_pylist() for c in ("key", "name", "segment", "several")]
            for k, n, s, m in zip(*col):
                if keys and k == keys[-1] and n == names[-1]:
                    continue  # the same segment of a repeated row
                if size > GROUP and k != keys[-1]:
                    yield _spans(keys, names, repeated_starts(segments, several, length))
                    keys, names, segments, several, size = [], [], [], [], 0
                keys.append(k)
                names.append(n)
                segments.append(s)
                several.append(m)
                size += len(s)
        if keys:
            yield _spans(keys, names, repeated_starts(segments, several, length))
    return run


def _windows(length: int):
    """The windows of hot segments: (one, two) hashes, how often, and the place."""
    def run(batches):
        for batch in batches:
            data, at = flat(batch.column("segment"))
            for i, j in chunks(at, 256 << 10):
                part, edges = data[at[i]:at[j]], at[i:j + 1] - at[i]
                many = np.maximum(np.diff(edges) - length + 1, 0)
                row = np.repeat(np.arange(j - i), many)
                off = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                x = edges[:-1][row] + off
                one, two = (span_hashes(prefix_sums(p), x, x + length).view(np.int64) for p in (part, part ^ 0x5A))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(mix(two.view(np.uint64)).view(np.int64))]
                    + [batch.column(c).take(pa.array(row + i)) for c in ("key", "name", "several")] + [pa.array(off)],
                    names=["one", "two", "key", "name", "several", "off"])
    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int | None = None, split: int = SPLIT) -> DataFrame:
    """One row per input row: doc_id, th, rid, n_bytes, sha (of the text) and spans, the
    merged byte ranges [a, b) that are covered by repeated windows (empty: none)."""
    bounded_batches(docs.sparkSession)
    gram = gram or max(1, length * 8 // 25)
    source = texts(docs, id_col, text_col)
    field = T.StructField
    schema = T.StructType([field("doc_id", source.schema["doc_id"].dataType), field("th", _LONG), field("rid", _LONG), field("n_bytes", _LONG),
                           field("sha", T.StringType()), field("ranges", T.ArrayType(T.StructType(
                               [field(c, _LONG) for c in ("lo", "hi", "key", "places", "name")])))])
    rows = staged(source.select("doc_id", "th", F.monotonically_increasing_id().alias("rid"), F.col("text").cast("binary").alias("text"))
                  .mapInArrow(_tidy(_describe(length, gram)), schema), "op3-rows")
    classes = staged(rows.groupBy("sha").agg(F.min("rid").alias("cid"), F.count(F.lit(1)).alias("copies")), "op3-classes")
    ranges = staged(rows.join(classes.select(F.col("cid").alias("rid"), "copies"), "rid")
                    .select(F.col("rid").alias("cid"), "copies", F.explode("ranges").alias("r")).select("cid", "copies", "r.*"), "op3-ranges")
    again = ranges.groupBy("key").agg(F.sum(F.col("places") * F.least("copies", F.lit(2))).alias("n")).where("n > 1").select("key")
    shared = staged(ranges.join(again, "key"), "op3-shared")
    place = F.struct("cid", "lo", "hi")
    segments = staged(shared.groupBy("key", "name").agg((F.sum(F.least("copies", F.lit(2))) > 1).alias("several"), F.min(place).alias("place")), "op3-segments")
    hot = staged(segments.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split).select("key", F.lit(True).alias("hot")), "op3-hot")
    asked = (segments.join(hot, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
             .groupBy("place.cid").agg(F.collect_list(F.struct("key", "name", "several", "hot", "place.lo", "place.hi")).alias("asked")))
    asked = (rows.select(F.col("rid").alias("cid"), F.col("doc_id").alias("name_id"), F.col("th").alias("name_th")).join(asked, "cid"))
    bytes_of = staged(source.join(asked, F.col("doc_id").eqNullSafe(F.col("name_id")) & (F.col("th") == F.col("name_th")))
                      .select(F.col("text").cast("binary").alias("text"), F.explode("asked").alias("a"))
                      .select("a.key", "a.name", "a.several", "a.hot",
                              F.substring("text", (F.col("a.lo") + 1).cast("int"), (F.col("a.hi") - F.col("a.lo") + length).cast("int")).alias("segment")),
                      "op3-bytes")
    span = "key long, name long, first long, last long"
    marked = (bytes_of.where("not hot").select("key", "name", "several", "segment")
              .repartition("key").sortWithinPartitions("key", "name").mapInArrow(_tidy(_sorted_groups(length)), span))
    windows = (bytes_of.where("hot").dropDuplicates(["key", "name"]).select("key", "name", "several", "segment")
               .mapInArrow(_windows(length), "one long, two long, key long, name long, several boolean, off long"))
    windows = staged(windows, "op3-windows")
    counted = (windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"), F.max("several").alias("more")).where("n > 1 or more").select("one", "two"))
    single = windows.join(counted, ["one", "two"], "left_semi").select("key", "name", F.col("off").alias("first"), F.col("off").alias("last"))
    marked = staged(marked.unionByName(single).select("key", "name", F.struct("first", "last").alias("s"))
                    .groupBy("key", "name").agg(F.collect_list("s").alias("found")), "op3-marked")
    covered = (shared.join(marked, ["key", "name"])
               .select("cid", F.explode(F.transform("found", lambda s: F.struct(
                   (F.col("lo") + s["first"]).alias("a"), (F.col("lo") + s["last"] + length).alias("b")))).alias("s"))
               .groupBy("cid").agg(F.sort_array(F.collect_list("s")).alias("s"))
               .select("cid", F.pandas_udf(_merge, _SPANS)(F.col("s.a"), F.col("s.b")).alias("spans")))
    by_class = classes.join(covered, "cid", "left").select("sha", "copies", "spans")
    none = F.lit(None).cast("array<struct<a:bigint,b:bigint>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n_bytes").alias("b")))
    return (rows.select("doc_id", "th", "rid", "n_bytes", "sha").join(by_class, "sha")
            .select("doc_id", "th", "rid", "n_bytes", "sha",
                    F.coalesce(F.when(F.col("copies") > 1, F.when(F.col("n_bytes") >= length, whole).otherwise(none)).otherwise(F.col("spans")),
                               F.array().cast("array<struct<a:bigint,b:bigint>>")).alias("spans")))


_SPANS = T.ArrayType(T.StructType([T.StructField("a", _LONG), T.StructField("b", _LONG)]))


def _merge(first: pd.Series, last: pd.Series) -> pd.Series:
    """Sorted ranges, those that touch or overlap made one."""
    out = []
    for a, b in zip(first, last):
        a, b = np.asarray(a, np.int64), np.maximum.accumulate(np.asarray(b, np.int64))
        new = np.append(True, a[1:] > b[:-1])
        out.append([{"a": int(x), "b": int(y)} for x, y in zip(a[new], b[np.append(new[1:], True)])])
    return pd.Series(out, dtype=object)


def cut(data: bytes, spans) -> bytes:
    """``data`` without the spans."""
    kept, at = [], 0
    for s in spans:
        kept.append(data[at:s["a"]])
        at = s["b"]
    return b"".join(kept) + data[at:]


def _kept_digests(batches):
    for batch in batches:
        out = [hashlib.sha256(cut(t, s)).hexdigest() for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("sha"), pa.array(out, pa.string())], names=["sha", "kept"])


def _partly(found: DataFrame) -> DataFrame:
    """Names and spans of the texts that lose some but not all bytes."""
    all_gone = (F.size("spans") == 1) & (F.col("spans")[0]["a"] == 0) & (F.col("spans")[0]["b"] == F.col("n_bytes"))
    return found.where((F.size("spans") > 0) & ~all_gone)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept."""
    found = staged(repeated_spans(docs, id_col, text_col, **parameters), "op3-found")
    one = _partly(found).groupBy("sha").agg(F.min("rid").alias("rid"))
    names = found.join(one, ["sha", "rid"]).select("sha", "spans", F.col("doc_id").alias("name_id"), F.col("th").alias("name_th"))
    digests = (texts(docs, id_col, text_col).join(names, F.col("doc_id").eqNullSafe(F.col("name_id")) & (F.col("th") == F.col("name_th")))
               .select("sha", F.col("text").cast("binary").alias("text"), "spans").mapInArrow(_kept_digests, "sha string, kept string")
               .groupBy("sha").agg(F.min("kept").alias("kept")))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    empty = hashlib.sha256(b"").hexdigest()
    return (found.join(digests, "sha", "left")
            .select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                    F.coalesce("kept", F.when(F.size("spans") > 0, F.lit(empty)).otherwise(F.col("sha"))).alias("kept_sha256"),
                    (F.col("n_bytes") - removed).alias("n_kept")))


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False, **parameters) -> DataFrame:
    """``docs`` with the repeated bytes cut out of its text (a character of which a
    part is cut goes whole); rows and other columns stay as they are, but a row that
    loses all its text goes if ``drop_emptied`` is set."""
    found = repeated_spans(docs, id_col, text_col, **parameters)
    names = (found.where(F.size("spans") > 0).select(F.col("doc_id").alias("cut_id"), F.col("th").alias("cut_th"), "spans")
             .dropDuplicates(["cut_id", "cut_th"]))

    def kept(text: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([t if a is None else cut((t or "").encode(), [{"a": x, "b": y} for x, y in zip(a, b)]).decode("utf-8", "ignore")
                          for t, a, b in zip(text, first, last)], dtype=object)

    text = F.pandas_udf(kept, T.StringType())(F.col("row").getField(text_col).cast("string"), F.col("spans.a"), F.col("spans.b"))
    both = (whole_rows(docs, id_col, text_col)
            .join(names, F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("th") == F.col("cut_th")), "left").withColumn("left", text))
    if drop_emptied:
        both = both.where(F.col("spans").isNull() | (F.length("left") > 0))
    return both.select(*[F.col("left").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
