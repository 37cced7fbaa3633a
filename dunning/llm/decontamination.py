"""Operator 13: benchmark decontamination as a prefix-filtered set join.

A window is ``window`` consecutive words of an item (an item with fewer words is
one window).  As a set, a window holds its shingles of ``shingle`` words.  A
document holds a window only if it holds all of them, so a prefix of one shingle,
the rarest, is necessary:

1. the item shingles are counted in all documents, which orders them by rarity; a
   window with a shingle that no document has is out;
2. the documents' shingles are joined with the rarest shingle of each window;
3. position and length bound the pairs: the window has to begin and end inside the
   document when the shingle stands where the document has it;
4. each remaining pair is verified word by word over a stretch of the document that
   is as long as the window.

The documents are read twice, map-only.  A Bloom filter of at most
``MAX_BITS`` bits, made in Spark from the item shingles, keeps most document
shingles from leaving the task; it loses none.  The tables of windows are
broadcast up to ``BROADCAST_BYTES``, beyond that the joins shuffle by shingle or
window and adaptive execution splits hot ones.  No step gathers more than one
document's own hits.

Defined results: words are runs of ASCII letters and digits and of all characters
beyond ASCII, A-Z lower-cased.  A null or empty text has no words; a document
without words is clean; an item without words has no windows; equal rows of a
table are treated alike, and each document row gives a row; items that share an id
are one item; an item with a null id marks words but is not named; empty tables
give empty or clean results; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, staged, texts
from .words import chunks, flat, mix, prefix_sums, span_hashes, tidy

WINDOW, SHINGLE = 10, 3
MAX_BITS = 1 << 27
BROADCAST_BYTES = 64 << 20
#: Candidates that one row carries; a document with more gets further rows.
ROW_CANDIDATES = 512
_BLOCK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def word_places(low: np.ndarray, at: np.ndarray):
    """Hash, first byte, end and row of each word of lower-cased rows."""
    if not len(low):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    word = _IN_WORD[low]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = word[first]
    ends[first[1:] - 1] = word[first[1:] - 1]
    start, end = np.nonzero(begins)[0], np.nonzero(ends)[0] + 1
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, "right")))
        a = start[i]
        out[i:j] = span_hashes(prefix_sums(low[a:end[j - 1]]), start[i:j] - a, end[i:j] - a)
        i = j
    return out, start, end, np.searchsorted(at, start, "right") - 1


def shingle_hashes(word: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on."""
    n = max(len(word) - size + 1, 0)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + word[k:k + n])
    return h


class Bloom:
    """Three bits for each 64-bit hash, in ``1 << log_bits`` bits."""

    SHIFTS = (0, 20, 37)

    def __init__(self, log_bits: int, words: dict[int, int]):
        self.mask = (1 << log_bits) - 1
        self.bits = np.zeros(max(1, (1 << log_bits) // 64), np.uint64)
        for k, v in words.items():
            self.bits[k] = v & (2**64 - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for s in self.SHIFTS:
            p = (h >> np.uint64(s)) & np.uint64(self.mask)
            out &= (self.bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out

    @classmethod
    def of(cls, hashes: DataFrame, most_bits: int) -> "Bloom":
        """Filter of the column ``h``: the words of the bit map are or-ed in Spark, so
        at most ``most_bits`` / 64 rows come to the driver."""
        n = hashes.count()
        log_bits = int(min(max(16 * n, 1 << 16), most_bits)).bit_length() - 1
        place = F.explode(F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(F.lit((1 << log_bits) - 1)) for s in cls.SHIFTS]))
        words = (hashes.select(place.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("w"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS INT))")).alias("v")))
        return cls(log_bits, {r.w: r.v for r in words.collect()})


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """Every window of every item: item (id as text), w (its words, one space apart),
    k (their number) and hs (its shingles in order)."""
    rows = texts(items, id_col, text_col).select(F.col("doc_id").cast("string").alias("item"), "text")
    schema = pa.schema([("item", pa.string()), ("w", pa.string()), ("k", pa.int32()), ("hs", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            data, at = flat(batch.column("text"))
            low = _LOWER[data]
            for r, item in enumerate(batch.column("item").to_pylist()):
                own = low[at[r]:at[r + 1]]
                h, start, end, _ = word_places(own, np.array([0, len(own)]))
                if not len(h):
                    continue
                k = min(len(h), window)
                size = min(k, shingle)
                hs = shingle_hashes(h, size).astype(np.int64)
                words = WORD.findall(own.tobytes())
                for a in range(0, len(h) - k + 1, 1000):
                    begin = range(a, min(a + 1000, len(h) - k + 1))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([item] * len(begin), pa.string()),
                        pa.array([b" ".join(words[t:t + k]).decode() for t in begin], pa.string()),
                        pa.array([k] * len(begin), pa.int32()),
                        pa.array([hs[t:t + k - size + 1] for t in begin], pa.list_(pa.int64()))], schema=schema)

    return rows.mapInArrow(tidy(run), "item string, w string, k int, hs array<long>")


def _places(batch, sizes: list[int], bloom: Bloom):
    """For each stretch of rows of a batch: first row, rows, lower-cased bytes, words and
    the shingles that pass the filter, as (size, first words, hashes)."""
    data, at = flat(batch.column("text"))
    for i, j in chunks(at):
        low, where = _LOWER[data[at[i]:at[j]]], at[i:j + 1] - at[i]
        h, start, end, row = word_places(low, where)
        found = []
        for size in sizes:
            hs = shingle_hashes(h, size)
            t = np.nonzero(bloom.has(hs) & (row[:len(hs)] == row[size - 1:size - 1 + len(hs)]))[0]
            found.append((size, t, hs[t].astype(np.int64)))
        yield i, j, low, start, end, row, found


def shingle_counts(rows: DataFrame, sizes: list[int], bloom: Bloom) -> DataFrame:
    """How often the documents hold each shingle that passes the filter."""
    def run(batches):
        for batch in batches:
            for *_, found in _places(batch, sizes, bloom):
                for _, _, hs in found:
                    h, n = np.unique(hs, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64())], ["h", "n"])

    return rows.select("text").mapInArrow(tidy(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def candidates(rows: DataFrame, sizes: list[int], bloom: Bloom, window: int) -> DataFrame:
    """One row for each document (``base``) and more for those with many candidates:
    doc_id, th, n_words, base, cands (pos: place of the shingle, h, before: words of ctx
    before it, ctx: the words around it that a window may take)."""
    id_type = rows.schema["doc_id"].dataType
    cand = pa.list_(pa.struct([("pos", pa.int64()), ("h", pa.int64()), ("before", pa.int32()), ("ctx", pa.string())]))
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("th", pa.int64()), ("n_words", pa.int64()), ("base", pa.bool_()), ("cands", cand)])

    def run(batches):
        for batch in batches:
            ids, ths = batch.column("doc_id"), batch.column("th")
            for i, j, low, start, end, row, found in _places(batch, sizes, bloom):
                first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=j - i))))
                held: dict[int, list] = {}
                for size, places, hs in found:
                    for t, h in zip(places.tolist(), hs.tolist()):
                        r = int(row[t])
                        a, b = max(int(first[r]), t - window + size), min(int(first[r + 1]), t + window)
                        ctx = b" ".join(WORD.findall(low[start[a]:end[b - 1]].tobytes())).decode()
                        held.setdefault(r, []).append({"pos": t - int(first[r]), "h": h, "before": t - a, "ctx": ctx})
                out = [(r, True, held.get(r, [])[:ROW_CANDIDATES]) for r in range(j - i)]
                out += [(r, False, c[a:a + ROW_CANDIDATES]) for r, c in held.items() for a in range(ROW_CANDIDATES, len(c), ROW_CANDIDATES)]
                take = pa.array([i + r for r, _, _ in out], pa.int64())
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([
                    ids.take(take), ths.take(take), pa.array([int(n[r]) for r, _, _ in out], pa.int64()),
                    pa.array([b for _, b, _ in out], pa.bool_()), pa.array([c for _, _, c in out], cand)], schema=schema)

    return rows.mapInArrow(tidy(run), f"doc_id {id_type.simpleString()}, th long, n_words long, base boolean, "
                                      "cands array<struct<pos:long,h:long,before:int,ctx:string>>")


def _joined_runs(hits: DataFrame) -> DataFrame:
    """Overlapping or touching spans of a document joined, and the words in them."""
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    id_type = hits.schema["doc_id"].dataType

    def run(batches):
        for batch in batches:
            spans, n_hit = [], []
            for own in batch.column("spans").to_pylist():
                a, b = (np.sort(np.array([s[x] for s in own], np.int64)) for x in "ab")
                cut = np.concatenate(([True], a[1:] > b[:-1]))  # sorted apart, the k-th end still bounds the k-th start
                a, b = a[cut], b[np.concatenate((cut[1:], [True]))]
                spans.append([{"a": x, "b": y} for x, y in zip(a.tolist(), b.tolist())])
                n_hit.append(int((b - a).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n_hit, pa.int64()), pa.array(spans, span)],
                                             ["doc_id", "th", "n_hit", "spans"])

    return hits.mapInArrow(tidy(run), f"doc_id {id_type.simpleString()}, th long, n_hit long, spans array<struct<a:long,b:long>>")


def _small(df: DataFrame, n_bytes: int | None) -> DataFrame:
    return F.broadcast(df) if (n_bytes or 0) <= BROADCAST_BYTES else df


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
             item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside any occurrence of a
    window), spans (maximal runs of such words as [begin, end) word places) and items
    (ids, as text and sorted, of the items with an occurring window)."""
    bounded_batches(docs.sparkSession)
    rows = texts(docs, id_col, text_col)
    all_windows = staged(item_windows(items, item_id_col, item_text_col, window, shingle), "op13-item-windows")
    windows = staged(all_windows.groupBy("w").agg(F.first("k").alias("k"), F.first("hs").alias("hs"))
                     .withColumn("wid", F.monotonically_increasing_id()), "op13-windows")
    owners = staged(all_windows.where("item IS NOT NULL").select("item", "w").distinct()
                    .join(windows.select("w", "wid"), "w").select("wid", "item"), "op13-owners")
    sizes = sorted({min(r.k, shingle) for r in windows.select("k").distinct().collect()})

    # order shingles by rarity
    parts = windows.select("wid", "w", "k", F.posexplode("hs").alias("p", "h"))
    counts = staged(shingle_counts(rows, sizes, Bloom.of(parts.select("h").distinct(), MAX_BITS)), "op13-counts")
    ranked = parts.join(counts, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = F.min(F.struct("n", "h", "p")).alias("least")
    prefix = staged(ranked.groupBy("wid", "w", "k").agg(rarest).where("least.n > 0")
                    .select("wid", "w", "k", "least.h", "least.p"), "op13-prefixes")
    widths = prefix.agg(F.sum(F.octet_length("w") + 40).alias("b")).first().b
    owner_bytes = owners.agg(F.sum(F.octet_length("item") + 24).alias("b")).first().b

    # join on the prefix, bound by position and length, verify the words
    found = staged(candidates(rows, sizes, Bloom.of(prefix.select("h").distinct(), MAX_BITS), window), "op13-candidates")
    pairs = (found.where(F.size("cands") > 0).select("doc_id", "th", "n_words", F.explode("cands").alias("c"))
             .select("doc_id", "th", "n_words", "c.*").join(_small(prefix, widths), "h")
             .where("p <= before AND pos - p + k <= n_words")
             .where(F.array_join(F.slice(F.split("ctx", " "), F.col("before") - F.col("p") + 1, F.col("k")), " ") == F.col("w")))
    hits = staged(pairs.select("doc_id", "th", (F.col("pos") - F.col("p")).alias("a"), "k", "wid").distinct(), "op13-hits")

    name = ["doc_id", "th"]
    runs = _joined_runs(hits.groupBy(*name, "a").agg(F.max("k").alias("k")).groupBy(*name)
                        .agg(F.collect_list(F.struct("a", (F.col("a") + F.col("k")).alias("b"))).alias("spans")))
    named = (hits.select(*name, "wid").distinct().join(_small(owners, owner_bytes), "wid").groupBy(*name)
             .agg(F.sort_array(F.collect_set("item")).alias("items")))
    marks = (runs.join(named.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), "items"),
                   F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")), "left"))
    marks = marks.select(F.col("doc_id").alias("m_id"), F.col("th").alias("m_th"), "n_hit", "spans", "items")
    return (found.where("base").select("doc_id", "th", "n_words")
            .join(marks, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th")), "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("spans", F.expr("cast(array() AS array<struct<a:bigint,b:bigint>>)")).alias("spans"),
                    F.coalesce("items", F.expr("cast(array() AS array<string>)")).alias("items")))
