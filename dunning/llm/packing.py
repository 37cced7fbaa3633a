"""Operator 8: packing documents into training sequences, shortest pack first.

A document is its ids and an end id.  It is cut after every ``size`` ids; the whole
pieces fill a sequence each, and the rest (shorter than ``size``) is packed.  Packing
works on the histogram of rest lengths, which has at most ``size`` rows whatever the
input: lengths are placed longest first, each onto the shortest packing pattern so
far (the one with most room left), by whole counts of equal patterns, and a new
pattern is opened where it does not fit.  The patterns are joined back to the
documents by the rank of a piece among those of its length.

The rank needs no sort and no hot group: a task numbers its own pieces of each
length as it writes them, and the tasks' counts (at most ``size`` rows a task) are
summed up in task order.  No text or id is shuffled.

Defined results: null text counts as empty; an empty text is one piece that holds
only the end id; every id lies in exactly one piece; repeated rows and ids are packed
like any others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .byte_bpe import byte_bpe
from .common import bounded_batches, staged
from .words import tidy

SIZE, END = 1024, 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_histogram(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """(how often, lengths in one sequence) for a histogram of lengths."""
    packs: list[tuple[int, tuple[int, ...], int]] = []  # a heap, shortest first: total, lengths, how often
    done = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left and packs and packs[0][0] + length <= size:
            total, lengths, often = heapq.heappop(packs)
            used = min(often, left)
            if often > used:
                heapq.heappush(packs, (total, lengths, often - used))
            heapq.heappush(packs, (total + length, (*lengths, length), used))
            left -= used
        if left:  # no pattern has room: new ones, each filled before the next is opened
            each = size // length
            for often, n in ((left // each, each), (1, left % each)):
                if often and n:
                    heapq.heappush(packs, (n * length, (length,) * n, often))
    done += [(often, lengths) for _, lengths, often in sorted(packs)]
    return done


class Places:
    """Where the piece with a given rank among those of its length goes."""

    def __init__(self, patterns: list[tuple[int, tuple[int, ...]]]):
        rows, sequence, used = [], 0, {}
        for often, lengths in patterns:
            offset = 0
            for length in sorted(set(lengths), reverse=True):
                n = lengths.count(length)
                rows.append((length, used.get(length, 0), n, sequence, offset))
                used[length] = used.get(length, 0) + often * n
                offset += n * length
            sequence += often
        rows.sort()
        self.length, self.rank, self.each, self.sequence, self.offset = np.array(rows, np.int64).reshape(-1, 5).T
        self.first = {int(k): int(np.searchsorted(self.length, k)) for k in np.unique(self.length)}
        self.total = sequence

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        values, starts = np.unique(length[order], return_index=True)
        for k, at in zip(values.tolist(), np.split(order, starts[1:])):
            a = self.first[k]
            b = a + int(np.searchsorted(self.length[a:], k, "right"))
            row = a + np.searchsorted(self.rank[a:b], rank[at], "right") - 1
            step = rank[at] - self.rank[row]
            sequence[at] = self.sequence[row] + step // self.each[row]
            offset[at] = self.offset[row] + step % self.each[row] * k
        return sequence, offset


def _cut(path: str, size: int, end: int, with_ids: bool):
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        encoder, task = byte_bpe(path), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            row, start, length, crc, total, rank, ids = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                data = encoder.encode(text) + tail
                n = len(data) // 4
                for a in range(0, n, size):
                    piece = data[4 * a:4 * (a + size)]
                    k = len(piece) // 4
                    row.append(i)
                    start.append(a)
                    length.append(k)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    rank.append(seen[k])
                    seen[k] += 1
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
            arrays = [batch.column("doc_id").take(pa.array(row, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total, rank)]
            arrays.append(pa.array(np.full(len(row), task, np.int64)))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "task"]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset (and ids, if asked for)."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    long = T.LongType()
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType)]
                          + [T.StructField(c, long) for c in ("start", "length", "ids_crc32", "doc_tokens", "rank", "task")]
                          + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    pieces = staged(source.mapInArrow(tidy(_cut(tokenizer or default_tokenizer(), size, end, with_ids)), schema), "op8-pieces")
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "op8-counts")
    histogram = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    places = docs.sparkSession.sparkContext.broadcast(Places(pack_histogram(histogram, size)))

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = places.value(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    where = F.pandas_udf(place, T.StructType([T.StructField("sequence_id", long), T.StructField("offset", long)]))
    ranked = pieces.join(starts.select("length", "task", "before"), ["length", "task"])
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "p.sequence_id", "p.offset"] + ["ids"] * with_ids
    return ranked.withColumn("p", where("length", F.col("before") + F.col("rank"))).select(*columns)
