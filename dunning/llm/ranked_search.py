"""Operator 12: ranked lexical search over a length-stratified index.

A document's length enters its score only through the normaliser
``m = 50 + (50*n*N) div L``, so documents with equal ``m`` form a stratum, in which a
term's impact ``(1000000000*tf) div (1000*tf + 20*m)`` depends on ``tf`` alone.  The
index holds each stratum in blocks of about ``BLOCK`` documents; a block keeps its
postings by term and, within a term, by ``tf``, with one impact for each ``tf``.

A search visits blocks in the order of their bound (the sum over the item's terms of
weight times the largest impact in the block) and stops where the bound falls below
the item's k-th score so far: no document there can rank.  A bound equal to that
score is still visited, as a smaller id could win the tie.  Tasks search their own
blocks, ``HELD`` at a time, and give at most k rows an item; a window ranks them.

What is held: the items are dealt into groups of about ``PAIRS`` (item, term) pairs,
each of which is searched in turn with its terms, document frequencies and items in
the tasks' memory.  Documents get postings for the terms that a group asks for; N, L
and n count all terms.  Blocks are dealt by stratum and a hash of the row, so a
stratum with any share of the documents is spread.

Defined results: null or empty texts have no terms; documents without terms count
neither in N nor in L; items without known terms have no rows; each row of the
documents is one document, so repeated rows each take a rank; items equal in id and
text are answered once; null document ids come first among equal scores; empty
tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .common import bounded_batches, staged, texts
from .words import tidy

TOP, BLOCK, HELD = 50, 4096, 24
PAIRS = 1 << 18
#: Strata up to this number are broadcast with their number of blocks.
STRATA = 1 << 18
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: bytes | None) -> list[bytes]:
    return TERM.findall((text or b"").lower())


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, th (names the text) and term: the distinct terms of each item."""
    rows = texts(items, id_col, text_col).dropDuplicates(["doc_id", "th"])
    id_type = rows.schema["doc_id"].dataType
    schema = pa.schema([("item_id", to_arrow_type(id_type)), ("th", pa.int64()), ("terms", pa.list_(pa.binary()))])

    def run(batches):
        for batch in batches:
            found = [sorted(set(terms_of(t.encode()))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(found, pa.list_(pa.binary()))], schema=schema)

    return rows.mapInArrow(tidy(run), f"item_id {id_type.simpleString()}, th long, terms array<binary>")


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the document), terms (numbers of those in the vocabulary) and tfs."""
    id_type = docs.schema["doc_id"].dataType

    def run(batches):
        get = vocabulary.get
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for text in batch.column("text"):
                words = TERM.findall(text.as_buffer().to_pybytes().lower())
                known = [v for v in map(get, words) if v is not None]
                t, c = np.unique(np.array(known, np.int32), return_counts=True)
                sizes.append(len(words)), terms.append(t), tfs.append(c)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                                              pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(tidy(run), f"doc_id {id_type.simpleString()}, n long, terms array<int>, tfs array<long>")


def impact(tf, m: int):
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def build_index(rows: DataFrame, n_docs: int, n_terms: int, block: int = BLOCK) -> DataFrame:
    """One row per block of a stratum: m, ids (ascending), and a list of places in
    ``ids`` for each (term, tf): term, impact, end (of the list) and posts."""
    spark = rows.sparkSession
    id_type = rows.schema["doc_id"].dataType
    normed = (rows.where(F.size("terms") > 0)
              .withColumn("m", F.expr(f"50 + (50L * n * {n_docs}L) div {n_terms}L"))
              .withColumn("at", F.xxhash64(F.monotonically_increasing_id())))
    strata = normed.groupBy("m").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    strata = staged(strata, "op12-strata")
    strata = F.broadcast(strata) if strata.count() <= STRATA else strata
    blocked = normed.join(strata, "m").withColumn("block", F.pmod("at", "blocks"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + rows.count() // (8 * block))
    dealt = blocked.select("m", "block", "doc_id", "terms", "tfs").repartition(parts, "m", "block").sortWithinPartitions("m", "block", "doc_id")
    schema = pa.schema([("m", pa.int64()), ("ids", pa.list_(to_arrow_type(id_type))), ("term", pa.list_(pa.int32())),
                        ("impact", pa.list_(pa.int64())), ("end", pa.list_(pa.int32())), ("posts", pa.list_(pa.int32()))])

    def built(table: pa.Table):
        m = table.column("m")[0].as_py()
        lists = table.column("terms").combine_chunks()
        term, tf = lists.flatten().to_numpy(), table.column("tfs").combine_chunks().flatten().to_numpy()
        doc = np.repeat(np.arange(table.num_rows, dtype=np.int32), lists.value_lengths().to_numpy())
        order = np.lexsort((doc, -tf, term))
        term, tf, doc = term[order], tf[order], doc[order]
        last = np.nonzero(np.concatenate(((term[1:] != term[:-1]) | (tf[1:] != tf[:-1]), [True])))[0]
        columns = [term[last], impact(tf[last], m), (last + 1).astype(np.int32), doc]
        ids = pa.array([table.column("doc_id").to_pylist()], schema.field("ids").type)
        return pa.RecordBatch.from_arrays([pa.array([m], pa.int64()), ids] + [pa.array([c], schema.field(n).type) for n, c in zip(schema.names[2:], columns)],
                                          schema=schema)

    def run(batches):
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            g = np.stack([batch.column(c).to_numpy() for c in ("m", "block")], axis=1)
            cuts = np.concatenate(([0], np.nonzero((g[1:] != g[:-1]).any(axis=1))[0] + 1, [len(g)]))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if tuple(g[i]) != key and held:
                    yield built(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(i, j - i))
                key = tuple(g[i])
        if held:
            yield built(pa.Table.from_batches(held))

    name = id_type.simpleString()
    return dealt.mapInArrow(tidy(run), f"m long, ids array<{name}>, term array<int>, impact array<long>, end array<int>, posts array<int>")


class _Block:
    """A block of the index: the postings of term t are posts[first[t]:end[t]], best
    impact first."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        term, imp, end = (row[c].to_numpy() for c in ("term", "impact", "end"))
        self.posts = row["posts"].to_numpy()
        start = np.concatenate(([0], end[:-1]))
        head = np.nonzero(np.concatenate(([True], term[1:] != term[:-1])))[0]
        self.terms, self.best = term[head], imp[head]
        self.first, self.end = start[head], np.concatenate((start[head][1:], [len(self.posts)]))
        self.impacts = np.repeat(imp, end - start)

    def bounds(self, terms: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The largest score that each item could reach here."""
        p = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.add.reduceat(np.where(self.terms[p] == terms, self.best[p], 0) * weights, starts)

    def top(self, terms: np.ndarray, weights: np.ndarray, least: int, k: int) -> list[tuple[int, int]]:
        """(score, place) of the documents that score ``least`` or more, the k best at most."""
        score = np.zeros(len(self.ids), np.int64)
        places = np.searchsorted(self.terms, terms)
        for p, t, w in zip(places.tolist(), terms.tolist(), weights.tolist()):
            if p < len(self.terms) and self.terms[p] == t:
                a, b = self.first[p], self.end[p]
                score[self.posts[a:b]] += w * self.impacts[a:b]
        hit = np.nonzero(score >= max(least, 1))[0]
        if len(hit) > k:
            hit = hit[score[hit] >= np.partition(score[hit], -k)[-k]]
        best = hit[np.argsort(-score[hit], kind="stable")[:k]]
        return list(zip(score[best].tolist(), best.tolist()))


def search_blocks(index: DataFrame, item_starts: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> DataFrame:
    """The k best documents of each task for each item: item, doc_id, score."""
    id_type = index.schema["ids"].dataType.elementType
    ends = np.concatenate((item_starts[1:], [len(terms)]))

    def run(batches):
        best: list[list] = [[] for _ in item_starts]  # (-score, id is not null, id), best first

        def visit(blocks: list[_Block]) -> None:
            bounds = np.stack([b.bounds(terms, weights, item_starts) for b in blocks])
            order = np.argsort(-bounds, axis=0, kind="stable")
            for i in range(len(item_starts)):
                own, mine, heavy = best[i], terms[item_starts[i]:ends[i]], weights[item_starts[i]:ends[i]]
                for b in order[:, i].tolist():
                    least = -own[-1][0] if len(own) == k else 1
                    if bounds[b, i] < least:
                        break
                    block = blocks[b]
                    found = block.top(mine, heavy, least, k)
                    if found:
                        ids = block.ids.take(pa.array([p for _, p in found])).to_pylist()
                        own = sorted(own + [(-s, d is not None, d) for (s, _), d in zip(found, ids)], key=lambda x: (x[0], x[1], x[2] if x[1] else 0))[:k]
                best[i] = own

        held: list[_Block] = []
        for batch in batches:
            for r in range(batch.num_rows):
                held.append(_Block({c: batch.column(c)[r].values for c in batch.schema.names if c != "m"}))
                if len(held) == HELD:
                    visit(held)
                    held = []
        if held:
            visit(held)
        rows = [(i, d, -s) for i, own in enumerate(best) for s, _, d in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], to_arrow_type(id_type)),
                                          pa.array([r[2] for r in rows], pa.int64())], ["item", "doc_id", "score"])

    return index.mapInArrow(tidy(run), f"item int, doc_id {id_type.simpleString()}, score long")


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _search_group(docs: DataFrame, group: list, id_type: str, k: int, block: int) -> DataFrame | None:
    spark = docs.sparkSession
    vocabulary = {t: v for v, t in enumerate(sorted({t for r in group for t in r.terms}))}
    rows = staged(postings(docs, vocabulary), "op12-postings")
    totals = rows.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not totals.docs:
        return None
    held = {r.t: r.df for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}
    numbers = [sorted(v for v in map(vocabulary.get, r.terms) if v in held) for r in group]
    asked = [(r, n) for r, n in zip(group, numbers) if n]
    if not asked:
        return None
    terms = np.array([t for _, n in asked for t in n], np.int32)
    weights = np.array([weight(held[t], totals.docs) for t in terms.tolist()], np.int64)
    starts = np.concatenate(([0], np.cumsum([len(n) for _, n in asked])[:-1])).astype(np.int64)
    index = staged(build_index(rows, totals.docs, totals.terms, block), "op12-index")
    found = search_blocks(index, starts, terms, weights, k)
    names = spark.createDataFrame([(i, r.item_id, r.th) for i, (r, _) in enumerate(asked)], f"item int, item_id {id_type}, item_th long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))))
    return ranked.where(F.col("rank") <= k).join(F.broadcast(names), "item").select("item_id", "item_th", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
           item_text_col: str = "text", k: int = TOP, block: int = BLOCK, pairs: int = PAIRS) -> DataFrame:
    """The k best documents of each item: item_id, item_th (names the item's text),
    rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    asked = staged(item_terms(items, item_id_col, item_text_col).where(F.size("terms") > 0), "op12-items")
    id_type = asked.schema["item_id"].dataType.simpleString()
    rows = texts(docs, id_col, text_col).select("doc_id", "text")
    doc_type = rows.schema["doc_id"].dataType.simpleString()
    groups = 1 + 2 * (asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // pairs
    out = spark.createDataFrame([], f"item_id {id_type}, item_th long, rank int, doc_id {doc_type}, score long")
    for g in range(groups):
        group = asked.where(F.pmod(F.xxhash64("item_id", "th"), F.lit(groups)) == g).collect()
        found = _search_group(rows, group, id_type, k, block) if group else None
        out = out if found is None else out.unionByName(found)
    return out
