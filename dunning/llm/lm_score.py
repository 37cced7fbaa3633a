"""Operator 10: language-model scoring by context-tree weighting.

The model codes each byte of a text, A-Z lower-cased, and one end mark (the byte 0xFF,
which UTF-8 never holds) after the last, as eight binary decisions.
For each decision the Krichevsky-Trofimov estimates of all context depths, from no
byte to the ``DEPTH`` bytes before, are mixed with the weights that the counts of the
training texts give them.  The score of a text is the log10 probability of its bytes
and its end under the trained tree; ``bits_per_byte`` in the result is the code length.

How it is spread: texts are dealt into buckets of some 30 MB.  A bucket gives each
distinct gram (context and byte) and each distinct word it holds with its count in
training texts, packed by share: a word's by its hash, a gram's by its three most
recent context bytes, so a share holds whole subtrees.  A share has at most one entry
of a key per bucket, so no key is hot; it sums the counts and works its subtrees.
Only the nodes above them (at most 65536 x 255, in texts far fewer) go to the driver
and back.  The answers return to the buckets that asked, in the order of their keys,
and each bucket scores its own texts.  Nothing that grows with the corpus, but for
those nodes up to their bound, is broadcast or collected.

The base score is that of single words with add-one smoothing.

Defined results: null text counts as empty; an empty text has the end as its one
token, and the log10 probability of an end at once as score; a row with a null id is used for training; repeated rows count as
often as they occur; without training texts every decision has probability 1/2 and
the base formula holds with N = V = 0; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, held_out, staged
from .context_tree import Level, gram_pieces, levels, log10_probability
from .words import _LOWER, chunks, flat, mix, release, word_hashes

DEPTH = 6
BUCKET_BYTES, BUCKETS = 32 << 20, 24
SHARES = 512
CHUNK, POOL, NODES = 512 << 10, 2 << 20, 64 << 10
GRAM, WORD = 0, 1
_LONG = T.LongType()
_END = b"\xff"
#: Bytes as words are read from them: the end mark is white space.
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[255] = 32


def _flip(gram: np.ndarray) -> np.ndarray:
    """Grams with their context read backwards, the most recent byte first, so that
    sorted ones stand by subtree; of flipped grams, the grams."""
    return (gram & ~np.int64(255)).byteswap() | gram & 255


def _pack(x: np.ndarray) -> bytes:
    """64-bit values byte plane by byte plane, compressed: sorted keys share most planes."""
    return pa.compress(x.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, many: int, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, many * 8, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(kind).ravel()


def _firsts(key: np.ndarray) -> np.ndarray:
    """Where each distinct key of a sorted array starts."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.nonzero(new)[0]


def _counts(key: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often each stands in a training text."""
    order = np.argsort(key, kind="stable")
    key, first = key[order], _firsts(key[order])
    return key[first], np.add.reduceat(used[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def _gram_counts(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of flipped grams (56 bits), whose lowest bit now is ``used``."""
    marked.sort()
    first = _firsts(marked >> 1)
    return marked[first] >> 1, np.add.reduceat(marked & 1, first) if len(first) else np.zeros(0, np.int64)


def _sum_counts(parts):
    key = np.concatenate([k for k, _ in parts])
    n = np.concatenate([c for _, c in parts])
    order = np.argsort(key, kind="stable")  # merges the sorted parts
    key, n = key[order], n[order]
    first = _firsts(key)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _bucket_counts(depth: int, shares: int):
    def run(table: pa.Table) -> pa.Table:
        data, at = flat(table.column("text"))
        teaches = ~table.column("held_out").to_numpy()
        found, pool = ([], []), []

        def merge(parts, least: int) -> None:  # before the parts of many chunks pile up
            if len(parts) > 1 and sum(len(k) for k, _ in parts[1:]) >= least:
                parts[:] = [_sum_counts(parts)]

        def drain(least: int) -> None:
            if pool and sum(map(len, pool)) >= least:
                found[GRAM].append(_gram_counts(np.concatenate(pool)))
                pool.clear()
                merge(found[GRAM], POOL)

        for i, j, own, code in gram_pieces(_LOWER[data], at, depth, CHUNK):
            pool.append(_flip(code) << 1 | np.repeat(teaches[i:j], np.diff(own)))
            drain(POOL)
        drain(1)
        for i, j in chunks(at, CHUNK):
            word, row = word_hashes(_SPACED[data[at[i]:at[j]]], at[i:j + 1] - at[i])
            found[WORD].append(_counts(word.view(np.int64), teaches[i:j][row]))
            merge(found[WORD], POOL // 4)
        rows = []
        for kind, parts in enumerate(found):
            if not parts:
                continue
            key, n = _sum_counts(parts)
            parts.clear()
            root = key >> 32 if kind == GRAM else key  # the three most recent bytes
            share = (mix(root.view(np.uint64)) % np.uint64(shares)).astype(np.int64)
            order = np.argsort(share, kind="stable")
            key, n, share = key[order], n[order], share[order]
            first = _firsts(share)
            for a, b in zip(first, [*first[1:], len(share)]):
                rows.append((kind, share[a], b - a, _pack(key[a:b]), _pack(n[a:b])))
        release()
        bucket = table.column("bucket")[0].as_py()
        columns = list(zip(*rows)) or [[]] * 5
        return pa.table({"bucket": pa.array([bucket] * len(rows), pa.int64())} | {
            c: pa.array(x, t) for c, t, x in zip(("kind", "share", "many", "keys", "counts"), (pa.int64(),) * 3 + (pa.binary(),) * 2, columns)})
    return run


def _subtrees(flipped: np.ndarray, n: np.ndarray, depth: int, least: int):
    """(grams, levels down to ``least``) of whole subtrees, some at a time."""
    root = flipped >> (56 - 8 * least)
    edge = np.append(_firsts(root), len(root))
    i = 0
    while i < len(edge) - 1:
        j = max(i + 1, int(np.searchsorted(edge, edge[i] + NODES, "right")) - 1)
        gram = _flip(flipped[edge[i]:edge[j]])
        yield gram, levels(gram, n[edge[i]:edge[j]], depth, least)
        i = j


def _merged(depth: int, least: int):
    """One row for a share: what each bucket asks, the sums in the order of the
    distinct keys, and the sums of the subtree roots one depth higher."""
    def run(table: pa.Table) -> pa.Table:
        t = table.select(["bucket", "many", "keys", "counts"]).to_pydict()
        kind, share = table.column("kind")[0].as_py(), table.column("share")[0].as_py()
        key, n = _sum_counts([(_unpack(k, m), _unpack(c, m)) for m, k, c in zip(t["many"], t["keys"], t["counts"])])
        top = b""
        if kind == GRAM:
            ups = [found[-1].up(least) for _, found in _subtrees(key, n, depth, least)]
            top = b"".join(np.concatenate([u[k] for u in ups]).tobytes() for k in range(4))
        release()
        return pa.table({"kind": pa.array([kind], pa.int64()), "share": pa.array([share], pa.int64()), "bucket": pa.array([t["bucket"]], pa.list_(pa.int64())),
                         "many": pa.array([t["many"]], pa.list_(pa.int64())), "keys": pa.array([t["keys"]], pa.list_(pa.binary())),
                         "sums": pa.array([_pack(n)], pa.binary()), "distinct": pa.array([len(n)], pa.int64()),
                         "total": pa.array([n.sum()], pa.int64()), "known": pa.array([(n > 0).sum()], pa.int64()), "top": pa.array([top], pa.binary())})
    return run


def _tops(batches):
    for batch in batches:
        for top in batch.column("top").to_pylist():
            x = np.frombuffer(top).reshape(4, -1)
            yield pa.record_batch({"key": pa.array(x[0].view(np.int64)), "zeros": pa.array(x[1]), "ones": pa.array(x[2]), "weighted": pa.array(x[3])})


def _answers(depth: int, least: int, top):
    """To each bucket, the values in the order of the keys it sent."""
    def run(batches):
        for batch in batches:
            for t in batch.to_pylist():
                sent = [_unpack(k, m) for m, k in zip(t["many"], t["keys"])]
                key = np.concatenate(sent)
                order = np.argsort(key, kind="stable")
                key = key[order]
                first = _firsts(key)
                value = n = _unpack(t["sums"], t["distinct"])
                if t["kind"] == GRAM:
                    value = np.concatenate([log10_probability(gram, found + top.value, depth) for gram, found in _subtrees(key[first], n, depth, least)])
                every = np.empty(len(key))
                every[order] = np.repeat(value, np.diff(np.append(first, len(key))))
                edge = np.cumsum([0, *t["many"]])
                yield pa.record_batch({
                    "bucket": pa.array(t["bucket"], pa.int64()), "kind": pa.array([t["kind"]] * len(sent), pa.int64()), "many": pa.array(t["many"], pa.int64()),
                    "keys": pa.array(t["keys"], pa.binary()), "answers": pa.array([_pack(every[a:b]) for a, b in zip(edge, edge[1:])], pa.binary())})
        release()
    return run


class Lookup:
    """Values by 64-bit key, vectorised open addressing."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        bits = max(4, int(4 * max(len(key), 1)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot, self.key, self.value = np.full(1 << bits, -1, np.int32), key, value
        left, at = np.arange(len(key)), self._start(key)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            stay = self.slot[at] != left
            left, at = left[stay], (at[stay] + 1) & self.mask

    def _start(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        """Values of keys that are all known."""
        at = self._start(key)
        found = self.slot[at]
        wrong = np.nonzero(self.key[found] != key)[0]
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            found[wrong] = self.slot[at[wrong]]
            wrong = wrong[self.key[found[wrong]] != key[wrong]]
        return self.value[found]


def _row_sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at) - 1)
    some = np.nonzero(at[1:] > at[:-1])[0]
    if len(some):
        out[some] = np.add.reduceat(x, at[some])
    return out


def _told(answers: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    t = answers.filter(pc.equal(answers.column("kind"), kind)).select(["many", "keys", "answers"]).to_pydict()
    return (np.concatenate([np.zeros(0, np.int64), *(_unpack(k, m) for m, k in zip(t["many"], t["keys"]))]),
            np.concatenate([np.zeros(0), *(_unpack(v, m, np.float64) for m, v in zip(t["many"], t["answers"]))]))


def _bucket_scores(depth: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        gram, word = (Lookup(*_told(answers, k)) for k in (GRAM, WORD))
        data, at = flat(table.column("text"))
        score, base, tokens, known = (np.zeros(len(at) - 1) for _ in range(4))
        for i, j, own, code in gram_pieces(_LOWER[data], at, depth, CHUNK):
            score[i:j] += _row_sums(gram(_flip(code)), own)
        for i, j in chunks(at, CHUNK):
            hashed, row = word_hashes(_SPACED[data[at[i]:at[j]]], at[i:j + 1] - at[i])
            c = word(hashed.view(np.int64))
            many = np.bincount(row, minlength=j - i)
            edge = np.concatenate(([0], np.cumsum(many)))
            base[i:j] = _row_sums(np.log10(c + 1), edge)
            tokens[i:j] = many
            known[i:j] = np.bincount(row[c > 0], minlength=j - i)
        del gram, word
        release()
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_bytes": pa.array(np.diff(at) - 1),
            "words": pa.array(tokens.astype(np.int64)), "known": pa.array(known.astype(np.int64)),
            "base": pa.array(base.astype(float)), "score": pa.array(score.astype(float))})
    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
          parts: int = 7, part: int = 2) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, bits_per_byte.  Learns from the rows that are not held out
    (crc32 of the id modulo ``parts`` is not ``part``)."""
    if not 2 <= depth <= 6:
        raise ValueError("depth: 2 to 6 bytes")
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(BUCKETS, -(-size // BUCKET_BYTES))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.concat(text, F.lit(_END)).alias("text")).select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).alias("bucket"), "doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "text")
    taught = rows.where("not held_out").count()
    least = min(3, depth)
    counted = rows.select("bucket", "held_out", "text").groupBy("bucket").applyInArrow(
        _bucket_counts(depth, max(SHARES, 2 * buckets)), "bucket long, kind long, share long, many long, keys binary, counts binary")
    asked = staged(counted.groupBy("kind", "share").applyInArrow(
        _merged(depth, least), "kind long, share long, bucket array<long>, many array<long>, keys array<binary>, sums binary, "
        "distinct long, total long, known long, top binary"), "op10-counts")
    words = asked.where(f"kind = {WORD}").agg(F.sum("total"), F.sum("known")).first()
    train_tokens = (words[0] or 0) + taught  # each text's end is a token
    distinct = (words[1] or 0) + (taught > 0)

    roots = (asked.where(f"kind = {GRAM}").select("top").mapInArrow(_tops, "key long, zeros double, ones double, weighted double")
             .groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")]).orderBy("key").toArrow())  # at most 65536 x 255
    above = [Level(*(roots.column(c).to_numpy() for c in ("key", "zeros", "ones", "weighted")))]
    for d in range(least - 1, 0, -1):
        above.append(Level(*above[-1].up(d)))
    top = spark.sparkContext.broadcast(above)
    answers = asked.select("kind", "bucket", "many", "keys", "sums", "distinct").mapInArrow(
        _answers(depth, least, top), "bucket long, kind long, many long, keys binary, answers binary")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("n_bytes", _LONG), T.StructField("words", _LONG),
                           T.StructField("known", _LONG), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType())])
    scored = rows.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_bucket_scores(depth), schema)
    tokens = F.col("words") + 1
    base = F.col("base") + F.log10(F.lit(float(taught + 1))) - tokens * F.log10(F.lit(float(train_tokens + distinct + 1)))
    return scored.select("doc_id", "held_out", tokens.alias("n_tokens"), (F.col("known") + F.lit(int(taught > 0))).alias("n_known"),
                         F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
                         F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
