"""Operator 7: URL filters by a sorted digest array.

A rule is a host and a path prefix; it fits its host, all subdomains of it, and
every path that starts with the prefix.  The rules become one index file: the sorted
64-bit xxhash of each rule's text, and the texts themselves.  Spark ships the file to
each executor once, where tasks map it into memory, so all workers of a machine share
one copy.  An URL gives one key for each suffix of its host that a rule could have
and each path length that occurs among the rules; the keys of a batch are hashed by
Spark and probed together by binary search, and every hit is confirmed on the stored
text, so a collision cannot decide.

The file's size is checked: beyond ``INDEX_ROWS`` rules the keys are joined with the rules by an
ordinary shuffle instead, with the same result.

Of the rules that fit, the one with the longest host wins, then the longest path;
of rules that are equal in both, ``block``.  Without one the verdict is ``allow``.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits
no rule; hosts are compared with A-Z lower-cased, paths as they are; a rule with a
null or empty host or a verdict other than block and allow is ignored, and a null path is
empty; repeated rows are judged alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import checkpoint_dir
from .common import ascii_lower, bounded_batches

INDEX_ROWS = 1_000_000
_SEED = 42  # Spark's xxhash64


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of an URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, "(?s)^[^/?#]*", 0))
    return host, F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def _rules(rules: DataFrame) -> DataFrame:
    """host, path, verdict: one row for each host and path."""
    return (rules.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict"))
            .where((F.length("host") > 0) & F.col("verdict").isin("block", "allow"))
            .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))  # block over allow


def _text(host, path):
    return host + "\0" + path


def build_index(rows: list[tuple[str, str, str]]) -> bytes:
    """Rows (host, path, verdict) as: count, sorted keys, text offsets, texts."""
    entries = sorted((xxhash.xxh64_intdigest(t := _text(h, p).encode(), _SEED), t + b"\0" + v.encode()) for h, p, v in rows)
    texts = [t for _, t in entries]
    edges = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype("<u8")
    return struct.pack("<Q", len(entries)) + np.array([k for k, _ in entries], "<u8").tobytes() + edges.tobytes() + b"".join(texts)


class Index:
    """The index file, mapped into memory."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n = int(data[:8].view("<u8")[0])
        self.keys = data[8:8 + 8 * n].view("<u8")
        self.edges = data[8 + 8 * n:16 + 16 * n].view("<u8")
        self.texts = data[16 + 16 * n:]

    def find(self, keys: np.ndarray, texts) -> list[str | None]:
        """The verdict of the rule with each text, None where there is no such rule."""
        first = np.searchsorted(self.keys, keys, "left")
        last = np.searchsorted(self.keys, keys, "right")
        out: list[str | None] = [None] * len(keys)
        for i in np.nonzero(last > first)[0].tolist():
            for k in range(first[i], last[i]):
                text, _, verdict = self.texts[int(self.edges[k]):int(self.edges[k + 1])].tobytes().rpartition(b"\0")
                if text == texts[i].encode():
                    out[i] = verdict.decode()
        return out


_open: dict[str, Index] = {}


def _mapped(name: str) -> Index:
    if name not in _open:
        _open[name] = Index(SparkFiles.get(name))
    return _open[name]


def _ship(spark, data: bytes) -> str:
    """Put the index into the shared folder, from where each executor fetches it once."""
    name = f"url-index-{uuid.uuid4().hex}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/{name}")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(where)
    out.write(data)
    out.close()
    files.deleteOnExit(where)
    spark.sparkContext.addFile(files.makeQualified(where).toString())
    return name


def _candidates(host: Column, path: Column, most_labels: int, path_lengths: list[int]) -> Column:
    """Every (host suffix, path prefix) that a rule could have, the best first."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    first = F.greatest(n - F.lit(most_labels), F.lit(0))
    suffixes = F.transform(F.sequence(first, n - 1), lambda i: F.array_join(F.slice(labels, i + 1, n - i), "."))
    prefixes = F.filter(F.array(*[F.struct(F.lit(k).alias("n"), F.substring(path, F.lit(1), F.lit(k)).alias("p")) for k in path_lengths]),
                        lambda p: F.length(path) >= p["n"])
    every = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("host"), p["p"].alias("path")))))
    return F.when(F.length(host) > 0, every).otherwise(F.array().cast("array<struct<host:string,path:string>>"))


def _probe(name: str):
    def run(batches):
        index = None
        for batch in batches:
            index = index or _mapped(name)
            keys, sizes = batch.column("keys"), batch.column("keys").value_lengths().to_numpy(zero_copy_only=False)
            texts = batch.column("texts").flatten().to_pylist()
            verdicts = index.find(keys.flatten().to_numpy(zero_copy_only=False).view(np.uint64), texts)
            at = np.concatenate(([0], np.cumsum(sizes))).tolist()
            rule, verdict = [], []
            for a, b in zip(at[:-1], at[1:]):
                hit = next((k for k in range(a, b) if verdicts[k]), None)
                rule.append(None if hit is None else texts[hit].replace("\0", ""))
                verdict.append("allow" if hit is None else verdicts[hit])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("page_id", "host", "path")] + [pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                                             names=["page_id", "host", "path", "rule", "verdict"])
    return run


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                index_rows: int = INDEX_ROWS) -> DataFrame:
    """One row per page: page_id, host, path, rule (host and path of the rule that
    decides, else null), verdict.  ``rules`` has the columns host, path, verdict."""
    spark = pages.sparkSession
    bounded_batches(spark)
    host, path = split_url(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    rules = _rules(rules)
    shape = rules.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("host", "\\."))).alias("labels")).first()
    lengths = sorted((r[0] for r in rules.select(F.length("path")).distinct().collect()), reverse=True)  # distinct path lengths
    best = _candidates(F.col("host"), F.col("path"), shape["labels"] or 0, lengths or [0])
    if shape["n"] <= index_rows:
        name = _ship(spark, build_index([tuple(r) for r in rules.select("host", "path", "verdict").collect()]))  # at most index_rows
        asked = (rows.withColumn("best", best)
                 .withColumn("texts", F.transform("best", lambda c: F.concat(c["host"], F.lit("\0"), c["path"])))
                 .select("page_id", "host", "path", "texts", F.transform("texts", lambda t: F.xxhash64(t)).alias("keys")))
        schema = T.StructType([rows.schema["page_id"]] + [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")])
        return asked.mapInArrow(_probe(name), schema)
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    keys = numbered.select("row", F.posexplode(best).alias("place", "c")).select("row", "place", "c.*")
    hits = keys.join(rules, ["host", "path"]).groupBy("row").agg(F.min(F.struct("place", "host", "path", "verdict")).alias("hit"))
    return numbered.join(hits, "row", "left").select(
        "page_id", numbered["host"], numbered["path"], F.concat("hit.host", "hit.path").alias("rule"), F.coalesce("hit.verdict", F.lit("allow")).alias("verdict"))
