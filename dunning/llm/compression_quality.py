"""Operator 4: quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled
text.  A text is cut into blocks of ``BLOCK`` bytes (all of them, no prefix);
each block is compressed with either dictionary.  The difference of the summed
sizes per input byte is the evidence, and a logistic curve fitted on labelled
rows that built no dictionary turns it into a probability.

Fitting uses a bounded sample: per class the ``FIT_ROWS`` rows smallest by a hash
of the id, and of each at most ``FIT_BYTES`` bytes from a place chosen by that hash.
The bound keeps the sample (2 x 2000 x 16 KiB at most) fit for the driver; the
class shares that set the curve's offset are counted over all labelled rows.
Scoring is one map-only pass over all rows; the two dictionaries (64 KiB each)
travel with the task.

Defined results: null text counts as empty, and an empty text gets the curve's
value at no evidence; rows with a null quality, or a label other than 0 or 1,
teach nothing; without labels of both classes every score is the share of good
labels, or 0.5 if there is none; repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, whole_rows

BLOCK, LEVEL, DICT_BYTES = 512, 3, 64 << 10
FIT_ROWS, FIT_BYTES = 2000, 16 << 10


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def score(self, texts) -> np.ndarray:
        f = evidence(texts, self.good, self.bad) if self.good and self.bad else np.zeros(len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * f + self.offset, -500, 500)))


def _blocks(data: bytes) -> list[bytes]:
    return [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]


def _dictionary(samples: list[bytes]) -> bytes:
    blocks = [b for s in samples for b in _blocks(s)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(blocks)[-DICT_BYTES:]


def evidence(texts, good: bytes, bad: bytes) -> np.ndarray:
    """(size with the bad dictionary - size with the good one) / bytes, 0 for empty."""
    def packer(raw):
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw),
                                        write_checksum=False, write_content_size=False, write_dict_id=False).compress
    with_good, with_bad = packer(good), packer(bad)
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if data:
            out[i] = sum(len(with_bad(b)) - len(with_good(b)) for b in _blocks(data)) / len(data)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted one-feature logistic regression by Newton steps, lightly ridged."""
    mean, scale = x.mean(), x.std() or 1.0
    a = np.column_stack([(x - mean) / scale, np.ones_like(x)])
    w, ridge = np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def fit(docs: DataFrame, labels: DataFrame, teaches: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> CompressionModel:
    """``teaches``: a condition on the column ``doc_id``; only such rows are learnt from."""
    known = (labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y"))
             .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & teaches)
             .groupBy("doc_id").agg(F.min("y").alias("y")))
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(share.values())
    ids = known.withColumn("place", F.xxhash64("doc_id"))
    sample = None
    for y in (0, 1):
        one = ids.where(F.col("y") == y).orderBy("place", "doc_id").limit(FIT_ROWS)
        sample = one if sample is None else sample.unionByName(one)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = (docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("data"))
            .join(F.broadcast(sample), "doc_id")  # 2 x FIT_ROWS rows
            .select("doc_id", "y", "place", F.substring(
                "data", (F.pmod("place", F.greatest(F.octet_length("data") - FIT_BYTES, F.lit(0)) + 1) + 1).cast("int"), F.lit(FIT_BYTES)).alias("data"))
            .groupBy("doc_id", "y", "place").agg(F.max("data").alias("data"))
            .orderBy("place", "doc_id").toPandas())
    data = {y: [bytes(x) for x in rows["data"][rows["y"] == y] if len(x)] for y in (0, 1)}
    if min(map(len, data.values())) < 2:
        good = min(max(share.get(1, 0) / total, 1e-6), 1 - 1e-6) if total else 0.5
        return CompressionModel(b"", b"", 0.0, float(np.log(good / (1 - good))))
    bad, good = (_dictionary(data[y][0::2]) for y in (0, 1))  # every other row builds, the rest calibrate
    rest = {y: [x.decode("utf-8", "ignore") for x in data[y][1::2]] for y in (0, 1)}
    x = evidence(rest[0] + rest[1], good, bad)
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    weight = np.where(y == 1, share[1] / len(rest[1]), share[0] / len(rest[0])) * len(y) / total
    slope, offset = _logistic(x, y, weight)
    return CompressionModel(good, bad, slope, offset)


def score(docs: DataFrame, model: CompressionModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score column, whole texts, map-only."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(text.tolist()))

    return docs.withColumn(score_col, scored(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))


def accepted(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more, with all their columns."""
    rows = whole_rows(docs, id_col, text_col).select("row", F.col("row").getField(text_col).cast("string").alias("text"))
    return score(rows, model).where("score >= 0.5").select("row.*")


def teaching_rows() -> Column:
    return ~held_out(F.col("doc_id"), 3, 1)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = fit(docs, labels, teaching_rows(), id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return score(rows, model).select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
