"""Operator 6: SentencePiece encoding by Gumbel top-k sampling, and decoding.

Each text gets ``samples`` distinct segmentations, drawn without replacement in
proportion to their probability, best perturbed score first.  A piece weighs
1 / (1 - score) ** alpha, and a segmentation the product of its pieces'.  The search
is exact (see :func:`sample`) and every random number is a hash of the row's key and
a place in the text, so results do not depend on how the rows are spread.  The
inclusion score is the probability of being among the drawn ones given the next
perturbed score, 1 - exp(-exp(log_prob - next)); 1 if there is no further
segmentation.  Map-only: no shuffle.

Defined results: null text counts as empty; an empty text has one segmentation
without ids; a text with fewer segmentations gets as many rows; rows with equal keys
and texts get equal samples; a null key is a key; a "▁" in a text is read as a space,
so it alone does not come back on decoding; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches
from .piece_lattice import ids_of, sample, vocabulary
from .words import chunks, tidy

SAMPLES, ALPHA = 4, 1.0
#: Characters of texts whose samples are turned into ids and back at a time.
DECODED = 128 << 10
_LONG = T.LongType()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _encode(path: str, count: int, alpha: float, with_ids: bool):
    def run(batches):
        words = vocabulary(path, alpha)
        for batch in batches:
            texts, seeds = batch.column("text").to_pylist(), batch.column("seed").to_pylist()
            edges = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            for i, j in chunks(edges, 2 << 20):
                lattice, found, following = sample(texts[i:j], seeds[i:j], count, words)
                rows, ids = [], []
                for a, b in chunks(edges[i:j + 1] - edges[i], DECODED):
                    ways = [(k, rank, w) for k in range(a, b) for rank, w in enumerate(found[k], 1)]
                    flat_ids, many = ids_of(lattice, np.concatenate([w[0] for *_, w in ways]), words)
                    data, ends = words.bytes_of(flat_ids)
                    raw, cut = data.tobytes(), np.concatenate(([0], np.cumsum(many)))[np.cumsum([0] + [len(w[0]) for *_, w in ways])].tolist()
                    at = np.concatenate(([0], ends))[cut].tolist()
                    spaced = {k: b" " * bool(texts[i + k]) + texts[i + k].encode("utf-8", "surrogatepass") for k in range(a, b)}
                    for x, (k, rank, (_, log_p, _)) in enumerate(ways):
                        own = flat_ids[cut[x]:cut[x + 1]]
                        score = 1.0 if following[k] == -np.inf else -np.expm1(-np.exp(min(log_p - following[k], 700.0)))
                        rows.append((i + k, rank, len(own), zlib.crc32(own.tobytes()), log_p, score, raw[at[x]:at[x + 1]] == spaced[k]))
                        if with_ids:
                            ids.append(own.astype(np.int32))
                row, rank, n, crc, log_p, score, same = zip(*rows)
                arrays = [batch.column("doc_id").take(pa.array(row, pa.int64()))] + [pa.array(x, pa.int64()) for x in (rank, n, crc)]
                arrays += [pa.array(log_p, pa.float64()), pa.array(score, pa.float64()), pa.array(same, pa.bool_())]
                names = ["doc_id", "sample", "n_ids", "ids_crc32", "log_prob", "inclusion", "round_trip"]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None,
           samples: int = SAMPLES, alpha: float = ALPHA, with_ids: bool = False) -> DataFrame:
    """One row per text and sample: doc_id, sample (from 1), n_ids, ids_crc32 (of the
    little-endian unsigned 32-bit ids), log_prob, inclusion, round_trip (the ids decode
    to the text), and ids if asked for."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
                         F.xxhash64(F.col(f"`{id_col}`").cast("string")).alias("seed"))
    schema = T.StructType([source.schema["doc_id"]] + [T.StructField(c, _LONG) for c in ("sample", "n_ids", "ids_crc32")]
                          + [T.StructField(c, T.DoubleType()) for c in ("log_prob", "inclusion")] + [T.StructField("round_trip", T.BooleanType())]
                          + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    return source.mapInArrow(tidy(_encode(model or default_model(), samples, alpha, with_ids)), schema)


def decode(rows: DataFrame, ids_col: str = "ids", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``rows`` with the text of its ids (null ids: null; control ids give nothing)."""
    path = model or default_model()

    def text(ids: pd.Series) -> pd.Series:
        words = vocabulary(path, ALPHA)
        return pd.Series([None if x is None else words.decode(np.asarray(x, np.int64)) for x in ids], dtype=object)

    return rows.withColumn(text_col, F.pandas_udf(text, T.StringType())(F.col(f"`{ids_col}`")))
