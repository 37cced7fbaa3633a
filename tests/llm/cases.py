"""Inputs with every shape the operators must stand, and plain versions to compare with."""
import re

from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = " ".join(f"word{i % 37}x{i % 11}" for i in range(120))
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c d e f g"), (4, "a b c d e f g"), (5, "A b  c d e f\x0bg"), (None, "x y z"),
       (None, None), (6, BASE), (7, BASE + " and one more"), (8, BASE.replace("word3x3", "changed", 1)), (9, BASE.upper()),
       (10, "one"), (11, "ONE"), (12, "é中 <|endoftext|> 🙂"), (13, ("long text " * 3000) + "end"), (14, "q" * 20000), (14, "other text")]
#: Names that the operators use inside.
CLASH = ["th", "rid", "sha", "key", "n", "kept", "keep_id", "held_out", "score", "bucket", "cid", "root", "spans", "seed", "label",
         "task", "rank", "part", "place", "turn", "first", "host", "path", "rule", "verdict", "__keep_id", "name"]


def docs(spark, rows=ODD):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select(*[F.lit(f"extra {c}").alias(c) for c in CLASH], "doc_id", "text")


def empty(spark):
    return docs(spark).where("false")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, size):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def sort_key(row):
    return tuple((x is not None, x) for x in row)
