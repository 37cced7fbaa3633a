"""Operators 1, 2, 3 and 9, and the components, against plain versions."""
import collections
import hashlib
import random
import re

import numpy as np
import pytest
from cases import ODD, components, docs, empty, shingles, sort_key

from dunning.llm import embedding_dedup, exact_dedup, minhash_dedup, suffix_dedup
from dunning.llm.components import connected_components
from dunning.llm.suffix_array import minimiser_ranges, repeated_starts


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(7, k) for k in range(100, 140)] + [(5, 5)]
    want = {k: r for k, r in enumerate(components(200, links)) if r != k}
    got = connected_components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("counters", [1, 2, 1024])
def test_exact(spark, counters):
    rows = ODD + [(k, "very  common") for k in range(100, 160)]
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    got = exact_dedup.exact_dedup(docs(spark, rows).repartition(5), counters=counters).collect()
    groups = collections.defaultdict(list)
    for (i, t), x in zip(rows, norm):
        groups[x].append((-len(t or ""), i is None, i or 0, i))
    want = sorted([(i, min(groups[x], key=lambda r: r[:3])[3], len(groups[x]), hashlib.sha256(x.encode()).hexdigest())
                   for (i, _), x in zip(rows, norm)], key=sort_key)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=sort_key) == want
    assert collections.Counter(r.text_sha256 for r in got if r.kept) == {hashlib.sha256(x.encode()).hexdigest(): 1 for x in groups}
    left = exact_dedup.keep_one(docs(spark, rows), counters=counters)
    assert left.count() == len(groups) and left.columns == docs(spark).columns
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_misra_gries():
    import pandas as pd
    stream = [f"x{i}" for i in range(3000)] + ["hot"] * 900 + ["warm"] * 500
    random.Random(1).shuffle(stream)
    held = exact_dedup.misra_gries((pd.Series(stream[i:i + 100]) for i in range(0, len(stream), 100)), 10)
    assert {"hot", "warm"} <= set(held.index) and len(held) <= 10 and held["hot"] <= 900


@pytest.mark.parametrize("size", [2, 5])
def test_near(spark, size):
    rnd = random.Random(size)
    rows = list(ODD)
    for k in range(12):  # groups of copies with more and more words changed
        base = [f"w{rnd.randrange(60)}" for _ in range(60)]
        for m in range(12):
            words = list(base)
            for _ in range(m):
                words[rnd.randrange(60)] = f"z{rnd.randrange(1000)}"
            rows.append((1000 + 20 * k + m, " ".join(words)))
    sets = [shingles(t, size) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = components(len(rows), links)
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(least.get(r, (True, 0)), (i is None, i or 0))
    want = sorted([(i, len(s), None if least[r][0] else least[r][1]) for (i, _), s, r in zip(rows, sets, root)], key=sort_key)
    got = minhash_dedup.near_duplicates(docs(spark, rows).repartition(4), words=size).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=sort_key) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert sum(r.keeper for r in got) == len(set(root))
    if size == 5:
        assert minhash_dedup.keep_one(docs(spark, rows), words=5).count() == len(set(root))
        assert minhash_dedup.near_duplicates(empty(spark)).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    for n, share in ((3, 0), (40, 0.5), (400, 0.8)):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[:int(n * share)], rng.integers(0, 2**63, n - int(n * share)).astype(np.uint64)])
        s = minhash_dedup.sketches(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, n, 2 * n, 2 * n]), 336)
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - j) < 0.12
        assert (s[2] == np.uint64(0xFFFFFFFFFFFFFFFF)).all() and not (s[:2] == np.uint64(0xFFFFFFFFFFFFFFFF)).any()


def test_compare_in_blocks(spark, monkeypatch):
    """One hot bucket, cut in blocks of two rows."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 2)
    test_near(spark, 2)


def _cut_plainly(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if count[t[k:k + length]] > 1:
                gone[k:k + length] = True
        starts = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(t), int(gone.sum()), starts, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=sort_key)


@pytest.mark.parametrize("split", [4096, 0])
def test_repeats(spark, split):
    rnd = random.Random(9)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(60))
    rows = list(ODD) + [(200 + k, "".join(rnd.choice("klmnopé ") for _ in range(rnd.randrange(80))) + passage[rnd.randrange(20):]
                         + "".join(rnd.choice("klmnop ") for _ in range(30))) for k in range(40)]
    got = suffix_dedup.remove_repeats(docs(spark, rows).repartition(4), length=30, split=split).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=sort_key) == _cut_plainly(rows, 30)


def test_planted_passages(spark):
    """At the default length a shared run of over 50 words goes from 400 bytes on; shorter ones and texts without one stay."""
    rnd = random.Random(4)

    def words(n):
        return " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    goes, stays = words(60), words(51)
    assert len(goes) >= 400 > len(stays) + 2
    rows = [(k, f"{words(20)} {(goes, stays, words(60))[k % 3]} {words(20)}") for k in range(30)]
    got = suffix_dedup.remove_repeats(docs(spark, rows).repartition(4)).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=sort_key) == _cut_plainly(rows, 400)
    assert {r.doc_id for r in got if r.n_removed >= len(goes)} == {r.doc_id for r in got if r.n_removed} == set(range(0, 30, 3))
    assert all(r.n_kept == r.n_bytes - r.n_removed for r in got)


def test_repeats_edges(spark):
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
    cut = suffix_dedup.cut_texts(docs(spark), length=30)
    assert cut.count() == len(ODD) and cut.columns == docs(spark).columns
    texts = {r.doc_id: r.text for r in cut.where("doc_id in (1, 2, 10, 12)").collect()}
    assert texts == {1: None, 2: "", 10: "one", 12: "é中 <|endoftext|> 🙂"}


def test_two_stage_order():
    rnd = random.Random(1)
    for _ in range(150):
        length, alphabet = rnd.choice([3, 5, 8]), rnd.choice([b"a", b"ab", b"abcd", bytes(range(40, 70))])
        segments = [bytes(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(1, 8))]
        several = [rnd.random() < 0.1 for _ in segments]
        count = collections.Counter(s[i:i + length] for s in segments for i in range(len(s) - length + 1))
        want = [[several[k] or count[s[i:i + length]] > 1 for i in range(len(s) - length + 1)] for k, s in enumerate(segments)]
        assert [list(map(bool, x)) for x in repeated_starts(segments, several, length)] == want
        data = np.frombuffer(b"".join(segments), np.uint8)
        at = np.concatenate(([0], np.cumsum([len(s) for s in segments])))
        row, lo, hi, key, places, _ = minimiser_ranges(data, at, length, 2)
        keys, total, covered = collections.defaultdict(set), collections.Counter(), 0
        for r, a, b, k, p in zip(row, lo, hi, key, places):
            total[k] += p
            covered += b - a + 1
            for i in range(a, b + 1):
                keys[segments[r][i:i + length]].add(k)
        assert covered == sum(count.values()) and all(len(k) == 1 for k in keys.values())
        assert all(total[next(iter(keys[w]))] >= 2 for w, n in count.items() if n > 1)


@pytest.mark.parametrize("block", [1024, 3])
def test_embeddings(spark, block):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(25):
        base = rng.standard_normal(16)
        for m in range(8):
            rows.append((10 * k + m, [float(x) for x in base + rng.standard_normal(16) * 0.05 * (m % 5)], int(k % 3)))
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] + [1.0] * 15, 1), (904, rows[0][1], None),
             (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0), (907, [], 0), (None, rows[3][1], 0), (3, rows[3][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.selectExpr("'x' as rid", "'y' as dim", "'z' as keys", "*").repartition(3)
    links = []
    for i, (_, x, lx) in enumerate(rows):
        for j, (_, y, ly) in enumerate(rows[:i]):
            if lx is None or lx != ly or not x or not y or len(x) != len(y) or None in x or None in y:
                continue
            a, b = np.array(x), np.array(y)
            if np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any() and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                links.append((i, j))
    root, n = components(len(rows), links), collections.Counter(x for p in links for x in p)
    least = collections.defaultdict(lambda: 10**9)
    for (i, _, _), r in zip(rows, root):
        least[r] = min(least[r], 10**9 if i is None else i)
    want = sorted([(i, n[k], None if least[root[k]] == 10**9 else least[root[k]]) for k, (i, _, _) in enumerate(rows)], key=sort_key)
    got = embedding_dedup.near_duplicates(df, block=block).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=sort_key) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_embedding_hot_class_and_recall(spark):
    """One vector holds a third of all rows; pairs just above the threshold are found."""
    rng = np.random.default_rng(4)
    hot = rng.standard_normal(24)
    vectors = [hot] * 2500 + list(rng.standard_normal((4000, 24)))
    for k in range(1000):  # cosine from 0.97 to 1, most just around the threshold
        base, off = vectors[2500 + k], rng.standard_normal(24)
        off -= base * (off @ base) / (base @ base)
        angle = np.arccos(rng.uniform(0.975, 0.985) if k % 4 else rng.uniform(0.97, 1))
        vectors.append(base / np.linalg.norm(base) * np.cos(angle) + off / np.linalg.norm(off) * np.sin(angle))
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.98
    assert embedding_dedup.plan_tables(5001, 0.98)[0] > 5
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(vectors))] == (near.sum(axis=1) - 1).tolist()
    assert got[0] >= 2499
