"""Operators 11 to 13 against their SQL and plain versions on odd inputs."""
import functools
import random

import duckdb
import pytest
from cases import BASE, ODD, docs, empty

from dunning.llm import decontamination, queries, ranked_search, turn_alignment, turn_repair

WORDS = BASE.split()
ITEMS = [(1, None), (2, ""), (3, "one"), (4, "A b  c, d e f g"), (4, "A b  c, d e f g"), (5, " ".join(WORDS[10:45])), (6, "É中 🙂 text"),
         (None, " ".join(WORDS[60:75])), (7, "x y"), (7, " ".join(WORDS[100:115])), (8, "q" * 20000), (9, "... !"), (10, "nothing of the kind here"),
         (11, "text long " * 5000)]
MORE = [(20, " ".join(WORDS[5:30]) + ". " + " ".join(WORDS[20:45])), (21, "Zero ONE, two; one"), (22, "a-b-c-d-e-f-g a b c d e f g h"),
        (23, "y. " + " ".join(WORDS[62:72]) + " tail"), (24, "x\x00y"), (25, "é中 🙂 text"), (None, "one one")]


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("'c' as term", "'c' as w", "'c' as doc_id", "'c' as h", "*")


def same(got, name, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        con.register(f"{t}_frame", df.toPandas())
        types = dict(df.dtypes)
        columns = ", ".join(f"CAST(CASE WHEN {c}::VARCHAR IN ('nan', '<NA>') THEN NULL ELSE {c} END AS BIGINT) AS {c}" if types[c] == "bigint" else c for c in df.columns)
        con.execute(f"CREATE TABLE {t} AS SELECT {columns} FROM {t}_frame")
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([tuple(r) for r in got.select(*names).collect()], key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.parametrize("small", [False, True])
def test_decontamination(spark, monkeypatch, small):
    if small:  # joins that shuffle, crowded filters, rows of few candidates
        for name, value in (("BROADCAST_BYTES", -1), ("MAX_BITS", 64), ("ROW_CANDIDATES", 3)):
            monkeypatch.setattr(decontamination, name, value)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(queries, "read", lambda s, d, t: d[t])
    tables = {"documents": docs(spark, ODD + MORE), "benchmark": items(spark)}
    try:
        same(queries.op13_decontamination(spark, tables), "op13_decontamination", **tables)
        none = {"documents": empty(spark), "benchmark": items(spark)}
        assert queries.op13_decontamination(spark, none).count() == 0
        clean = queries.op13_decontamination(spark, {"documents": docs(spark), "benchmark": items(spark).where("false")})
        assert clean.count() == len(ODD) and clean.where("contaminated OR n_items > 0").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_decontamination_spans(spark):
    one = spark.createDataFrame([(1, "z " + " ".join(WORDS[0:12]) + " z z " + " ".join(WORDS[2:12]))], "doc_id long, text string")
    row = decontamination.overlaps(one, items(spark, [(5, " ".join(WORDS[0:30]))])).first()
    assert [tuple(s) for s in row.spans] == [(1, 13), (15, 25)] and row.n_hit == 22 and row["items"] == ["5"]


@pytest.mark.parametrize("k, block, pairs", [(50, 4096, 1 << 18), (3, 2, 8)])
def test_ranked_search(spark, monkeypatch, k, block, pairs):
    tables = {"documents": docs(spark, ODD + MORE), "benchmark": items(spark)}
    got = ranked_search.search(tables["documents"], tables["benchmark"], k=k, block=block, pairs=pairs).drop("item_th")
    monkeypatch.setitem(queries.ORACLES, "op12_ranked_search", queries.ORACLES["op12_ranked_search"].replace("<= 50", f"<= {k}"))
    two = tables["benchmark"].where("item_id IS NULL OR item_id <> 7")  # SQL takes the items of one id as one
    same(got.where("item_id IS NULL OR item_id <> 7"), "op12_ranked_search", **(tables | {"benchmark": two}))
    for d, b in ((empty(spark), items(spark)), (docs(spark), items(spark).where("false")), (docs(spark, [(1, "..."), (2, None)]), items(spark))):
        assert ranked_search.search(d, b).count() == 0


def test_ranked_search_stops_early(spark):
    """Blocks that cannot rank are not visited: the bound alone leaves them out."""
    rows = [(i, "common " * (1 + i % 3) + "filler " * (1 + i % 40)) for i in range(400)] + [(1000, "rare common"), (1001, "rare rare common")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "rare common")], "item_id long, text string")
    same(ranked_search.search(d, b, block=16).drop("item_th"), "op12_ranked_search", documents=d, benchmark=b)


def plain_repair(turns):
    @functools.lru_cache(None)
    def go(i, state, inserts):
        want, after = ("a", 3) if state == 2 else ("u", 2)
        ways = [(0, "")] if i == len(turns) and state in (0, 3) else []
        if inserts < 4:
            c, a = go(i, after, inserts + 1)
            ways.append((c + 5, "I" + a))
        if i < len(turns):
            initial, must_go, cut_off = turns[i]
            c, a = go(i + 1, state, 0)
            ways.append((c + 2, "D" + a))
            if not must_go:
                c, a = go(i + 1, after, 0)
                ways.append((c + 1 + 5 * cut_off, "R" + a))
                if initial == want:
                    ways.append((c + 5 * cut_off, "K" + a))
                if initial == "s" and state == 0:
                    c, a = go(i + 1, 1, 0)
                    ways.append((c + 5 * cut_off, "K" + a))
        return min(ways) if ways else (10**9, "")
    return go(0, 0, 0)


@pytest.mark.parametrize("run", [32, 1, 3])
def test_alignment(monkeypatch, run):
    monkeypatch.setattr(turn_alignment, "RUN", run)
    rng = random.Random(run)
    for _ in range(1500):
        p = rng.random() / 2
        turns = [(rng.choice("uasuaX"), rng.random() < p * 0.6, rng.random() < p) for _ in range(rng.randint(0, 9))]
        assert turn_alignment.solve(turns) == plain_repair(tuple(turns)), turns


def odd_turns():
    rng = random.Random(5)
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "agent"])
    text = lambda: rng.choice(["Yes.", "No!", "Why?", " \t\n", "", None, "cut off", "end. \x0b", "é中🙂", "dots...", f"only {rng.random()}."])
    rows = [(rng.choice([*range(30), None]), rng.choice([*range(12), None]), role(), text()) for _ in range(400)]
    rows += [(100, t, ["user", "assistant"][t % 2], f"turn {t}." if t % 9 else "cut") for t in range(700)]  # crosses partitions
    rows += [(101, 3, "user", "the same.")] * 300 + [(102, None, None, None)] * 5 + [(103, 1, "system", "alone " * 20000)]
    return rows


@pytest.mark.parametrize("parts", ["3", "40"])
def test_turn_repair(spark, monkeypatch, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    monkeypatch.setattr(queries, "read", lambda s, d, t: d)
    try:
        rows = spark.createDataFrame(odd_turns(), "conv_id long, turn long, role string, text string")
        clash = rows.selectExpr("'c' as fault", "'c' as sha", "'c' as rid", "'c' as place", "'c' as task", "*")
        same(queries.op11_turn_repair(spark, clash), "op11_turn_repair", conversations=rows)
        assert queries.op11_turn_repair(spark, clash.where("false")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
