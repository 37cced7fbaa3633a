"""Registered queries against their SQL, URL rules, and the pipeline."""
import os

import duckdb
import pytest
from cases import docs

from dunning.llm import queries, url_filter

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.execute(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


URLS = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http://NET/"), (6, "http://a.net"), (7, "http://a.net/x?q#f"),
        (8, "https://EXAMPLE.net/en/1"), (9, "https://www.example.net/EN/1"), (10, "x://example.com/de/"), (11, "x://notexample.com/de/"),
        (12, "a://b://example.com/de/"), (13, "http://org/fr/"), (14, "http://w.org?x=/fr/"), (15, "http://w.org#/fr/"), (16, "http://w.org/fr/\n"),
        (17, "http://" + "a." * 5000 + "net/"), (8, "https://EXAMPLE.net/en/1"), (None, "http://x.net/")]


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_url_rules(spark, rows):
    pages = spark.createDataFrame(URLS, "page_id long, url string").selectExpr("'q' as host", "'r' as path", "'s' as rule", "*")
    rules = spark.createDataFrame(queries.URL_RULES + [("", "/", "block"), (None, "/", "block"), ("x.net", "/", "maybe")], "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, index_rows=rows).collect()}
    none = (None, "allow")
    assert got == {1: none, 2: none, 3: none, 4: none, 5: ("net/", "block"), 6: none, 7: ("net/", "block"), 8: ("example.net/en/", "allow"),
                   9: ("net/", "block"), 10: ("example.com/de/", "block"), 11: none, 12: none, 13: ("org/fr/", "allow"), 14: none, 15: none,
                   16: ("org/fr/", "allow"), 17: ("net/", "block"), None: ("net/", "block")}
    assert url_filter.filter_urls(pages.where("false"), rules, index_rows=rows).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.where("false"), index_rows=rows).collect()} == {"allow"}


def test_index_confirms_texts(tmp_path):
    import numpy as np
    path = tmp_path / "index"
    path.write_bytes(url_filter.build_index([("a", "/", "block"), ("b", "/", "allow")]))
    index = url_filter.Index(str(path))
    import xxhash
    key = xxhash.xxh64_intdigest(b"a\0/", 42)
    assert index.find(np.array([key, key, 5], np.uint64), ["a\0/", "z\0/", "a\0/"]) == ["block", None, None]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]
    rows = corpus_pipeline.run(spark, SF)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in rows.select("doc_id").distinct().collect()}
    assert 0 < len(kept) < d.count() and kept <= {r.doc_id for r in d.select("doc_id").collect()}
    odd = str(tmp_path / "odd")
    docs(spark).write.parquet(f"{odd}/documents.parquet")
    spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int").write.parquet(f"{odd}/labels.parquet")
    step = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, step, odd)
        assert after.columns == step.columns, name
        after.write.parquet(f"{odd}/{name}")
        step = spark.read.parquet(f"{odd}/{name}")
    assert corpus_pipeline.STAGES[-1][1](spark, step, odd).count() >= step.count() > 0
    none = step.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, odd).count() == 0, name


def test_whole_tables():
    import inspect
    source = inspect.getsource(queries)
    assert ".limit(" not in source and ".sample(" not in source
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert os.path.exists(SF)
