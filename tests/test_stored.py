"""Bucketed tables, quarantined records and observed metrics."""
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunning.plans import queries as Q
from dunning.sources import io as IO


def test_bucketed_join_has_no_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = [Q._stored(spark, spark.range(2000).selectExpr("CAST(id AS STRING) AS transaction_id", f"id % {m} AS v"), f"t{m}") for m in (5, 7)]
        both = tables[0].join(tables[1].withColumnRenamed("v", "w"), "transaction_id")
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert both.where("CAST(transaction_id AS LONG) % 5 = v AND CAST(transaction_id AS LONG) % 7 = w").count() == 2000
        grouped = tables[0].groupBy("transaction_id").agg(F.sum("v"))
        assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_quarantine(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("d", T.DecimalType(9, 2))])
    (tmp_path / "a.csv").write_text("id,n,d\nA,1,2.50\nB,x,1\nC,1\nD,1,2,3\n,4,5\nE,,\n\"F,G\",7,zz\n")
    good, bad = IO.read_checked(spark, str(tmp_path / "a.csv"), schema, required=("id",))
    assert sorted((r.id, r.n) for r in good.collect()) == [("A", 1), ("E", None)]
    reasons = {r.record: (r.reason, r.file.rsplit("/", 1)[1]) for r in bad.collect()}
    assert {k: v[0] for k, v in reasons.items() if not k.startswith("{")} == {
        "B,x,1": "bad n", "C,1": "wrong number of fields", "D,1,2,3": "wrong number of fields", "\"F,G\",7,zz": "bad d"}
    assert [v for k, v in reasons.items() if k.startswith("{")] == [("missing id", "a.csv")]
    (tmp_path / "b.json").write_text('{"id": "A", "n": 1}\n{"id": "B", "n": "q"}\n{"id": \n')
    good, bad = IO.read_checked(spark, str(tmp_path / "b.json"), schema, "json")
    assert [r.id for r in good.collect()] == ["A"] and sorted(r.reason for r in bad.collect()) == ["bad n", "not JSON"]
    (tmp_path / "c.csv").write_text("id,n,d\n")
    good, bad = IO.read_checked(spark, str(tmp_path / "c.csv"), schema)
    assert good.count() == bad.count() == 0


def test_observed_in_one_pass(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def seen(x):
        calls.add(1)
        return x
    df = spark.range(100).select(F.udf(seen, "long")("id").alias("v"))
    got = IO.write_observed(df, str(tmp_path / "o"), {"n": F.count(F.lit(1)), "total": F.sum("v")}).first()
    assert tuple(got) == (100, 4950) and calls.value == 100 and spark.read.parquet(str(tmp_path / "o")).count() == 100
