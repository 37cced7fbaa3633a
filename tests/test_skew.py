"""The lookup join keeps all rows, in one plan, with NULL and hot keys."""
from pyspark.sql import functions as F

from dunning.operators.joins import lookup_join


def _sides(spark):
    big = spark.range(0, 20000).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).when(F.col("id") % 3 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("K"), (F.col("id") % 500).cast("string"))).alias("k"), F.col("id"))
    small = spark.range(0, 400).select(F.concat(F.lit("K"), F.col("id").cast("string")).alias("k"),
                                       (F.col("id") * 2).alias("v")) \
        .unionByName(spark.createDataFrame([("HOT", -1)], "k string, v long"))
    return big, small


def test_same_rows_as_the_plain_join(spark):
    big, small = _sides(spark)
    joined, plain = lookup_join(big, small, "k", "left"), big.join(small, "k", "left")
    assert joined.columns == plain.columns
    assert joined.count() == plain.count() == 20000
    assert joined.exceptAll(plain).count() == 0


def test_null_keys_are_spread(spark):
    """Rows of a NULL key reach many join partitions, and the fact side is scanned once."""
    big, small = _sides(spark)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        joined = lookup_join(big, small, "k", "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Range (0, 20000") == 1 and "BroadcastHashJoin" not in plan
        parts = joined.where("k is null").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_decisions_of_rows_without_customer(spark):
    from helpers import cust, enriched, tx
    rows = enriched(spark, [tx("A", 100, "BANK_TIMEOUT", cust=None), tx("B", 100, "BANK_TIMEOUT")], [cust(flag=True)])
    got = {r["transaction_id"]: r["risk_flag"] for r in rows.collect()}
    assert got == {"A": False, "B": True}
