"""The registered op6 draws several distinct segmentations of a text."""
from dunning.llm.queries import op6_piece_sampling


def test_four_samples(spark):
    rows = op6_piece_sampling(spark, "/root/testdata/sf0.001")
    assert rows.groupBy("doc_id").count().agg({"count": "max"}).first()[0] >= 4
