"""op10 at its registered depth knows held-out texts better than single words do."""
from pyspark.sql import functions as F

from dunning.llm.queries import op10_lm_score


def test_model_beats_single_words(spark):
    sums = op10_lm_score(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1]
