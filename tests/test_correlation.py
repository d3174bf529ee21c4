"""Correlations of values that do not vary."""

import math

from pyspark.sql import functions as F

from flowlens.functions import columns as C
from flowlens.operators import explain


def test_correlation_of_values_that_do_not_vary(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (1.0, 2.0, 4.0), (1.0, 4.0, 5.0)], "a double, b double, c double")
    r = df.agg(C.correlation("a", "b").alias("none"), C.correlation("b", "c").alias("some"), F.corr("b", "c").alias("same")).first()
    assert math.isnan(r.none) and math.isclose(r.some, r.same)
    assert df.where("a > 1").agg(C.correlation("b", "c").alias("r")).first().r is None
    flat = spark.createDataFrame([(0, "x", 2.0), (0, "y", 2.0)], "id long, feature string, value double")
    assert math.isnan(explain.rank_correlation(flat, flat).first().spearman)
