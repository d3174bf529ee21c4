"""Work whose share of a task does not grow with the table."""

from pyspark.sql import functions as F

from flowlens.operators import explain
from flowlens.plans import more_queries
from flowlens.sources.scratch import dealt

SMALL = "/root/testdata/sf0.001"


def test_rows_are_dealt_by_their_number(spark):
    df = spark.range(1000)
    assert dealt(df, 1000, "id", most=50).rdd.getNumPartitions() == 20
    plan = more_queries.values(spark, SMALL)._jdf.queryExecution().toString()
    assert "RepartitionByExpression" in plan  # the exchange before the grouping has its own number of parts


def test_modality_share_counts_features_without_a_modality(spark):
    v = spark.createDataFrame([(1, "a", 1.0), (1, "b", -2.0), (1, "c", 1.0), (2, "c", 3.0)], "id long, feature string, value double")
    of = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y")], "feature string, modality string")
    got = {(r.id, r.modality): r.share for r in explain.modality_share(v, of).collect()}
    assert got == {(1, "x"): 0.75, (1, "y"): 0.5}


def test_wording_takes_quantiles_in_ranges(spark):
    plan = more_queries.l11_l12_wording(spark, SMALL).select(F.col("words"))._jdf.queryExecution().toString()
    assert "percentile(" not in plan.lower()
