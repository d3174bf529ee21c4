"""Steps whose work or memory must not outgrow the table."""

from pyspark.sql import functions as F

from flowlens.plans import model_queries

SMALL = "/root/testdata/sf0.001"


def test_a_family_is_read_from_the_items_own_row(spark):
    v = model_queries.vectors(spark, SMALL, family=F.col("l_linestatus"))
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    assert v.count() == li.count()  # a join by row_id, which repeats, gave more
    assert "Join" not in v._jdf.queryExecution().optimizedPlan().toString()
