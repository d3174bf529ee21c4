"""An as-of join's tasks do not grow with the tables."""

from pyspark.sql import functions as F

from flowlens.operators import joins


def test_rows_are_dealt_by_their_number(spark):
    left = spark.range(40).select(F.col("id").alias("row_id"), (F.col("id") % 4).alias("host"), (F.col("id") * 9000).alias("lt"))
    right = spark.range(20).select((F.col("id") % 4).alias("host"), (F.col("id") * 17000).alias("rt"), F.col("id").alias("v"))
    out = joins.as_of(left, right, ["host"], "lt", "rt", ["v"], 2)
    want = {r["row_id"]: max((q["v"] for q in right.collect() if q["host"] == r["host"] and q["rt"] <= r["lt"] + 2), default=None) for r in left.collect()}
    assert {r["row_id"]: r["v"] for r in out.collect()} == want
    assert "RepartitionByExpression" in out._jdf.queryExecution().analyzed().toString()
