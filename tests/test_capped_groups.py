"""A sample of each group is found without ordering the whole group."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlens.functions.columns import row_hash
from flowlens.operators import split


def test_cap_per_group_orders_few_rows(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    order = Window.partitionBy("g").orderBy(row_hash(["id"], 4), "id")
    want = df.withColumn("_r", F.row_number().over(order)).where("_r <= 7").drop("_r")
    got = split.cap_per_group(df, "g", 7, "id", 4)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == 21
    assert split.cap_per_group(df, "g", 30_000, "id").count() == 20_000
    assert hasattr(split, "HASH_CELLS") and "_last" in got._jdf.queryExecution().optimizedPlan().toString()  # rows are filtered before the window
