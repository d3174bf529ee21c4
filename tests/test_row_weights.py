"""Weights of a row bootstrap: each hash once, by comparing digits."""

import hashlib

from pyspark.sql import functions as F

from flowlens.operators import resample


def test_weights_are_those_of_the_numbers(spark):
    df = spark.createDataFrame([(i,) for i in [*range(60), None]], "id long")
    got = {r.id: r.w for r in df.select("id", resample.row_weights("id", 5, 3).alias("w")).collect()}
    for i, w in got.items():
        for r, x in enumerate(w, 1):
            n = int(hashlib.md5(f"{'' if i is None else i}|{r}|3".encode()).hexdigest()[:15], 16)
            assert x == sum((n + 0.5) / 2**60 > p for p in resample.POISSON)


def test_limits_part_the_numbers():
    for p in resample.POISSON:
        n = int(resample.hex_limit(p), 16)
        assert (float(n) + 0.5) / 2**60 > p >= (float(n - 1) + 0.5) / 2**60


def test_row_bootstrap_adds_up_in_a_hash_table(spark):
    df = spark.range(500).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), F.pmod(F.xxhash64("id"), F.lit(50)).cast("double").alias("s"))
    plan = resample.row_bootstrap_auc(df, "y", "s", "id", 4)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan  # it sorts whole rows of weights from 128 groups on
