"""Neighbours with many equal distances, and how often a vector is handed out."""

import numpy as np
from pyspark.sql import functions as F

from flowlens.operators import joins, neighbours


def test_closest_takes_the_smallest_ids_of_many_ties():
    m = np.zeros((60, 3))
    m[50:] = 5.0
    ids = np.arange(60)[::-1].copy()
    got = joins.closest(np.zeros((2, 3)), np.array([100, 101]), m, ids, 4, False)
    assert got["ref_id"].tolist() == [10, 11, 12, 13] * 2 and got["distance"].tolist() == [0.0] * 8


def test_a_vector_goes_to_a_shelf_once(spark):
    x = np.random.default_rng(2).normal(size=(600, 24))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "id long, x array<double>, role int")
    index = neighbours.index_cells(df, 2, block=20, shelf=300)
    shelves = index.blocks["shelf"].nunique()
    asked = neighbours.calls(df.withColumn("far", F.lit(float("inf"))), index, 2).cache()
    assert shelves <= 4 and len(index.blocks) > 20
    assert asked.count() <= 600 * shelves and asked.select("id", "shelf").distinct().count() == asked.count()
    asked.unpersist()
