"""Batches in which a task has no rows."""

import math

import numpy as np

from flowlens.operators import simulate


def test_simulatability_with_batches_of_benign_rows_only(spark):
    rng = np.random.default_rng(3)
    labels = ["Benign"] * 60 + ["dos"] * 20 + ["scan"] * 20
    df = spark.createDataFrame([(i, v, rng.normal(size=2).tolist()) for i, v in enumerate(labels)], "id long, label string, x array<double>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = simulate.simulatability(df, ["x"], "label", "id", steps=4).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        cut = simulate.simulatability(df, ["x"], "label", "id", steps=4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r.task for r in cut] == [r.task for r in whole]
    assert all(math.isclose(a["mean"], b["mean"], abs_tol=1e-9) for a, b in zip(cut, whole))
