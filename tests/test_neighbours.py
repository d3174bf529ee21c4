"""Neighbours by pivot cells against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import neighbours


def brute(rows, refs, k, same_role, exclude_self):
    out = set()
    for i, x, r in rows:
        near = sorted((float(np.sqrt(((x - y) ** 2).sum())), j) for j, y, s in refs if (not same_role or r == s) and not (exclude_self and i == j))
        out |= {(i, j, round(d, 9), n + 1) for n, (d, j) in enumerate(near[:k])}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(int(i), x.tolist(), int(r)) for i, x, r in rows], "id long, x array<double>, role int").repartition(3)


def asked(df):
    return {(r.id, r.ref_id, round(r.distance, 9), r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("role, self_out, k", [(None, True, 3), ("role", False, 2)])
def test_cells_equal_all_pairs(spark, role, self_out, k):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(8, 4)) * 10
    x = centers[rng.integers(0, 8, 300)] + 0.1 * rng.normal(size=(300, 4))
    x[:90] = x[0]  # a third are copies
    x[90:130] = rng.integers(0, 2, (40, 4))  # ties on a grid
    rows = [(i * 7 % 1009, v, i % 2) for i, v in enumerate(x)]
    df = frame(spark, rows)
    got = neighbours.nearest_by_cells(df, df, k, role, self_out, pivots=12, block=20, crowd=16)
    assert asked(got) == brute(rows, rows, k, role is not None, self_out)


def test_cells_read_few_blocks(spark):
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(40, 8)) * 50)[rng.integers(0, 40, 4000)] + 0.1 * rng.normal(size=(4000, 8))
    df = frame(spark, [(i, v, 0) for i, v in enumerate(x)]).persist()
    index = neighbours.index_cells(df, 2, block=100)
    size = {b: n for b, n in zip(index.blocks["block"], index.blocks["n"])}
    first = neighbours.visits(df, index, 2, True)
    bound = df.withColumn("far", F.lit(0.5))
    n = sum(size[r.block] * r["count"] for d in (first, neighbours.visits(bound, index, 2, True)) for r in d.groupBy("block").count().collect())
    assert n < 0.25 * 4000 * 4000
    df.unpersist()


def test_cells_of_little(spark):
    rows = [(1, np.array([0.0, 1.0]), 0), (2, np.array([0.0, 2.0]), 1)]
    df = frame(spark, rows)
    assert neighbours.nearest_by_cells(df, df.limit(0), 2).count() == 0
    assert neighbours.nearest_by_cells(df.limit(0), df, 2).count() == 0
    assert asked(neighbours.nearest_by_cells(df, df, 5)) == brute(rows, rows, 5, False, False)
    holes = df.unionByName(spark.createDataFrame([(3, None, 0), (4, [1.0, 1.0], None)], df.schema)).withColumn("block", F.lit("extra"))
    assert asked(neighbours.nearest_by_cells(holes, holes, 1, "role")) == {(1, 1, 0.0, 1), (2, 2, 0.0, 1)}
