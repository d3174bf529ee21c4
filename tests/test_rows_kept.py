"""Operators that add columns keep every row, with nulls in keys, times and scores."""

import pytest
from pyspark.sql import functions as F

from flowlens.operators import joins, metrics, scoring, split

ROWS = [(1, "a", 10, 1.0, True), (2, "a", 20, None, True), (3, "b", 5, 3.0, False), (4, None, 7, 2.0, True), (5, "a", None, 2.0, True), (6, "b", None, None, None), (7, None, None, None, None), (8, "c", 1, 2.0, False), (8, "c", 1, 2.0, False)]
CASES = {
    "as_of": lambda d: joins.as_of(d, d.select("g", F.col("t").alias("rt"), F.col("v").alias("w")), ["g"], "t", "rt", ["w"]),
    "time_split": lambda d: split.time_split(d, "g", "t", "id", 0.5, "ok"),
    "rank_in": lambda d: scoring.rank_in(d, "v", d, "v"),
    "rank_in_groups": lambda d: scoring.rank_in(d, "v", d, "v", ["g"]),
    "tail_score": lambda d: scoring.tail_score(d, "v", d, "v", "tail", ["g"]),
    "halves": lambda d: split.halves(d, "g", "t"),
    "rank_bins": lambda d: metrics.rank_bins(d, "v", 3),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_rows_out_are_rows_in(spark, name):
    df = spark.createDataFrame(ROWS, "id long, g string, t long, v double, ok boolean").repartition(2)
    out = CASES[name](df)
    assert set(df.columns) <= set(out.columns)
    assert sorted(map(str, out.select(df.columns).collect())) == sorted(map(str, df.collect()))


def test_what_nulls_get(spark):
    df = spark.createDataFrame(ROWS, "id long, g string, t long, v double, ok boolean")
    r = {x.id: x for x in scoring.rank_in(df, "v", df, "v").collect()}
    assert r[1].n == 6 and r[1].at_most == 1 and r[3].at_most == 6 and r[2].n is None
    s = {x.id: x for x in split.time_split(df, "g", "t", "id", 0.5, "ok").collect()}
    assert s[3].split is None and s[8].cutoff is None and s[1].split == "train" and s[2].split == "val"
    a = {x.id: x for x in joins.as_of(df, df.select("g", F.col("t").alias("rt"), F.col("v").alias("w")), ["g"], "t", "rt", ["w"]).collect()}
    assert a[1].w == 1.0 and a[4].w is None and a[5].asof_rt is None
