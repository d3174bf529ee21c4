"""Ranks are taken only of the rows that need them, and groups with few scores are not shuffled."""

import pytest

from flowlens.operators import errors, scoring
from flowlens.plans import deep_queries

SMALL = "/root/testdata/sf0.001"


def decisions(spark):
    rows = [("m", s, i, "A" if i % 2 else "Benign", i % 2, (i + s) % 5 > 2, float(i % 7), (i % 7) / 7) for s in (0, 1) for i in range(70)]
    return spark.createDataFrame(rows, "method string, seed int, row_id long, label string, y int, flagged boolean, score double, p double")


def test_decisions_are_not_ranked(spark):
    assert "p" not in deep_queries._decisions(spark, SMALL).columns


@pytest.mark.parametrize("measure", [errors.seed_flips, errors.near_misses])
def test_only_rows_that_need_p_get_it(spark, measure):
    dec, seen = decisions(spark), []

    def with_p(rows):
        seen.append(rows.count())
        return rows.withColumn("p", rows["score"] / 7)

    want = {tuple(r) for r in measure(dec).collect()}
    assert {tuple(r) for r in measure(dec.drop("p"), with_p).collect()} == want
    assert 0 < seen[0] < dec.count()


def test_groups_with_few_and_many_scores(spark, monkeypatch):
    monkeypatch.setattr(scoring, "FEW", 10)
    ref = spark.createDataFrame([("a", float(i % 4)) for i in range(40)] + [("b", float(i)) for i in range(40)] + [("a", None), (None, 1.0)], "g string, s double")
    df = spark.createDataFrame([("a", 1.5), ("a", 3.0), ("b", 20.5), ("b", -1.0), ("c", 1.0), (None, 1.0), ("a", None)], "g string, s double")
    out = scoring.rank_in(df, "s", ref, "s", ["g"])
    got = {(r.g, r.s): (r.at_most, r.n) for r in out.collect()}
    assert got == {("a", 1.5): (20, 40), ("a", 3.0): (40, 40), ("b", 20.5): (21, 40), ("b", -1.0): (0, 40), ("c", 1.0): (0, 0), (None, 1.0): (None, None), ("a", None): (None, None)}
    assert "Union" in out._jdf.queryExecution().analyzed().toString()


def test_identical_rows_without_nearest_ones(spark):
    rows = decisions(spark)
    got = errors.per_attack(errors.with_identical(rows.where("y = 1"), rows.where("y = 0 AND score < 3"), ["score"]))
    assert "misses_near" not in got.columns
    assert {r.seed: (r.flows, r.misses_identical is not None) for r in got.collect()} == {0: (35, True), 1: (35, True)}
