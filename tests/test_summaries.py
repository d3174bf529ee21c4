"""Report tables: nulls, ties and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import audit, plausible, summaries


def test_best_with_ties(spark):
    df = spark.createDataFrame([("a", 0.900, 0.1), ("b", 0.897, 0.5), ("c", 0.890, 0.9), ("d", None, 1.0), ("e", 0.897, None), ("f", 0.897, 0.5)], "name string, pr double, mcc double")
    assert [r.name for r in summaries.best_with_ties(df, "pr", "mcc", "name").collect()] == ["b"]
    assert [r.name for r in summaries.best_with_ties(df, "pr", "mcc", "name", 1e-9).collect()] == ["a"]
    assert summaries.best_with_ties(df.limit(0), "pr", "mcc", "name").count() == 0


def test_z_fusion(spark):
    rng = np.random.default_rng(2)
    rows = [(i, m, float(v), i < 40) for i in range(60) for m, v in (("a", rng.normal()), ("b", rng.normal() * 5), ("c", 1.0))] + [(99, "a", None, False), (98, "new", 1.0, False)]
    got = {(r.id, r.variant): r.score for r in summaries.z_fusion(spark.createDataFrame(rows, "id long, m string, s double, v boolean"), "id", "m", "s", "v").collect()}
    z = {}
    for m in "abc":
        val = np.array([s for _, n, s, v in rows if n == m and v])
        med = np.median(val)
        z[m] = {i: (s - med) / (1.4826 * np.median(np.abs(val - med)) + 1e-9) for i, n, s, _ in rows if n == m and s is not None}
    for i in range(60):
        p = [z[m][i] for m in "abc"]
        assert got[i, "mean"] == pytest.approx(np.mean(p)) and got[i, "max"] == pytest.approx(max(p)) and got[i, "without b"] == pytest.approx((p[0] + p[2]) / 2)
    assert len(got) == 60 * 5 and not any(i > 90 for i, _ in got)


def test_alert_volume_and_benign_day(spark):
    df = spark.createDataFrame([("x", "c", "s", 0), ("y", "c", None, 3600), (None, None, "s", 7200), ("x", "c", "t", 100)], "src string, c string, s string, t long")
    got = {(r.side, r.kind, r.name): (r.n, r.per_hour) for r in summaries.alert_volume(df, F.col("src") == "x", "c", "s", "t").collect()}
    assert got[("attacker", "total", None)] == (2, 1.0) and got[("background", "total", None)] == (2, 1.0)
    assert got[("background", "category", None)] == (1, 0.5) and got[("background", "signature", "s")] == (1, 0.5) and len(got) == 6
    assert summaries.alert_volume(df.limit(0), F.col("src") == "x", "c", "s", "t").count() == 0
    row = summaries.benign_day_alerts(df, F.col("src") == "x", "t").first()
    assert (row.flows, row.alerted_flows, row.alerted_share, row.alerted_flows_per_hour) == (4, 2, 0.5, 1.0)
    none = summaries.benign_day_alerts(df.limit(0), F.col("src") == "x", "t").first()
    assert none.flows == 0 and none.alerted_share is None and none.alerted_flows_per_hour is None


def test_window_alerts(spark):
    cols = "r int, d string, t long, s double, y int, l string"
    val = [(0, "v", i, float(i % 100), 0, "b") for i in range(1000)]
    test = [(0, "t", i, 99.5, 1, "scan") for i in range(50)] + [(0, "t", 600 + i, 1.0, 0, "b") for i in range(50)] + [(0, "t", 1200, None, 1, "slow"), (None, "t", 5, 99.5, 0, "b")]
    rates, covered = summaries.window_alerts(spark.createDataFrame(val, cols), spark.createDataFrame(test, cols), "r", "d", "t", "s", "y", "l")
    row = rates.first()
    assert (row.attack_test_windows, row.benign_test_windows, row.val_windows) == (2, 1, 2) and row.window_recall == 0.5 and row.window_fpr == 0 and row.any_window_recall == 0.5
    assert {r.l: (r.n, r.covered) for r in covered.collect()} == {"scan": (50, 1.0), "slow": (1, 0.0)}
    empty = spark.createDataFrame([], cols)
    rates, covered = summaries.window_alerts(empty, empty, "r", "d", "t", "s", "y", "l")
    assert covered.count() == 0 and rates.first().benign_test_windows == 0


def test_study_and_hypotheses(spark):
    key = spark.createDataFrame([(1, 1, "Scan", "A", "B"), (2, 0, "None", "B", "A")], "alert int, is_attack int, category string, condition_form_1 string, condition_form_2 string")
    said = spark.createDataFrame([("p", 1, 1, " ATTACK!", "scan ", 3, 5), ("p", 2, 1, None, None, None, 4), ("q", 1, 2, "benign", "x", 1, 2), ("q", 9, 2, "attack", "x", 1, 2)], "participant string, alert int, form int, decision string, category_answer string, seconds int, trust int")
    got = {(r.part, r.name, r.condition, r.measure): (r.n, r.value) for r in summaries.study_tables(said, key, ["seconds"], ["trust"]).collect()}
    assert got["condition", None, "A", "correct"] == (1, 1.0) and got["condition", None, "B", "correct"] == (2, 0.5) and got["condition", None, "B", "seconds"] == (1, 1.0)
    assert got["truth", "0", "B", "correct"] == (1, 1.0) and got["participant", "p", "B", "category_correct"] == (1, 0.0) and got["rating", None, "B", "trust"] == (2, 3.0)
    h = spark.createDataFrame([("a", 0.1, 0.05, 0.2), ("b", -0.1, -0.2, -0.01), ("c", 0.1, None, 0.2), ("d", 0.0, -1.0, 1.0)], "name string, diff double, lo double, hi double")
    assert {r.name: (r.supported, r.refuted, r.result) for r in summaries.hypothesis_checks(h).collect()} == {"a": (True, False, "+0.100 [+0.050, +0.200]"), "b": (False, True, "-0.100 [-0.200, -0.010]"), "c": (False, False, None), "d": (False, False, "+0.000 [-1.000, +1.000]")}


def test_split_profile(spark):
    df = spark.createDataFrame([(1, " Scan", 1.0, None), (0, "Benign", 1.0, None), (1, None, 2.0, 3.0), (None, "Scan", 2.0, 4.0)], "label int, cat string, a double, b double")
    row = summaries.split_profile(df, "label", "cat", ["a", "b"], df.where("b IS NULL")).first().asDict()
    assert row == {"rows": 4, "attack_rows": 2, "mismatch": 2, "padded": 1, "missing_cells": 2, "rows_with_missing": 2, "duplicate_rows": 1, "rows_seen_in_train": 2}
    assert summaries.split_profile(df.limit(0), "label", "cat", ["a", "b"], df).first().asDict() == dict.fromkeys(row, 0)


def test_modalities(spark):
    alerts = spark.createDataFrame([(1, [5.0, 5.0, 1.0]), (2, [0.1, 0.0, 0.0]), (3, [1.0, 1.0, 1.0])], "id long, x array<double>")
    refs = spark.createDataFrame([(7, [0.0, 0.0, 0.0])], "id long, x array<double>")
    near = spark.createDataFrame([(1, 7), (2, 7)], "id long, ref_id long")
    top = plausible.top_modality(spark.createDataFrame([(1, "m", 0.5), (1, "n", 0.5), (2, "n", 0.9), (2, "m", 0.1)], "id long, modality string, share double"))
    assert {r.id: r.modality for r in top.collect()} == {1: "m", 2: "n"}
    gone = plausible.modality_replaced(alerts, near, refs, {"m": (0, 2), "n": (2, 3)}).withColumn("score", F.aggregate("x", F.lit(0.0), lambda s, v: s + v))
    got = {r.id: (r.drop, r.other_drop) for r in plausible.modality_drop(gone, top).collect()}
    assert got[1] == pytest.approx((10 / 11, 1 / 11)) and got[2] == (None, None) and len(got) == 2
    expected = spark.createDataFrame([("a", "m"), ("a", "m"), ("z", "n")], "label string, modality string")
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "q")], "id long, label string")
    assert [tuple(r) for r in plausible.plausibility(top, labels, expected, 2).collect()] == [("a", 2, 0.5, 0.5)]


def test_quality_counts_infinite(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("-inf"),), (float("nan"),), (None,), (0.0,)], "a double")
    row = audit.quality(df, ["a"]).first()
    assert (row.missing, row.infinite, row.negative, row.n_distinct, row.is_constant) == (1, 2, 1, 5, False)
