"""Explanations and methods that read their rows once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlens.operators import batch, detectors, explain

CUT = {"a": (0, 2), "b": (2, 4)}


def xs(spark, n=60):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(i, [float(v) for v in rng.normal(size=4)], i % 9) for i in range(n)], "row_id long, x array<double>, role int")


def test_surrogate_keeps_one_row_for_an_alert(spark):
    v = xs(spark).withColumnRenamed("row_id", "id").select("id", "x")
    twice = v.where("id < 4").unionByName(v.where("id BETWEEN 10 AND 12").withColumn("id", F.col("id") - 10))  # ids 0 to 2 have two alerts
    back, score = v.where("id >= 20"), lambda m: m[:, 0] * m[:, 1] + np.abs(m).sum(1)
    out = explain.local_surrogate(twice, back, score, 4, 30, 1.0, 5)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in text and "FlatMapGroups" not in text
    b = np.array([r.x for r in back.orderBy("id").collect()])
    h = lambda *c: F.xxhash64(*c)
    draws = twice.select("id", "x", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("r"))
    draws = draws.select("id", "x", F.pmod(h("id", "r", F.lit(5)), F.lit(len(b))).alias("p"), *[F.when(F.col("r") == 0, 1).otherwise(F.pmod(h("id", "r", F.lit(i), F.lit(6)), F.lit(2))).alias(f"k{i}") for i in range(4)])
    got = {(r.id, r.feature): r.value for r in out.collect()}
    for i, g in draws.toPandas().groupby("id"):
        k = g[[f"k{j}" for j in range(4)]].to_numpy()
        y = score(np.where(k == 1, np.stack(g["x"].to_list()), b[g["p"]]))
        w, a = np.exp(-(((1 - k.mean(1)) / 0.5) ** 2)), np.c_[np.ones(len(k)), k]
        c = np.linalg.solve(a.T @ (a * w[:, None]) + np.diag([0.0, 1, 1, 1, 1]), a.T @ (w * y))[1:]
        assert np.allclose([got[i, j] for j in range(4)], c)
    assert len(got) == 16


def test_evidence_without_a_join_for_raw_values(spark):
    v = spark.createDataFrame([(1, "f", 2.0, 0, 5.0), (1, "g", 1.0, 0, 6.0), (1, "h", -1.0, 0, 7.0), (2, "g", 3.0, 1, 8.0)], "id long, feature string, value double, role int, raw double")
    base = spark.createDataFrame([(None, "f", 1.0, 0.0, 2.0), (None, "g", 1.0, 0.0, 2.0), (1, "g", 4.0, 3.0, 5.0)], "role int, feature string, typical double, p5 double, p95 double")
    again = spark.createDataFrame([(1, ["g"])], "id long, top array<string>")
    want = explain.evidence(v.select("id", "feature", "value"), v.select("id", "role", "feature", "raw"), base, again, 2)
    got = explain.evidence(v, None, base, again, 2)
    assert got.columns == want.columns and {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == 3


def test_methods_score_a_row_in_one_pass(spark):
    v = xs(spark)
    specs = {"all": detectors.METHODS["autoencoder"], "roles": detectors.METHODS["multi_view_roles"], **detectors.expert_specs(["b"])}
    out = batch.run_methods(v, v, CUT, "row_id", [0, 1], specs, epochs=1)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    w, _ = detectors.train_encoder(v.withColumn("x", F.slice("x", 3, 2)), {"b": (0, 2)}, "row_id", contrast=0.0, seed=1, epochs=1)
    want = {r.row_id: r.rec for r in detectors.encode(v.withColumn("x", F.slice("x", 3, 2)), w, {"b": (0, 2)}).collect()}
    got = {r.row_id: r.score for r in out.where("method = 'only_b' AND seed = 1").collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert out.count() == 6 * 60 and out.columns == ["method", "seed", "row_id", "score"]


def test_gelu_and_matrix():
    x = np.linspace(-4, 4, 101)
    value, slope = detectors.gelu(x)
    assert np.allclose(value, 0.5 * x * (1 + np.tanh(0.7978845608 * (x + 0.044715 * x**3))))
    assert np.allclose(slope[1:-1], (detectors.gelu(x[1:-1] + 1e-6)[0] - detectors.gelu(x[1:-1] - 1e-6)[0]) / 2e-6, atol=1e-6)
    assert detectors.matrix(pd.Series([[1, 2], np.array([3.0, 4.0])])).tolist() == [[1.0, 2.0], [3.0, 4.0]]
    with pytest.raises(ValueError):
        detectors.matrix(pd.Series([[1], [2, 3]]))
