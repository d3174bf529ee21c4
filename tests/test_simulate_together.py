"""The models of simulatability share the rows' products and stop when they have settled."""

import numpy as np
import pytest

from flowlens.operators import simulate


@pytest.mark.parametrize("classes", [["a", "b"], ["a", "b", "c", "d"]])
def test_sums_of_all_models(monkeypatch, classes):
    monkeypatch.setattr(simulate, "CHUNK", 70)
    rng = np.random.default_rng(2)
    n, c = 300, len(classes)
    xs = [rng.normal(size=(n, 1)) * 50 + 900, np.hstack([rng.normal(size=(n, 2)) * [1e-3, 1e4], np.full((n, 1), 7.0)])]
    y, folds = rng.integers(0, c, n), rng.integers(0, 5, (n, 5))
    m = simulate._Models(["s", "x"], [1, 3], classes)
    moments = m.all_moments(y, folds, xs)
    for k in m.keys:
        train = folds[:, k[1]] != k[2]
        assert np.allclose(moments[k], m.moments(y[train], xs[k[0]][train]), rtol=1e-12)
        m.take_moments(k, moments[k])
        m.w[k] = rng.normal(size=m.w[k].shape)
    got = m.in_models(m.all_sums(y, folds, xs))
    assert got.keys() == set(m.keys)
    for k in m.keys:
        train = folds[:, k[1]] != k[2]
        want = m.step(k, y[train], xs[k[0]][train])
        assert np.allclose(got[k], want, rtol=1e-7, atol=1e-7)


def test_passes_end_when_the_models_have_settled(spark, monkeypatch):
    """All 25 steps were taken, since rounding kept the intercepts moving."""
    passes, run = [], simulate._pass
    monkeypatch.setattr(simulate, "_pass", lambda rows, tasks, what: passes.append(what) or run(rows, tasks, what))
    rng = np.random.default_rng(3)
    labels = [["Benign", "dos", "scan", "web"][i] for i in rng.integers(0, 4, 400)]
    df = spark.createDataFrame([(i, v, [float(rng.integers(45, 51))], [float(rng.integers(45, 51)), float(rng.normal(5e4, 1e4)), float(len(v))]) for i, v in enumerate(labels)], "id long, label string, score array<double>, x array<double>").coalesce(2)
    out = {(r.input, r.task): r for r in simulate.simulatability(df, ["score", "x"], "label", "id", floor="score").collect()}
    assert len(out) == 4 and out["x", simulate.TYPES].passed
    assert passes[0] == "moments" and 3 < len(passes) <= 20
