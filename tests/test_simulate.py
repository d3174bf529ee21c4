"""Simulatability against plain numpy over the same folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import simulate


def logistic(z, y, k, u):
    """Gradient descent with momentum on the same loss, slowly but surely."""
    w = np.zeros((k if k > 2 else 1, z.shape[1]))
    v = np.zeros_like(w)
    ridge = np.ones_like(w)
    ridge[:, 0] = 0
    size = 1.0 / (np.linalg.norm(z * np.sqrt(u)[:, None], 2) ** 2 / 2 + 1)
    for _ in range(6000):
        s = z @ (w + 0.9 * v).T
        s = np.hstack([np.zeros((len(s), 1)), s]) if k == 2 else s
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        wrong = (p - np.eye(k)[y])[:, (slice(1, 2) if k == 2 else slice(0, None))]
        v = 0.9 * v - size * ((u[:, None] * wrong).T @ z + ridge * (w + 0.9 * v))
        w = w + v
    return w


def test_simulatability(spark):
    rng = np.random.default_rng(7)
    labels = np.array(["Benign"] * 40 + ["dos"] * 30 + ["scan"] * 17 + ["web"] * 11 + ["rare"] * 3)
    x = rng.normal(size=(len(labels), 3)) + np.array([[0, 0, 0], [2, 0, 1], [0, 2, 0], [-1, -1, 2], [1, 1, 1]])[[["Benign", "dos", "scan", "web", "rare"].index(v) for v in labels]] * 0.8
    score = x.sum(1, keepdims=True) + rng.normal(size=(len(labels), 1))
    df = spark.createDataFrame([(i, str(v), a.tolist(), b.tolist()) for i, (v, a, b) in enumerate(zip(labels, x, score))], "id long, label string, x array<double>, score array<double>").repartition(3)
    got = {(r.input, r.task): r for r in simulate.simulatability(df, ["score", "x"], "label", "id", floor="score").collect()}
    folds = {r.id: r.folds for r in simulate.stratified_folds(df, "label", "id").collect()}
    f = np.array([folds[i] for i in range(len(labels))])
    for name in ("Benign", "dos", "scan", "web"):  # equal shares of every class
        for r in range(5):
            n = np.bincount(f[labels == name, r], minlength=5)
            assert n.max() - n.min() <= 1
    assert len({tuple(v) for v in f.T.tolist()}) == 5
    for task in (simulate.TYPES, simulate.ALARMS):
        who = np.isin(labels, ["dos", "scan", "web"]) if task == simulate.TYPES else np.ones(len(labels), bool)
        y = (np.unique(labels[who], return_inverse=True)[1] if task == simulate.TYPES else (labels != "Benign").astype(int))[: who.sum()]
        k, found = len(set(y.tolist())), []
        for r in range(2):  # two of the repeats take long enough
            for fold in range(5):
                train, test = f[who, r] != fold, f[who, r] == fold
                mean, std = x[who][train].mean(0), x[who][train].std(0)
                z = np.hstack([np.ones((who.sum(), 1)), (x[who] - mean) / std])
                u = train.sum() / (k * np.bincount(y[train], minlength=k))
                w = logistic(z[train], y[train], k, u[y[train]])
                s = z[test] @ w.T
                if task == simulate.TYPES:
                    p = s.argmax(1)
                    found.append(np.mean([2 * ((p == c) & (y[test] == c)).sum() / ((p == c).sum() + (y[test] == c).sum()) for c in sorted(set(p.tolist()) | set(y[test].tolist()))]))
                else:
                    a, b = s[y[test] == 1, 0], s[y[test] == 0, 0]
                    found.append(((a[:, None] > b[None]) + 0.5 * (a[:, None] == b[None])).mean())
        assert got["x", task].mean == pytest.approx(np.mean(found), abs=0.06) and got["x", task].std > 0
    assert got["x", simulate.TYPES].passed and got["score", simulate.TYPES].passed is False
    none = simulate.simulatability(df.where("label = 'rare'"), ["x"], "label", "id").collect()
    assert len(none) == 2 and all(r["mean"] is None and r.passed is None for r in none)


def test_models_reach_the_optimum(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 2)), rng.integers(0, 3, 200)
    m = simulate._Models(["x"], [2], ["a", "b", "c"])
    k = (0, 0, 0)
    m.take_moments(k, m.moments(y, x))
    for _ in range(20):
        m.take_step(k, m.step(k, y, x))
    z, u = m.design(k, x), m.weight[k][y]
    w = logistic(z, y, 3, u)
    assert np.allclose(m.w[k][:, 1:], w[:, 1:], atol=1e-3)
