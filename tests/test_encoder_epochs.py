"""The encoder's queries train as long as the operator does, and the contrastive loss is what it was."""

import inspect

import numpy as np
import pytest

from flowlens.operators import detectors
from flowlens.plans.all_queries import QUERIES


class Called(Exception):
    pass


@pytest.mark.parametrize("name", ["m01_m06_encoder", "m10_m32_methods"])
def test_all_epochs(spark, monkeypatch, name):
    signature = inspect.signature(detectors.train_encoder)

    def train(*args, **options):
        bound = signature.bind(*args, **options)
        bound.apply_defaults()
        raise Called({k: bound.arguments[k] for k in ("epochs", "batch", "patience")})

    monkeypatch.setattr(detectors, "train_encoder", train)
    with pytest.raises(Called) as got:
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.value.args[0] == {k: signature.parameters[k].default for k in ("epochs", "batch", "patience")} and got.value.args[0]["epochs"] >= 10


@pytest.mark.parametrize("masked", [False, True])
def test_info_nce_by_softmax(masked):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(30, 4)), rng.normal(size=(30, 4))
    same = (rng.random((30, 30)) < 0.2) | np.eye(30, dtype=bool) if masked else None
    loss, ga, gb = detectors.info_nce(a, b, same)

    def plain(a, b):
        s = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T / 0.2
        if masked:
            s = np.where(same & ~np.eye(30, dtype=bool), -np.inf, s)
        return sum((np.log(np.exp(s).sum(k)) - np.diag(s)).mean() / 2 for k in (0, 1))

    assert abs(loss - plain(a, b)) < 1e-6
    for m, g in ((a, ga), (b, gb)):
        for i, j in ((0, 1), (7, 3), (29, 0)):
            old = m[i, j]
            m[i, j] = old + 1e-5
            up = plain(a, b)
            m[i, j] = old - 1e-5
            down = plain(a, b)
            m[i, j] = old
            assert abs((up - down) / 2e-5 - g[i, j]) < 1e-6
