"""Simulatability: how well a simple model tells attack types, and attacks from false alarms, by what explanations say.

All folds, repeats, inputs and tasks are trained together: each Newton step is one pass over the rows, in which a task
adds up gradients and Hessians of every model with the rows that its fold trains on. The models of an input share its
rows' products, in one frame that each model's own standardisation is an affine map of. What is shuffled is one vector
for each model and task of Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.columns import row_hash
from flowlens.operators.metrics import roc_auc
from flowlens.operators.quantiles import prefix_sum
from flowlens.sources.scratch import dealt, written

TYPES, ALARMS = "attack type macro-F1", "attack vs false alarm ROC-AUC"
SPLITS, REPEATS = 5, 5
#: Rows that all models of an input take together.
CHUNK = 2048


def stratified_folds(df: DataFrame, label: str, row_id: str, name: str = "folds", seed: int = 0) -> DataFrame:
    """df with `name`: for each of REPEATS repeats the row's fold, 0 .. SPLITS - 1, each with an equal share of every class.

    Rows of a class are numbered by a hash of their id; every SPLITS of them in a row are dealt to the folds by a
    permutation of their own. row_id must be unique.
    """
    placed = prefix_sum(df.select(label, row_id, row_hash([row_id], seed).alias("_h"), F.lit(1).alias("_one")), [label], "_h", "_one", "_n")
    block, at = F.floor((F.col("_n") - 1) / SPLITS), (F.col("_n") - 1) % SPLITS

    def fold(r: int):
        h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(label).cast("string"), block.cast("string"), F.lit(f"{r}|{seed}")).cast("binary")), 1, 12), 16, 10).cast("long")
        return ((at * (h % (SPLITS - 1) + 1) + F.floor(h / 16) % SPLITS) % SPLITS).cast("int")  # SPLITS is a prime

    return df.join(placed.select(label, row_id, F.array(*[fold(r) for r in range(REPEATS)]).alias(name)), [label, row_id])


class _Models:
    """Standardised (multinomial) logistic models of some inputs on one task, a model for each input, repeat and fold."""

    def __init__(self, inputs: list[str], dims: list[int], classes: list[str]):
        self.inputs, self.dims, self.classes = inputs, dims, classes
        self.free = len(classes) if len(classes) > 2 else 1  # of two classes the first one's score is 0
        self.keys = [(i, r, f) for i in range(len(inputs)) for r in range(REPEATS) for f in range(SPLITS)]
        self.w = {k: np.zeros((self.free, dims[k[0]] + 1)) for k in self.keys}
        self.mean: dict = {}
        self.std: dict = {}
        self.weight: dict = {}

    def rows(self, batch: pa.RecordBatch, t: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Class, folds and inputs of the batch's rows that are in task t."""
        own = batch.filter(batch.column(f"in{t}"))
        y = pc.index_in(own.column(f"y{t}"), pa.array(self.classes)).to_numpy(zero_copy_only=False).astype(int)
        flat = lambda c: own.column(c).flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1) if own.num_rows else np.zeros((0, 1))
        return y, flat("folds"), [flat(f"x{i}") for i in range(len(self.inputs))]

    def design(self, k: tuple, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), (x - self.mean[k]) / self.std[k]])

    def shares(self, k: tuple, z: np.ndarray) -> np.ndarray:
        s = z @ self.w[k].T
        s = np.hstack([np.zeros((len(s), 1)), s]) if self.free == 1 else s
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def moments(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(y, minlength=len(self.classes)), x.sum(0), (x * x).sum(0)])

    def all_moments(self, y: np.ndarray, folds: np.ndarray, xs: list[np.ndarray]) -> dict[tuple, np.ndarray]:
        """moments() of the rows that each model trains on: what all folds add up to, without its own."""
        out = {}
        for i, x in enumerate(xs):
            each = np.hstack([np.eye(len(self.classes))[y], x, x * x])
            for r in range(REPEATS):
                of = (folds[:, r, None] == np.arange(SPLITS)).T.astype(float) @ each
                out |= {(i, r, f): np.delete(of, f, 0).sum(0) for f in range(SPLITS)}
        return out

    def take_moments(self, k: tuple, v: np.ndarray) -> None:
        c, d = len(self.classes), self.dims[k[0]]
        count, n = v[:c], v[:c].sum()
        self.mean[k] = v[c : c + d] / max(n, 1)
        std = np.sqrt(np.maximum(v[c + d :] / max(n, 1) - self.mean[k] ** 2, 0))
        self.std[k] = np.where(std > 1e-12, std, 1.0)
        self.weight[k] = n / (c * np.maximum(count, 1))  # balanced

    def step(self, k: tuple, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = self.design(k, x)
        p, u = self.shares(k, z), self.weight[k][y]
        wrong = p - np.eye(len(self.classes))[y]
        own = slice(0, None) if self.free > 1 else slice(1, 2)
        g = (u[:, None] * wrong[:, own]).T @ z
        p = p[:, own]
        m = z.shape[1]
        h = np.zeros((self.free, m, self.free, m))
        for a in range(self.free):
            for b in range(self.free):
                h[a, :, b] = z.T @ (z * (u * p[:, a] * ((a == b) - p[:, b]))[:, None])
        return np.concatenate([g.ravel(), h.ravel()])

    def all_sums(self, y: np.ndarray, folds: np.ndarray, xs: list[np.ndarray]) -> dict[int, list[np.ndarray]]:
        """Of each input: gradients (class, model, column) and Hessians (pair of classes, model, columns) in the input's frame."""
        c, pairs = len(self.classes), self.pairs()
        out = {}
        for i, x in enumerate(xs):
            keys, maps = self.of(i)
            w = [np.stack([t @ self.w[k][a] for k, t in zip(keys, maps, strict=True)], 1) for a in range(self.free)]
            weight = np.stack([self.weight[k] for k in keys], 1)
            centre, scale = self.frame(i)
            m = x.shape[1] + 1
            g, h = np.zeros((self.free, len(keys), m)), np.zeros((len(pairs), len(keys), m * m))
            for lo in range(0, len(x), CHUNK):
                part, own = slice(lo, lo + CHUNK), y[lo : lo + CHUNK]
                d = np.hstack([np.ones((len(own), 1)), (x[part] - centre) / scale])
                dd = (d[:, :, None] * d[:, None]).reshape(len(d), -1)
                u = weight[own] * np.stack([folds[part, r] != f for _, r, f in keys], 1)
                s = [d @ v for v in w]
                if self.free == 1:
                    p = [0.5 + 0.5 * np.tanh(0.5 * s[0])]
                else:
                    top = np.maximum.reduce(s)
                    e = [np.exp(v - top) for v in s]
                    whole = sum(e)
                    p = [v / whole for v in e]
                up = [u * v for v in p]
                for a in range(self.free):
                    g[a] += (up[a] - u * (own == a + (self.free != c))[:, None]).T @ d
                for j, (a, b) in enumerate(pairs):
                    h[j] += (up[a] * (1 - p[a]) if a == b else -up[a] * p[b]).T @ dd
            out[i] = [g, h]
        return out

    def pairs(self) -> list[tuple[int, int]]:
        return [(a, b) for a in range(self.free) for b in range(a, self.free)]

    def frame(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        keys = [k for k in self.keys if k[0] == i]
        return np.mean([self.mean[k] for k in keys], 0), np.max([self.std[k] for k in keys], 0)

    def of(self, i: int) -> tuple[list[tuple], list[np.ndarray]]:
        """An input's models, and the matrices that take a row of the frame to each model's design."""
        centre, scale = self.frame(i)
        keys, maps = [k for k in self.keys if k[0] == i], []
        for k in keys:
            t = np.diag(np.append(1.0, scale / self.std[k]))
            t[0, 1:] = (centre - self.mean[k]) / self.std[k]
            maps.append(t)
        return keys, maps

    def in_models(self, sums: dict[int, list[np.ndarray]]) -> dict[tuple, np.ndarray]:
        """What step() gives, of all_sums()."""
        out = {}
        for i, (g, h) in sums.items():
            m = g.shape[2]
            for j, (k, t) in enumerate(zip(*self.of(i), strict=True)):
                whole = np.zeros((self.free, m, self.free, m))
                for (a, b), v in zip(self.pairs(), h[:, j], strict=True):
                    whole[a, :, b] = whole[b, :, a] = t.T @ v.reshape(m, m) @ t
                out[k] = np.concatenate([(g[:, j] @ t).ravel(), whole.ravel()])
        return out

    def take_step(self, k: tuple, v: np.ndarray) -> float:
        size = self.w[k].size
        ridge = np.ones_like(self.w[k])
        ridge[:, 0] = 1e-9 if self.free == 1 else 1e-6  # the intercept
        g = v[:size] + (ridge * self.w[k]).ravel()
        h = v[size:].reshape(size, size) + np.diag(ridge.ravel())
        move = np.linalg.solve(h, g)
        if self.free > 1:  # a shift of all intercepts changes no share; rounding alone would move them and never settle
            move = move.reshape(self.w[k].shape)
            move[:, 0] -= move[:, 0].mean()
            move = move.ravel()
        move *= min(1.0, 5.0 / max(np.abs(move).max(), 1e-12))
        self.w[k] = self.w[k] - move.reshape(self.w[k].shape)
        return float(np.abs(move).max())


SUMS = "t int, i int, r int, f int, v array<double>"


def _pass(rows: DataFrame, tasks: list[_Models], what: str) -> dict[tuple[int, tuple], np.ndarray]:
    """Sums over the rows that each model trains on, by task and key."""
    shared = rows.sparkSession.sparkContext.broadcast(tasks)  # parameters: bounded by classes and columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        steps: dict[int, dict[int, list[np.ndarray]]] = {}
        for batch in batches:
            for t, models in enumerate(shared.value):
                y, folds, xs = models.rows(batch, t)
                if not len(y):
                    continue
                if what == "moments":
                    for k, v in models.all_moments(y, folds, xs).items():
                        sums[t, k] = sums.get((t, k), 0) + v
                else:
                    for i, v in models.all_sums(y, folds, xs).items():
                        held = steps.setdefault(t, {})
                        held[i] = [a + b for a, b in zip(held[i], v, strict=True)] if i in held else v
        for t, held in steps.items():
            sums |= {(t, k): v for k, v in shared.value[t].in_models(held).items()}
        t, k = [t for t, _ in sums], [k for _, k in sums]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in (t, *([v[j] for v in k] for j in range(3)))] + [pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["t", "i", "r", "f", "v"])

    parts = rows.mapInArrow(run, SUMS)
    got = parts.groupBy("t", "i", "r", "f").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).collect()  # a row for each model
    return {(r["t"], (r["i"], r["r"], r["f"])): np.array(r["v"]) for r in got}


#: Counts of held rows by class and predicted class (task of types, p is null), or by class and share of class 1 (pred is null).
PREDICTED = ["t", "i", "r", "f", "y", "pred", "p", "n"]
PREDICTED_KINDS = [pa.int32()] * 6 + [pa.float64(), pa.int64()]


def _predicted(models: _Models, t: int, k: tuple, y: np.ndarray, p: np.ndarray, types: bool) -> pa.RecordBatch:
    if types:
        c = len(models.classes)
        both, n = np.unique(y * c + p.argmax(1), return_counts=True)
        y, pred, p = both // c, both % c, [None] * len(both)
    else:
        found = [np.unique(p[y == c, -1], return_counts=True) for c in (0, 1)]
        y, p, n = np.repeat([0, 1], [len(v) for v, _ in found]), *(np.concatenate([v[j] for v in found]) for j in (0, 1))
        pred = [None] * len(y)
    columns = [*([x] * len(y) for x in (t, *k)), y, pred, p, n]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, PREDICTED_KINDS, strict=True)], names=PREDICTED)


def simulatability(df: DataFrame, inputs: list[str], label: str, row_id: str, benign: str = "Benign", floor: str | None = None, steps: int = 25, seed: int = 0) -> DataFrame:
    """input, task, mean, std and passed (mean over the floor's mean + 2 std; floor: the input of the score only) over SPLITS x REPEATS stratified folds.

    inputs: columns with vectors of a fixed length. The tasks: macro-F1 of the attack type (types with at least SPLITS
    rows), and the ROC area of attacks against false alarms (label benign). Columns are standardised and classes
    balanced on each fold's training rows; the models have a ridge of 1. A task with less than two classes of SPLITS
    rows is null. Types are few; their names and counts come to the driver.
    """
    spark = df.sparkSession
    sizes = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}  # a row for each type
    types = sorted(t for t, n in sizes.items() if t != benign and n >= SPLITS)
    attacks = sum(n for t, n in sizes.items() if t != benign)
    jobs = []
    if len(types) > 1:
        jobs.append((TYPES, types, F.col(label).isin(types), F.col(label).cast("string")))
    if min(attacks, sizes.get(benign, 0)) >= SPLITS:
        jobs.append((ALARMS, ["0", "1"], F.col(label).isNotNull(), (F.col(label) != benign).cast("int").cast("string")))
    out = []
    if jobs:
        dims = [len(df.select(c).first()[0]) for c in inputs]
        base = df.where(F.col(label).isNotNull()).select(row_id, label, *[F.col(c).cast("array<double>").alias(f"x{i}") for i, c in enumerate(inputs)])
        rows = stratified_folds(base, label, row_id, "folds", seed).select("*", *[x for t, (_, _, who, y) in enumerate(jobs) for x in (who.alias(f"in{t}"), y.alias(f"y{t}"))])
        rows = written(dealt(rows, sum(sizes.values()), row_id, most=100_000), "folds")
        tasks = [_Models(inputs, dims, classes) for _, classes, _, _ in jobs]
        for (t, k), v in _pass(rows, tasks, "moments").items():
            tasks[t].take_moments(k, v)
        for _ in range(steps):
            if max(tasks[t].take_step(k, v) for (t, k), v in _pass(rows, tasks, "step").items()) < 1e-8:
                break
        shared, of_types = spark.sparkContext.broadcast(tasks), [task == TYPES for task, _, _, _ in jobs]

        def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for t, models in enumerate(shared.value):
                    y, folds, xs = models.rows(batch, t)
                    for k in models.keys if len(y) else ():
                        test = folds[:, k[1]] == k[2]
                        yield _predicted(models, t, k, y[test], models.shares(k, models.design(k, xs[k[0]][test])), of_types[t])

        found = written(rows.mapInArrow(predict, "t int, i int, r int, f int, y int, pred int, p double, n long"), "predicted")
        for t, (task, _, _, _) in enumerate(jobs):
            own, by = found.where(F.col("t") == t), ["i", "r", "f"]
            if task == TYPES:
                n = own.groupBy(*by, "y", "pred").agg(F.sum("n").alias("count"))
                side = lambda c: n.groupBy(*by, F.col(c).alias("c")).agg(F.sum("count").alias("n"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("count")).otherwise(0)).alias("hit"))  # noqa: B023, E731
                both = side("y").select(*by, "c", F.col("n").alias("a"), "hit").join(side("pred").select(*by, "c", F.col("n").alias("b")), [*by, "c"], "full_outer").na.fill(0)
                each = both.groupBy(*by).agg(F.avg(2 * F.col("hit") / (F.col("a") + F.col("b"))).alias("m"))
            else:
                each = roc_auc(own, "y", "p", by, "n").withColumnRenamed("roc_auc", "m")
            for r in each.groupBy("i").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std")).collect():  # a row for each input
                out.append((inputs[r["i"]], task, r["mean"], r["std"]))
    known = {(i, t): (m, s) for i, t, m, s in out}
    full = []
    for t in (TYPES, ALARMS):
        bar = known.get((floor, t))
        for i in inputs:
            m, s = known.get((i, t), (None, None))
            full.append((i, t, m, s, None if m is None or bar is None else bool(m > bar[0] + 2 * bar[1])))
    return spark.createDataFrame(full, "input string, task string, mean double, std double, passed boolean")
