"""Diagnostics of vectors: effective rank, what one set of columns tells of another, and scales of distances.

Sums of products come from one pass, added up in the tasks: what leaves a task, and what reaches the driver, grows with
the square of the number of columns only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.columns import row_hash, squared_distance
from flowlens.operators import joins, split
from flowlens.operators.audit import gram
from flowlens.operators.quantiles import quantiles


def effective_rank(df: DataFrame, x: str) -> DataFrame:
    """One row: effective_rank (e to the entropy of the centred matrix's singular values, as shares) and dim. Null without rows, 0 if all rows are equal."""
    rows = gram(df, x, x).collect()  # dim ** 2 sums
    spark, schema = df.sparkSession, "effective_rank double, dim int"
    if not rows:
        return spark.createDataFrame([(None, None)], schema)
    dim = max(r["i"] for r in rows) + 1
    c = np.zeros((dim, dim))
    for r in rows:
        c[r["i"], r["j"]] = r["c"]
    s = np.sqrt(np.clip(np.linalg.eigvalsh((c + c.T) / 2), 0, None))
    p = s / s.sum() if s.sum() else s
    return spark.createDataFrame([(float(np.exp(-(p * np.log(p + 1e-12)).sum())) if s.sum() else 0.0, dim)], schema)


def _moments(df: DataFrame, z: str, y: str, half: Column) -> tuple[np.ndarray, int]:
    """For each half (0, 1) the sums of products of (1, z, y), and the length of z."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        wide = 0
        for pdf in batches:
            for h, g in pdf.groupby("half"):
                a, b = (np.stack([np.asarray(v, np.float64) for v in g[c]]) for c in ("z", "y"))
                u, wide = np.hstack([np.ones((len(a), 1)), a, b]), a.shape[1]
                sums[int(h)] = sums.get(int(h), 0) + u.T @ u
        for h, m in sums.items():
            i, j = np.indices(m.shape)
            yield pd.DataFrame({"half": h, "i": i.ravel(), "j": j.ravel(), "wide": wide, "s": m.ravel()})

    sums = df.select(half.alias("half"), F.col(z).alias("z"), F.col(y).alias("y")).where("z IS NOT NULL AND y IS NOT NULL").mapInPandas(run, "half int, i int, j int, wide int, s double")
    rows = sums.groupBy("half", "i", "j").agg(F.sum("s").alias("s"), F.max("wide").alias("wide")).collect()  # two squares of the number of columns
    if not rows:
        return np.zeros((2, 1, 1)), 0
    n = max(r["i"] for r in rows) + 1
    out = np.zeros((2, n, n))
    for r in rows:
        out[r["half"], r["i"], r["j"]] = r["s"]
    return out, rows[0]["wide"]


def ridge_from_moments(m: np.ndarray, wide: int, alpha: float = 1.0) -> float | None:
    """R2 on half 1 of a ridge regression with intercept fitted on half 0, over the columns of y that vary there."""
    n = m[:, 0, 0]
    if min(n) < 1:
        return None
    z, y = slice(1, 1 + wide), slice(1 + wide, None)
    mean = m[:, 0] / n[:, None]
    centred = m[0] - n[0] * np.outer(mean[0], mean[0])
    w = np.linalg.solve(centred[z, z] + alpha * np.eye(wide), centred[z, y])
    b = mean[0, y] - mean[0, z] @ w
    t = np.vstack([b[None], w, -np.eye(len(b))])  # residuals are (1, z, y) @ t
    res = np.einsum("ij,ik,kj->j", t, m[1], t)
    tot = np.diag(m[1])[y] - n[1] * mean[1, y] ** 2 + 1e-9
    keep = tot > 1e-6
    return float(1 - res[keep].sum() / tot[keep].sum()) if keep.any() else None


def ridge_r2(df: DataFrame, z: str, y: str, row_id: str, seed: int = 0, alpha: float = 1.0) -> float | None:
    """How well the vectors z tell the vectors y: ridge fitted on the rows with an even hash, R2 on the others. One pass."""
    return ridge_from_moments(*_moments(df, z, y, (row_hash([row_id], seed) % 2).cast("int")), alpha)


def retained_information(df: DataFrame, views: dict[str, tuple[str, str]], row_id: str, seed: int = 0) -> DataFrame:
    """views: for each modality the columns of its code and of its values (vectors). A row for each pair (code, values): r2, and own: whether both are of one modality."""
    rows = [(a, b, ridge_r2(df, views[a][0], views[b][1], row_id, seed), a == b) for a in views for b in views]
    return df.sparkSession.createDataFrame(rows, "code string, target string, r2 double, own boolean")


def distance_scales(rows: DataFrame, refs: DataFrame, moved: str | None = None, k: int = 5, most_refs: int = 10_000, most_rows: int = 20_000, pairs: int = 5_000) -> DataFrame:
    """One row: the median distance to the k nearest references over that of random pairs, its 99th percentile over its median, and (moved: the vectors of slightly changed rows) the median shift over it.

    rows, refs: id, x. The measure is of samples with documented sizes, drawn by a hash of the id.
    """
    some, known = split.cap(rows, most_rows, "id", 1), split.cap(refs, most_refs, "id", 2)
    near = joins.nearest(some, known, k).groupBy("id").agg(F.avg("distance").alias("d"))
    q = quantiles(near, "d", {"near": 0.5, "far": 0.99}, []).drop("n")
    order = lambda seed, name: split.cap(some, pairs, "id", seed).select(F.row_number().over(Window.orderBy(row_hash(["id"], seed), "id")).alias("place"), F.col("x").alias(name))  # noqa: E731  at most `pairs` rows
    both = order(3, "a").join(order(4, "b"), "place").select(F.sqrt(squared_distance("a", "b")).alias("d"))
    out = q.crossJoin(F.broadcast(quantiles(both, "d", {"pair": 0.5}, []).drop("n")))  # one row each
    columns = [(F.col("near") / F.col("pair")).alias("near_over_pair"), (F.col("far") / F.col("near")).alias("far_over_near")]
    if moved:
        shift = quantiles(some.select(F.sqrt(squared_distance("x", moved)).alias("d")), "d", {"shift": 0.5}, []).drop("n")
        out, columns = out.crossJoin(F.broadcast(shift)), [*columns, (F.col("shift") / F.col("near")).alias("shift_over_near")]
    return out.select(*columns)
