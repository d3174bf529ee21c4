"""Detectors: isolation forest, PCA, forest of labelled rows, encoder, and their scores.

fit functions return small model tables or arrays; score functions add a column. Vectors are arrays of doubles in a
column x, row ids decide every random choice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.columns import row_hash
from flowlens.operators.split import cap, cap_per_group
from flowlens.sources.scratch import scratch_path


def matrix(x: pd.Series) -> np.ndarray:
    """Arrays of one length as the rows of a matrix."""
    rows = x.to_list()
    if not rows:
        return np.zeros((0, 0))
    if len({len(v) for v in rows}) > 1:
        raise ValueError("arrays differ in length")
    return np.concatenate(rows).astype(np.float64).reshape(len(rows), -1)


# --- isolation forest -----------------------------------------------------------------------------------------------


def path_length(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def fit_isolation_forest(df: DataFrame, row_id: str, trees: int = 100, sample: int = 256, seed: int = 0) -> DataFrame:
    """One row for each node: tree, node, feature (-1: leaf), split, left, right, size, depth. Each tree takes `sample` rows by a hash and grows in its own task."""
    # Rows offer themselves to each tree by a hash; the offer is wide enough that a tree has its sample.
    n = df.count()
    rate = min(1.0, 4 * sample / max(n, 1))
    draw = lambda t: F.pmod(F.xxhash64(F.col(row_id), t, F.lit(seed)), F.lit(1_000_000)) / 1e6
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < rate)  # no row is copied to trees that don't draw it
    offered = df.select(F.col(row_id).alias("_id"), "x", F.explode(drawn).alias("tree"))
    ranked = offered.withColumn("_r", F.row_number().over(Window.partitionBy("tree").orderBy(F.xxhash64("_id", "tree", F.lit(seed)), "_id"))).where(F.col("_r") <= sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id")
        x, tree = matrix(pdf["x"]), int(pdf["tree"].iloc[0])
        rng, limit = np.random.default_rng([seed, tree]), math.ceil(math.log2(max(2, len(x))))
        rows: list[list] = []

        def node(ix: np.ndarray, depth: int) -> int:
            me = len(rows)
            rows.append([tree, me, -1, 0.0, -1, -1, len(ix), depth])
            part = x[ix]
            wide = np.flatnonzero(part.max(0) > part.min(0)) if len(ix) > 1 else []
            if depth < limit and len(wide):
                f = int(rng.choice(wide))
                s = float(rng.uniform(part[:, f].min(), part[:, f].max()))
                low = part[:, f] < s
                rows[me][2:6] = [f, s, node(ix[low], depth + 1), node(ix[~low], depth + 1)]
            return me

        node(np.arange(len(x)), 0)
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "split", "left", "right", "size", "depth"])

    return ranked.groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, split double, left int, right int, size long, depth int")


def score_isolation_forest(df: DataFrame, forest: DataFrame, sample: int = 256, name: str = "score") -> DataFrame:
    """2 ** (-mean depth / c(sample)): higher is more unusual. The forest, trees * 2 * sample nodes at most, goes to every task."""
    nodes = forest.orderBy("tree", "node").toPandas()
    shared = df.sparkSession.sparkContext.broadcast([g.drop(columns="tree").to_numpy() for _, g in nodes.groupby("tree")])
    norm = float(path_length(np.array([sample]))[0])

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in batches:
            x, total = matrix(xs), np.zeros(len(xs))
            for t in shared.value:
                at = descend(x, t[:, 1], lambda v, at, t=t: v < t[at, 2], t[:, 3], t[:, 4])
                total += t[at, 6] + path_length(t[at, 5])
            yield pd.Series(2.0 ** (-total / max(1, len(shared.value)) / norm))

    return df.withColumn(name, score("x"))


# --- PCA, random forest ---------------------------------------------------------------------------------------------


def fit_pca(df: DataFrame, d: int, variance: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the components that explain `variance`."""
    means = df.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)]).first()
    model = PCA(k=d, inputCol="v", outputCol="p").fit(df.select(array_to_vector(F.transform("x", lambda v: v.cast("double"))).alias("v")))
    share = np.cumsum(model.explainedVariance.toArray())
    k = int(min(np.searchsorted(share, variance) + 1, d))
    return np.array(list(means), np.float64), model.pc.toArray()[:, :k].T


def score_pca(df: DataFrame, mean: np.ndarray, parts: np.ndarray, name: str = "score") -> DataFrame:
    """Mean squared error of the projection to the components, as native array expressions."""
    centred = F.zip_with(F.col("x"), F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b)
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)
    dots = F.array(*[F.aggregate(F.zip_with(centred, F.array(*[F.lit(float(v)) for v in p]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for p in parts])
    return df.withColumn(name, F.greatest(F.lit(0.0), square(centred) - square(dots)) / len(mean))


def fit_random_forest(df: DataFrame, y: str, trees: int = 100, depth: int = 20, leaf: int = 2, seed: int = 0) -> list[np.ndarray]:
    """A class-balanced forest of Spark ML, as a table of nodes for each tree: feature (-1: leaf), threshold, left, right, share of class 1."""
    n = {r[y]: r["n"] for r in df.groupBy(y).agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    weight = F.when(F.col(y) == 1, total / (2 * max(1, n.get(1, 0)))).otherwise(total / (2 * max(1, n.get(0, 0))))
    data = df.select(array_to_vector(F.transform("x", lambda v: v.cast("double"))).alias("features"), F.col(y).cast("double").alias("label"), weight.alias("w"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, weightCol="w", seed=seed).fit(data)
    path = scratch_path(df.sparkSession, "forest")
    model.save(path)
    stats = F.col("nodeData.impurityStats")
    share = F.coalesce(F.get(stats, 1), F.lit(0.0)) / F.aggregate(stats, F.lit(0.0), lambda s, v: s + v)
    nodes = df.sparkSession.read.parquet(f"{path}/data").select("treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex", F.get("nodeData.split.leftCategoriesOrThreshold", 0).alias("threshold"), share.alias("share"))
    rows = nodes.orderBy("treeID", "id").toPandas()  # the model's nodes: at most trees * 2 ** (depth + 1)
    return [g.drop(columns=["treeID", "id"])[["featureIndex", "threshold", "leftChild", "rightChild", "share"]].to_numpy(np.float64) for _, g in rows.groupby("treeID")]


def descend(x: np.ndarray, feature: np.ndarray, goes_left, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The leaf of each row of x. goes_left(values, nodes)."""
    at = np.zeros(len(x), np.int64)
    while len(go := np.flatnonzero(feature[at] >= 0)):
        f = feature[at[go]].astype(np.int64)
        at[go] = np.where(goes_left(x[go, f], at[go]), left[at[go]], right[at[go]]).astype(np.int64)
    return at


def score_random_forest(df: DataFrame, forest: list[np.ndarray], name: str = "score") -> DataFrame:
    """Probability of class 1, the mean over the trees; its threshold is 0.5. The forest goes to every task."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in batches:
            x, total = matrix(xs), np.zeros(len(xs))
            for t in shared.value:
                total += t[descend(x, t[:, 0], lambda v, at, t=t: v <= t[at, 1], t[:, 2], t[:, 3]), 4]
            yield pd.Series(total / max(1, len(shared.value)))

    return df.withColumn(name, score("x"))


# --- encoder --------------------------------------------------------------------------------------------------------

Weights = dict[str, np.ndarray]


def gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = x * x
    t = np.tanh(0.7978845608 * (x + 0.044715 * square * x))
    half = 0.5 * (1 + t)
    return x * half, half + 0.5 * x * (1 - t * t) * 0.7978845608 * (1 + 0.134145 * square)


def init_encoder(slices: dict[str, tuple[int, int]], roles: int = 0, hidden: int = 32, code: int = 16, seed: int = 0) -> Weights:
    """Weights of: an MLP for each modality, a fusion layer (with a role embedding), a decoder."""
    rng = np.random.default_rng(seed)
    dense = lambda a, b: rng.normal(0, math.sqrt(2 / (a + b)), (a, b))
    w: Weights = {}
    for m, (a, b) in slices.items():
        w |= {f"{m}.w1": dense(b - a, hidden), f"{m}.b1": np.zeros(hidden), f"{m}.w2": dense(hidden, code), f"{m}.b2": np.zeros(code)}
    d = max(b for _, b in slices.values())
    w |= {"fuse.w": dense(code * len(slices), code), "fuse.b": np.zeros(code), "dec.w1": dense(code, hidden), "dec.b1": np.zeros(hidden), "dec.w2": dense(hidden, d), "dec.b2": np.zeros(d)}
    if roles:
        w["role"] = rng.normal(0, 0.1, (roles, code))
    return w


def forward(w: Weights, slices: dict[str, tuple[int, int]], x: np.ndarray, role: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """All layers' values; z.<modality> are the views' codes, z the fused one, out the reconstruction."""
    v: dict[str, np.ndarray] = {"x": x}
    for m, (a, b) in slices.items():
        v[f"{m}.h"], v[f"{m}.d"] = gelu(x[:, a:b] @ w[f"{m}.w1"] + w[f"{m}.b1"])
        v[f"z.{m}"] = v[f"{m}.h"] @ w[f"{m}.w2"] + w[f"{m}.b2"]
    v["cat"] = np.concatenate([v[f"z.{m}"] for m in slices], 1)
    v["z"] = v["cat"] @ w["fuse.w"] + w["fuse.b"]
    if "role" in w and role is not None:
        v["z"] = v["z"] + w["role"][role]
    v["dec.h"], v["dec.d"] = gelu(v["z"] @ w["dec.w1"] + w["dec.b1"])
    v["out"] = v["dec.h"] @ w["dec.w2"] + w["dec.b2"]
    return v


def info_nce(a: np.ndarray, b: np.ndarray, same: np.ndarray | None = None, temperature: float = 0.2) -> tuple[float, np.ndarray, np.ndarray]:
    """Cross-view contrastive loss of two code matrices and its gradients. same: pairs that are no negatives."""
    na, nb = np.linalg.norm(a, axis=1, keepdims=True) + 1e-8, np.linalg.norm(b, axis=1, keepdims=True) + 1e-8
    ua, ub, n = a / na, b / nb, len(a)
    e = (ua / temperature) @ ub.T
    e -= 1 / temperature  # at most 0, as cosines are at most 1
    np.exp(e, out=e)
    own = e.diagonal().copy()
    if same is not None:
        e[same] = 0
        np.fill_diagonal(e, own)
    r, c = 1 / np.maximum(e.sum(1, keepdims=True), 1e-300), 1 / np.maximum(e.sum(0)[:, None], 1e-300)
    loss = -float(np.log(np.maximum(own * r[:, 0], 1e-12)).mean() + np.log(np.maximum(own * c[:, 0], 1e-12)).mean()) / 2
    # The gradient of the cosines is (e / row sum + e / column sum) / 2n, less 1 / n on the diagonal; it is never held.
    width, scale = a.shape[1], 1 / (2 * n * temperature)
    by_row, by_col = e @ np.hstack([ub, c * ub]), e.T @ np.hstack([ua, r * ua])
    ga = scale * (r * by_row[:, :width] + by_row[:, width:] - 2 * ub)
    gb = scale * (c * by_col[:, :width] + by_col[:, width:] - 2 * ua)
    return loss, (ga - ua * (ga * ua).sum(1, keepdims=True)) / na, (gb - ub * (gb * ub).sum(1, keepdims=True)) / nb


def loss_and_gradient(w: Weights, slices: dict[str, tuple[int, int]], x: np.ndarray, masked: np.ndarray, role: np.ndarray | None = None, contrast: float = 0.0, sub: int = 256) -> tuple[float, Weights]:
    """Squared error of reconstructing x from `masked`, plus contrast times the mean InfoNCE over pairs of views on the first `sub` rows."""
    v, g = forward(w, slices, masked, role), {k: np.zeros_like(a) for k, a in w.items()}
    diff = v["out"] - x
    loss = float((diff**2).mean())
    d = 2 * diff / diff.size
    g["dec.w2"], g["dec.b2"] = v["dec.h"].T @ d, d.sum(0)
    d = (d @ w["dec.w2"].T) * v["dec.d"]
    g["dec.w1"], g["dec.b1"] = v["z"].T @ d, d.sum(0)
    dz = d @ w["dec.w1"].T
    if "role" in w and role is not None:
        np.add.at(g["role"], role, dz)
    g["fuse.w"], g["fuse.b"] = v["cat"].T @ dz, dz.sum(0)
    dcat, names = dz @ w["fuse.w"].T, list(slices)
    code = w["fuse.b"].shape[0]
    dv = {m: dcat[:, i * code : (i + 1) * code].copy() for i, m in enumerate(names)}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    if contrast and pairs and len(x) > 1:
        for a, b in pairs:
            same = np.zeros((min(sub, len(x)),) * 2, bool)
            for m in (a, b):
                equal = np.ones_like(same)
                for i in range(*slices[m]):
                    equal &= x[:sub, i, None] == x[None, :sub, i]
                same |= equal
            part, ga, gb = info_nce(v[f"z.{a}"][:sub], v[f"z.{b}"][:sub], same)
            loss += contrast * part / len(pairs)
            dv[a][:sub] += contrast * ga / len(pairs)
            dv[b][:sub] += contrast * gb / len(pairs)
    for m, (a, b) in slices.items():
        g[f"{m}.w2"], g[f"{m}.b2"] = v[f"{m}.h"].T @ dv[m], dv[m].sum(0)
        dh = (dv[m] @ w[f"{m}.w2"].T) * v[f"{m}.d"]
        g[f"{m}.w1"], g[f"{m}.b1"] = masked[:, a:b].T @ dh, dh.sum(0)
    return loss, g


def _masked(x: np.ndarray, slices: dict[str, tuple[int, int]], rng: np.random.Generator, share: float, drop: float) -> np.ndarray:
    out = np.where(rng.random(x.shape) < share, 0.0, x)
    for a, b in slices.values():
        out[rng.random(len(x)) < drop, a:b] = 0.0
    return out


def train_encoder(df: DataFrame, slices: dict[str, tuple[int, int]], row_id: str, roles: int = 0, epochs: int = 10, batch: int = 256, rate: float = 2e-3, decay: float = 1e-4, contrast: float = 0.1, share: float = 0.15, drop: float = 0.1, patience: int = 3, seed: int = 0) -> tuple[Weights, list[float]]:
    """Distributed local SGD: in each epoch every partition runs AdamW over its rows from the shared weights, and the driver averages what they return, weighted by rows.

    A tenth of the rows, chosen by a hash, is held for the loss under fixed masks, by which training stops. df: row_id,
    x and, with roles, role. Only weights pass through the driver.
    """
    spark = df.sparkSession
    data = df.select("x", (F.col("role") if roles else F.lit(0)).cast("int").alias("role"), (F.pmod(row_hash([row_id], seed), F.lit(10)) == 0).alias("held"), F.col(row_id).cast("long").alias("_id")).persist()
    w, history, best, stale = init_encoder(slices, roles, seed=seed), [], None, 0
    names = list(w)
    shapes = {k: w[k].shape for k in names}
    pack = lambda a: np.concatenate([a[k].ravel() for k in names])

    def unpack(v: np.ndarray) -> Weights:
        out, at = {}, 0
        for k in names:
            n = int(np.prod(shapes[k]))
            out[k] = v[at : at + n].reshape(shapes[k])
            at += n
        return out

    held_rows = data.where("held").orderBy("_id").select("x", "role").persist()  # ordered once, not in each epoch
    try:
        for epoch in range(epochs):
            shared = spark.sparkContext.broadcast(pack(w))

            def local(batches: Iterator[pd.DataFrame], shared=shared, epoch=epoch) -> Iterator[pd.DataFrame]:
                flat = shared.value.copy()
                own = unpack(flat)  # views of the flat weights, which are updated in place
                first, second = np.zeros_like(flat), np.zeros_like(flat)
                step = rows = 0
                for pdf in batches:
                    ids = pdf["_id"].to_numpy()
                    place = np.argsort(ids, kind="stable")
                    x, role = matrix(pdf["x"])[place], pdf["role"].to_numpy()[place]
                    rng = np.random.default_rng([seed, epoch, int(ids[place[0]]) & 0xFFFFFFFF])
                    order = rng.permutation(len(x))
                    for lo in range(0, len(x), batch):
                        ix = order[lo : lo + batch]
                        _, g = loss_and_gradient(own, slices, x[ix], _masked(x[ix], slices, rng, share, drop), role[ix] if roles else None, contrast)
                        change = pack(g)
                        change *= min(1.0, 5.0 / (math.sqrt(float(change @ change)) + 1e-12))
                        step += 1
                        rows += len(ix)
                        first = 0.9 * first + 0.1 * change
                        second = 0.999 * second + 0.001 * change * change
                        flat *= 1 - rate * decay
                        flat -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
                if rows:
                    yield pd.DataFrame({"n": [rows], "w": [flat.tolist()]})

            parts = data.where("NOT held").select("_id", "x", "role").mapInPandas(local, "n long, w array<double>")
            # The weighted sum is an aggregate by place, so only one set of weights returns.
            summed = parts.select("n", F.posexplode("w").alias("i", "v")).groupBy("i").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v")).orderBy("i").collect()
            if not summed:
                break
            w = unpack(np.array([r["v"] for r in summed]))
            now = spark.sparkContext.broadcast(pack(w))

            def judge(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
                own = unpack(now.value)
                for pdf in batches:
                    x, role = matrix(pdf["x"]), pdf["role"].to_numpy()
                    rng = np.random.default_rng([seed, 77])
                    v = forward(own, slices, _masked(x, slices, rng, share, drop), role if roles else None)
                    yield pd.DataFrame({"n": [x.size], "s": [float(((v["out"] - x) ** 2).sum())]})

            held = held_rows.mapInPandas(judge, "n long, s double").agg(F.sum("s"), F.sum("n")).first()
            history.append(float(held[0] / held[1]) if held[1] else 0.0)
            if best is None or history[-1] < best[0] - 1e-6:
                best, stale = (history[-1], {k: a.copy() for k, a in w.items()}), 0
            else:
                stale += 1
                if stale >= patience:
                    break
    finally:
        held_rows.unpersist()
        data.unpersist()
    return (best[1] if best else w), history


def encode(df: DataFrame, w: Weights, slices: dict[str, tuple[int, int]], roles: bool = False) -> DataFrame:
    """df with z (code), rec (mean squared error), xmod (mean 1 - cosine over pairs of views) and feat_err (squared error of each feature)."""
    shared = df.sparkSession.sparkContext.broadcast(w)

    @F.pandas_udf("z array<double>, rec double, xmod double, feat_err array<double>")
    def run(xs: pd.Series, role: pd.Series) -> pd.DataFrame:
        x = matrix(xs)
        v = forward(shared.value, slices, x, role.to_numpy().astype(np.int64) if roles else None)
        err = (v["out"] - x) ** 2
        names = list(slices)
        unit = {m: v[f"z.{m}"] / (np.linalg.norm(v[f"z.{m}"], axis=1, keepdims=True) + 1e-8) for m in names}
        pairs = [1 - (unit[a] * unit[b]).sum(1) for i, a in enumerate(names) for b in names[i + 1 :]]
        return pd.DataFrame({"z": list(v["z"]), "rec": err.mean(1), "xmod": np.mean(pairs, 0) if pairs else np.zeros(len(x)), "feat_err": list(err)})

    out = df.withColumn("_m", run("x", (F.col("role") if roles else F.lit(0)).cast("int")))
    return out.select(*df.columns, "_m.z", "_m.rec", "_m.xmod", "_m.feat_err")


def reconstruction_errors(df: DataFrame, models: list[tuple[Weights, dict[str, tuple[int, int]], list[int], bool]], name: str = "rec") -> DataFrame:
    """df with an array: the mean squared error of each model (weights, slices, places of x, whether roles are used), all in one pass over x."""
    shared = df.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("array<double>")
    def run(xs: pd.Series, role: pd.Series) -> pd.Series:
        whole, roles = matrix(xs), role.to_numpy().astype(np.int64)
        errors = np.empty((len(whole), len(shared.value)))
        for i, (w, slices, places, uses) in enumerate(shared.value):
            x = whole[:, places]
            errors[:, i] = ((forward(w, slices, x, roles if uses else None)["out"] - x) ** 2).mean(1)
        return pd.Series(list(errors))

    return df.withColumn(name, run("x", F.coalesce(F.col("role"), F.lit(0)).cast("int") if any(m[3] for m in models) else F.lit(0)))


#: Method specs: modalities (None: all), whether roles are used, and the weight of the contrastive term.
METHODS = {
    "autoencoder": {"modalities": None, "roles": False, "contrast": 0.0},
    "multi_view": {"modalities": None, "roles": False, "contrast": 0.1},
    "multi_view_roles": {"modalities": None, "roles": True, "contrast": 0.1},
    "no_contrast": {"modalities": None, "roles": True, "contrast": 0.0},
}


def expert_specs(modalities: list[str]) -> dict[str, dict]:
    """A method for each modality alone."""
    return {f"only_{m}": {"modalities": [m], "roles": False, "contrast": 0.0} for m in modalities}


def synthetic_anomalies(df: DataFrame, slices: dict[str, tuple[int, int]], modality: str, row_id: str, limit: float = 8.0, seed: int = 0) -> DataFrame:
    """Two copies of each row, with kind: `swap` has one modality of another row (its neighbour in hash order within hash blocks), `extreme` has 15 % of its places at the clip."""
    a, b = slices[modality]
    order = Window.partitionBy(F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(64))).orderBy(F.xxhash64(row_id, F.lit(seed + 1)), row_id)
    other = F.coalesce(F.lead("x").over(order), F.col("x"))
    swap = df.withColumn("x", F.concat(F.slice("x", 1, a), F.slice(other, a + 1, b - a), F.slice("x", b + 1, 10_000))).withColumn("kind", F.lit("swap"))

    def put(v, i):
        h = F.pmod(F.xxhash64(F.col(row_id), i, F.lit(seed)), F.lit(200))
        return F.when(h < 15, F.lit(limit)).when(h < 30, F.lit(-limit)).otherwise(v.cast("double"))

    return swap.unionByName(df.withColumn("x", F.transform("x", put)).withColumn("kind", F.lit("extreme")))


def fit_references(df: DataFrame, role: str, row_id: str, n: int = 10_000, n_role: int = 5_000, min_ref: int = 500, seed: int = 0, digits: int | None = None) -> DataFrame:
    """A bounded sample of benign codes: role null for the global one, else of roles with min_ref rows. digits: only distinct codes rounded so."""
    base = df.select(F.col(row_id).alias("id"), F.col("x"), F.col(role).alias("role"))
    if digits is not None:
        base = base.withColumn("x", F.transform("x", lambda v: F.round(v.cast("double"), digits))).groupBy("role", "x").agg(F.min("id").alias("id")).select("id", "x", "role")
    whole = cap(base, n, "id", seed).withColumn("role", F.lit(None).cast("int"))
    sized = base.join(F.broadcast(base.groupBy("role").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_ref)), "role").drop("_n")
    each = cap_per_group(sized, "role", n_role, "id", seed)
    return whole.unionByName(each.select("id", "x", F.col("role").cast("int").alias("role")))


def latent_distance(df: DataFrame, refs: DataFrame, role: str, row_id: str, k: int = 5) -> DataFrame:
    """row_id and score: mean distance to the k nearest references of the row's role, or of the global sample where the role has none."""
    from flowlens.operators.joins import nearest

    known = [r["role"] for r in refs.where("role IS NOT NULL").select("role").distinct().collect()]
    rows = df.select(F.col(row_id).alias("id"), "x", F.when(F.col(role).isin(known), F.col(role)).otherwise(-1).cast("int").alias("_role")) if known else df.select(F.col(row_id).alias("id"), "x", F.lit(-1).alias("_role"))
    near = nearest(rows, refs.withColumn("_role", F.coalesce("role", F.lit(-1)).cast("int")).drop("role"), k, "_role")
    return near.groupBy("id").agg(F.avg("distance").alias("score")).withColumnRenamed("id", row_id)


def nearest_sums(x: np.ndarray, m: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean Euclidean distance of each row of x to its k nearest rows of m (ties: the smaller id), and the mean squared difference of each place.

    The k-th least of the least values of blocks of references bounds the k-th distance, so only few are looked at.
    """
    n, wide = len(m), max(1, int(np.sqrt(len(m))))
    k = min(k, n)
    room = -n % wide
    norm = np.concatenate([(m**2).sum(1), np.full(room, np.inf)])
    table = np.vstack([m, np.zeros((room, m.shape[1]))]).T
    mean, errors = np.full(len(x), np.nan), np.zeros((len(x), m.shape[1]))
    for lo in range(0, len(x), 256):
        part = x[lo : lo + 256]
        d = norm[None] - 2 * part @ table
        least = d.reshape(len(part), -1, wide).min(2)
        bound = np.partition(least, k - 1, 1)[:, k - 1] if least.shape[1] >= k else np.full(len(part), np.inf)
        own = (part**2).sum(1)
        row, ref = np.nonzero(d <= (bound + 1e-9 * (np.abs(bound) + own + 1))[:, None])
        row, ref = row[ref < n], ref[ref < n]
        square = (part[row] - m[ref]) ** 2
        dist = np.sqrt(square.sum(1))
        order = np.lexsort((ids[ref], dist, row))
        first = np.searchsorted(row, np.arange(len(part)))  # row is sorted, with and without the order
        keep = order[(first[:, None] + np.arange(k)).ravel()]
        mean[lo : lo + 256] = dist[keep].reshape(-1, k).mean(1)
        errors[lo : lo + 256] = square[keep].reshape(len(part), k, -1).mean(1)
    return mean, errors


def knn_scores(df: DataFrame, refs: DataFrame, role: str, row_id: str, k: int = 5, limit: float | None = None) -> DataFrame:
    """row_id, role, distance and errors: latent_distance() in one pass without a shuffle. df: row_id, x, role, and maybe feat_err.

    errors (rows with a distance over limit; null for others and without a limit): feat_err, or the mean squared
    difference of each place to the neighbours. Rows with a null or not finite place have a null distance. refs: the
    bounded sample of fit_references(), which travels to every task.
    """
    pdf = refs.withColumn("_role", F.coalesce("role", F.lit(-1)).cast("int")).select("_role", F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x")).orderBy("id").toPandas()
    held = df.sparkSession.sparkContext.broadcast({r: (g["id"].to_numpy(), np.stack(g["x"].to_list())) for r, g in pdf.groupby("_role")})
    own = "feat_err" in df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = held.value
        for pdf in batches:
            which = np.where(pdf["known"].isin(list(sets)), pdf["known"], -1)
            distance, errors = np.full(len(pdf), np.nan), np.full(len(pdf), None, object)
            for r in np.unique(which):
                if r not in sets:
                    continue
                at = np.flatnonzero(which == r)
                x = np.array([np.asarray(v, np.float64) for v in pdf["x"].to_numpy()[at]])
                sound = np.isfinite(x).all(1)
                at, x = at[sound], x[sound]
                distance[at], e = nearest_sums(x, sets[r][1], sets[r][0], k)
                if limit is not None:
                    for i in np.flatnonzero(distance[at] > limit):
                        errors[at[i]] = np.asarray(pdf["feat_err"].iloc[at[i]], np.float64) if own else e[i]
            yield pd.DataFrame({row_id: pdf[row_id], "role": pdf["known"], "distance": distance, "errors": errors})

    key = dict(df.select(row_id).dtypes)[row_id]
    rows = df.select(row_id, F.col("x").cast("array<double>").alias("x"), F.coalesce(F.col(role), F.lit(-1)).cast("int").alias("known"), *(["feat_err"] if own else []))
    out = rows.mapInPandas(run, f"`{row_id}` {key}, role int, distance double, errors array<double>")
    return out.withColumn("distance", F.when(~F.isnan("distance"), F.col("distance"))).withColumn("role", F.nullif("role", F.lit(-1)))
