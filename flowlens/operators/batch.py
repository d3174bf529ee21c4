"""Batch scoring, method runs and label-free choices, composed of the other operators."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.columns import role_from_port, role_override, row_hash
from flowlens.operators import audit, clean, detectors, features, metrics, scoring
from flowlens.operators.events import with_flow
from flowlens.operators.quantiles import quantiles
from flowlens.sources.scratch import written


@dataclass
class Model:
    """A fitted nearest-neighbour detector: feature space, references in it, calibration; with an encoder, weights and slices, in whose codes the distances are taken."""

    space: list
    refs: DataFrame
    med: float
    scale: float
    threshold: float
    k: int = 5
    weights: detectors.Weights | None = None
    slices: dict[str, tuple[int, int]] | None = None


def pseudo_time(df: DataFrame, row_id: str, seed: int = 0) -> DataFrame:
    """df with ts: a random order's place in (0, 1) for data without timestamps, from a hash of the id."""
    return df.withColumn("ts", F.pmod(row_hash([row_id], seed), F.lit(1 << 40)) / float(1 << 40))


def _coded(df: DataFrame, space: list, row_id: str, weights: detectors.Weights | None, slices: dict | None) -> DataFrame:
    """row_id, x and role: standardised features, or their codes (then with the reconstruction's error of each feature)."""
    x = features.apply_space(df, space)
    if weights is None:
        return x.select(row_id, "x", "role")
    return detectors.encode(x.select(row_id, "x", "role"), weights, slices).select(row_id, F.col("z").alias("x"), "role", "feat_err")


def fit_model(df: DataFrame, val: DataFrame, modalities: dict[str, list[str]], role: str, row_id: str, fpr: float = 0.01, encoder: dict | None = None, min_ref: int = 500, k: int = 5, n_refs: int = 10_000, n_role: int = 5_000) -> Model:
    """Everything is fitted on benign rows: df for space, encoder and references, val for calibration. encoder: options of detectors.train_encoder(); None: distances are taken in the feature space, and the model is the same for any partitions."""
    space = features.fit_space(df, modalities).orderBy("pos").collect()  # a row for each feature
    cut, w = features.slices(space), None
    if encoder is not None:
        w, _ = detectors.train_encoder(features.apply_space(df, space), cut, row_id, **encoder)
    z = lambda d: _coded(d.withColumn("role", F.col(role)), space, row_id, w, cut)
    refs = written(detectors.fit_references(z(df), "role", row_id, n_refs, n_role, min_ref), "references")
    scores = written(detectors.knn_scores(z(val), refs, "role", row_id, k), "calibration")
    stats = features.robust_stats(scores, F.col("distance"), []).first()
    limit = quantiles(scores.select(((F.col("distance") - stats["med"]) / stats["scale"]).alias("z")), "z", {"limit": 1 - fpr}, []).first()["limit"]
    return Model(space, refs, stats["med"], stats["scale"], limit, k, w, cut)


def score_batch(df: DataFrame, m: Model, row_id: str, duration: str | None, protocol: str, port: str, given_role: str | None = None, top_k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(scored, rejected): row_id, score, alert, role and the top features of alerts (top_k 0: none); or row_id and reason. A bad row never fails the batch.

    One pass checks, scales, encodes and scores the rows and is written once; both results read that table. A feature
    is on top if it adds most to the squared distances to the neighbours, or with an encoder by its reconstruction.
    """
    names = [r["name"] for r in m.space]
    checked = df.withColumn("_reason", clean.rejection(df, names, duration, protocol, port, given_role))
    sound = clean.numeric(checked.where("_reason IS NULL"), list(dict.fromkeys([*names, port])))
    role = role_from_port(port)
    sound = sound.withColumn("role", role_override(given_role, role) if given_role else role)
    near = detectors.knn_scores(_coded(sound, m.space, row_id, m.weights, m.slices), m.refs, "role", row_id, m.k, m.med + m.scale * m.threshold if top_k else None)
    z = (F.col("distance") - m.med) / m.scale
    finite = z.isNotNull() & ~F.isnan(z) & (F.abs(z) != float("inf"))
    items = F.transform(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("errors").alias("error")), lambda p: F.struct((-p["error"]).alias("o"), p["feature"].alias("feature"), p["error"].alias("error")))
    top = F.transform(F.slice(F.array_sort(items), 1, max(1, top_k)), lambda p: F.struct(p["feature"].alias("feature"), p["error"].alias("error")))
    good = near.select(row_id, z.alias("score"), (z > m.threshold).alias("alert"), "role", F.when(finite & (z > m.threshold), top).alias("top_features"), F.when(~finite, "score is not finite").alias("reason"))
    both = written(good.unionByName(checked.where("_reason IS NOT NULL").select(row_id, F.col("_reason").alias("reason")), allowMissingColumns=True), "scored")
    return both.where("reason IS NULL").select(row_id, "score", "alert", "role", *(["top_features"] if top_k else [])), both.where("reason IS NOT NULL").select(row_id, "reason")


def run_methods(df: DataFrame, test: DataFrame, slices: dict[str, tuple[int, int]], row_id: str, seeds: list[int], specs: dict[str, dict] | None = None, **options) -> DataFrame:
    """Long scores (method, seed, row_id, score): reconstruction errors of each spec and seed on test. df, test: row_id, x, role."""
    models, names = [], []
    for name, spec in (specs or detectors.METHODS).items():
        keep = spec["modalities"] or list(slices)
        places = [i for m in keep for i in range(*slices[m])]
        cut, at = {}, 0
        for m in keep:
            cut[m] = (at, at + slices[m][1] - slices[m][0])
            at = cut[m][1]
        part = lambda d, places=places: d.withColumn("x", F.transform(F.array(*[F.lit(i) for i in places]), lambda i: F.get("x", i)))
        for seed in seeds:
            w, _ = detectors.train_encoder(part(df), cut, row_id, 9 if spec["roles"] else 0, contrast=spec["contrast"], seed=seed, **options)
            models.append((w, cut, places, spec["roles"]))
            names.append(F.struct(F.lit(name).alias("method"), F.lit(seed).alias("seed")))
    # All models score a row in one pass over test.
    rows = detectors.reconstruction_errors(test.select(row_id, "x", "role"), models, "_rec")
    return rows.select(row_id, F.explode(F.arrays_zip(F.array(*names).alias("of"), F.col("_rec").alias("score"))).alias("_m")).select("_m.of.method", "_m.of.seed", row_id, "_m.score")


def late_fusion(parts: list[DataFrame], val: list[DataFrame], row_id: str) -> DataFrame:
    """row_id and the largest robust z over the modalities' scores; val: benign scores of the same modalities."""
    out = None
    for i, (p, v) in enumerate(zip(parts, val, strict=True)):
        s = features.robust_stats(v, F.col("score"), []).first()
        z = p.select(row_id, ((F.col("score") - s["med"]) / s["scale"]).alias(f"z{i}"))
        out = z if out is None else out.join(z, row_id)
    return out.select(row_id, F.greatest(*[f"z{i}" for i in range(len(parts))]).alias("score") if len(parts) > 1 else F.col("z0").alias("score"))


def select_without_labels(candidates: dict[str, DataFrame]) -> DataFrame:
    """name and the mean AUC of benign rows against each kind of synthetic anomalies. candidates: score, kind (benign or another)."""
    out = None
    for name, df in candidates.items():
        kinds = [r["kind"] for r in df.where("kind <> 'benign'").select("kind").distinct().collect()]
        aucs = [metrics.roc_auc(df.where(F.col("kind").isin("benign", k)).withColumn("_y", (F.col("kind") == k).cast("int")), "_y", "score") for k in kinds]
        both = aucs[0]
        for a in aucs[1:]:
            both = both.unionByName(a)
        row = both.agg(F.avg("roc_auc").alias("auc")).withColumn("name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def lofo(df: DataFrame, family: str, families: list[str], row_id: str, y: str = "y", trees: int = 20) -> DataFrame:
    """Leave one family of attacks out: roc_auc of a forest on that family and benign rows, trained with it (seen) and without (unseen), on a held third."""
    held = F.pmod(row_hash([row_id]), F.lit(3)) == 0
    out = None
    for f in families:
        for seen in (True, False):
            train = df.where(~held) if seen else df.where(~held & (F.col(family).isNull() | (F.col(family) != f)))
            test = df.where(held & ((F.col(y) == 0) | (F.col(family) == f)))
            auc = metrics.roc_auc(detectors.score_random_forest(test, detectors.fit_random_forest(train, y, trees, 8)), y, "score")
            row = auc.select(F.lit(f).alias("family"), F.lit(seen).alias("seen"), "roc_auc")
            out = row if out is None else out.unionByName(row)
    return out


def fit_linear(df: DataFrame, label: str) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (classes x features) and intercepts of a logistic regression on x, penalised on standardised features. With two classes the first's are 0."""
    data = df.select(array_to_vector(F.transform("x", lambda v: v.cast("double"))).alias("features"), F.col(label).cast("double").alias("label"))
    model = LogisticRegression(maxIter=50, regParam=0.01).fit(data)
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    return (np.vstack([np.zeros_like(w), w]), np.append(0.0, b)) if len(w) == 1 else (w, b)


def linear_class(w: np.ndarray, b: np.ndarray) -> Column:
    """The class of the highest linear score of x."""
    scores = [F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in row]), lambda p, q: p * q), F.lit(float(i)), lambda s, v: s + v) for row, i in zip(w, b, strict=True)]
    return F.array_position(F.array(*scores), F.greatest(*scores, F.lit(-float("inf")))) - 1


def simulatability(df: DataFrame, label: str, row_id: str, folds: int = 5) -> DataFrame:
    """Accuracy of telling label (0, 1, ...) from attributions x by logistic regression, by hashed folds."""
    placed = df.withColumn("_f", F.pmod(row_hash([row_id]), F.lit(folds)))
    out = None
    for k in range(folds):
        guess = linear_class(*fit_linear(placed.where(F.col("_f") != k), label))
        got = placed.where(F.col("_f") == k).agg(F.avg((guess == F.col(label)).cast("double")).alias("accuracy"), F.count("*").alias("n")).withColumn("fold", F.lit(k))
        out = got if out is None else out.unionByName(got)
    return out


def linear_probe(df: DataFrame, label: str, row_id: str) -> DataFrame:
    """Mean accuracy of simulatability()."""
    return simulatability(df, label, row_id).agg(F.avg("accuracy").alias("accuracy"))


def linear_cka(a: DataFrame, b: DataFrame, row_id: str) -> DataFrame:
    """Likeness of two representations (row_id, x) of the same rows, from sums over pairs of places of centred values."""
    both = a.select(row_id, F.col("x").alias("u")).join(b.select(row_id, F.col("x").alias("v")), row_id)
    ab, aa, bb = (audit.gram(both, x, y).agg(F.sum(F.col("c") * F.col("c")).alias(n)) for n, x, y in (("ab", "u", "v"), ("aa", "u", "u"), ("bb", "v", "v")))
    return ab.crossJoin(aa).crossJoin(bb).select((F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("cka"))  # one row each


def batch_duplicates(df: DataFrame, slices: dict[str, tuple[int, int]], row_id: str, batch: int = 256, seed: int = 0) -> DataFrame:
    """Share of rows whose block of a modality another row of its hashed batch has too: modality, share."""
    n = max(1, df.count() // batch)
    placed = df.withColumn("_b", F.pmod(row_hash([row_id], seed), F.lit(n)))
    blocks = F.array(*[F.struct(F.lit(m).alias("modality"), F.slice("x", a + 1, b - a).alias("block")) for m, (a, b) in slices.items()])
    long = placed.select("_b", F.explode(blocks).alias("p")).select("_b", "p.modality", F.to_json("p.block").alias("block")).groupBy("_b", "modality", "block").agg(F.count("*").alias("n"))
    return long.groupBy("modality").agg((F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))


def replaced(alerts: DataFrame, near: DataFrame, refs: DataFrame, order: DataFrame, most: int = 10) -> DataFrame:
    """Alerts with their k first features (of order: id, top) taken from the nearest benign row, for k = 0 .. most: id, k, x."""
    j = alerts.join(near.select("id", "ref_id"), "id").join(refs.select(F.col("id").alias("ref_id"), F.col("x").alias("_r")), "ref_id").join(order, "id")
    j = j.withColumn("k", F.explode(F.sequence(F.lit(0), F.least(F.lit(most), F.size("top")))))
    x = F.transform(F.arrays_zip(F.col("x").alias("v"), F.col("_r").alias("r"), F.sequence(F.lit(0), F.size("x") - 1).alias("i")), lambda p: F.when(F.array_contains(F.slice("top", 1, F.col("k")), p["i"]), p["r"]).otherwise(p["v"]).cast("double"))
    return j.select("id", "k", x.alias("x"))


def aopc(scored: DataFrame) -> DataFrame:
    """Mean drop of the score over k = 1 .. and the least k that takes it under the threshold (counterfactual size). scored: id, k, score, threshold."""
    first = Window.partitionBy("id")
    s0 = F.max(F.when(F.col("k") == 0, F.col("score"))).over(first)
    d = scored.withColumn("_d", s0 - F.col("score"))
    return d.groupBy("id").agg(F.avg(F.when(F.col("k") > 0, F.col("_d"))).alias("aopc"), F.min(F.when(F.col("score") <= F.col("threshold"), F.col("k"))).alias("counterfactual_size"))


def shuffled_weights(w: detectors.Weights, seed: int = 0) -> detectors.Weights:
    """The weights of a randomised model: each array drawn again with its own spread."""
    rng = np.random.default_rng(seed)
    return {k: rng.normal(0, float(a.std()) + 1e-6, a.shape) for k, a in w.items()}


def flow_context(alerts: DataFrame, assembled: DataFrame, sensor: DataFrame | None = None, seq: str = "seq", most: int = 3) -> DataFrame:
    """Alerts with the endpoints and signatures of their flow, joined on the flow's id and place; with sensor (the parsed events) also http and dns (the first `most` hosts with urls, and names, of the flow) and sni (its last)."""
    own = assembled.select("flow_id", "flow_seq", "flow_key", "src_ip", "dst_ip", "event_types", "signatures")
    out = alerts.join(own, ["flow_id", "flow_seq"], "left")
    if sensor is None:
        return out
    named = F.when(F.col("event_type") == "http", F.when(F.col("http.hostname").isNotNull() & F.col("http.url").isNotNull(), F.concat_ws("/", "http.hostname", "http.url"))).when(F.col("event_type") == "dns", F.nullif("dns.rrname", F.lit(""))).when(F.col("event_type") == "tls", F.col("tls.sni"))
    seen = with_flow(sensor, seq).where(F.col("event_type").isin("http", "dns", "tls") & F.col("flow_seq").isNotNull()).select("flow_id", "flow_seq", "event_type", F.col(seq).alias("_seq"), named.alias("_name")).where("_name IS NOT NULL")
    order = Window.partitionBy("flow_id", "flow_seq", "event_type")
    late = F.row_number().over(order.orderBy(F.desc("_seq")))
    first = seen.withColumn("_r", F.row_number().over(order.orderBy("_seq"))).where(F.col("_r") <= most)
    last = seen.where("event_type = 'tls'").withColumn("_r", late).where("_r = 1")
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, F.struct("_r", "_name")))), lambda x: x["_name"]).alias(kind)  # noqa: E731  at most `most`
    lists = first.where("event_type <> 'tls'").groupBy("flow_id", "flow_seq").agg(listed("http"), listed("dns"))
    out = out.join(lists, ["flow_id", "flow_seq"], "left").join(last.select("flow_id", "flow_seq", F.col("_name").alias("sni")), ["flow_id", "flow_seq"], "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"http": F.coalesce("http", none), "dns": F.coalesce("dns", none)})
