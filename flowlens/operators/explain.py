"""Explanations of alerts as table jobs: attributions, their checks, evidence and reports.

A score is a function from a matrix to a vector (numpy), applied in Arrow batches to tables of perturbed rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.columns import correlation, jaccard
from flowlens.operators.detectors import matrix

Score = Callable[[np.ndarray], np.ndarray]


def scored(df: DataFrame, score: Score, x: str = "x", name: str = "score") -> DataFrame:
    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(score(matrix(v)), np.float64))

    return df.withColumn(name, run(x))


def native_attribution(df: DataFrame, names: list[str], weights: Column | None = None) -> DataFrame:
    """A row for each feature of a row's feat_err (squared error), scaled by weights (an array) if given: id, feature, value."""
    err = F.zip_with("feat_err", weights, lambda a, b: a * b) if weights is not None else F.col("feat_err")
    return df.select("id", F.posexplode(err).alias("i", "value")).select("id", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1).alias("feature"), "value")


def permutation_shapley(alerts: DataFrame, background: DataFrame, score: Score, d: int, rounds: int = 20, seed: int = 0) -> DataFrame:
    """alerts, background: id, x. Each round walks from a background row to the alert in a hashed order of features; the mean change at a feature is its value. Sums to score(alert) - mean score of the rows used."""
    refs = background.withColumn("_p", F.row_number().over(Window.orderBy("id")) - 1).select("_p", F.col("x").alias("_b"))  # a bounded background sample
    n = refs.count()
    walks = alerts.select("id", "x", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")).withColumn("_p", F.pmod(F.xxhash64("id", "round", F.lit(seed)), F.lit(n)).cast("int"))
    order = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.struct(F.xxhash64(F.col("id"), F.col("round"), i, F.lit(seed + 1)).alias("h"), i.alias("i")))), lambda s: s["i"])
    steps = walks.join(F.broadcast(refs), "_p").withColumn("_o", order).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    at = F.transform("x", lambda v, i: F.when(F.array_position("_o", i) <= F.col("step"), v.cast("double")).otherwise(F.get("_b", i).cast("double")))
    run = scored(steps.withColumn("_x", at), score, "_x", "s")
    change = F.col("s") - F.lag("s").over(Window.partitionBy("id", "round").orderBy("step"))
    return run.withColumn("value", change).where("step > 0").withColumn("feature", F.element_at("_o", F.col("step")).cast("int")).groupBy("id", "feature").agg(F.avg("value").alias("value"))


def group_shapley(alerts: DataFrame, background: DataFrame, score: Score, slices: dict[str, tuple[int, int]]) -> DataFrame:
    """Exact Shapley values of the groups of features: all coalitions, each averaged over the background, weighed by factorials. id, modality, value.

    background: a sample that the caller bounds; it travels to every task, where coalitions are mixed in Arrow batches.
    """
    names, g = list(slices), len(slices)
    owner = np.zeros(max(b for _, b in slices.values()), int)
    for k, (a, b) in enumerate(slices.values()):
        owner[a:b] = k
    held = alerts.sparkSession.sparkContext.broadcast(matrix(background.select("x").toPandas()["x"]))
    share = [[math.factorial(bin(m & ~(1 << k)).count("1")) * math.factorial(g - bin(m & ~(1 << k)).count("1") - 1) / math.factorial(g) * (1 if m >> k & 1 else -1) for k in range(g)] for m in range(1 << g)]
    part = max(1, 20_000 // max(1, len(held.value)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        back = held.value
        for pdf in batches:
            for lo in range(0, len(pdf), part):
                x, ids = matrix(pdf["x"].iloc[lo : lo + part]), pdf["id"].to_numpy()[lo : lo + part]
                value = np.zeros((len(x), g))
                for m in range(1 << g):
                    own = (m >> owner & 1).astype(bool)
                    mixed = np.where(own, x[:, None, :], back[None]).reshape(-1, x.shape[1])
                    value += np.asarray(score(mixed), np.float64).reshape(len(x), -1).mean(1)[:, None] * np.array(share[m])
                yield pd.DataFrame({"id": np.repeat(ids, g), "modality": names * len(x), "value": value.ravel()})

    return alerts.select(F.col("id").cast("long").alias("id"), "x").mapInPandas(run, "id long, modality string, value double")


def local_surrogate(alerts: DataFrame, background: DataFrame, score: Score, d: int, samples: int = 200, ridge: float = 1.0, seed: int = 0) -> DataFrame:
    """A weighted ridge regression of the score on which features were kept, around each alert: id, feature, value.

    An alert stays one row: its draws are hashed natively, then mixed with the background (a sample that the caller
    bounds, which travels to every task), scored and solved in Arrow batches. Alerts of one id share a regression.
    """
    refs = background.select("id", "x").orderBy("id").toPandas()
    held = alerts.sparkSession.sparkContext.broadcast(matrix(refs["x"]))
    n, key = len(refs), F.col("id")
    draw = F.sequence(F.lit(0), F.lit(samples - 1))
    place = F.transform(draw, lambda r: F.pmod(F.xxhash64(key, r, F.lit(seed)), F.lit(n)).cast("int"))
    kept = lambda i: F.transform(draw, lambda r: F.when(r == 0, 1).otherwise(F.pmod(F.xxhash64(key, r, F.lit(i), F.lit(seed + 1)), F.lit(2))).cast("int"))
    rows = alerts.groupBy("id").agg(F.flatten(F.collect_list(F.col("x").cast("array<double>"))).alias("x"))  # an id's few alerts
    rows = rows.select("id", "x", place.alias("p"), F.concat(*[kept(i) for i in range(d)]).alias("keep"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        back = held.value
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                part = pdf.iloc[lo : lo + 1000]
                ids, size = part["id"].to_numpy(), part["x"].map(len).to_numpy() // d
                x, of = np.concatenate(part["x"].to_list()).reshape(-1, d), np.repeat(np.arange(len(ids)), size)
                p, keep = np.stack(part["p"].to_list()), np.stack(part["keep"].to_list()).reshape(len(ids), d, samples).transpose(0, 2, 1)
                w = np.exp(-(((1 - keep.mean(2)) / 0.5) ** 2))
                a = np.concatenate([np.ones((*keep.shape[:2], 1)), keep], 2)
                aw = a * w[:, :, None]
                mixed = np.where(keep[of] == 1, x[:, None], back[p[of]])
                y = np.zeros(w.shape)
                np.add.at(y, of, np.asarray(score(mixed.reshape(-1, d)), np.float64).reshape(len(x), -1))
                m = (aw.transpose(0, 2, 1) @ a) * size[:, None, None] + ridge * np.diag([0.0] + [1.0] * d)
                c = np.linalg.solve(m, (aw * y[:, :, None]).sum(1)[:, :, None])[:, 1:, 0]
                yield pd.DataFrame({"id": np.repeat(ids, d), "feature": np.tile(np.arange(d, dtype=np.int32), len(ids)), "value": c.ravel()})

    return rows.mapInPandas(fit, "id long, feature int, value double")


def top_features(values: DataFrame, k: int) -> DataFrame:
    """id and top: the k features of largest absolute value, ties by name."""
    order = Window.partitionBy("id").orderBy(F.desc(F.abs("value")), "feature")
    best = values.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return best.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "feature"))), lambda s: s["feature"]).alias("top"))


def agreement(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Jaccard of the top k of two runs or methods, for each id."""
    return top_features(a, k).join(top_features(b, k).withColumnRenamed("top", "_t"), "id").select("id", jaccard("top", "_t").alias("agreement"))


def deletion(alerts: DataFrame, top: DataFrame, median: list[float], score: Score, k: int, seed: int = 0, controls: int = 5) -> DataFrame:
    """Share of the score that goes when the k top features become the background's median, and the mean of random sets: id, drop, random_drop (null where the score is under 0.5). top: id, top (places)."""
    d, med = len(median), F.array(*[F.lit(float(m)) for m in median])
    j = alerts.join(top, "id").withColumn("set", F.explode(F.sequence(F.lit(-1), F.lit(controls))))
    shuffled = F.transform(F.slice(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.struct(F.xxhash64(F.col("id"), F.col("set"), i, F.lit(seed)).alias("h"), i.alias("i")))), 1, k), lambda s: s["i"])
    gone = F.when(F.col("set") == -1, F.array().cast("array<int>")).when(F.col("set") == 0, F.slice("top", 1, k)).otherwise(shuffled)
    j = j.withColumn("_g", gone).withColumn("_x", F.transform(F.arrays_zip(F.col("x").alias("v"), med.alias("m"), F.sequence(F.lit(0), F.lit(d - 1)).alias("i")), lambda p: F.when(F.array_contains(F.col("_g"), p["i"]), p["m"]).otherwise(p["v"].cast("double"))))
    s = scored(j, score, "_x", "s").groupBy("id").agg(F.max(F.when(F.col("set") == -1, F.col("s"))).alias("s0"), F.max(F.when(F.col("set") == 0, F.col("s"))).alias("s1"), F.avg(F.when(F.col("set") > 0, F.col("s"))).alias("s2"))
    ok = F.abs("s0") >= 0.5
    return s.select("id", F.when(ok, (F.col("s0") - F.col("s1")) / F.abs("s0")).alias("drop"), F.when(ok, (F.col("s0") - F.col("s2")) / F.abs("s0")).alias("random_drop"))


def modality_share(values: DataFrame, modalities: DataFrame) -> DataFrame:
    """Share of each modality in the absolute values of an id. modalities: feature, modality."""
    of = modalities.groupBy("feature").agg(F.collect_list("modality").alias("_of"))
    whole = F.array(F.lit(None).cast("string"))  # every value counts once for no modality: that is the total
    long = values.join(F.broadcast(of), "feature", "left").select("id", F.abs("value").alias("_a"), F.explode(F.concat(whole, F.coalesce("_of", F.array().cast("array<string>")))).alias("modality"))
    part = long.groupBy("id", "modality").agg(F.sum("_a").alias("_v"))
    total = F.max(F.when(F.col("modality").isNull(), F.col("_v"))).over(Window.partitionBy("id"))  # a row for each modality
    return part.withColumn("_t", total).where("modality IS NOT NULL").select("id", "modality", (F.col("_v") / F.greatest("_t", F.lit(1e-12))).alias("share"))


def rank_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Spearman's correlation of absolute values, for each id; NaN where a side's values are all equal."""
    both = a.select("id", "feature", F.abs("value").alias("_a")).join(b.select("id", "feature", F.abs("value").alias("_b")), ["id", "feature"])

    def mean_rank(c: str) -> Column:
        w = Window.partitionBy("id").orderBy(c)
        return F.rank().over(w) + (F.count("*").over(Window.partitionBy("id", c)) - 1) / 2

    return both.withColumn("_ra", mean_rank("_a")).withColumn("_rb", mean_rank("_b")).groupBy("id").agg(correlation("_ra", "_rb").alias("spearman"))


def evidence(values: DataFrame, rows: DataFrame | None, baseline: DataFrame, top_again: DataFrame, k: int = 8) -> DataFrame:
    """The k features that push an id's score up most, with value, typical, p5, p95 and stable (also in the second run's top). rows: id, role, feature, raw; None: values have role and raw, so no join is needed. baseline: role (null: all), feature, typical, p5, p95."""
    order = Window.partitionBy("id").orderBy(F.desc("value"), "feature")
    best = values.where("value > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("value")
    own, whole = baseline.where("role IS NOT NULL").select("role", "feature", *[F.col(c).alias(f"r_{c}") for c in ("typical", "p5", "p95")]), baseline.where("role IS NULL").select("feature", "typical", "p5", "p95")
    own_rows = best if rows is None else best.select("id", "feature", "place").join(rows, ["id", "feature"])
    j = own_rows.join(F.broadcast(whole), "feature").join(F.broadcast(own), ["role", "feature"], "left").join(top_again, "id", "left")
    pick = lambda c: F.coalesce(f"r_{c}", c).alias(c)
    return j.select("id", "place", "feature", F.col("raw").alias("value"), pick("typical"), pick("p5"), pick("p95"), F.coalesce(F.array_contains("top", F.col("feature")), F.lit(False)).alias("stable"))


def hypotheses(found: DataFrame, groups: DataFrame) -> DataFrame:
    """id and the sorted hypotheses that its stable evidence supports. groups: feature, direction (high: above p95; low: under half of typical), hypothesis."""
    j = found.where("stable").join(F.broadcast(groups), "feature")
    hit = F.when(F.col("direction") == "high", F.col("value") > F.col("p95")).otherwise(F.col("value") < F.col("typical") * 0.5)
    return j.where(hit).groupBy("id").agg(F.array_sort(F.collect_set("hypothesis")).alias("hypotheses"))


def signature_meaning(df: DataFrame, name: str, category: str, rules: DataFrame) -> DataFrame:
    """df with the meaning of the first rule (order, keyword, meaning) whose keyword the signature's name or category has."""
    text = F.lower(F.concat_ws(" ", name, category))
    pairs = df.select(name, category).distinct().join(F.broadcast(rules), text.contains(F.lower("keyword")))  # some dozens of rules
    first = pairs.groupBy(name, category).agg(F.min_by("meaning", "order").alias("meaning"))
    return df.join(first, [name, category], "left").withColumn("meaning", F.coalesce("meaning", F.lit("a suspicious pattern: see the rule's description")))


def priority(severity: str, ratio: str, has_signature: str) -> Column:
    return F.when(F.col(has_signature) & (F.col(severity) <= 2), "HIGH").when(F.col(has_signature) | (F.col(ratio) >= 3), "MEDIUM").otherwise("LOW")


def confidence(n_stable: str) -> Column:
    return F.when(F.col(n_stable) >= 3, "high").when(F.col(n_stable) >= 1, "medium").otherwise("low")


def report(alerts: DataFrame, found: DataFrame, supported: DataFrame) -> DataFrame:
    """One row for each alert (id, score, threshold, severity, has_signature): verdict, priority, confidence, n_evidence, hypotheses and text."""
    lines = found.groupBy("id").agg(F.count("*").alias("n_evidence"), F.count_if("stable").alias("n_stable"), F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(" ", "feature", F.format_number("value", 2), F.lit("usually"), F.format_number("typical", 2)).alias("t")))), lambda s: s["t"]).alias("lines"))
    j = alerts.join(lines, "id", "left").join(supported, "id", "left").na.fill(0, ["n_evidence", "n_stable"]).withColumn("ratio", F.col("score") / F.col("threshold"))
    verdict = F.when(F.col("has_signature"), "confirmed").otherwise("anomaly_only")
    out = j.withColumns({"verdict": verdict, "priority": priority("severity", "ratio", "has_signature"), "confidence": confidence("n_stable")})
    text = F.concat_ws("\n", F.concat_ws(" ", "priority", "verdict"), F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n"), F.array_join(F.coalesce("hypotheses", F.array().cast("array<string>")), "; "))
    return out.select("id", "verdict", "priority", "confidence", "n_evidence", "n_stable", F.round("ratio", 6).alias("ratio"), "hypotheses", text.alias("text"))
