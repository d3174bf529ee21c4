"""Scores: calibration, tails, fusion, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.features import robust_stats
from flowlens.operators.quantiles import prefix_sum, quantiles
from flowlens.sources.scratch import written

EPS = 1e-8
#: Distinct scores of a group that count as few.
FEW = 5_000


def calibrator(df: DataFrame, component: str, role: str, min_n: int = 500, floor: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Robust statistics of ln(component): over all rows, and of each role with min_n rows (its scale at least floor times the global one)."""
    # Values are counted once by role; the counts serve the roles and, without them, the whole.
    counted = df.select(F.col(role).alias("_role"), F.log(F.col(component) + EPS).alias("_v")).where("_v IS NOT NULL").groupBy("_role", "_v").agg(F.count("*").alias("_c"))
    rows = counted.where("_role IS NOT NULL").withColumn("_all", F.lit(False)).unionByName(counted.withColumns({"_all": F.lit(True), "_role": F.lit(None).cast(counted.schema["_role"].dataType)}))
    rows, keys = written(rows, "counted"), ["_all", "_role"]
    med = quantiles(rows, "_v", {"_med": 0.5}, keys, "_c").drop("n").withColumnsRenamed({k: f"{k}_of" for k in keys})  # a row for each role
    off = rows.join(F.broadcast(med), F.col("_all").eqNullSafe(F.col("_all_of")) & F.col("_role").eqNullSafe(F.col("_role_of"))).withColumn("_d", F.abs(F.col("_v") - F.col("_med")))
    size = rows.groupBy(*keys).agg(F.sum("_c").alias("n"))
    dev = quantiles(off, "_d", {"_s": 0.5}, keys, "_c").drop("n")
    found = med.join(dev, F.col("_all").eqNullSafe(F.col("_all_of")) & F.col("_role").eqNullSafe(F.col("_role_of"))).drop("_all_of", "_role_of").join(size.withColumnsRenamed({k: f"{k}_of" for k in keys}), F.col("_all").eqNullSafe(F.col("_all_of")) & F.col("_role").eqNullSafe(F.col("_role_of")))
    stats = written(found.select("_all", F.col("_role").alias(role), F.col("_med").alias("med"), (F.col("_s") * 1.4826 + 1e-6).alias("scale"), "n"), "calibrator")
    whole = stats.where("_all").select(F.col("med").alias("g_med"), F.col("scale").alias("g_scale"))
    each = stats.where(~F.col("_all") & (F.col("n") >= min_n)).crossJoin(F.broadcast(whole))
    return whole, each.select(role, "med", F.greatest("scale", F.col("g_scale") * floor).alias("scale"))


def calibrated(df: DataFrame, component: str, role: str, whole: DataFrame, each: DataFrame, name: str = "z") -> DataFrame:
    """df with the robust z-score of ln(component) under its role's statistics, else the global ones."""
    out = df.crossJoin(F.broadcast(whole)).join(F.broadcast(each), role, "left")  # one row; one row for each role
    z = (F.log(F.col(component) + EPS) - F.coalesce("med", "g_med")) / F.coalesce("scale", "g_scale")
    return out.withColumn(name, z).drop("med", "scale", "g_med", "g_scale")


def rank_in(df: DataFrame, score: str, ref: DataFrame, ref_score: str, groups: list[str] | None = None) -> DataFrame:
    """df with at_most (reference scores <= the row's) and n (reference scores), by groups.

    Both sides are reduced to distinct scores before the running count, which no task takes over a whole group. Null
    scores are not counted, and rows with one (or with a null group) get nulls. With groups, rows of those with few
    distinct scores, many rows each, are told apart from the others: their small table is left to Spark to broadcast.
    """
    groups = groups or []
    own = df.select(*groups, F.col(score).cast("double").alias("_s"), F.lit(0).cast("long").alias("_c"))
    other = ref.select(*groups, F.col(ref_score).cast("double").alias("_s"), F.lit(1).cast("long").alias("_c"))
    steps = own.unionByName(other).where("_s IS NOT NULL").groupBy(*groups, "_s").agg(F.sum("_c").alias("_c"))
    ranks = lambda s: prefix_sum(s, groups, "_s", "_c", "at_most", total="n").drop("_c")
    rows = df.withColumn("_s", F.col(score).cast("double"))
    if not groups:
        return rows.join(ranks(steps), "_s", "left").drop("_s")
    steps = written(steps, "steps")
    few = written(steps.groupBy(*groups).agg(F.count("*").alias("_d")).where(F.col("_d") <= FEW).drop("_d"), "groups")
    small = written(ranks(steps.join(few, groups, "left_semi")), "ranks")
    large = ranks(steps.join(few, groups, "left_anti"))
    apart = rows.join(few, groups, "left_semi").join(small, [*groups, "_s"], "left")
    return apart.unionByName(rows.join(few, groups, "left_anti").join(large, [*groups, "_s"], "left")).drop("_s")


def tail(at_most: str | Column = "at_most", n: str | Column = "n") -> Column:
    """-ln of the share of reference scores above, smoothed by one."""
    a, m = (F.col(x) if isinstance(x, str) else x for x in (at_most, n))
    return -F.log((m - a + 1) / (m + 1))


def tail_score(df: DataFrame, score: str, ref: DataFrame, ref_score: str, name: str, groups: list[str] | None = None) -> DataFrame:
    return rank_in(df, score, ref, ref_score, groups).withColumn(name, tail()).drop("at_most", "n")


def extended_tail(df: DataFrame, score: str, ref: DataFrame, ref_score: str, name: str, q: float = 0.99) -> DataFrame:
    """tail_score() up to the reference score at place floor(q * n); above it an exponential tail with the mean excess (1 if 0)."""
    steps = ref.groupBy(F.col(ref_score).alias("_r")).agg(F.count("*").alias("_c"))
    placed = prefix_sum(steps, [], "_r", "_c", "_upto", total="_m").withColumn("_k", F.floor(F.col("_m") * q))
    # Of each distinct score, how many rows are at place _k or later.
    late = placed.withColumn("_late", F.least("_c", F.col("_upto") - F.col("_k"))).where("_late > 0")
    limit = late.agg(F.min("_r").alias("_u"), (F.sum(F.col("_r") * F.col("_late")) / F.sum("_late")).alias("_mean"), F.max("_k").alias("_k"), F.max("_m").alias("_m"))
    scaled = limit.withColumn("_scale", F.when(F.col("_mean") > F.col("_u"), F.col("_mean") - F.col("_u")).otherwise(1.0))
    out = tail_score(df, score, ref, ref_score, name).crossJoin(F.broadcast(scaled))  # one row
    above = -F.log((F.col("_m") - F.col("_k")) / (F.col("_m") + 1)) + (F.col(score) - F.col("_u")) / F.col("_scale")
    return out.withColumn(name, F.when(F.col(score) > F.col("_u"), above).otherwise(F.col(name))).drop("_u", "_mean", "_k", "_m", "_scale")


def fuse_long(scores: DataFrame, key: list[str], members: int | None = None, how: str = "max") -> DataFrame:
    """One fused score for each key from a long table (key, method, score): min-p keeps the largest tail score. members: rows with fewer are left out."""
    out = scores.groupBy(*key).agg((F.max("score") if how == "max" else F.avg("score")).alias("score"), F.count("*").alias("_n"))
    return (out.where(F.col("_n") == members) if members else out).drop("_n")


def threshold(df: DataFrame, score: str, fpr: float, keys: list[str] | None = None) -> DataFrame:
    """The (1 - fpr) quantile, interpolated, of the benign validation scores."""
    return quantiles(df, score, {"threshold": 1 - fpr}, keys or []).drop("n")


def robust_threshold(df: DataFrame, value: str, fpr: float) -> DataFrame:
    """One row: med, scale, and threshold, the (1 - fpr) quantile of the robust z, which rises with the value: so the median and that quantile come from one count."""
    q = quantiles(df, value, {"med": 0.5, "high": 1 - fpr}, []).drop("n")
    off = df.select(F.col(value).cast("double").alias("_v")).crossJoin(F.broadcast(q)).select(F.abs(F.col("_v") - F.col("med")).alias("_d"))  # one row
    dev = quantiles(off, "_d", {"_s": 0.5}, []).select((F.col("_s") * 1.4826 + 1e-6).alias("scale"))
    return q.crossJoin(F.broadcast(dev)).select("med", "scale", ((F.col("high") - F.col("med")) / F.col("scale")).alias("threshold"))


def adapt_by_day(df: DataFrame, day: str, time: str, score: str, window: int, fpr: float) -> DataFrame:
    """Rows after each day's first `window` seconds, with adapted (robust z under these seconds) and threshold (their quantile)."""
    first = df.groupBy(day).agg(F.min(time).alias("_t0"))
    flagged = df.join(F.broadcast(first), day).withColumn("_ref", F.col(time) < F.col("_t0") + window)  # a row for each day
    ref = flagged.where("_ref")
    stats = robust_stats(ref, F.col(score), [day]).select(day, "med", "scale")
    z = (F.col(score) - F.col("med")) / F.col("scale")
    limits = quantiles(ref.join(F.broadcast(stats), day).withColumn("_z", z), "_z", {"threshold": 1 - fpr}, [day]).drop("n")
    return flagged.where("NOT _ref").join(F.broadcast(stats), day).withColumn("adapted", z).join(F.broadcast(limits), day).drop("_t0", "_ref", "med", "scale")


def hybrid_or(score: str, signature: str) -> Column:
    """A signature hit lifts the score above every threshold."""
    return F.col(score) + F.lit(1e6) * F.col(signature)


def tail_ensemble(long: DataFrame, ref: DataFrame, knn: str) -> DataFrame:
    """Tail ensemble of (seed, row_id, method, score): by seed the tail of max(tail(knn), tail(max of the experts' tails)), then the mean over seeds. Each level is referenced to its own scores on ref."""
    seeded = ["seed", "method"]
    all_rows = long.withColumn("_is_ref", F.lit(False)).unionByName(ref.withColumn("_is_ref", F.lit(True)))
    t = tail_score(all_rows, "score", ref, "score", "t", seeded)
    levels = t.groupBy("seed", "_is_ref", "row_id").agg(F.max(F.when(F.col("method") == knn, F.col("t"))).alias("knn"), F.max(F.when(F.col("method") != knn, F.col("t"))).alias("experts"))
    levels = written(levels, "levels")  # each level is read as rows and as its own reference
    levels = written(tail_score(levels, "experts", levels.where("_is_ref"), "experts", "te", ["seed"]).withColumn("both", F.greatest("knn", "te")), "levels")
    final = tail_score(levels, "both", levels.where("_is_ref"), "both", "score", ["seed"])
    return final.where("NOT _is_ref").groupBy("row_id").agg(F.avg("score").alias("score"))


def alert_rate(df: DataFrame, score: str, limit: Column) -> DataFrame:
    return df.agg(F.avg((F.col(score) > limit).cast("double")).alias("alert_rate"), F.count("*").alias("n"))


def recalibrate(df: DataFrame, score: str, fpr: float, min_n: int = 2000) -> DataFrame:
    """Median, scale and threshold of at least min_n assumed-benign scores; no row with fewer."""
    stats = robust_stats(df, F.col(score), [])
    z = df.crossJoin(F.broadcast(stats)).select(((F.col(score) - F.col("med")) / F.col("scale")).alias("_z"))
    return stats.crossJoin(quantiles(z, "_z", {"threshold": 1 - fpr}, []).drop("n")).where(F.col("n") >= min_n)  # one row each


def pick_best(df: DataFrame, value: str, default: str, margin: float) -> DataFrame:
    """The candidate with the highest value if it beats the default by more than margin, else the default. df: name, value."""
    best = df.agg(F.max_by("name", F.struct(value, F.col("name"))).alias("best"), F.max(value).alias("top"), F.max(F.when(F.col("name") == default, F.col(value))).alias("base"))
    return best.select(F.when(F.col("top") > F.col("base") + margin, F.col("best")).otherwise(default).alias("chosen"), "top", "base")
