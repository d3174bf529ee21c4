"""Error analysis of decisions: what is missed and why, false alarms by factor, seeds that disagree, features that deviate.

Decisions are a long table: row_id, method, seed, label, y (attack), flagged, and p (the share of benign validation
scores above the row's).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators import detectors, split
from flowlens.operators.quantiles import quantiles
from flowlens.sources.scratch import written

#: The bins of a flow's packets.
SIZE_BINS = [(2, "1-2"), (5, "3-5"), (20, "6-20"), (100, "21-100")]


def size_bin(packets: str | Column) -> Column:
    c = F.col(packets) if isinstance(packets, str) else packets
    out = F.when(c <= 0, None)
    for most, name in SIZE_BINS:
        out = out.when(c <= most, name)
    return out.when(c.isNotNull(), ">100")


def same_as_benign(df: DataFrame, label: str, columns: list[str], within: list[str] | None = None, digits: int = 4, benign: str = "Benign") -> DataFrame:
    """label, n and identical: of each attack label the rows whose columns, rounded, are those of a benign row (with equal `within`: its day). A null equals a null."""
    key = [F.round(F.col(c).cast("double"), digits).alias(f"_k{i}") for i, c in enumerate(columns)]
    rows = df.select(label, *[F.col(c).alias(f"_w{i}") for i, c in enumerate(within or [])], *key)
    names = [c for c in rows.columns if c != label]
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in names])
    keyed = rows.select(label, F.sha2(text.cast("binary"), 256).alias("_key"))
    counts = keyed.where(F.col(label) != benign).groupBy(label, "_key").agg(F.count("*").alias("_n"))
    known = keyed.where(F.col(label) == benign).select("_key").distinct().withColumn("_b", F.lit(1))
    return counts.join(known, "_key", "left").groupBy(label).agg(F.sum("_n").alias("n"), F.coalesce(F.sum(F.when(F.col("_b") == 1, F.col("_n"))), F.lit(0)).alias("identical"))


def with_identical(rows: DataFrame, benign: DataFrame, columns: list[str]) -> DataFrame:
    """rows with identical: whether a benign row has the same columns; a null equals nothing. The benign rows' distinct values are written, so Spark knows whether they are few enough to travel to the rows."""
    known = written(benign.select(*columns).distinct(), "benign").withColumn("_same", F.lit(True))
    return rows.join(known, columns, "left").withColumn("identical", F.coalesce("_same", F.lit(False))).drop("_same")


def benign_flags(rows: DataFrame, benign: DataFrame, role: str, row_id: str, near: float = 0.1, n: int = 50_000, seed: int = 0) -> DataFrame:
    """row_id, identical (x and role are those of a benign row) and near (identical, or an attack within `near` of the closest of n benign rows, a sample by hash). rows: row_id, x, role, y; benign: row_id, x, role."""
    known = benign.select(F.to_json(F.struct("x", F.col(role).alias("r"))).alias("_k")).distinct().withColumn("_same", F.lit(True))
    same = rows.withColumn("_k", F.to_json(F.struct("x", F.col(role).alias("r")))).join(known, "_k", "left").select(row_id, F.coalesce("_same", F.lit(False)).alias("identical"))
    refs = split.cap(benign.select(F.col(row_id).alias("id"), "x"), n, "id", seed).withColumn("role", F.lit(None).cast("int"))
    close = detectors.knn_scores(rows.where("y = 1").select(row_id, "x", F.lit(-1).alias("role")), refs, "role", row_id, 1).select(row_id, (F.col("distance") < near).alias("_near"))
    return same.join(close, row_id, "left").select(row_id, "identical", (F.col("identical") | F.coalesce("_near", F.lit(False))).alias("near"))


def per_attack(decisions: DataFrame) -> DataFrame:
    """method, seed, label: flows, recall, misses, the shares of the misses that are identical to and near benign rows (null without misses), and of all flows that are near. decisions with identical and, for the last two, near."""
    miss = ~F.col("flagged")
    close = [F.avg(F.when(miss, F.col("near").cast("double"))).alias("misses_near"), F.avg(F.col("near").cast("double")).alias("near_share")] if "near" in decisions.columns else []
    return decisions.where("y = 1").groupBy("method", "seed", "label").agg(
        F.count("*").alias("flows"), F.avg(F.col("flagged").cast("double")).alias("recall"), F.count_if(miss).alias("misses"), F.avg(F.when(miss, F.col("identical").cast("double"))).alias("misses_identical"), *close,
    )


def misses_by_factor(decisions: DataFrame, factors: list[str]) -> DataFrame:
    """method, seed, factor, level: attack flows, miss_rate and the three most frequent attack types."""
    rows = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("string").alias("level")) for c in factors])
    long = decisions.where("y = 1").select("method", "seed", "label", "flagged", F.explode(rows).alias("x")).select("method", "seed", "label", "flagged", "x.*")
    n = long.groupBy("method", "seed", "factor", "level", "label").agg(F.count("*").alias("_n"), F.count_if(~F.col("flagged")).alias("_m"))
    keys = ["method", "seed", "factor", "level"]
    ranked = n.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), "label")))  # a row for each label
    types = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= 3, F.struct("_r", "label")))), lambda x: x["label"]), ", ")
    return ranked.groupBy(*keys).agg(F.sum("_n").alias("attack_flows"), (F.sum("_m") / F.sum("_n")).alias("miss_rate"), types.alias("attack_types"))


def alarms_by_factor(decisions: DataFrame, factors: list[str], top: int = 15) -> DataFrame:
    """method, seed, factor, level: benign flows, false alarms, their rate and share of all; of each factor the `top` levels with most false alarms."""
    rows = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("string").alias("level")) for c in factors])
    long = decisions.where("y = 0").select("method", "seed", "flagged", F.explode(rows).alias("x")).select("method", "seed", "flagged", "x.*")
    n = long.groupBy("method", "seed", "factor", "level").agg(F.count("*").alias("benign_flows"), F.count_if("flagged").alias("false_alarms"))
    group = Window.partitionBy("method", "seed", "factor")
    total = n.groupBy("method", "seed", "factor").agg(F.greatest(F.sum("false_alarms"), F.lit(1)).alias("_all"))
    first = n.withColumn("_r", F.row_number().over(group.orderBy(F.desc("false_alarms"), "level"))).where(F.col("_r") <= top).drop("_r")
    return first.join(total, ["method", "seed", "factor"]).select("method", "seed", "factor", "level", "benign_flows", "false_alarms", (F.col("false_alarms") / F.col("benign_flows")).alias("rate"), (F.col("false_alarms") / F.col("_all")).alias("share"))


def complementarity(decisions: DataFrame) -> DataFrame:
    """label, method: flows, the shares caught by any, by all and by none of the detectors (the same in all rows of a label) and only by this one. Detectors are the method and seed pairs of decisions, each with every row."""
    k = decisions.select("method", "seed").distinct().count()  # some detectors
    rows = decisions.where("y = 1").groupBy("row_id", "label").agg(F.count_if("flagged").alias("_c"), F.max(F.when(F.col("flagged"), F.concat_ws("/", "method", F.col("seed").cast("string")))).alias("_one"))
    counts = written(rows.groupBy("label", "_c", "_one").agg(F.count("*").alias("_n")), "caught")  # rows are grouped once
    share = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0)) / F.sum("_n")
    whole = counts.groupBy("label").agg(F.sum("_n").alias("flows"), share(F.col("_c") > 0).alias("any"), share(F.col("_c") == k).alias("all"), share(F.col("_c") == 0).alias("none"))
    only = counts.where("_c = 1").groupBy("label", F.col("_one").alias("detector")).agg(F.sum("_n").alias("_o"))
    names = decisions.select(F.concat_ws("/", "method", F.col("seed").cast("string")).alias("detector")).distinct()
    grid = whole.crossJoin(F.broadcast(names))  # labels and detectors
    return grid.join(only, ["label", "detector"], "left").select("label", "detector", "flows", "any", "all", "none", (F.coalesce("_o", F.lit(0)) / F.col("flows")).alias("only"))


def seed_flips(decisions: DataFrame, with_p: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """method, label: flows, flip_share (rows that some seeds flag and others don't) and the median p of these rows over all seeds. with_p: adds p to the rows that need it, if decisions have none."""
    whole = written(decisions.groupBy("method", "row_id", "label").agg((F.max("flagged") & ~F.min("flagged")).alias("flip")), "flips")
    share = whole.groupBy("method", "label").agg(F.count("*").alias("flows"), F.avg(F.col("flip").cast("double")).alias("flip_share"))
    p = decisions.select("method", "seed", "row_id", "label", *(["score"] if with_p else ["p"])).join(whole.where("flip").select("method", "row_id", "label"), ["method", "row_id", "label"])
    p = with_p(written(p, "flipped")) if with_p else p
    median = quantiles(p, "p", {"median_p": 0.5}, ["method", "label"]).drop("n")
    return share.join(median, ["method", "label"], "left")


def near_misses(decisions: DataFrame, with_p: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """method, seed, label: misses, the shares with p up to 0.05 and over 0.5, and their median p. with_p: adds p to the rows that need it, if decisions have none."""
    keys = ["method", "seed", "label"]
    missed = decisions.where("y = 1 AND NOT flagged")
    if with_p:  # each score is ranked once
        counted = missed.groupBy(*keys, "score").agg(F.count("*").alias("_n"))
        missed = written(with_p(written(counted, "missed")), "missed")
        share = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0)) / F.sum("_n")
        stats = missed.groupBy(*keys).agg(F.sum("_n").alias("misses"), share(F.col("p") <= 0.05).alias("p_low"), share(F.col("p") > 0.5).alias("p_high"))
        return stats.join(quantiles(missed, "p", {"median_p": 0.5}, keys, "_n").drop("n"), keys)
    stats = missed.groupBy(*keys).agg(F.count("*").alias("misses"), F.avg((F.col("p") <= 0.05).cast("double")).alias("p_low"), F.avg((F.col("p") > 0.5).cast("double")).alias("p_high"))
    return stats.join(quantiles(missed, "p", {"median_p": 0.5}, keys).drop("n"), keys)


def capture_end(decisions: DataFrame, at_end: str) -> DataFrame:
    """method, seed: false alarms, the share of them on flows that the end of the capture closed, and the rates on these and on other benign flows."""
    end, hit = F.col(at_end), F.col("flagged").cast("double")
    return decisions.where("y = 0").groupBy("method", "seed").agg(F.count_if("flagged").alias("false_alarms"), F.avg(F.when(F.col("flagged"), end.cast("double"))).alias("end_share"), F.avg(F.when(end, hit)).alias("rate_end"), F.avg(F.when(~end, hit)).alias("rate_other"))


def deviations(decisions: DataFrame, features: list[str]) -> DataFrame:
    """feature: the median absolute value in hits (tp), misses (fn), false alarms (fp) and the rest (tn), and fp - tn and fn - tp. decisions of one detector, with the standardised features."""
    group = F.when(F.col("y") == 1, F.when(F.col("flagged"), "tp").otherwise("fn")).otherwise(F.when(F.col("flagged"), "fp").otherwise("tn"))
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(F.col(c).cast("double")).alias("v")) for c in features])
    long = decisions.select(group.alias("g"), F.explode(pairs).alias("x")).select("g", "x.*")
    med = written(quantiles(long, "v", {"m": 0.5}, ["feature", "g"]).drop("n"), "medians")
    out = med.groupBy("feature").agg(*[F.max(F.when(F.col("g") == g, F.col("m"))).alias(g) for g in ("tp", "fn", "fp", "tn")])
    return out.withColumns({"fp_minus_tn": F.col("fp") - F.col("tn"), "fn_minus_tp": F.col("fn") - F.col("tp")})
