"""Metrics of scores against labels, incidents and alert groups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.quantiles import prefix_sum, quantiles


def confusion(df: DataFrame, y: str, flagged: Column, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn and the rates made of them; empty denominators count as 1 (F1: 1e-12, MCC: 0)."""
    pos = F.col(y) == 1
    counts = [F.count_if(flagged & pos).alias("tp"), F.count_if(flagged & ~pos).alias("fp"), F.count_if(~flagged & pos).alias("fn"), F.count_if(~flagged & ~pos).alias("tn")]
    c = df.groupBy(*keys).agg(*counts) if keys else df.agg(*counts)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    c = c.withColumns({"precision": tp / F.greatest(tp + fp, F.lit(1.0)), "recall": tp / F.greatest(tp + fn, F.lit(1.0)), "fpr": fp / F.greatest(fp + tn, F.lit(1.0)), "accuracy": (tp + tn) / n, "attack_rate": (tp + fn) / n})
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12))
    return c.withColumns({"f1": f1, "mcc": F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(0.0)})


def by_score(df: DataFrame, y: str, score: str, keys: list[str], weight: str | None = None) -> DataFrame:
    """Positives and negatives at each distinct score."""
    w = F.col(weight) if weight else F.lit(1)
    return df.groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("_p"), F.sum(F.when(F.col(y) == 1, 0).otherwise(w)).alias("_q"))


def roc_auc(df: DataFrame, y: str, score: str, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve; tied scores count half. Null where a class is missing."""
    keys = keys or []
    below = prefix_sum(by_score(df, y, score, keys, weight), keys, "_s", "_q", "_below")
    total = F.sum("_p") * F.sum("_q")
    area = F.sum(F.col("_p") * (F.col("_below") - F.col("_q") * 0.5)) / F.when(total > 0, total)
    return below.groupBy(*keys).agg(area.alias("roc_auc")) if keys else below.agg(area.alias("roc_auc"))


def average_precision(df: DataFrame, y: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """Area under the precision-recall curve, as a sum over distinct thresholds."""
    keys = keys or []
    steps = by_score(df, y, score, keys).withColumn("_a", F.col("_p") + F.col("_q"))
    steps = prefix_sum(steps, keys, "_s", "_p", "_tp", True, more={"_all": "_a"})
    area = F.sum(F.col("_p") * F.col("_tp") / F.col("_all")) / F.when(F.sum("_p") > 0, F.sum("_p"))
    return steps.groupBy(*keys).agg(area.alias("pr_auc")) if keys else steps.agg(area.alias("pr_auc"))


def folded(auc: str | Column) -> Column:
    a = F.col(auc) if isinstance(auc, str) else auc
    return F.greatest(a, 1 - a)


def auc_per_type(df: DataFrame, y: str, label: str, score: str) -> DataFrame:
    """roc_auc of each attack type against all benign rows, from counts by score."""
    attacks = df.where(F.col(y) == 1).groupBy(F.col(label).alias("attack"), F.col(score).alias("_s")).agg(F.count("*").alias("_p"))
    benign = df.where(F.col(y) != 1).groupBy(F.col(score).alias("_s")).agg(F.count("*").alias("_q"))
    below = prefix_sum(df.select(F.col(score).alias("_s")).distinct().join(benign, "_s", "left").na.fill({"_q": 0}), [], "_s", "_q", "_below")
    total = benign.agg(F.sum("_q").alias("_n"))
    area = F.sum(F.col("_p") * (F.col("_below") - F.col("_q") * 0.5)) / (F.sum("_p") * F.max("_n"))
    return attacks.join(below, "_s").crossJoin(F.broadcast(total)).groupBy("attack").agg(area.alias("roc_auc"))


def incidents(df: DataFrame, day: str, label: str, time: str, flagged: str, gap: float) -> DataFrame:
    """Attack rows (df) of a day and label, split where they pause for more than gap. The window runs over one row for each time."""
    times = df.groupBy(day, label, F.col(time).alias("_t")).agg(F.count("*").alias("_n"), F.count_if(F.col(flagged)).alias("_f"))
    order = Window.partitionBy(day, label).orderBy("_t")
    new = F.coalesce((F.col("_t") - F.lag("_t").over(order) > gap).cast("int"), F.lit(0))
    run = times.withColumn("_new", new).withColumn("incident", F.sum("_new").over(order))
    start, hit = F.min("_t"), F.min(F.when(F.col("_f") > 0, F.col("_t")))
    out = run.groupBy(day, label, "incident").agg(start.alias("start"), (F.max("_t") - start).alias("duration"), F.sum("_n").alias("n_rows"), F.sum("_f").alias("n_flagged"), (hit - start).alias("seconds_to_detect"))
    return out.withColumn("detected", F.col("n_flagged") > 0)


def incident_summary(inc: DataFrame, keys: list[str]) -> DataFrame:
    return inc.groupBy(*keys).agg(F.count("*").alias("incidents"), F.count_if("detected").alias("detected"), F.median("seconds_to_detect").alias("median_seconds"))


def time_to_detect(df: DataFrame, keys: list[str], time: str, flagged: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.min(F.when(F.col(flagged), F.col(time))) - F.min(time)).alias("seconds_to_first_detection"))


def false_alerts_per_hour(df: DataFrame, day: str, time: str, false_alert: Column) -> DataFrame:
    days = df.groupBy(day).agg(((F.max(time) - F.min(time)) / 3600).alias("_h"), F.count_if(false_alert).alias("_f"))
    return days.agg((F.sum("_f") / F.greatest(F.sum("_h"), F.lit(1e-9))).alias("false_alerts_per_hour"))


def alert_groups(df: DataFrame, entity: str, time: str, width: int, flagged: Column, y: str) -> DataFrame:
    """Alerts: (entity, bin) with a flagged row; true if a flagged row is an attack."""
    return df.where(flagged).groupBy(entity, F.floor(F.col(time) / width).alias("bin")).agg(F.count("*").alias("n_flagged"), F.max(F.col(y)).alias("is_true"))


def binomial_tail(df: DataFrame, k: str, n: str, q: float, name: str) -> DataFrame:
    """df with -ln P(Binomial(n, q) >= k), in log space, computed once for each (k, n). Spark has no gamma function: numpy in Arrow batches."""

    @F.pandas_udf("double")
    def tail(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import math

        import numpy as np

        for ks, ns in pairs:
            out = []
            for a, m in zip(ks.astype(int), ns.astype(int), strict=True):
                i = np.arange(max(a, 0), m + 1)
                steps = np.log((m - i[:-1]) / (i[:-1] + 1)) + math.log(q) - math.log1p(-q)  # from each term to the next
                first = math.lgamma(m + 1) - math.lgamma(i[0] + 1) - math.lgamma(m - i[0] + 1) + i[0] * math.log(q) + (m - i[0]) * math.log1p(-q) if len(i) else -math.inf
                out.append(0.0 if a <= 0 else -min(0.0, float(np.logaddexp.reduce(first + np.append(0.0, np.cumsum(steps))))))
            yield pd.Series(out, dtype="float64")

    pairs = df.select(F.col(k).alias("_k"), F.col(n).alias("_m")).distinct().withColumn(name, tail("_k", "_m"))
    return df.join(pairs, F.col(k).eqNullSafe(F.col("_k")) & F.col(n).eqNullSafe(F.col("_m"))).drop("_k", "_m")


def seed_summary(df: DataFrame, keys: list[str], seed: str, values: list[str]) -> DataFrame:
    """Mean and sample deviation over seeds, of methods that every seed has."""
    seeds = df.agg(F.count_distinct(seed).alias("_all"))
    stats = [x for v in values for x in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"))]
    return df.groupBy(*keys).agg(F.count_distinct(seed).alias("_k"), *stats).crossJoin(F.broadcast(seeds)).where("_k = _all").drop("_k", "_all")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles and max, a row for each column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(F.explode(pairs).alias("x")).select("x.name", "x.v")
    stats = long.groupBy("name").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = quantiles(long, "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["name"]).drop("n")
    return stats.join(F.broadcast(q), "name", "left").select("name", "n", "mean", "std", "min", "p25", "p50", "p75", "max")  # a row for each column


def rank_bins(df: DataFrame, score: str, bins: int, name: str = "bin", keys: list[str] | None = None) -> DataFrame:
    """df with the score's rank (within keys) as one of `bins` places; ties share one, null scores have none."""
    keys = keys or []
    steps = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("_s")).agg(F.count("*").alias("_c"))
    low = prefix_sum(steps, keys, "_s", "_c", "_upto", total="_n").withColumn("_rank", F.col("_upto") - F.col("_c"))
    placed = low.select(*keys, "_s", F.floor(F.col("_rank") * bins / F.col("_n")).alias(name))
    return df.withColumn("_s", F.col(score)).join(placed, [*keys, "_s"], "left").drop("_s")
