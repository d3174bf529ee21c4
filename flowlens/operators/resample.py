"""Bootstrap intervals from counts: blocks of time, or rows, resampled by hashes of their ids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.columns import row_hash
from flowlens.operators.metrics import rank_bins
from flowlens.operators.split import cap
from flowlens.sources.scratch import dealt


def block_weights(blocks: DataFrame, day: str, block: str, resamples: int, seed: int = 0) -> DataFrame:
    """How often each block is drawn in each resample: as many draws with replacement within each day as it has blocks. blocks: distinct (day, block)."""
    from pyspark.sql import Window

    placed = blocks.withColumn("_p", F.row_number().over(Window.partitionBy(day).orderBy(block)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(day)))
    draws = placed.select(day, "_p", "_n", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("resample"))
    pick = row_hash([day, "_p", "resample"], seed) % F.col("_n")
    hits = draws.select(day, "resample", pick.alias("_p")).groupBy(day, "resample", "_p").agg(F.count("*").alias("weight"))
    return hits.join(placed.select(day, block, F.col("_p").cast("long").alias("_p")), [day, "_p"]).select(day, block, "resample", "weight")


def weight_vectors(weights: DataFrame, keys: list[str], resamples: int) -> DataFrame:
    """keys and w: a vector with the weight of each resample (1 ..). One row for each block."""
    at = F.map_from_entries(F.collect_list(F.struct("resample", F.col("weight").cast("double"))))  # at most one entry for each resample
    w = weights.groupBy(*keys).agg(at.alias("_m"))
    return w.select(*keys, array_to_vector(F.transform(F.sequence(F.lit(1), F.lit(resamples)), lambda r: F.coalesce(F.try_element_at("_m", r), F.lit(0.0)))).alias("w"))


def auc_of_resamples(counts: DataFrame, keys: list[str], resamples: int) -> DataFrame:
    """keys, resample, roc_auc (null if a class is missing). counts: keys, _s (score), _p (class, 0 or 1) and _v, how often each resample has them (a vector). A group has a row for each score and class, which the caller bounds."""
    names = ", ".join(f"`{k}` {t}" for k, t in counts.select(*keys).dtypes)
    number = "".join(keys) + "_g"

    def areas(pdf: pd.DataFrame) -> pd.DataFrame:
        score, place = np.unique(pdf["_s"].to_numpy(), return_inverse=True)
        sums = np.zeros((2, len(score), resamples))
        np.add.at(sums, (pdf["_p"].to_numpy(), place), np.stack([np.asarray(v, np.float64) for v in pdf["_v"]]))
        below = np.cumsum(sums[0], 0) - sums[0] / 2
        total = sums[0].sum(0) * sums[1].sum(0)
        area = (sums[1] * below).sum(0)
        out = pd.DataFrame({"resample": np.arange(1, resamples + 1), "roc_auc": [float(x / t) if t > 0 else None for x, t in zip(area, total, strict=True)]})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return counts.withColumn(number, F.lit(0)).groupBy(*keys, number).applyInPandas(areas, f"{names + ', ' if names else ''}resample int, roc_auc double")


def bootstrap_auc(df: DataFrame, day: str, time: str, y: str, score: str, method: str | None = None, width: int = 600, resamples: int = 200, bins: int = 20_000, seed: int = 0) -> DataFrame:
    """roc_auc of each (method,) resample of blocks of `width` seconds of a day. All methods share the draws.

    Rows are counted by (block, score bin, class); each count is multiplied with the block's vector of weights, one for
    each resample, and the vectors are added up by bin and class before they are shuffled. So neither rows nor counts
    are repeated for the resamples, and what is shuffled is bounded by bins. Scores and times must not be null.
    """
    keys = [method] if method else []
    binned = rank_bins(df, score, bins, "bin", keys)
    counts = binned.withColumn("_b", F.floor(F.col(time) / width)).groupBy(*keys, day, "_b", "bin", y).agg(F.count("*").alias("_n"))
    blocks = df.select(day, F.floor(F.col(time) / width).alias("_b")).distinct()
    vectors = weight_vectors(block_weights(blocks, day, "_b", resamples, seed), [day, "_b"], resamples)
    weighed = counts.join(vectors, [day, "_b"]).groupBy(*keys, F.col("bin").alias("_s"), F.col(y).cast("int").alias("_p")).agg(vector_to_array(Summarizer.sum(F.col("w"), F.col("_n").cast("double"))).alias("_v"))
    return auc_of_resamples(weighed, keys, resamples)


def interval(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Mean, 2.5 and 97.5 % of the defined resamples, and how many were defined."""
    p = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    aggs = [F.avg(value).alias("mean"), p[0].alias("low"), p[1].alias("high"), F.count(value).alias("defined"), F.count("*").alias("resamples")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def paired_difference(df: DataFrame, method: str, reference: str, value: str) -> DataFrame:
    """Interval of reference - method over shared resamples."""
    ref = df.where(F.col(method) == reference).select("resample", F.col(value).alias("_r"))
    return interval(df.where(F.col(method) != reference).join(ref, "resample").withColumn("difference", F.col("_r") - F.col(value)), "difference", [method])


#: The Poisson(1) distribution: a row's uniform number counts as often as it exceeds one of these.
POISSON = [0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675884]


def hex_limit(share: float) -> str:
    """The least 15 hex digits whose number n has (n + 0.5) / 2 ** 60 > share. Hex digits of one length sort as their numbers do."""
    low, high = 0, 1 << 60
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if (float(mid) + 0.5) / float(1 << 60) > share else (mid + 1, high)
    return f"{low:015x}"


def row_digits(row_id: str, r: Column, seed: int = 0) -> Column:
    """15 hex digits of the hash of a row and a resample."""
    text = F.concat_ws("|", F.coalesce(F.col(row_id).cast("string"), F.lit("")), r.cast("string"), F.lit(str(seed)))
    return F.substring(F.md5(text.cast("binary")), 1, 15)


def poisson_weight(digits: Column) -> Column:
    """0 to 7: how many of the distribution's steps the digits reach."""
    out = None
    for w, x in enumerate(POISSON):
        out = F.when(digits < hex_limit(x), float(w)) if out is None else out.when(digits < hex_limit(x), float(w))
    return out.otherwise(float(len(POISSON)))


def row_weights(row_id: str, resamples: int, seed: int = 0) -> Column:
    """A Poisson(1) weight for each resample, by a hash of the row and the resample: an array. Each hash is taken once."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(resamples)), lambda r: row_digits(row_id, r, seed))
    return F.transform(digits, poisson_weight)


def row_bootstrap_auc(df: DataFrame, y: str, score: str, row_id: str, resamples: int = 200, most: int | None = None, bins: int = 20_000, seed: int = 0) -> DataFrame:
    """roc_auc of each resample of the rows. Their weights are added up as vectors by score bin and class, in the tasks. most: only so many rows, a sample by hash; null scores are left out."""
    rows = df.where(F.col(score).isNotNull()).select(row_id, y, score)
    rows = cap(rows, most, row_id, seed) if most else rows
    # A column for each resample, so that tasks add up in a hash table; each column's hash is taken once, before it is weighed.
    names = [f"_w{r}" for r in range(1, resamples + 1)]
    binned = dealt(rank_bins(rows, score, bins), rows.count(), row_id, most=50_000)
    digits = binned.select(F.col("bin").alias("_s"), F.col(y).cast("int").alias("_p"), *[row_digits(row_id, F.lit(r), seed).alias(n) for r, n in enumerate(names, 1)])
    weighed = digits.groupBy("_s", "_p").agg(*[F.sum(poisson_weight(F.col(n))).alias(n) for n in names])
    return auc_of_resamples(weighed.select("_s", "_p", F.array(*names).alias("_v")), [], resamples)


def row_bootstrap_mean(df: DataFrame, value: str, row_id: str, resamples: int = 200, seed: int = 0) -> DataFrame:
    """Mean of each resample of the rows with a value; null with under three of them. One row of sums leaves each task."""
    w = row_weights(row_id, resamples, seed)
    v = F.col(value).cast("double")
    both = df.where(v.isNotNull()).select(array_to_vector(w).alias("w"), array_to_vector(F.transform(w, lambda x: x * v)).alias("vw"))
    sums = both.agg(F.count("*").alias("n"), vector_to_array(Summarizer.sum(F.col("w"))).alias("w"), vector_to_array(Summarizer.sum(F.col("vw"))).alias("vw"))
    parts = sums.select("n", F.posexplode(F.arrays_zip("w", "vw")).alias("at", "x"))
    return parts.select((F.col("at") + 1).alias("resample"), F.when((F.col("n") >= 3) & (F.col("x.w") > 0), F.col("x.vw") / F.col("x.w")).alias("mean"))
