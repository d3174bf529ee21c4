"""Audits of tables, labels, splits and errors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.metrics import folded, roc_auc

#: Parts of names that identify a record or leak its label.
SUSPICIOUS = ("id", "ip", "addr", "label", "class", "attack", "truth", "timestamp")
#: Names that would be identifiers, or leaks of a label or of a detector's decision, among the inputs.
IDENTIFIERS = ["Flow ID", "Src IP", "Dst IP", "Src Port", "Dst Port", "Timestamp", "ts", "id", "src_ip", "dst_ip", "src_port", "dst_port", "start", "start_utc", "stcpb", "dtcpb"]
LABEL_LIKE = ["Label", "label", "attack", "attack_cat", "class", "truth", "sig", "alerted", "rule", "n_engine_alerts", "event_type_alert", "pad_zone"]


def alignment(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """Rows only on one side, and rows whose labels differ."""
    j = a.select(key, F.col(label).alias("_a"), F.lit(1).alias("_x")).join(b.select(key, F.col(label).alias("_b"), F.lit(1).alias("_y")), key, "outer")
    return j.agg(F.count_if(F.col("_x").isNull()).alias("only_right"), F.count_if(F.col("_y").isNull()).alias("only_left"), F.count_if(F.col("_a") != F.col("_b")).alias("differ"))


def check_aligned(a: DataFrame, b: DataFrame, key: str, label: str) -> None:
    r = alignment(a, b, key, label).first()
    if any(r):
        raise ValueError(f"tables are not aligned: {r.asDict()}")


def diff_tables(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """For each other column of a: extra and missing rows of b, differing nulls, and differing values (numbers: by more than the tolerance)."""
    names = [c for c in a.columns if c not in keys and c in b.columns]
    numbers = {c for c, t in a.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")}
    left = a.select(*keys, F.lit(1).alias("_x"), *[F.col(c).alias(f"a_{c}") for c in names])
    right = b.select(*keys, F.lit(1).alias("_y"), *[F.col(c).alias(f"b_{c}") for c in names])
    j = left.join(right, keys, "outer")
    both, rows = F.col("_x").isNotNull() & F.col("_y").isNotNull(), []
    for c in names:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        other = F.abs(x - y) > tolerance if c in numbers else x != y
        rows.append(F.struct(F.lit(c).alias("name"), F.count_if(F.col("_x").isNull()).alias("extra"), F.count_if(F.col("_y").isNull()).alias("missing"), F.count_if(both & (x.isNull() != y.isNull())).alias("null_differs"), F.count_if(both & other).alias("differs")))
    return j.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def profile(df: DataFrame, label: str, duration: str, port: str, columns: list[str]) -> DataFrame:
    number = lambda c: F.col(c).try_cast("double")
    base = df.agg(F.count("*").alias("rows"), F.count_if(F.col(label) == label).alias("headers"), F.count_if(F.col(duration).isNull()).alias("missing"), F.count_if(number(duration) < 0).alias("negative"), F.count_if(number(port) > 65535).alias("bad_ports"), F.count_distinct(F.trim(label)).alias("labels"))
    distinct = df.select(columns).distinct().agg(F.count("*").alias("_d"))
    return base.crossJoin(distinct).withColumn("duplicates", F.col("rows") - F.col("_d")).drop("_d")


def quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """missing, infinite, negative, zero_share, n_distinct and is_constant of each column. Values are counted by (column, value) first, so distinct ones need no further pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])
    counts = df.select(F.explode(pairs).alias("x")).groupBy("x.name", "x.v").agg(F.count("*").alias("n"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    v = F.col("v")
    out = counts.groupBy("name").agg(n(v.isNull()).alias("missing"), n(F.abs(v) == float("inf")).alias("infinite"), n(v < 0).alias("negative"), (n(v == 0) / F.nullif(n(v.isNotNull()), F.lit(0))).alias("zero_share"), F.count("v").alias("n_distinct"))
    return out.withColumn("is_constant", F.col("n_distinct") <= 1)


def conflicts(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Groups of equal features with several labels, and their rows."""
    g = df.groupBy(*features).agg(F.count("*").alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo <> hi")
    return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def label_windows(df: DataFrame, day: str, time: str, y: str, port: str) -> DataFrame:
    """Benign rows inside and outside each day's span of attacks, and the share of ephemeral ports inside."""
    spans = df.where(F.col(y) == 1).groupBy(day).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    x = df.join(F.broadcast(spans), day)  # a row for each day
    benign, inside = F.col(y) == 0, F.col(time).between(F.col("_lo"), F.col("_hi"))
    return x.groupBy(day).agg(F.count_if(benign & inside).alias("inside"), F.count_if(benign & ~inside).alias("outside"), F.avg(F.when(benign & inside, (F.col(port) >= 49152).cast("double"))).alias("ephemeral"))


def split_integrity(df: DataFrame, split: str, day: str, time: str, y: str) -> DataFrame:
    """Rows, attacks and time range by split and day, and whether they start after all training rows."""
    last = df.where(F.col(split) == "train").agg(F.max(time).alias("_t"))
    g = df.groupBy(split, day).agg(F.count("*").alias("rows"), F.sum(F.col(y).cast("long")).alias("attacks"), F.min(time).alias("first"), F.max(time).alias("last"))
    return g.crossJoin(F.broadcast(last)).withColumn("after_train", F.col("first") > F.col("_t")).drop("_t")


def seen_before(df: DataFrame, train: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Share of each label's rows whose key training has."""
    known = train.select(*keys).distinct().withColumn("_seen", F.lit(1.0))
    return df.join(known, keys, "left").groupBy(label).agg(F.count("*").alias("n"), F.avg(F.coalesce("_seen", F.lit(0.0))).alias("seen"))


def identifier_auc(df: DataFrame, identifier: str, y: str) -> DataFrame:
    """How well the mean label of an identifier, on the same rows, tells the classes apart."""
    rate = df.groupBy(identifier).agg(F.avg(y).alias("_s"), F.sum(y).alias("_p"), F.count("*").alias("_n"))
    both = rate.select("_s", F.lit(1).alias("_y"), F.col("_p").alias("_w")).unionByName(rate.select("_s", F.lit(0).alias("_y"), (F.col("_n") - F.col("_p")).alias("_w")))
    return roc_auc(both, "_y", "_s", None, "_w").select(folded("roc_auc").alias("folded_auc"))


def single_feature_auc(df: DataFrame, features: list[str], y: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("s")) for c in features])
    long = df.select(y, F.explode(rows).alias("x")).select(y, "x.feature", "x.s")
    return roc_auc(long, y, "s", ["feature"]).select("feature", folded("roc_auc").alias("folded_auc"))


def errors_by_factor(df: DataFrame, factors: list[str], y: str, flagged: Column) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("string").alias("level")) for c in factors])
    long = df.select(y, flagged.alias("_f"), F.explode(rows).alias("x")).select(y, "_f", "x.factor", "x.level")
    pos = F.col(y) == 1
    return long.groupBy("factor", "level").agg(F.count_if(pos & ~F.col("_f")).alias("misses"), F.count_if(~pos & F.col("_f")).alias("false_alarms"), F.count_if(pos).alias("attacks"))


def drift(df: DataFrame, order: str, flagged: Column, design: float, size: int = 10_000, least: int = 1_000) -> DataFrame:
    """Alert rate of the last `size` rows against the design rate. order: a dense row number from 0, by which rows are dealt to blocks of `size`; a block needs the one before it."""
    block = F.floor(F.col(order) / size)
    both = df.withColumn("_f", flagged.cast("double")).withColumn("_b", F.explode(F.array(block, block + 1)))
    # Running sums, less those of `size` rows before: a sliding frame would add up `size` rows for each row.
    w = Window.partitionBy("_b").orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = both.withColumns({"_row": F.count("*").over(run), "_sum": F.coalesce(F.sum("_f").over(run), F.lit(0.0)), "_set": F.count("_f").over(run)})
    gone = {c: F.col(c) - F.coalesce(F.lag(c, size).over(w), F.lit(0)) for c in ("_sum", "_set")}
    rated = sums.withColumns(gone).where(F.col("_b") == block).withColumns({"_n": F.least("_row", F.lit(size)), "_rate": F.col("_sum") / F.nullif("_set", F.lit(0))})
    state = F.when(F.col("_n") < least, "insufficient").when(F.col("_rate") > 3 * design, "drifting").otherwise("ok")
    return rated.select(order, state.alias("state"), (F.col("_rate") / design).alias("ratio"))


def gram(df: DataFrame, x: str, y: str) -> DataFrame:
    """i, j, c: sums over the rows of the products of centred x[i] and y[j]. Each task adds up its rows; a row for each task and pair of places is what is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, parts = 0, None
        for pdf in batches:
            if len(pdf):
                a, b = (np.stack([np.asarray(v, np.float64) for v in pdf[c]]) for c in ("left", "right"))
                new = a.T @ b, a.sum(0), b.sum(0)
                n, parts = n + len(a), new if parts is None else tuple(p + q for p, q in zip(parts, new, strict=True))
        if parts is not None:
            i, j = np.indices(parts[0].shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "n": n, "p": parts[0].ravel(), "a": parts[1][i.ravel()], "b": parts[2][j.ravel()]})

    sums = df.select(F.col(x).alias("left"), F.col(y).alias("right")).mapInPandas(run, "i int, j int, n long, p double, a double, b double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in "npab"])
    return sums.select("i", "j", (F.col("p") - F.col("a") * F.col("b") / F.col("n")).alias("c"))


def participation_ratio(df: DataFrame, x: str) -> DataFrame:
    """tr(C) ** 2 / |C| ** 2 of the vectors' covariance C."""
    cov = gram(df, x, x)
    return cov.agg((F.pow(F.sum(F.when(F.col("i") == F.col("j"), F.col("c")).otherwise(0.0)), 2) / F.sum(F.col("c") * F.col("c"))).alias("participation_ratio"))


def suspicious_names(columns: list[str]) -> list[str]:
    """Names that are listed as identifiers or labels, and others with a part that identifies a record or its label."""
    return [c for c in columns if c in IDENTIFIERS or c in LABEL_LIKE or reduce(lambda a, p: a or p in c.lower().replace("_", " ").split(), SUSPICIOUS, False)]
