"""Splits and samples, decided by time and by hashes of row ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.columns import row_hash
from flowlens.operators.clean import DataError
from flowlens.operators.quantiles import prefix_sum, quantiles


def time_split(df: DataFrame, day: str, time: str, row_id: str, part: float, benign: str) -> DataFrame:
    """df with cutoff (of its day) and split: train before, val from the cutoff on; rows that are not benign get sup before it, else null.

    The cutoff is the time of the benign row at place floor(n * (1 - part)), counted from 0. Rows of a day without
    benign rows, and rows without a day or time, have neither cutoff nor split.
    """
    steps = df.where(F.col(benign) & F.col(time).isNotNull()).groupBy(day, time).agg(F.count("*").alias("_c"))
    placed = prefix_sum(steps, [day], time, "_c", "_upto", total="_n").withColumn("_place", F.floor(F.col("_n") * (1 - part)))
    cut = placed.where((F.col("_upto") - F.col("_c") <= F.col("_place")) & (F.col("_place") < F.col("_upto"))).select(day, F.col(time).alias("cutoff"))
    before = F.col(time) < F.col("cutoff")
    return df.join(cut, day, "left").withColumn("split", F.when(F.col(benign), F.when(before, "train").when(~before, "val")).when(before, "sup"))


def cap(df: DataFrame, n: int, row_id: str, seed: int = 0) -> DataFrame:
    """n rows chosen by a hash of their id."""
    return df.orderBy(row_hash([row_id], seed), row_id).limit(n)


#: Ranges of the hash in which the rows of a group are counted.
HASH_CELLS = 1 << 16


def cap_per_group(df: DataFrame, group: str, n: int, row_id: str, seed: int = 0) -> DataFrame:
    """At most n rows of each group, those with the smallest hashes of their ids (ties: the smaller id).

    Rows are counted by range of the hash first; only those up to the range in which a group reaches n are ordered. So
    a task orders about n rows of a group, however many it has. df is read twice.
    """
    hashed = df.withColumn("_h", row_hash([row_id], seed)).withColumn("_cell", F.floor(F.col("_h") / F.lit((1 << 60) // HASH_CELLS)).cast("int"))
    cells = hashed.groupBy(group, "_cell").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = cells.withColumn("_before", before).where(F.col("_before") < n).groupBy(F.col(group).alias("_g")).agg(F.max("_cell").alias("_last"))  # a row for each group
    near = hashed.join(F.broadcast(last), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_cell") <= F.col("_last")))
    order = Window.partitionBy(group).orderBy("_h", row_id)
    return near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r", "_h", "_cell", "_g", "_last")


def cap_per_class(df: DataFrame, label: str, n: int, row_id: str, seed: int = 0) -> DataFrame:
    """At most n rows of each class, chosen by a hash of their id."""
    return cap_per_group(df, label, n, row_id, seed)


def halves(df: DataFrame, label: str, time: str) -> DataFrame:
    """df with late: whether a row lies at or after its label's median time; null without a label or time."""
    return df.join(quantiles(df, time, {"_m": 0.5}, [label]).drop("n"), label, "left").withColumn("late", F.col(time) >= F.col("_m")).drop("_m")


def last_part(df: DataFrame, time: str, row_id: str, part: float = 0.2) -> DataFrame:
    """df with held: whether a row is in the last part by time."""
    at = quantiles(df, time, {"_t": 1 - part}, []).drop("n")
    return df.crossJoin(F.broadcast(at)).withColumn("held", F.col(time) >= F.col("_t")).drop("_t")


def leave_one_out(families: list[str]) -> list[tuple[str, list[str]]]:
    """Each family, and those that are left."""
    return [(f, [x for x in families if x != f]) for f in families]


def dev_test(df: DataFrame, day: str, test: list, measure: Callable[[DataFrame], DataFrame], name: str, value: str) -> DataFrame:
    """A measure (name, value) of each candidate on the days outside and inside `test`: name, dev_<value>, test_<value>, and chosen: the best on the development days (all of several equal ones)."""
    dev, held = (measure(df.where(F.col(day).isin(test) == inside)).select(name, F.col(value).alias(f"{part}_{value}")) for part, inside in (("dev", False), ("test", True)))
    best = dev.agg(F.max(f"dev_{value}").alias("_best"))
    return dev.join(held, name, "left").crossJoin(F.broadcast(best)).withColumn("chosen", F.col(f"dev_{value}") == F.col("_best")).drop("_best")  # one row


def check_days(train: list[str], test: list[str]) -> None:
    if both := sorted(set(train) & set(test)):
        raise DataError(f"days in train and test: {', '.join(both)}")


def split_summary(df: DataFrame, day: str, label: str, attack: str) -> DataFrame:
    """Rows, attacks and the sorted attack labels of each day."""
    return df.groupBy(day).agg(F.count("*").alias("rows"), F.sum(F.col(attack).cast("long")).alias("attacks"), F.array_join(F.array_sort(F.collect_set(F.when(F.col(attack), F.col(label)))), ", ").alias("types"))
