"""Running sums and exact quantiles that no task takes over a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.sources.scratch import written


def prefix_sum(df: DataFrame, groups: list[str], order: str, value: str, name: str, descending: bool = False, total: str | None = None, more: dict[str, str] | None = None) -> DataFrame:
    """df with the running sum of value up to each row's order in its group, and with the group's sum as `total`. Ties must have been summed. more: names of further running sums, and their values.

    Rows are dealt to ranges of (groups, order) and written once; sums of the ranges, a row for each range and group,
    give each range its start.
    """
    key = F.desc(order) if descending else F.asc(order)
    ranged = df.repartitionByRange(*[F.col(g) for g in groups], key).withColumn("_cell", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    sums = {name: value, **(more or {})}
    cells = ranged.groupBy(*groups, "_cell").agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in sums.items()])
    group = Window.partitionBy(*groups)
    earlier = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumns({f"_start_{n}": F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)) for n in sums})
    if total:
        starts = starts.withColumn(total, F.sum(f"_sum_{name}").over(group))
    names = [*groups, "_cell"]
    starts = starts.drop(*(f"_sum_{n}" for n in sums)).withColumnsRenamed({c: f"{c}_of" for c in names})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in names])
    inside = Window.partitionBy(*names).orderBy(key)
    out = ranged.withColumns({f"_inside_{n}": F.sum(v).over(inside) for n, v in sums.items()}).join(starts, same)
    out = out.withColumns({n: F.col(f"_inside_{n}") + F.col(f"_start_{n}") for n in sums})
    return out.drop("_cell", *(f"{c}_of" for c in names), *(f"{x}_{n}" for n in sums for x in ("_inside", "_start")))


def quantiles(df: DataFrame, value: str, at: dict[str, float], keys: list[str], weight: str | None = None) -> DataFrame:
    """keys, n (values that are not null) and a column for each name of `at`: the exact quantile, interpolated between neighbours. One row for each key; without keys one row, also of an empty table. weight: how often each row counts.

    The values are counted by distinct value and summed up in ranges; of each group only the values at the places
    wanted are looked at.
    """
    steps = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg((F.sum(weight) if weight else F.count("*")).alias("_c"))
    placed = prefix_sum(steps, keys, "_v", "_c", "_upto", total="n")
    first = F.col("_upto") - F.col("_c")  # the places first .. _upto - 1 have the value

    def at_place(place: Column) -> Column:
        return F.max(F.when((first <= place) & (place < F.col("_upto")), F.col("_v")))

    spots = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in at.items()}
    wanted = reduce(Column.__or__, [(first <= F.ceil(p)) & (F.floor(p) < F.col("_upto")) for p in spots.values()])
    found = placed.where(wanted).groupBy(*keys).agg(F.max("n").alias("n"), *[x for c, p in spots.items() for x in (at_place(F.floor(p)).alias(f"_{c}_lo"), at_place(F.ceil(p)).alias(f"_{c}_hi"))])
    out = {}
    for c, q in at.items():
        spot, lo, hi = (F.col("n") - 1) * F.lit(float(q)), F.col(f"_{c}_lo"), F.col(f"_{c}_hi")
        out[c] = lo + (hi - lo) * (spot - F.floor(spot))
    return found.select(*keys, F.coalesce("n", F.lit(0)).cast("long").alias("n"), *[v.alias(c) for c, v in out.items()])
