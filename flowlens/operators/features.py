"""Features: trailing-window context, scaling, robust statistics.

Windows run over one row for each (key, second): that is what keeps a flood on one key from filling a task, and why
all rows of a second count each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.columns import clip, signed_log
from flowlens.operators.quantiles import quantiles
from flowlens.sources.scratch import written

MAX_GAP = 3600.0


def per_second(df: DataFrame, keys: list[str], sec: str, counts: dict[str, int], gap: str | None = None) -> DataFrame:
    """One row for each (keys, second): how many rows lie in the trailing windows, and the seconds since the key's last second."""
    order = Window.partitionBy(*keys).orderBy(sec)
    seconds = df.groupBy(*keys, sec).agg(F.count("*").alias("_n"))
    out = {name: F.sum("_n").over(order.rangeBetween(-(w - 1), 0)) for name, w in counts.items()}
    if gap:
        out[gap] = F.coalesce(F.least(F.col(sec) - F.lag(sec).over(order), F.lit(MAX_GAP)), F.lit(MAX_GAP)).cast("double")
    return seconds.withColumns(out).drop("_n")


def trailing_count(df: DataFrame, keys: list[str], sec: str, counts: dict[str, int], gap: str | None = None) -> DataFrame:
    """df with the columns of per_second(); keys must not be null."""
    return df.join(per_second(df, keys, sec, counts, gap), [*keys, sec])


def distinct_per_bucket(df: DataFrame, groups: list[str], value: str, sec: str, width: int, name: str) -> DataFrame:
    """df with the number of distinct values in the row's fixed bucket of `width` seconds, counted from the group's first second."""
    first = df.groupBy(*groups).agg(F.min(sec).alias("_first"))
    placed = df.join(F.broadcast(first) if not groups else first, groups) if groups else df.crossJoin(F.broadcast(first))
    placed = placed.withColumn("_bucket", F.floor((F.col(sec) - F.col("_first")) / width))
    counts = placed.groupBy(*groups, "_bucket").agg(F.count_distinct(value).alias(name))
    return placed.join(counts, [*groups, "_bucket"]).drop("_first", "_bucket")


def trailing_distinct(df: DataFrame, groups: list[str], value: str, sec: str, width: int, name: str) -> DataFrame:
    """Distinct values in the trailing window of each second: a value counts from its second for `width` seconds; overlapping spells merge to islands, whose ends are summed up."""
    own = Window.partitionBy(*groups, value).orderBy(sec)
    seconds = df.select(*groups, value, sec).distinct()
    head = seconds.withColumn("_new", (F.coalesce(F.col(sec) - F.lag(sec).over(own) >= width, F.lit(True))).cast("int"))
    spells = head.withColumn("_spell", F.sum("_new").over(own)).groupBy(*groups, value, "_spell").agg(F.min(sec).alias("_from"), (F.max(sec) + width).alias("_to"))
    steps = spells.select(*groups, F.col("_from").alias(sec), F.lit(1).alias("_step")).unionByName(spells.select(*groups, F.col("_to").alias(sec), F.lit(-1).alias("_step")))
    steps = steps.unionByName(seconds.select(*groups, sec, F.lit(0).alias("_step")))
    net = steps.groupBy(*groups, sec).agg(F.sum("_step").alias("_step"))
    level = net.withColumn(name, F.sum("_step").over(Window.partitionBy(*groups).orderBy(sec))).drop("_step")
    return df.join(level, [*groups, sec])


def add_context(df: DataFrame, day: str, sec: str, port: str, shape: list[str], short: int = 1, long: int = 60, wide: int = 10) -> DataFrame:
    """The twelve context columns over whole days: load, load on the port, shares, port diversity, repetition, gaps.

    df is reduced once to a row for each (day, port, shape, second); the coarser counts come from that table, and one
    join brings all columns back to the rows. Keys must not be null.
    """
    s, l = f"{short}s", f"{long}s"  # noqa: E741
    keys = [day, *dict.fromkeys([port, *shape])]
    base = written(df.groupBy(*keys, sec).agg(F.count("*").alias("_n")), "seconds")
    by_port = base.groupBy(day, port, sec).agg(F.sum("_n").alias("_n"))
    by_day = by_port.groupBy(day, sec).agg(F.sum("_n").alias("_n"))

    def trailing(seconds: DataFrame, of: list[str], name: str, gap: str | None = None) -> DataFrame:
        order = Window.partitionBy(*of).orderBy(sec)
        out = {f"{name}_{w}s": F.sum("_n").over(order.rangeBetween(-(w - 1), 0)) for w in (short, long)}
        if gap:
            out[gap] = F.coalesce(F.least(F.col(sec) - F.lag(sec).over(order), F.lit(MAX_GAP)), F.lit(MAX_GAP)).cast("double")
        return seconds.withColumns(out).drop("_n")

    days = trailing(by_day, [day], "ctx_flows")
    first = F.broadcast(by_day.groupBy(day).agg(F.min(sec).alias("_first")))  # a row for each day
    for w in (short, wide):
        bucket = F.floor((F.col(sec) - F.col("_first")) / w)
        ports = by_port.join(first, day).groupBy(day, bucket.alias("_bucket")).agg(F.count_distinct(port).alias(f"ctx_ports_{w}s"))
        days = days.join(first, day).withColumn("_bucket", bucket).join(ports, [day, "_bucket"]).drop("_bucket", "_first")
    ports = trailing(by_port, [day, port], "ctx_port_flows", "ctx_port_gap").join(days, [day, sec])
    context = trailing(base, keys, "ctx_shape", "ctx_shape_gap").join(ports, [day, port, sec])
    out = df.join(context, [*keys, sec])
    return out.withColumns({f"ctx_port_share_{l}": F.col(f"ctx_port_flows_{l}") / F.col(f"ctx_flows_{l}"), f"ctx_shape_share_{l}": F.col(f"ctx_shape_{l}") / F.col(f"ctx_port_flows_{l}")})


def fit_space(df: DataFrame, modalities: dict[str, list[str]], min_std: float = 1e-6) -> DataFrame:
    """One row for each feature that varies: pos, modality, name, mean, std (population) of its signed log. One pass over df."""
    names = [(m, c) for m, cs in modalities.items() for c in cs]
    wide = df.agg(*[x for i, (_, c) in enumerate(names) for x in (F.avg(signed_log(c)).alias(f"m{i}"), F.stddev_pop(signed_log(c)).alias(f"s{i}"))])
    rows = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(m).alias("modality"), F.lit(c).alias("name"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std")) for i, (m, c) in enumerate(names)])
    long = wide.select(F.explode(rows).alias("x")).select("x.*").where(F.col("std") > min_std)
    return long.withColumn("pos", F.row_number().over(Window.orderBy("at")) - 1).drop("at")  # one row for each feature


def apply_space(df: DataFrame, space: list, limit: float = 8.0) -> DataFrame:
    """df with x: the clipped standard scores of the space's features, in its order. space: collected rows of fit_space()."""
    parts = [clip((signed_log(r["name"]) - F.lit(r["mean"])) / F.lit(r["std"]), -limit, limit) for r in space]
    return df.withColumn("x", F.array(*parts))


def slices(space: list) -> dict[str, tuple[int, int]]:
    """First and last place (left out) of each modality in x."""
    out: dict[str, tuple[int, int]] = {}
    for r in space:
        a, _ = out.get(r["modality"], (r["pos"], 0))
        out[r["modality"]] = (a, r["pos"] + 1)
    return out


def subset(space: list, keep: list[str]) -> tuple[list[int], dict[str, tuple[int, int]]]:
    """Places of the features of some modalities, and their slices when only these are left."""
    places = [r["pos"] for r in space if r["modality"] in keep]
    out: dict[str, tuple[int, int]] = {}
    for i, r in enumerate(r for r in space if r["modality"] in keep):
        a, _ = out.get(r["modality"], (i, 0))
        out[r["modality"]] = (a, i + 1)
    return places, out


def robust_stats(df: DataFrame, value: Column, keys: list[str]) -> DataFrame:
    """Median, and 1.4826 times the median deviation plus 1e-6, of each group, with n. An empty table without keys: one row of nulls."""
    v = df.select(*keys, value.cast("double").alias("_v"))
    med = quantiles(v, "_v", {"med": 0.5}, keys)  # a row for each group
    off = (v.join(F.broadcast(med.drop("n")), keys) if keys else v.crossJoin(F.broadcast(med.drop("n")))).withColumn("_d", F.abs(F.col("_v") - F.col("med")))
    dev = quantiles(off, "_d", {"_s": 0.5}, keys).select(*keys, (F.col("_s") * 1.4826 + 1e-6).alias("scale"), "n")
    return (med.drop("n").join(dev, keys) if keys else med.drop("n").crossJoin(dev)).select(*keys, "med", "scale", "n")


def raw_baseline(df: DataFrame, features: list[str], role: str, min_n: int = 500) -> DataFrame:
    """Median, 5th and 95th percentile of each feature, over all rows (role null) and in roles with min_n rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features])
    long = df.select(F.col(role).cast("int").alias("role"), F.explode(pairs).alias("x")).select("role", "x.feature", "x.v")
    counted = long.groupBy("role", "feature", "v").agg(F.count("*").alias("c"))  # values are counted once, for roles and for all rows
    rows = counted.unionByName(counted.withColumn("role", F.lit(None).cast("int")))
    stats = quantiles(rows, "v", {"typical": 0.5, "p5": 0.05, "p95": 0.95}, ["role", "feature"], "c")
    size = long.where(F.col("feature") == features[0]).groupBy("role").agg(F.count("*").alias("rows"))
    whole = size.agg(F.sum("rows").alias("rows")).select(F.lit(None).cast("int").alias("role"), "rows")
    n = size.where((F.col("rows") >= min_n) & F.col("role").isNotNull()).unionByName(whole).withColumnRenamed("role", "r")
    return stats.drop("n").join(F.broadcast(n), F.col("role").eqNullSafe(F.col("r"))).select("role", F.col("rows").alias("n"), "feature", "typical", "p5", "p95")
