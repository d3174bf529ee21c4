"""Joins that Spark has no keyword for: as-of, band, range with CIDR, nearest neighbours."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.sources.scratch import dealt


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], slack: int = 0, cell: int = 86_400) -> DataFrame:
    """left with the values of the last right row of its key at or before its time (+ slack); null if none, as for left rows with a null key or time. Ties on the right: the largest values.

    Time is cut into cells, so that no key fills a task: within a cell both sides are sorted and the last right row is
    carried along; what earlier cells hand on comes from a table of one row for each key and cell.
    """
    place = lambda t: F.floor(t / cell).cast("long")
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in keys], F.col(left_time).isNotNull())
    given, left = left, left.where(known)
    one = right.groupBy(*keys, F.col(right_time).alias("_t")).agg(F.max(F.struct(F.col(right_time).alias("_rt"), *values)).alias("_v"))
    a = left.select(*keys, (F.col(left_time) + slack).alias("_t"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(one.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_side"))
    b = one.select(*keys, "_t", F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), "_v", F.lit(0).alias("_side"))
    both = dealt(a.unionByName(b).withColumn("_cell", place(F.col("_t"))), left.count() + right.count(), *keys, "_cell")
    inside = Window.partitionBy(*keys, "_cell").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_v", ignorenulls=True).over(inside)).where("_side = 1")
    ends = both.groupBy(*keys, "_cell").agg(F.max("_v").alias("_end"))  # values begin with their time: the last one
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.withColumn("_from", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    out = found.join(handed, [*keys, "_cell"]).withColumn("_last", F.coalesce("_last", "_from"))
    out = out.select("_l.*", F.col("_last._rt").alias(f"asof_{right_time}"), *[F.col(f"_last.{v}").alias(v) for v in values])
    return out.unionByName(given.where(~known), allowMissingColumns=True)


def as_of_match(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, length: str, values: list[str], same: dict[str, str], slack: int = 2, grace: int = 5) -> DataFrame:
    """as_of() with matched: the right row has not ended over `grace` ago, and its columns in `same` (left name: right name) are equal. Values of rows that don't match become null. keys must not be null."""
    out = as_of(left, right.withColumnsRenamed({r: f"_same_{r}" for r in same.values()}), keys, left_time, right_time, [length, *values, *(f"_same_{r}" for r in same.values())], slack)
    matched = F.col(left_time) <= F.col(f"asof_{right_time}") + F.col(length) + grace
    for mine, theirs in same.items():
        matched = matched & F.col(mine).eqNullSafe(F.col(f"_same_{theirs}"))
    out = out.withColumn("matched", F.coalesce(matched, F.lit(False)))
    return out.withColumns({v: F.when(F.col("matched"), F.col(v)) for v in (f"asof_{right_time}", *values)}).drop(length, *(f"_same_{r}" for r in same.values()))


def within(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, most: int) -> DataFrame:
    """Pairs of one key whose times differ by at most `most`: the time axis is cut into such widths, and a right row meets its own cell and the two beside it. So the side with more rows belongs left."""
    a = left.withColumn("_cell", F.floor(F.col(left_time) / most))
    b = right.withColumn("_cell", F.explode(F.array(*[F.floor(F.col(right_time) / most) + d for d in (-1, 0, 1)])))
    return a.join(b, [*keys, "_cell"]).where(F.abs(F.col(left_time) - F.col(right_time)) <= most).drop("_cell")


def nearest_within(left: DataFrame, right: DataFrame, left_id: str, keys: list[str], left_time: str, right_time: str, most: int, value: str) -> DataFrame:
    """left_id with the value of the nearest right row within `most`; ties: the smallest value."""
    pairs = within(left, right, keys, left_time, right_time, most)
    return pairs.groupBy(left_id).agg(F.min_by(value, F.struct(F.abs(F.col(left_time) - F.col(right_time)), F.col(value))).alias(value))


def both_ways(flows: DataFrame, conns: DataFrame, a: str, b: str, left_time: str, right_time: str, most: int) -> DataFrame:
    """Flows that meet a connection of the same endpoints, in either orientation."""
    swapped = conns.withColumnsRenamed({a: "_x", b: a}).withColumnRenamed("_x", b)
    return within(flows, conns, [a, b], left_time, right_time, most).unionByName(within(flows, swapped, [a, b], left_time, right_time, most)).distinct()


def ipv4(text: str | Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    c = F.col(text) if isinstance(text, str) else text
    p = F.split(c, r"\.")
    parts = [F.get(p, F.lit(i)).try_cast("long") for i in range(4)]
    good = (F.size(p) == 4) & parts[0].between(0, 255) & parts[1].between(0, 255) & parts[2].between(0, 255) & parts[3].between(0, 255)
    return F.when(good, ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3])


def cidr_ranges(text: str) -> list[tuple[int, int]]:
    """The ranges of a ;-separated list of IPv4 networks; bad ones and other versions are skipped."""
    out = []
    for x in text.split(";"):
        try:
            net = ipaddress.ip_network(x.strip(), strict=False)
        except ValueError:
            continue
        if net.version == 4:
            out.append((int(net.network_address), int(net.broadcast_address)))
    return out


def networks(rules: DataFrame, text: str, lo: str, hi: str) -> DataFrame:
    """rules with a row for each IPv4 network or address in a ;-separated list, and its first and last address as numbers; other entries are skipped."""
    entry = F.trim("_x")
    base = ipv4(F.regexp_extract(entry, r"^([0-9.]+)(/[0-9]+)?$", 1))
    bits = F.coalesce(F.nullif(F.regexp_extract(entry, r"/([0-9]{1,2})$", 1), F.lit("")).try_cast("int"), F.when(F.contains(entry, F.lit("/")), F.lit(None)).otherwise(F.lit(32)))
    size = F.pow(F.lit(2.0), 32 - bits).cast("long")
    out = rules.withColumn("_x", F.explode(F.split(text, ";"))).withColumns({"_base": base, "_size": F.when(bits <= 32, size)}).where("_base IS NOT NULL AND _size IS NOT NULL")
    first = F.col("_base") - F.col("_base") % F.col("_size")
    return out.withColumns({lo: first, hi: first + F.col("_size") - 1}).drop("_x", "_base", "_size")


def local_window(day: Column, start: str, end: str, zone: str) -> dict[str, Column]:
    """start and end, texts HH:MM of the clock of a zone on a day, as seconds of UTC. The end minute belongs to the window: label_by_schedule() adds it."""
    at = lambda c: F.unix_seconds(F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", day.cast("string"), F.col(c)), "yyyy-MM-dd HH:mm"), zone))
    return {start: at(start), end: at(end)}


def expand_schedule(rules: DataFrame, attacker: str = "attacker", victim: str = "victim") -> DataFrame:
    """A schedule with lists of networks as the member ranges that label_by_schedule() reads: a row for each pair of networks of a rule."""
    return networks(networks(rules, attacker, "a_lo", "a_hi"), victim, "v_lo", "v_hi").drop(attacker, victim)


def label_by_schedule(flows: DataFrame, rules: DataFrame, src: str, dst: str, time: str, row_id: str, pad: int = 0, minute: int = 60) -> DataFrame:
    """flows with label, rule and pad_zone from a small schedule; rows that must go are left out.

    rules: rule (order), label, a_lo, a_hi, v_lo, v_hi (member ranges), start, end, direction (one, any), outside
    (keep, drop). A rule hits if the ends are its members (or swapped when direction is any) and
    start - pad <= time < end + minute + pad; the first rule wins. pad_zone: hit only thanks to pad. A pair of
    members without any hit goes if one of its rules says drop.
    """
    r = F.broadcast(rules)  # a schedule: some dozens of rows
    forward = F.col(src).between(F.col("a_lo"), F.col("a_hi")) & F.col(dst).between(F.col("v_lo"), F.col("v_hi"))
    back = (F.col("direction") == "any") & F.col(dst).between(F.col("a_lo"), F.col("a_hi")) & F.col(src).between(F.col("v_lo"), F.col("v_hi"))
    pairs = flows.select(row_id, src, dst, time).join(r, forward | back)
    t = F.col(time)
    hit = (t >= F.col("start") - pad) & (t < F.col("end") + minute + pad)
    core = (t >= F.col("start")) & (t < F.col("end") + minute)
    best = pairs.groupBy(row_id).agg(F.min(F.when(hit, F.struct("rule", F.col("label").alias("label"), (~core).alias("pad_zone")))).alias("_h"), F.max((F.col("outside") == "drop").cast("int")).alias("_drop"))
    out = flows.join(best, row_id, "left").where("_h IS NOT NULL OR coalesce(_drop, 0) = 0")
    return out.select(*flows.columns, F.coalesce("_h.label", F.lit("Benign")).alias("label"), F.col("_h.rule").alias("rule"), F.coalesce("_h.pad_zone", F.lit(False)).alias("pad_zone"))


def closest(x: np.ndarray, own: np.ndarray, m: np.ndarray, ids: np.ndarray, k: int, exclude_self: bool) -> pd.DataFrame:
    """id, ref_id and distance of the k nearest rows of m to each row of x, all ties compared by exact distance and ref_id."""
    out = [pd.DataFrame({"id": np.zeros(0, np.int64), "ref_id": np.zeros(0, np.int64), "distance": np.zeros(0)})]
    shift = m.mean(0) if len(m) else 0.0
    mc = m - shift
    norm = (mc**2).sum(1)
    wide = np.c_[-2 * mc, norm].T
    rows = min(256, max(1, 2_000_000 // max(1, len(m))))  # rows at a time, so that rows times references stay bounded
    few = max(1, len(m) // max(1024, 8 * k))  # the k-th of some of the references bounds the k-th of all
    for lo in range(0, len(x), rows):
        part, who = x[lo : lo + rows], own[lo : lo + rows]
        pc = part - shift
        d = np.c_[pc, np.ones(len(pc))] @ wide  # squared distances but for a term of the row
        if exclude_self:
            d[who[:, None] == ids[None]] = np.inf
        some = d[:, ::few]
        top = np.partition(some, k - 1, axis=1)[:, k - 1] if k < some.shape[1] else np.full(len(d), np.inf)
        bar = np.minimum(top + 1e-9 * (1 + (pc**2).sum(1) + norm.max(initial=0.0)), np.finfo(float).max)
        at, ref = np.nonzero(d <= bar[:, None])
        exact = np.concatenate([np.zeros(0), *[np.sqrt(((part[at[s : s + 100_000]] - m[ref[s : s + 100_000]]) ** 2).sum(1)) for s in range(0, len(at), 100_000)]])
        order = np.lexsort((ids[ref], exact, at))
        at, ref, exact = at[order], ref[order], exact[order]
        keep = np.arange(len(at)) - np.searchsorted(at, at) < k
        out.append(pd.DataFrame({"id": who[at[keep]], "ref_id": ids[ref[keep]], "distance": exact[keep]}))
    return pd.concat(out)


FOUND = "id long, ref_id long, distance double"


def _points(df: DataFrame, role: str | None) -> DataFrame:
    return df.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"), (F.col(role) if role else F.lit(0)).cast("int").alias("role"))


def _best(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "ref_id"))).where(F.col("rank") <= k)


def nearest(rows: DataFrame, refs: DataFrame, k: int, role: str | None = None, exclude_self: bool = False) -> DataFrame:
    """The k nearest references of each row by Euclidean distance: id, ref_id, distance, rank. rows, refs: id, x array<float> and, with role, role.

    References are a sample that the caller bounds (fit_references): they travel to every task. Distances come from
    numpy in Arrow batches. Ties: the smaller ref_id. For whole tables: nearest_of_all().
    """
    pdf = _points(refs, role).orderBy("id").toPandas()
    held = rows.sparkSession.sparkContext.broadcast({r: (g["id"].to_numpy(), np.stack(g["x"].to_list())) for r, g in pdf.groupby("role")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r, g in pdf.groupby("role"):
                if r in held.value:
                    ids, m = held.value[r]
                    yield closest(np.stack(g["x"].to_list()), g["id"].to_numpy(), m, ids, k, exclude_self)

    return _best(_points(rows, role).mapInPandas(run, FOUND), k)


def nearest_of_all(rows: DataFrame, refs: DataFrame, k: int, role: str | None = None, exclude_self: bool = False, block: int = 20_000) -> DataFrame:
    """nearest() with references of any number, which stay on Spark: blocks of rows meet blocks of references, and the blocks' best merge. Exact, so the work grows with rows times references; the k * blocks best of a row are what is shuffled."""
    spark = rows.sparkSession
    r = max(1, -(-refs.count() // block))
    q = max(-(-int(spark.conf.get("spark.sql.shuffle.partitions")) // r), -(-rows.count() // block))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = _points(rows, role).withColumn("_q", deal(q)).withColumn("_r", every(r))
    b = _points(refs, role).withColumn("_r", deal(r)).withColumn("_q", every(q))

    def meet(x: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"id": [], "ref_id": [], "distance": []})]
        for own, g in x.groupby("role"):
            theirs = m[m["role"] == own]
            if len(theirs):
                parts.append(closest(np.stack(g["x"].to_list()), g["id"].to_numpy(), np.stack(theirs["x"].to_list()), theirs["id"].to_numpy(), k, exclude_self))
        return pd.concat(parts)

    return _best(a.groupBy("_q", "_r").cogroup(b.groupBy("_q", "_r")).applyInPandas(meet, FOUND), k)
