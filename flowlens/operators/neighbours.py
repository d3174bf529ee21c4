"""Exact nearest neighbours of whole tables, by pivot cells whose bounds leave most blocks of references unread."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.joins import FOUND, _best, _points, closest as nearest_in
from flowlens.sources.scratch import written

SLACK = 1e-9  # bounds are widened by it, as floating sums are not exact
SLICE = 8192  # visits that leave a task's Python at once


@dataclass
class Cells:
    """References in blocks of one role and one pivot's cell, and of neighbouring distances to that pivot."""

    refs: DataFrame  # id, x, block
    pivots: np.ndarray
    blocks: pd.DataFrame  # block, role, cell, n, lo, hi, place and shelf (blocks side by side, read at once): at most `most_blocks` and one for each cell and role


def distances(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Euclidean distances, by sums of squared differences: exact where copies must give 0."""
    return np.sqrt(np.stack([((x - p) ** 2).sum(1) for p in m], axis=1)) if len(m) else np.zeros((len(x), 0))


def few_copies(refs: DataFrame, k: int) -> DataFrame:
    """At most k rows of each role and vector, those of the smallest ids; parts of a vector's rows are cut first, so that copies without number meet in no task."""
    parts = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = refs.withColumns({"_salt": F.pmod(F.xxhash64("id"), F.lit(parts)), "_h": F.xxhash64("x")})
    for keys in (["role", "_h", "x", "_salt"], ["role", "_h", "x"]):
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("_n") <= k)
    return out.drop("_salt", "_h", "_n")


def index_cells(refs: DataFrame, k: int, role: str | None = None, pivots: int = 128, block: int = 4096, most_blocks: int = 65_536, shelf: int = 32_768) -> Cells:
    """References (id, x and, with role, role) as Cells for searches of up to k neighbours. Rows without a vector are left out.

    Pivots are at most `pivots` references with the smallest hashes. Blocks follow (role, cell, distance, id), so a cell
    of any size is cut into rings; they get larger beyond `most_blocks`, which bounds the table that tasks hold. Blocks of a role, up to about `shelf` references, share a shelf.
    """
    pts = written(few_copies(_points(refs, role).where("x IS NOT NULL AND role IS NOT NULL"), k + 1), "references")
    n = pts.count()
    chosen = pts.orderBy(F.xxhash64("x"), "id").limit(min(pivots, int(np.ceil(np.sqrt(n))))).toPandas()
    centers = np.stack(chosen["x"].to_list()) if len(chosen) else np.zeros((0, 0))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = distances(np.stack(pdf["x"].to_list()), centers)
                cell = d.argmin(1)
                yield pdf.assign(cell=cell.astype(np.int32), dist=d[np.arange(len(d)), cell])

    placed = pts.mapInPandas(place, "id long, x array<double>, role int, cell int, dist double")
    ranges = max(1, -(-n // max(block, -(-n // most_blocks))))
    dealt = placed.repartitionByRange(ranges, "role", "cell", "dist", "id").withColumn("_range", F.spark_partition_id())
    dealt = written(dealt.withColumn("block", F.concat_ws("-", "role", "cell", "_range")), "cells")
    blocks = dealt.groupBy("block", "role", "cell").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).orderBy("role", "cell", "lo", "block").toPandas()
    step = blocks.groupby("role")["n"].cumsum().sub(blocks["n"]) // shelf
    blocks["place"], blocks["shelf"] = np.arange(len(blocks), dtype=np.int32), blocks["role"].astype(str).str.cat(step.astype(str), "-").factorize()[0].astype(np.int32)
    return Cells(dealt.select("id", "x", "block"), centers, blocks)


def _wanted(rows: DataFrame, index: Cells, k: int, exclude_self: bool, give: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What give() makes of a few rows, the blocks of their role, and which row has to read which block."""
    spark, again = rows.sparkSession, "far" in rows.columns
    held = spark.sparkContext.broadcast((index.pivots, {r: g.reset_index(drop=True) for r, g in index.blocks.groupby("role")}))
    least = k + bool(exclude_self)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, roles = held.value
        for pdf in batches:
            for r, g in pdf.groupby("role"):
                if r not in roles:
                    continue
                b = roles[r]
                step = max(1, 500_000 // len(b))  # rows at a time, so that rows times blocks stay bounded
                for lo in range(0, len(g), step):
                    part = g.iloc[lo : lo + step]
                    d = distances(np.stack(part["x"].to_list()), pivots)
                    cells, home = b["cell"].to_numpy(), d.min(1)
                    mine = d[:, cells]
                    bound = np.maximum(np.maximum(mine - b["hi"].to_numpy(), b["lo"].to_numpy() - mine), (mine - home[:, None]) / 2)
                    bound = np.maximum(bound, 0)  # a reference is at least as near to its own pivot as to the row's: the last term
                    order = np.lexsort((np.abs(mine - (b["hi"] + b["lo"]).to_numpy() / 2), bound), axis=1)
                    before = np.cumsum(b["n"].to_numpy()[order], axis=1) - b["n"].to_numpy()[order]
                    first = np.zeros(bound.shape, bool)
                    np.put_along_axis(first, order, before < least, axis=1)
                    yield from give(part, b, ~first & (bound <= part["far"].to_numpy()[:, None] * (1 + SLACK) + SLACK) if again else first)

    return rows.mapInPandas(choose, schema)


def visits(rows: DataFrame, index: Cells, k: int, exclude_self: bool = False) -> DataFrame:
    """id, x and block. rows: id, x, role and, for the second round, far (a known bound of the k-th distance; infinite if none).

    Without far: the blocks with the least bounds that hold k references. With far: all other blocks that can hold
    a reference as near as that, by the triangle inequality on the distance to a block's pivot.
    """

    def give(part: pd.DataFrame, b: pd.DataFrame, want: np.ndarray) -> Iterator[pd.DataFrame]:
        at, which = np.nonzero(want)
        for lo in range(0, len(at), SLICE):  # a slice has a vector for each visit
            i, j = at[lo : lo + SLICE], which[lo : lo + SLICE]
            yield pd.DataFrame({"id": part["id"].to_numpy()[i], "x": part["x"].to_numpy()[i], "block": b["block"].to_numpy()[j]})

    return _wanted(rows, index, k, exclude_self, give, "id long, x array<double>, block string")


def calls(rows: DataFrame, index: Cells, k: int, exclude_self: bool = False) -> DataFrame:
    """visits() by shelves of blocks: id, x, shelf, base (its first block's place) and want, a byte for each of its blocks. A row's vector goes to each shelf once."""

    def give(part: pd.DataFrame, b: pd.DataFrame, want: np.ndarray) -> Iterator[pd.DataFrame]:
        shelf, place = b["shelf"].to_numpy(), b["place"].to_numpy()
        start = np.flatnonzero(np.append(True, shelf[1:] != shelf[:-1]))
        end = np.append(start[1:], len(b))
        at, which = np.nonzero(np.logical_or.reduceat(want, start, axis=1))
        for lo in range(0, len(at), SLICE):
            i, j = at[lo : lo + SLICE], which[lo : lo + SLICE]
            marks = [want[p, start[q] : end[q]].tobytes() for p, q in zip(i, j, strict=True)]
            yield pd.DataFrame({"id": part["id"].to_numpy()[i], "x": part["x"].to_numpy()[i], "shelf": shelf[start[j]], "base": place[start[j]], "want": marks})

    return _wanted(rows, index, k, exclude_self, give, "id long, x array<double>, shelf int, base int, want binary")


def nearest_on_shelf(x: pd.DataFrame, m: pd.DataFrame, k: int, exclude_self: bool) -> pd.DataFrame:
    """The k nearest references of a shelf (id, x, place) to each row that calls on it, over the blocks that it wants."""
    rows, own, want = np.stack(x["x"].to_list()), x["id"].to_numpy(), np.frombuffer(b"".join(x["want"]), bool).reshape(len(x), -1)
    m = m.sort_values("place", kind="stable")
    refs, ids, edges = np.stack(m["x"].to_list()), m["id"].to_numpy(), np.searchsorted(m["place"], x["base"].iloc[0] + np.arange(want.shape[1] + 1))
    groups = np.unique(want, axis=0, return_inverse=True)[1].ravel() if len(x) > 1 else np.zeros(1, int)
    alike = np.bincount(groups).min() * want.shape[1] >= 4096  # whole crowds want the same blocks: they meet these at once
    found = []
    for g in range(groups.max() + 1 if alike else want.shape[1]):
        who = np.flatnonzero(groups == g) if alike else np.flatnonzero(want[:, g])
        blocks = np.flatnonzero(want[who[0]]) if alike and len(who) else [g]
        at = np.concatenate([np.arange(edges[j], edges[j + 1]) for j in blocks]) if len(blocks) else np.zeros(0, int)
        if len(who) and len(at):
            found.append(nearest_in(rows[who], own[who], refs[at], ids[at], k, exclude_self))
    if not found:
        return pd.DataFrame({"id": np.zeros(0, np.int64), "ref_id": np.zeros(0, np.int64), "distance": np.zeros(0)})
    out = pd.concat(found).sort_values(["id", "distance", "ref_id"], kind="stable")
    return out[out.groupby("id").cumcount() < k]


def _search(asked: DataFrame, index: Cells, k: int, exclude_self: bool, crowd: int) -> DataFrame:
    """The k best of each call. A shelf that many rows call on is given out once for each `crowd` of them."""
    counted = asked.groupBy("shelf").agg(F.ceil(F.count("*") / crowd).cast("int").alias("_parts"))  # a row for each shelf
    a = asked.join(counted, "shelf").withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).drop("_parts")
    places = asked.sparkSession.createDataFrame(index.blocks[["block", "shelf", "place"]], "block string, shelf int, place int")
    b = index.refs.join(F.broadcast(places), "block").drop("block")  # a row for each block
    b = b.join(counted, "shelf").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")

    def meet(x: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(m):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "ref_id": np.zeros(0, np.int64), "distance": np.zeros(0)})
        return nearest_on_shelf(x, m, k, exclude_self)

    return a.groupBy("shelf", "_part").cogroup(b.groupBy("shelf", "_part")).applyInPandas(meet, FOUND)


def nearest_by_cells(rows: DataFrame, refs: DataFrame, k: int, role: str | None = None, exclude_self: bool = False, pivots: int = 128, block: int = 4096, crowd: int = 8192, index: Cells | None = None) -> DataFrame:
    """joins.nearest_of_all() without meeting every block: id, ref_id, distance, rank of the k nearest references, exactly; ties: the smaller ref_id.

    Two rounds. Each row searches the blocks nearest by their bounds; its k-th distance there then rules out the blocks
    that can't hold a nearer reference. Ids are unique among rows and among references. Rows without a vector or role
    have no neighbours; with fewer than k references there are fewer ranks. Spread-out vectors of many dimensions
    prune little, and the work nears rows times references.
    """
    index = index or index_cells(refs, k, role, pivots, block)
    pts = written(_points(rows, role).where("x IS NOT NULL AND role IS NOT NULL"), "rows")
    first = written(_search(written(calls(pts, index, k, exclude_self), "calls"), index, k, exclude_self, crowd), "near")
    kth = first.groupBy("id").agg(F.array_sort(F.collect_list("distance")).alias("_d"))  # a few blocks' k each
    far = F.when(F.size("_d") >= k, F.element_at("_d", k)).otherwise(float("inf"))
    bound = pts.join(kth, "id", "left").withColumn("far", F.coalesce(far, F.lit(float("inf")))).drop("_d")
    more = _search(written(calls(bound, index, k, exclude_self), "calls"), index, k, exclude_self, crowd)
    return _best(first.unionByName(more), k)
