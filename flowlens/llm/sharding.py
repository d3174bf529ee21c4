"""Sharding by a histogram sort: shards of equal bytes, equal texts side by side.

Rows are ordered by a hash of their text, then by id. Exact counts of the bytes below candidate boundaries come from
histograms of the key's bits; only the cells that hold a wanted boundary are counted again by the next bits, until
every boundary is known. Then the rows move once, to ranges of equal bytes, and are numbered there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import hash48, partitions, written

BITS, LEVELS = 12, 4
#: A boundary moves to the edge of a group of equal texts if that is within this part of a shard.
TOLERANCE = 0.01


def _locate(keys: DataFrame, key: str, width: int, wanted: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """For each (group, bytes) the cell of `key` in which so many bytes are reached: (key, bytes below it in the group, bytes in it).

    keys: columns group, `key` (under 2 ** width) and size. One pass for each BITS; what returns to the driver is one row for each wanted boundary.
    """
    spark, levels = keys.sparkSession, -(-width // BITS)
    state = [(i, g, 0, n) for i, (g, n) in enumerate(wanted)]  # boundary, group, prefix, bytes still below
    found: list[tuple[int, int, int]] = [(0, 0, 0)] * len(wanted)
    below = [0] * len(wanted)
    for k in range(levels):
        shift = BITS * (levels - 1 - k)
        ask = spark.createDataFrame(state, "i int, g long, prefix long, need long")
        open_cells = F.broadcast(ask.select("g", "prefix").distinct())  # no more rows than boundaries
        inside = keys.withColumn("cell", F.shiftright(key, shift)).join(open_cells, (F.col("group") == F.col("g")) & (F.shiftright(F.col(key), shift + BITS) == F.col("prefix")))
        cells = inside.groupBy("g", "prefix", "cell").agg(F.sum("size").alias("n"))
        sums = cells.withColumn("upto", F.sum("n").over(Window.partitionBy("g", "prefix").orderBy("cell")))
        hit = ask.join(sums, ["g", "prefix"]).where((F.col("upto") > F.col("need")) & (F.col("upto") - F.col("n") <= F.col("need")))
        state = []
        for r in hit.select("i", "g", "cell", "n", "upto", "need").collect():
            under = r["upto"] - r["n"]
            below[r["i"]] += under
            found[r["i"]] = (r["cell"], below[r["i"]], r["n"])
            state.append((r["i"], r["g"], r["cell"], r["need"] - under))
    return found


def boundaries(keys: DataFrame, shards: int, ranges: int) -> list[tuple[int, int, int]]:
    """shards * ranges - 1 sorted boundaries as (hash, id, range): rows of at least (hash, id) belong to range or later.

    keys: h, i (the id as a number from 0), size. A boundary between shards lies at the edge of a group of equal
    texts if one is within TOLERANCE, else inside the group at the nearest row.
    """
    total = keys.agg(F.sum("size").alias("n")).first()["n"] or 0
    parts = shards * ranges
    if not total:
        return []
    wanted = [total * j // parts for j in range(1, parts)]
    slack = TOLERANCE * total / shards
    at_hash = _locate(keys.withColumn("group", F.lit(0).cast("long")), "h", BITS * LEVELS, [(0, n) for n in wanted])
    out: dict[int, tuple[int, int]] = {}
    inner: list[tuple[int, int, int]] = []
    for j, (n, (h, below, inside)) in enumerate(zip(wanted, at_hash, strict=True), 1):
        down, up = n - below, below + inside - n
        if min(down, up) <= slack:
            out[j] = (h, 0) if down <= up else (h + 1, 0)
        else:
            inner.append((j, h, n - below))
    if inner:
        at_id = _locate(keys.withColumn("group", F.col("h")), "i", 60, [(h, n) for _, h, n in inner])
        for (j, h, n), (i, below, inside) in zip(inner, at_id, strict=True):
            out[j] = (h, i) if n - below <= below + inside - n else (h, i + 1)
    return [(*out[j], j) for j in sorted(out)]


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows of docs (the columns in keep, or all) with shard_size, shard_crc32, shard and slot.

    The law is `bytes`: each row counts the UTF-8 bytes of its text plus 1 (null: 1), and the shards' sums differ by
    about 2 * TOLERANCE or one row (or the rows of one id and text, which stay together). slot numbers a shard's rows from 0 without gaps, in order of (hash of text, id).
    Equal texts, however many, lie side by side and in one shard unless a boundary would miss the tolerance; null
    and empty texts count as equal. Ids may be null or repeat (null first; ties in any order). An empty table gives
    no row. Columns of docs named like the new ones are replaced.
    """
    made = ["shard_size", "shard_crc32", "shard", "slot"]
    columns = [c for c in (keep or docs.columns) if c not in made]
    text = F.coalesce(F.col(text_col), F.lit(""))
    number = F.coalesce(F.col(id_col).cast("long") + F.lit(1 << 59), F.lit(0))
    # One struct of the columns to keep: none of them can clash with the names used here.
    row = docs.select(F.struct(*columns).alias("row"), hash48(text).alias("h"), number.alias("i"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc32"))
    keys = written(row.select("h", "i", "size"), "keys")
    spark = docs.sparkSession
    ranges = max(1, -(-partitions(spark) // shards))
    cuts = boundaries(keys, shards, ranges)
    # Boundaries by the hash's first bits: a row compares itself with those of its own cell only.
    cells: list[tuple[int, int, list[tuple[int, int, int]]]] = []
    last, top = 0, BITS * (LEVELS - 1)
    by_cell: dict[int, list[tuple[int, int, int]]] = {}
    for c in cuts:
        by_cell.setdefault(c[0] >> top, []).append(c)
    for cell in range(1 << BITS):
        cells.append((cell, last, by_cell.get(cell, [])))
        last = by_cell[cell][-1][2] if cell in by_cell else last
    lookup = F.broadcast(spark.createDataFrame(cells, "cell long, base int, cuts array<struct<h:long,i:long,j:int>>"))  # 2 ** BITS rows and the boundaries

    def ranged(df: DataFrame) -> DataFrame:
        passed = F.filter("cuts", lambda c: (c.h < F.col("h")) | ((c.h == F.col("h")) & (c.i <= F.col("i"))))
        at = F.greatest("base", F.coalesce(F.array_max(F.transform(passed, lambda c: c.j)), F.lit(0)))
        return df.join(lookup, F.shiftright("h", top) == F.col("cell")).withColumn("range", at).drop("cell", "base", "cuts")

    counts = {r["range"]: r["n"] for r in ranged(keys).groupBy("range").agg(F.count("*").alias("n")).collect()}  # one row for each range
    bases, seen = [], 0
    for r in range(shards * ranges):
        seen = 0 if r % ranges == 0 else seen
        bases.append((r, seen))
        seen += counts.get(r, 0)
    first = F.broadcast(spark.createDataFrame(bases, "range int, first long"))
    slot = F.row_number().over(Window.partitionBy("range").orderBy("h", "i")) - 1 + F.col("first")
    placed = ranged(row).join(first, "range")
    return placed.select("row.*", F.col("size").alias("shard_size"), F.col("crc32").alias("shard_crc32"), F.floor(F.col("range") / ranges).cast("int").alias("shard"), slot.cast("long").alias("slot"))
