"""Mixing sources to target weights by nested hash thresholds.

Every row has a hash. The sizes are summed by source and hash bucket; the bucket in which a source's budget ends is
refined by the next bits of the hash, and so on, until one hash value is left. Rows under the threshold are taken by
a filter: nothing is sorted. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import hash48, word_count, written

#: Bits of the hash that each level of the histograms looks at, and levels.
BITS, LEVELS = 12, 4


def row_hash(id_col: str, text_col: str) -> Column:
    """Of the id; rows without one are told apart by their text."""
    return hash48(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("t:"), F.coalesce(F.col(text_col), F.lit("")))), "mix:")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """One row for each source: source, source_size, target, whole (full passes) and rest (words of the last, partial pass).

    Sources in order of code points, null last, weigh weights[0], weights[1], ... and again from the start. They
    share `share` of all words by weight; no target exceeds cap times its source, and what is over goes to the
    others by weight. Sorted by the share at which each reaches its cap, the first that stays below gives the level.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))  # from here on one row for each source
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = total.withColumn("rank", rank).withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % n + 1).cast("int")))
    caps = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("full_at", F.col("most") / F.col("w"))
    order = Window.orderBy("full_at", "rank")
    budget = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (budget - before) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    found = caps.withColumn("pos", F.row_number().over(order)).withColumn("level", level).withColumn("below", F.col("level") <= F.col("full_at"))
    every = Window.partitionBy()
    first = F.min(F.when(F.col("below"), F.col("pos"))).over(every)
    at = F.max(F.when(F.col("pos") == F.col("first"), F.col("level"))).over(every)
    filled = found.withColumn("first", first).withColumn("at", at)
    target = F.when(F.col("first").isNull() | (F.col("pos") < F.col("first")), F.col("most")).otherwise(F.col("w") * F.col("at"))
    out = filled.select("source", "source_size", target.alias("target"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return out.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with `below`: the partial pass takes the rows whose hash is less. sizes: source, size, h.

    Each level writes one row for each source. The row at which the budget ends is taken if that comes nearer.
    """
    state = targets.withColumn("prefix", F.lit(0).cast("long")).withColumn("need", F.col("rest"))
    for k in range(LEVELS):
        state = written(state.drop("n"), f"threshold{k}")
        shift = BITS * (LEVELS - 1 - k)
        here = sizes.join(state.select(F.col("source").alias("s"), "prefix"), F.col("source").eqNullSafe(F.col("s")))
        inside = here.where(F.shiftright("h", shift + BITS) == F.col("prefix")).withColumn("cell", F.shiftright("h", shift))
        cells = inside.groupBy("source", "cell").agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("cell"))  # at most 2 ** BITS rows for each source
        sums = cells.withColumn("upto", upto).select(F.col("source").alias("s"), "cell", "n", "upto")
        ends = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").where(F.col("s").isNull() | (F.col("upto") > F.col("need")))
        first = F.min_by(F.struct("cell", "n", "upto"), "cell").alias("x")
        state = (
            ends.groupBy("source", "source_size", "target", "whole", "rest", "need")
            .agg(first)
            .select("source", "source_size", "target", "whole", "rest", F.coalesce("x.cell", F.lit(0)).cast("long").alias("prefix"), (F.col("need") - F.coalesce(F.col("x.upto") - F.col("x.n"), F.lit(0))).alias("need"), F.coalesce("x.n", F.lit(0)).alias("n"))
        )
    nearer = F.col("n") - F.col("need") < F.col("need")
    return state.select("source", "source_size", "target", "whole", (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("below"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Rows of docs (the columns in keep, or all) with mix_size (words), mix_source_size, mix_target (of the row's source) and mix_copies (how often the mix takes the row).

    Every row returns. A null or empty text has size 0 and takes no part in the sums; null sources are one source,
    the last. Repeated rows (one id) have one hash and are taken or left together; rows without an id are told apart
    by their text. An empty table gives no row. Columns of docs named like the new ones are replaced, others kept as
    they are. A row is taken `whole` times, and once more if its hash is under its source's threshold, so never more
    than cap times. The choice depends on ids and sizes alone: reruns agree. Without the text among the columns to
    keep, texts are read once.
    """
    made = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]
    columns = [c for c in (keep or docs.columns) if c not in made]
    # One struct of the columns to keep: none of them can clash with the names used here.
    row = docs.select(F.struct(*columns).alias("row"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), row_hash(id_col, text_col).alias("h"))
    if text_col not in columns:
        row = written(row, "rows")
    sizes = row.select("source", "size", "h") if text_col not in columns else written(row.select("source", "size", "h"), "sizes")
    targets = written(source_targets(sizes, weights, share, cap), "targets")
    limits = written(thresholds(sizes, targets), "limits").withColumnRenamed("source", "s")
    # One row for each source, of a size that Spark knows from the files: it broadcasts them if they are few.
    joined = row.join(limits, F.col("source").eqNullSafe(F.col("s")))
    copies = (F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)).cast("long")
    return joined.select("row.*", F.col("size").alias("mix_size"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), copies.alias("mix_copies"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w,
             row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
c AS (SELECT *, source_size * 3.0::DOUBLE AS most, source_size * 3.0::DOUBLE / w AS full_at FROM r),
f AS (SELECT *, row_number() OVER (ORDER BY full_at, rank) AS pos,
             (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY full_at, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
l AS (SELECT min_by(level, pos) AS level, min(pos) AS first FROM f WHERE level <= full_at),
t AS (SELECT source, source_size, CASE WHEN first IS NULL OR pos < first THEN most ELSE w * l.level END AS target FROM f CROSS JOIN l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
x AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN upto <= rest OR (upto - size <= rest AND upto - rest < rest - (upto - size)) THEN 1 ELSE 0 END) AS taken
FROM x
"""
