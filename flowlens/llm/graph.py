"""Connected components as Spark joins: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import written


def _sign(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"] or 0


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges: u, v (long). Returns node, component (its smallest node) for every node of an edge between two nodes.

    Each round points a node's larger neighbours, then its smaller ones, to the smallest node among them. The
    minimum is a grouped aggregate joined back, so no neighbourhood is gathered in one task. Rounds grow with the
    logarithm of the components' sizes; each is a table in the shared folder.
    """
    cur = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    sign = _sign(cur)
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        before, sign = sign, _sign(cur)
        if sign == before:
            break
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
