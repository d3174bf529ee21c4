"""Events of any shape: JSON lines as VARIANT values, flattened to a row for each key without a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.columns import col
from flowlens.sources.scratch import written

#: Levels that one pass over the lines opens; deeper values are opened by further passes over what is left.
LEVELS = 4

_OPEN = """
SELECT {keep}, CASE WHEN x.pos IS NULL THEN path ELSE concat_ws('_', path, coalesce(x.key, CAST(x.pos AS STRING))) END AS path, coalesce(x.value, v) AS v, x.pos IS NOT NULL AS opened
FROM {rows}, LATERAL variant_explode_outer(v) AS x
"""


def flatten_events(lines: DataFrame, line: str = "value", keep: list[str] | None = None, levels: int = LEVELS) -> DataFrame:
    """A row for each scalar of each JSON line: the columns in keep (default: all others), key, value (text) and kind.

    Keys of nested objects are joined by _, list items go by their place from 0; nothing is lost for want of a schema.
    kind is the value's type (STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID). A JSON null is a row with a null value;
    empty objects and lists have no rows, like null lines and lines that are no JSON. A line that is a scalar has key ''.
    Values may be nested to any depth: each pass opens `levels` of them in one go without a shuffle, and only what is
    deeper goes to the next pass. A key that occurs twice in one object makes the line invalid.
    """
    keep = [c for c in lines.columns if c != line] if keep is None else keep
    out, rest = None, lines.select(*keep, F.lit("").alias("path"), F.try_parse_json(col(line)).alias("v"))
    spark = lines.sparkSession
    while True:
        names = ", ".join(f"`{c}`" for c in keep) or "1 AS _"
        for _ in range(levels):
            rest = spark.sql(_OPEN.replace("{keep}", names), rows=rest)
        text = F.to_json("v")
        # What the last level opened may hold more; a string's JSON begins with a quote, so only containers match.
        deep = F.col("opened") & F.substring(text, 1, 1).isin("{", "[")
        done = written(rest.where("v IS NOT NULL").select(*keep, "path", F.when(deep, text).alias("more"), F.try_variant_get("v", "$", "string").alias("value"), F.regexp_extract(F.schema_of_variant("v"), r"^\w+", 0).alias("kind"), F.substring(text, 1, 1).isin("{", "[").alias("container")), "flat")
        leaves = done.where("NOT container").select(*keep, F.regexp_replace("path", "^_", "").alias("key"), "value", "kind")
        out = leaves if out is None else out.unionByName(leaves)
        left = done.where("more IS NOT NULL")
        if left.isEmpty():
            return out
        rest = left.select(*keep, "path", F.parse_json("more").alias("v"))


def key_profile(flat: DataFrame, id_col: str) -> DataFrame:
    """What flattened events hold: for each key the events that have it, values (null or not), nulls, distinct kinds and numeric values. List places count as one key (dns_answers_0_ttl as dns_answers_*_ttl)."""
    key = F.regexp_replace("key", r"(?<=^|_)\d+(?=_|$)", "*")
    numeric = F.col("kind").isin("BIGINT", "DECIMAL", "DOUBLE")
    return flat.groupBy(key.alias("key")).agg(F.count_distinct(id_col).alias("events"), F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"), F.count_if(numeric).alias("numbers"), F.count_distinct("kind").alias("kinds"))


def flat_text(flat: DataFrame, keys: list[str]) -> DataFrame:
    """keys and text: `k: v, k: v` of each event's pairs by key, with the separators ', ' and ' ; ' taken out of values. Missing values are left out. Groups are single events."""
    value = F.replace(F.replace(F.col("value"), F.lit(" ; "), F.lit(" ;")), F.lit(", "), F.lit(","))
    pairs = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("key", value.alias("v")))))
    return flat.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit(": "), p["v"])), ", ").alias("text"))
