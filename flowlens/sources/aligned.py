"""Stores that fit together: splits, scores and labels as tables bucketed and sorted by row id, which join without a shuffle; and CSV files read in bounded chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.clean import DataError, require_columns


def write_aligned(df: DataFrame, table: str, key: str, buckets: int = 64, path: str | None = None) -> None:
    """df as a table of the catalogue, in `buckets` files sorted by key: dealt out once, when it is written. Tables that are to fit together need the same number. path: where its files go; else the warehouse, which driver and executors share."""
    writer = df.repartition(buckets, key).sortWithinPartitions(key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def fitted(spark: SparkSession, left: str, right: str, key: str) -> DataFrame:
    """All rows of two stores side by side by key (left columns, then right ones): a merge of buckets, without a shuffle (tasks sort what the files hold in order). Keys of one side only have nulls on the other."""
    a, b = spark.table(left), spark.table(right)
    twice = sorted(set(a.columns) & set(b.columns) - {key})
    if twice:
        raise DataError(f"{left} and {right} both have {', '.join(twice)}")
    return a.hint("merge").join(b, key, "full_outer")


def check_fit(spark: SparkSession, left: str, right: str, key: str, left_label: str | None = None, right_label: str | None = None) -> DataFrame:
    """fitted(), if the stores have the same keys, once each, and equal labels (where both are named); else an error with the counts."""
    a, b = spark.table(left), spark.table(right)
    own = a.select(key, F.lit(1).alias("_l"), *([F.col(left_label).alias("_a")] if left_label else []))
    other = b.select(key, F.lit(1).alias("_r"), *([F.col(right_label).alias("_b")] if right_label else []))
    both = own.hint("merge").join(other, key, "full_outer")
    odd = {"only_left": F.count_if(F.col("_r").isNull()), "only_right": F.count_if(F.col("_l").isNull())}
    if left_label and right_label:
        odd["differ"] = F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b")))
    found = both.agg(F.count("*").alias("rows"), *[c.alias(n) for n, c in odd.items()]).first().asDict()
    found["repeated"] = sum(t.groupBy(key).count().where("count > 1 OR " + f"`{key}` IS NULL").count() for t in (a, b))
    if any(found[n] for n in (*odd, "repeated")):
        raise DataError(f"{left} and {right} do not fit: {found}")
    return fitted(spark, left, right, key)


def scan_csv(spark: SparkSession, path: str, required: list[str], role_column: str | None = None, column_map: dict[str, str] | None = None, chunk: int = 64 << 20) -> DataFrame:
    """A stream over the CSV files under path, as text, in micro-batches of about `chunk` bytes (and one file at least).

    Names come from the header, which all files share; they are stripped and renamed by column_map (theirs: ours), and
    role_column becomes given_role. Run it with trigger(availableNow=True): it ends when all is read, and goes on from
    its checkpoint with the files that have come since.
    """
    names = spark.read.option("header", True).csv(path).columns
    raw = spark.readStream.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).option("header", True).option("maxBytesPerTrigger", chunk).csv(path)
    renamed = {n: (column_map or {}).get(n.strip(), n.strip()) for n in names}
    if role_column:
        renamed = {n: "given_role" if r == role_column else r for n, r in renamed.items()}
    out = raw.withColumnsRenamed(renamed)
    require_columns(out, [*required, *(["given_role"] if role_column else [])], path)
    return out
