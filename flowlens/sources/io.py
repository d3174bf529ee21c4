"""Readers of flow files and sensor logs, and the stores that stages hand over."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.clean import DataError, require_columns


def read_flow_csv(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """A CSV with a header, all columns text; with required, missing names are an error."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    df = df.toDF(*[c.strip() for c in df.columns])
    if required:
        require_columns(df, required, path)
    return df


def read_flow_parquet(spark: SparkSession, path: str, day: str | None = None, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.where(F.col("day") == day) if day is not None else df
    return df.select(*columns) if columns else df


def read_eve(spark: SparkSession, path: str) -> DataFrame:
    """Lines with seq: file, then place in the file's splits."""
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("seq"))


def read_zeek(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated log with the names of its #fields line; - and (empty) are null and ''."""
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith("#fields")).first()
    if head is None:
        raise DataError(f"{path} has no #fields line")
    names = head["value"].split("\t")[1:]
    parts = F.split("value", "\t")
    clean = lambda c: F.when(c == "(empty)", "").when(c != "-", c)
    return lines.where(~F.col("value").startswith("#")).select(*[clean(parts[i]).alias(n) for i, n in enumerate(names)])


def read_first(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of several spellings of a CSV's path that can be read."""
    for p in paths:
        try:
            return read_flow_csv(spark, p)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise DataError(f"none of {', '.join(paths)} is there")


#: What a schedule's columns may hold.
DOMAINS = {"direction": {"one", "any"}, "outside_window": {"keep", "drop"}}


def load_schedule(spark: SparkSession, path: str, days: list[str]) -> DataFrame:
    df = read_flow_csv(spark, path, ["day", "label", "attacker", "victim", "start", "end", "direction", "outside_window"])
    for c, allowed in {**DOMAINS, "day": set(days)}.items():
        bad = [r[c] for r in df.where(~F.coalesce(F.col(c), F.lit("")).isin(list(allowed))).select(c).distinct().limit(5).collect()]
        if bad:
            raise DataError(f"{path}: {c} can't be {bad}")
    return df


def read_traffic_labels(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Latin-1 CSVs with padded names: some columns, rows with a label."""
    df = spark.read.csv(path, header=True, encoding="ISO-8859-1", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.toDF(*[c.strip() for c in df.columns]).select(*columns).dropna(subset=[columns[-1]])


def column_map(text: str) -> dict[str, str]:
    """{theirs: ours} from JSON."""
    m = json.loads(text)
    if not isinstance(m, dict) or not all(isinstance(k, str) and isinstance(v, str) for k, v in m.items()):
        raise DataError("a column map is an object of strings")
    return m


def cached_day(spark: SparkSession, path: str, day: str, make) -> DataFrame:
    """The cleaned day under path/day=..., made first if it is not there."""
    at = f"{path}/day={day}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def write_splits(df: DataFrame, path: str) -> None:
    """Partitioned by split and day."""
    df.write.mode("overwrite").partitionBy("split", "day").parquet(path)


def read_splits(spark: SparkSession, path: str, split: str, day: str | None = None) -> DataFrame:
    """The rows of a split (of a day); other folders are not read."""
    rows = spark.read.parquet(path).where(F.col("split") == split)
    return rows.where(F.col("day") == day) if day is not None else rows


def write_scores(df: DataFrame, path: str) -> None:
    """Partitioned by method and seed; a partition that is written again is replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "seed").parquet(path)


def read_scores(spark: SparkSession, path: str, labels: DataFrame, row_id: str, method: str | None = None) -> DataFrame:
    """Scores with the columns of labels; a score without a label, or a labelled row without a score, is an error."""
    scores = spark.read.parquet(path)
    scores = scores.where(F.col("method") == method) if method is not None else scores
    both = scores.join(labels.withColumn("_known", F.lit(True)), row_id, "full_outer")
    odd = both.where("_known IS NULL OR method IS NULL").agg(F.count("*").alias("n")).first()["n"]
    if odd:
        raise DataError(f"{path}: {odd} rows have a score or a label only")
    return both.drop("_known")


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Metric tables, or the scored and the rejected rows of a batch, as CSV with headers: a folder for each name."""
    for name, df in tables.items():
        plain = [F.to_json(c).alias(c) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c) for c, f in zip(df.columns, df.schema, strict=True)]
        df.select(*plain).write.mode("overwrite").csv(f"{path}/{name}", header=True)


def checksum(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order: the sum of their hashes, and their number."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.sha2(F.to_json(F.struct(*df.columns)), 256), 1, 12), 16, 10).cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}:{r['s']}"


VERSION = 1


def save_bundle(spark: SparkSession, path: str, tables: dict[str, DataFrame], about: dict) -> None:
    """Model tables as Parquet and a manifest with their checksums."""
    sums = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        sums[name] = checksum(spark.read.parquet(f"{path}/{name}"))
    manifest = {"version": VERSION, "tables": sums, "about": about}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_bundle(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables and what was saved about them; another version or another checksum is an error."""
    m = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/manifest").collect()))
    if m["version"] != VERSION:
        raise DataError(f"{path} has version {m['version']}, not {VERSION}")
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in m["tables"]}
    for n, s in m["tables"].items():
        if checksum(tables[n]) != s:
            raise DataError(f"{PurePosixPath(path).name}: table {n} does not have its checksum")
    return tables, m["about"]


def day_manifest(df: DataFrame, day: str, attack: str) -> DataFrame:
    return df.groupBy(day).agg(F.count("*").alias("rows"), F.sum(F.col(attack).cast("long")).alias("attacks"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
