"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode without that setting, a temporary folder; on a cluster the setting is required."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="flowlens-")
    return _local[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by drop_scratch()."""
    path = f"{scratch_root(spark)}/flowlens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a table in the shared folder: computed once, cut from its lineage, safe from lost executors. options: of the writer."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str, most: int = 250_000) -> DataFrame:
    """df dealt by keys to so many tasks that one gets about `most` of its `rows` rows, however large it is; what is grouped by the keys afterwards stays there."""
    return df.repartition(max(1, -(-rows // most), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if rows > most else 1), *keys)


def drop_scratch(spark: SparkSession) -> int:
    """Remove the scratch tables of this application; call it when their results have been written. Returns how many there were."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)
