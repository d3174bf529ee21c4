"""What the operators share: scratch tables, word rules and column checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.sources.scratch import drop_scratch, scratch_path, scratch_root, written

__all__ = ["SPACES", "WORD", "drop_scratch", "hash48", "partitions", "scratch_path", "scratch_root", "table", "word_count", "written"]

#: Characters between words: space and \x09 to \x0D.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str | Column) -> Column:
    """Number of words; null text: 0."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which the user sizes to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash48(value: Column, salt: str = "") -> Column:
    """A number under 2 ** 48 from the value's MD5; the same in any engine that has MD5."""
    text = F.concat(F.lit(salt), value.cast("string")) if salt else value.cast("string")
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")
