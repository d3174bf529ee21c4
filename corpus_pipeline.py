"""A corpus pipeline: toxicity, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and gives what it reads
back to the next stage. All stages but the last return the columns of documents; other columns of docs are dropped.
An empty table gives an empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import scratch_path
from flowlens.llm.mixing import mix_sources
from flowlens.llm.ngram_join import keep_first
from flowlens.llm.packing import concat_and_cut
from flowlens.llm.substring import dedup_substrings
from flowlens.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled examples vote toxic go. Null and empty texts, and rows without an id, are scored like others; equal rows stay or go together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score_toxicity(docs, labels).where("tox_predicted = 0").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, of equal rows one; what is in no group (no words, no id) stays."""
    return keep_first(docs.select(COLUMNS), 5, 75)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut out; documents that lose all their words go.

    Null and short texts, and rows without an id, stay as they are. Equal rows get equal results; rows of one id do
    not cut each other. A text that loses words has the others joined by one space, and n_chars of that.
    """
    cut = F.col("n_removed") > 0
    out = dedup_substrings(docs.select(COLUMNS), 50).where("n_removed = 0 OR n_removed < n_words")
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("text"))
    return out.withColumns({"n_chars": F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")), "text": text}).select(COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: up to three times, or not at all.

    Null sources are one source. Texts without words weigh nothing: they are taken as often as their hash says. Equal
    rows are taken alike.
    """
    mixed = mix_sources(docs.select(COLUMNS)).where("mix_copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; a row for each piece of a document. Null and empty texts are the end token alone; repeated rows are packed as often as they occur; null ids stay null."""
    import public_tokenizers

    pieces = concat_and_cut(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, 1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("source_mix", source_mix), ("packing", packing)]

#: A tokeniser's ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
