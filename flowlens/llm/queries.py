"""The numbered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.audio import fingerprint_turns, match_recordings
from flowlens.llm.common import table, written
from flowlens.llm import language
from flowlens.llm.licenses import scan_licenses
from flowlens.llm.merkle import merkle_manifest, op12_sql
from flowlens.llm.mixing import OP10_SQL, mix_sources
from flowlens.llm.ngram_join import ngram_components
from flowlens.llm.packing import concat_and_cut
from flowlens.llm.search import bm25_search
from flowlens.llm.sharding import shard
from flowlens.llm.substring import dedup_substrings
from flowlens.llm.toxicity import held_out, score_toxicity
from flowlens.llm.trie import CRC32_SQL, OP11_SQL, conversation_trie
from flowlens.llm.warc import page_round_trip


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 50-word windows that an earlier document has."""
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), 50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations played as recordings: their classes, and where those with an id divisible by 50 align with others."""
    prints = written(fingerprint_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")), "prints")
    return match_recordings(prints, prints.where("rec_id % 50 = 0"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the toxicity that their nearest labelled examples vote for."""
    scored = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted"), F.slice("tox_evidence", 1, 3).alias("evidence"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens; a row for each piece."""
    import public_tokenizers

    pieces = concat_and_cut(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048, 1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document with an id divisible by 50 the ten best of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bm25_search(docs, docs.where("doc_id % 50 = 0"), 10).drop("query_key")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the component of near duplicates that each is in."""
    return ngram_components(table(spark, sf_dir, "documents"), 5, 75)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through WARC archives and back."""
    return page_round_trip(spark, table(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal bytes; a row for each document."""
    out = shard(table(spark, sf_dir, "documents"), 16, keep=["doc_id"])
    return out.select("doc_id", F.col("shard_size").alias("size"), F.col("shard_crc32").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, and how many words of each the mix takes."""
    mixed = mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the root of their manifest, with what their proofs say."""
    return merkle_manifest(table(spark, sf_dir, "documents"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the language that the field reads in them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~language.held_out() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang"))
    out = language.identify_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.size("lang_spans").alias("runs"))


QUERIES = {"op1_substring": op1_substring, "op2_audio": op2_audio, "op3_toxicity": op3_toxicity, "op4_packing": op4_packing, "op5_search": op5_search, "op6_licenses": op6_licenses, "op7_ngram_join": op7_ngram_join, "op8_warc": op8_warc, "op9_sharding": op9_sharding, "op10_mixing": op10_mixing, "op11_trie": op11_trie, "op12_merkle": op12_merkle, "op13_language": op13_language}

#: All windows as texts, their smallest documents, and the words that no repeated window covers.
OP1_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS s FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 48)) AS i)),
least AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (s) WHERE doc_id > first)),
kept AS (SELECT doc_id, p, word FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) ANTI JOIN gone USING (doc_id, p)),
texts AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM kept GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN texts USING (doc_id)
"""

#: Base 32 from the hexadecimal digest: each five digits are four characters.
OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda c: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 1 + 5 * CAST(floor(c / 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (c % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
 CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM d
"""

#: Scores of every document that shares a word.
OP5_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
t AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS word FROM w) GROUP BY ALL),
n AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS mean FROM w), f AS (SELECT word, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM t, n GROUP BY word, n),
i AS (SELECT doc_id, word, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75 * len(ws) / mean)) AS impact FROM t JOIN w USING (doc_id), n),
s AS (SELECT q.doc_id AS query_id, i.doc_id, round(sum(q.tf * idf * impact), 6) AS score FROM t q JOIN f USING (word) JOIN i USING (word) WHERE q.doc_id % 50 = 0 GROUP BY ALL)
SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""

#: Overlaps from shared shingles; what links reach from each document.
OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""

SQL = {"op1_substring": OP1_SQL, "op5_search": OP5_SQL, "op7_ngram_join": OP7_SQL, "op8_warc": OP8_SQL, "op10_mixing": OP10_SQL, "op11_trie": OP11_SQL, "op12_merkle": op12_sql(CRC32_SQL)}
