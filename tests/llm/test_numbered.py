"""The numbered queries as registered: columns, types and rows, against DuckDB or plain Python on the smallest tables; the pipeline's stages against brute force."""

import collections
import sys
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from test_queries import TABLES, plain  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return [(r[0], r[1]) for r in duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op1_substring", "op5_search", "op7_ngram_join", "op8_warc", "op10_mixing", "op11_trie", "op12_merkle"])
def test_query_with_sql(spark, duck, name):
    from flowlens.llm.queries import QUERIES, SQL

    got, want = plain(QUERIES[name](spark, DATA).toPandas()), plain(duck.sql(SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        if not same.all() and got[c].dtype.kind == "f":
            same |= (got[c] - want[c]).abs() <= 2e-6 * (1 + want[c].abs())
        assert same.all(), (c, got[~same].head(), want[~same].head())


def types(df):
    return dict(df.dtypes)


def test_op3(spark, documents):
    from flowlens.llm.queries import op3_toxicity

    out = op3_toxicity(spark, DATA)
    assert {c: types(out)[c] for c in ("doc_id", "held_out", "score", "predicted")} == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_op4(spark, documents):
    import numpy as np
    from tokenizers import Tokenizer

    import public_tokenizers
    from flowlens.llm.queries import op4_packing

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in documents}
    out = op4_packing(spark, DATA)
    assert types(out) == {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    seen, filled = collections.defaultdict(list), collections.defaultdict(list)
    for r in out.collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        seen[r.doc_id].append((r.start, r.length))
        filled[r.sequence_id].append((r.offset, r.length))
    whole = lambda parts: all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:])) and min(parts)[0] == 0
    assert set(seen) == set(ids) and all(whole(p) and sum(n for _, n in p) == len(ids[i]) for i, p in seen.items())
    assert all(whole(p) and sum(n for _, n in p) <= 2048 for p in filled.values())
    assert len(filled) == -(-sum(map(len, ids.values())) // 2048)


def test_op9(spark, documents):
    from flowlens.llm.queries import op9_sharding

    out = op9_sharding(spark, DATA)
    assert types(out) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    rows = out.collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in documents)
    slots, sizes = collections.defaultdict(list), collections.Counter()
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - sum(sizes.values()) / 16 <= max(r["size"] for r in rows)


def test_op2_and_op6(spark):
    from flowlens.llm.queries import op2_audio, op6_licenses

    out = op2_audio(spark, DATA).collect()
    members = {r.rec_id: r.query_id for r in out if r.kind == "member"}
    assert members and all(members[c] == c and c <= i for i, c in members.items())
    found = op6_licenses(spark, DATA)
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    from flowlens.llm.licenses import TEMPLATES

    for r in found.collect():
        part = texts[r.doc_id].encode()[r.start_byte : r.end_byte].decode()
        assert r.coverage >= 0.8 and (r.license not in TEMPLATES or abs(len(part.split()) - len(TEMPLATES[r.license].split())) <= 8)


def test_pipeline_by_brute_force(spark, tmp_path):
    """near_duplicates, repeated_passages and source_mix keep what plain Python keeps; packing holds every token of what is left."""
    pipeline = pytest.importorskip("corpus_pipeline")
    import random

    from test_documents import substrings

    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    base, passage = text(90), text(60)
    rows = [(1, base), (2, base), (3, base + " more words"), (4, text(30)), (5, f"{text(20)} {passage} {text(9)}"), (6, f"{text(8)} {passage} {text(30)}"), (7, passage), (8, ""), (9, None), (4, text(25)), (10, "few words"), (11, "few words")]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.near_duplicates(spark, docs, DATA)
    # The first row of each component, and every row without words.
    want = []
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        similar = [r for r in want if r[1] and t and _linked(r[1], t)]
        if not t or not similar:
            want.append((i, t))
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want))
    cut = {(r.doc_id, r.text) for r in pipeline.repeated_passages(spark, kept, DATA).collect()}
    expected = set()
    for (i, n, gone, left), count in substrings([(i, t) for i, t in want], 50).items():
        own = [t for j, t in want if j == i and len((t or "").split()) == n]
        if not gone or gone < n:
            expected |= {(i, left if gone else t) for t in own}
    assert cut == expected
    left = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in sorted(cut, key=str)], docs.schema)
    mixed = pipeline.source_mix(spark, left, DATA)
    assert mixed.columns == pipeline.COLUMNS and {r.doc_id for r in mixed.collect()} <= {i for i, _ in cut}
    packed = pipeline.packing(spark, mixed, DATA)
    assert packed.agg(F.sum("length").alias("n")).first()["n"] == packed.where("start = 0").agg(F.sum("doc_tokens").alias("n")).first()["n"]
    assert packed.where("start = 0").count() == mixed.count()


def _linked(a, b):
    x, y = ({tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} for w in (a.split(), b.split()))
    return 100 * len(x & y) >= 75 * len(x | y)
