"""Language identification: forward-backward against plain sums over paths, held-out accuracy, code-switched text, odd rows."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def naive(score, moves):
    """Word probabilities by the sum over all paths."""
    n, k = score.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        s = np.exp(sum(score[i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])) + np.log(np.exp(moves[:, path[0]]).sum()))
        out[np.arange(n), path] += s
    return out / out.sum(1, keepdims=True)


def forward_backward(score, moves):
    """The same word by word, in logarithms."""
    lse = np.logaddexp.reduce
    n, k = score.shape
    a, b = np.zeros((n, k)), np.zeros((n, k))
    a[0] = score[0] + lse(moves, 0)
    for i in range(1, n):
        a[i] = score[i] + lse(a[i - 1][:, None] + moves, 0)
    for i in range(n - 2, -1, -1):
        b[i] = lse(moves + (score[i + 1] + b[i + 1])[None], 1)
    p = a + b
    return np.exp(p - lse(p, 1)[:, None])


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_posteriors(monkeypatch, chunk):
    from flowlens.llm import language

    monkeypatch.setattr(language, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    sizes = [0, 1, 2, 7, 0, 64, 65, 1000, 3, 128, 0]
    first = np.concatenate([[0], np.cumsum(sizes)])
    score, moves = rng.normal(0, 2, (first[-1], 3)), rng.normal(0, 1, (3, 3))
    got = language.posteriors(score, moves, first)
    for lo, hi in zip(first, first[1:]):
        if hi > lo:
            assert np.allclose(got[lo:hi], forward_backward(score[lo:hi], moves), atol=1e-9)
    assert np.allclose(got[first[3] : first[4]], naive(score[first[3] : first[4]], moves))


@pytest.fixture(scope="module")
def model(spark):
    from flowlens.llm import language

    docs = spark.read.parquet(f"/root/testdata/sf0.01/documents.parquet").where(~language.held_out())
    return language.fit(docs.select("text", "lang"), 100)


def test_query_and_accuracy(spark):
    from flowlens.llm.queries import op13_language

    out = op13_language(spark, DATA)
    assert {c: t for c, t in out.dtypes if c != "runs"} == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    hidden = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in hidden) >= 0.95 * len(hidden)


def test_code_switched_text(spark, model):
    from flowlens.llm.language import identify_languages

    found = {}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 400").orderBy("doc_id").select("lang", F.split("text", "[ \n|]+").alias("w"))
    for r in docs.collect():
        found.setdefault(r.lang, [w for w in r.w if w.isalpha()][:60])
    langs = sorted(found)
    mixed = " ".join(w for lang in langs for w in found[lang])
    row = identify_languages(spark.createDataFrame([(mixed,)], "text string"), model).first()
    truth = [lang for lang in langs for _ in found[lang]]
    told = [s.lang for s in row.lang_spans for _ in range(s.words)]
    assert len(told) == len(truth) and [s.first_word for s in row.lang_spans] == [sum(s.words for s in row.lang_spans[:i]) for i in range(len(row.lang_spans))]
    assert sum(a == b for a, b in zip(told, truth)) >= 0.9 * len(truth)
    assert all(0 < s.score <= 1 for s in row.lang_spans)


def test_odd_rows(spark, model):
    from flowlens.llm.language import UNKNOWN, identify_languages

    texts = [None, "", " \n\t", "123 456", "...!?", "→ ∞ 42", "а", "the", "THE", "the " * 60000, "x", "x"]
    docs = spark.createDataFrame([(i, t, "a", 5.0, [1]) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, weights double, list array<int>")
    for parts in (1, 4):
        got = identify_languages(docs.repartition(parts), model)
        assert set(got.columns) == {"doc_id", "text", "weights", "list", "lang_pred", "lang_score", "lang_spans"}
        rows = {r.doc_id: r for r in got.collect()}
        assert [rows[i].lang_pred == UNKNOWN for i in range(12)] == [True] * 6 + [False] * 6
        assert all(rows[i].lang_score == 0 for i in range(6)) and rows[0].lang_spans == [] and rows[1].lang_spans == []
        assert rows[7].lang_pred == rows[8].lang_pred == rows[9].lang_pred == "en" and rows[7].lang_score == rows[8].lang_score
        assert sum(s.words for s in rows[9].lang_spans) == 60000 and rows[10][5:] == rows[11][5:]


def test_learning_of_little(spark):
    from flowlens.llm.language import UNKNOWN, fit, identify_languages

    docs = spark.createDataFrame([("some text", "en")], "text string, lang string")
    nothing = fit(docs.where("false"))
    assert [r.lang_pred for r in identify_languages(docs, nothing).collect()] == [UNKNOWN]
    assert identify_languages(docs.where("false"), nothing).count() == 0
    assert [r.lang_pred for r in identify_languages(docs, fit(docs)).collect()] == ["en"]
    assert fit(spark.createDataFrame([("", "en"), ("12", "de")], docs.schema)).langs == ["de", "en"]


def test_model_is_the_same_for_any_partitions(spark, model):
    from flowlens.llm import language

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(~language.held_out())
    again = language.fit(docs.repartition(7).select("text", "lang"), 100)
    assert again.langs == model.langs and np.array_equal(again.weights, model.weights) and np.array_equal(again.moves, model.moves)
