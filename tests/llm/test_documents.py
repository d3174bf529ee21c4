"""Operators on documents against brute force on small tables with nulls, ties, repeats, long and empty texts."""

import base64
import collections
import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return (t or "").encode().split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 40
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(70)
    out = [(i, text(rng.randint(1, 150))) for i in range(60)]
    near = text(200).split()
    for i in range(60, 80):  # near copies
        w = list(near)
        w[rng.randrange(200)] = "changed"
        out.append((i, " ".join(w)))
    out += [(i, text(20) + " " + passage + " " + text(30)) for i in range(80, 95)]
    out += [(i, out[3][1]) for i in range(95, 100)]  # exact copies
    out += [(100, None), (101, ""), (102, " \t\n"), (103, "one"), (104, "One"), (105, text(9000)), (106, "é à b  x"), (107, passage.upper()), (3, out[3][1]), (None, passage), (-7, passage)]
    return [(i, t, "en", None if (i or 0) % 9 == 0 else f"s{(i or 0) % 4}", len(t or "")) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def substrings(rows, k):
    first = {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for j in range(len(w) - k + 1):
            first.setdefault(tuple(w[j : j + k]), i)
    out = []
    for i, t, *_ in rows:
        w = words(t)
        keep = [True] * len(w)
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j : j + k])] < i:
                keep[j : j + k] = [False] * k
        kept = [a for a, b in zip(w, keep) if b]
        out.append((i, len(w), len(w) - len(kept), b" ".join(kept).decode()))
    return collections.Counter(out)


@pytest.mark.parametrize("bucket", [1000, 1])
def test_substring_dedup(docs, rows, monkeypatch, bucket):
    from flowlens.llm import substring

    monkeypatch.setattr(substring, "BUCKET", bucket)
    got = substring.dedup_substrings(docs.withColumnRenamed("lang", "n_words"), 50)
    assert set(got.columns) == {"doc_id", "text", "source", "n_chars", "n_words", "n_removed", "kept_text"}
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()) == substrings(rows, 50)


@pytest.mark.parametrize("bucket", [1000, 1])
def test_substring_dedup_of_repeats_within_a_document(spark, monkeypatch, bucket):
    from flowlens.llm import substring

    monkeypatch.setattr(substring, "BUCKET", bucket)
    rng = random.Random(3)
    p, q, r = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (60, 70, 90))
    rows = [(1, p), (2, f"{q} {p} {q} {p} {q}"), (2, f"{p} {q} {p} {q} {r} {p}"), (3, f"{r} {q} {p} {q} {r} {p} {r} {p} {r}"), (3, f"{r} {q} {p} {q} {r} {p} {r} {p} {r}")]
    got = substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()
    assert collections.Counter((g.doc_id, g.n_words, g.n_removed, g.kept_text) for g in got) == substrings(rows, 50)


def test_substring_dedup_empty(empty):
    from flowlens.llm.substring import dedup_substrings

    assert dedup_substrings(empty).count() == 0


def components(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t, *_ in rows:
        w = words((t or "").translate(lower))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    use = [k for k, r in enumerate(rows) if r[0] is not None and sets[k]]
    for a in use:
        for b in use:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    groups = collections.defaultdict(list)
    for k in use:
        groups[find(k)].append(rows[k][0])
    return collections.Counter((r[0], len(sets[k]), min(groups[find(k)]) if k in use else r[0]) for k, r in enumerate(rows))


@pytest.mark.parametrize("block", [2_000_000, 1000])
def test_ngram_components(docs, rows, monkeypatch, block):
    from flowlens.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", block)
    assert collections.Counter(map(tuple, ngram_join.ngram_components(docs).collect())) == components(rows)


def test_ngram_components_empty(empty):
    from flowlens.llm.ngram_join import ngram_components

    assert ngram_components(empty).count() == 0


NEAR = " ".join(f"p{i}" for i in range(60))


@pytest.mark.parametrize("parts", [1, 64])
@pytest.mark.parametrize("rows", [[(1, NEAR)], [(1, NEAR), (2, NEAR + " more")], [(1, NEAR), (5, "an other text " * 9), (5, NEAR + " more"), (7, "one"), (7, "two"), (None, NEAR), (8, None), (8, "")]])
def test_ngram_components_of_few_rows(spark, rows, parts):
    """Buckets without a shared shingle, and ids whose rows have different texts."""
    from flowlens.llm.ngram_join import keep_first, ngram_components

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "component", "i", "node", "words")})
        assert collections.Counter(map(tuple, ngram_components(docs).collect())) == components(rows)
        if len(rows) > 2:
            kept = keep_first(docs)
            assert kept.columns == docs.columns
            assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter(r for r in rows if r != (5, NEAR + " more"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_occurrences_merge_and_probe():
    from flowlens.llm.ngram_join import occurrences

    rng = random.Random(1)
    for _ in range(200):
        lists = [sorted(rng.sample(range(60), rng.choice([1, 2, 5, 40]))) for _ in range(rng.randrange(1, 30))]
        least, low, high = rng.randrange(1, 12), rng.randrange(20), rng.randrange(30, 70)
        count = collections.Counter(x for s in lists for x in s)
        goal = {x: least + x % 3 for x in count}
        want = [x for x in sorted(count) if low <= x < high and x % 7 and count[x] >= goal[x]]
        assert list(occurrences(lists, least, low, high, lambda x: x % 7 == 0, goal.get)) == want


def test_links_join_all_similar_sets():
    import numpy as np

    from flowlens.llm.ngram_join import links

    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 500, 60)) for _ in range(12)]
    sets = []
    for b in base:
        for _ in range(5):
            s = b.copy()
            s[rng.integers(0, len(s), rng.integers(0, 9))] = rng.integers(1000, 9000)
            sets.append(np.unique(s).astype(np.uint64))
    got = list(range(len(sets)))
    want = list(range(len(sets)))

    def join(lab, a, b):
        x, y = lab[a], lab[b]
        return [min(x, y) if v in (x, y) else v for v in lab]

    for a, b in links(sets, 75):
        inter = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * inter >= 75 * (len(sets[a]) + len(sets[b]) - inter)
        got = join(got, a, b)
    for a in range(len(sets)):
        for b in range(a):
            inter = len(np.intersect1d(sets[a], sets[b]))
            if 100 * inter >= 75 * (len(sets[a]) + len(sets[b]) - inter):
                want = join(want, a, b)
    assert got == want


TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_packing(docs, rows):
    import numpy as np
    from tokenizers import Tokenizer

    from flowlens.llm.packing import concat_and_cut

    t = Tokenizer.from_file(TOKENIZER)
    want = collections.Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [1])) for i, x, *_ in rows)
    pieces = sorted(concat_and_cut(docs, TOKENIZER, 64).collect(), key=lambda r: (r.sequence_id, r.offset))
    at, whole, got = 0, [], collections.Counter()
    for r in pieces:
        assert (r.sequence_id, r.offset) == (at // 64, at % 64) and r.length > 0
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        assert r.start == len(whole)
        whole += ids
        at += r.length
        if len(whole) == r.doc_tokens:
            got[(r.doc_id, tuple(whole))] += 1
            whole = []
    assert got == want and not whole


def test_packing_empty(empty):
    from flowlens.llm.packing import concat_and_cut

    assert concat_and_cut(empty, TOKENIZER).count() == 0


@pytest.mark.parametrize("text", ["a b", "a  b", " a", "a ", "a \n b", "a　b c", "x<|endoftext|> y", "\n\nThe end.\n of", "é è", "tab\t tab", "don't 12 !!  "])
def test_encoder_equals_tokenizers(text):
    from tokenizers import Tokenizer

    from flowlens.llm.packing import Encoder

    assert Encoder(TOKENIZER).encode(text) == Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids


def test_sharding(docs, rows):
    from flowlens.llm.sharding import shard

    got = shard(docs.withColumnRenamed("lang", "slot"), 4).collect()
    assert collections.Counter((r.doc_id, r.shard_size, r.shard_crc32) for r in got) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    size = collections.Counter()
    for r in got:
        size[r.shard] += r.shard_size
    total, largest = sum(size.values()), max(r.shard_size for r in got)
    assert all(abs(size[k] - total / 4) <= largest + 0.02 * total / 4 for k in range(4))


def test_sharding_splits_a_hot_text(spark):
    from flowlens.llm.sharding import shard

    df = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(3000)], "doc_id long, text string")
    size = [r["sum(shard_size)"] for r in shard(df, 8).groupBy("shard").sum("shard_size").collect()]
    assert len(size) == 8 and max(size) - min(size) <= 0.03 * sum(size) / 8 + 10


def test_sharding_empty(empty):
    from flowlens.llm.sharding import shard

    assert shard(empty).count() == 0


def test_mixing(docs, rows):
    from flowlens.llm.mixing import mix_sources

    got = mix_sources(docs.withColumnRenamed("lang", "mix_copies_note")).collect()
    again = mix_sources(docs.repartition(5)).collect()
    assert sorted((str(r.doc_id), r.mix_copies) for r in got) == sorted((str(r.doc_id), r.mix_copies) for r in again)
    size = collections.Counter()
    for i, t, _, s, _ in rows:
        size[s] += len(words(t))
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight = {s: (1.0, 2.0, 3.0)[k % 3] for k, s in enumerate(names)}
    budget, open_, target = float(sum(size.values())), set(names), {}
    while True:
        left = budget - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 3 * size[s]]
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = 3.0 * size[s]
            open_.remove(s)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert 0 <= r.mix_copies <= 3
        assert r.mix_source_size == size[r.source] and abs(r.mix_target - target[r.source]) < 1e-6 * budget
        taken[r.source] += r.mix_copies * r.mix_size
        largest[r.source] = max(largest[r.source], r.mix_size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in size)


#: Names that the operators use for columns of their own.
INTERNAL = "_h _i _id _key _range _base _row _spans _text _wanted at base bucket cell content crc32 cuts first h i key minimiser n n_rows node piece prefix range rank rest row s size source_size t target text_key whole below words".split()


@pytest.mark.parametrize("name", ["mix_sources", "dedup_substrings", "shard", "keep_first", "score_toxicity"])
def test_columns_with_clashing_names(spark, name):
    from flowlens.llm import mixing, ngram_join, sharding, substring, toxicity

    rows = [(i, "some words of a text " * i, "s") for i in range(1, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(c) for c in INTERNAL})
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "doc_id long, toxic int")
    run = {"mix_sources": mixing.mix_sources, "dedup_substrings": lambda d: substring.dedup_substrings(d, 4), "shard": lambda d: sharding.shard(d, 2), "keep_first": ngram_join.keep_first, "score_toxicity": lambda d: toxicity.score_toxicity(d, labels)}[name]
    got = run(docs)
    assert got.columns[: len(docs.columns)] == docs.columns
    assert all(r[c] == c for r in got.collect() for c in INTERNAL)
    again = run(got.drop("kept_text")) if name != "keep_first" else run(got)  # columns of the new names are replaced
    assert len(again.columns) == len(set(again.columns)) == len(got.columns) and again.count() == got.count()


def test_mixing_keeps_columns(docs):
    from flowlens.llm.mixing import mix_sources

    whole, narrow = mix_sources(docs), mix_sources(docs, keep=["doc_id"])
    assert narrow.columns == ["doc_id", "mix_size", "mix_source_size", "mix_target", "mix_copies"]
    assert sorted(map(str, narrow.collect())) == sorted(map(str, whole.select(narrow.columns).collect()))


def test_mixing_empty(empty):
    from flowlens.llm.mixing import mix_sources

    assert mix_sources(empty).count() == 0


def test_toxicity(spark):
    """Neighbours, cosines, votes and scores against plain Python."""
    import math
    import string

    from flowlens.llm.toxicity import fit, held_out, score_toxicity

    rng = random.Random(2)
    bad = ["nasty", "awful", "vile"]
    data, labels = [], []
    for i in range(300):
        w = [f"w{rng.randrange(80)}" for _ in range(rng.randrange(5, 40))]
        w += rng.sample(["intern", "internal", "internet", "international", "été", "étéàçê", "étéàçêü", "étéàçêüö", "日本語", "日本語日本語日"], 3)
        if i % 5 == 0:
            for j in range(0, len(w), 6):
                w[j] = rng.choice(bad) if j else rng.choice(bad).upper() + "!"
        data.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    data += [(500, None), (501, ""), (None, "vile nasty"), (502, "nasty vile awful " * 5000), (503, data[10][1]), (504, "unknown words only")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in data], "doc_id long, text string, tox_score string, doc_id_text string")
    lab = spark.createDataFrame([*labels, (None, 1), (9999, 1), (7, None), (8, 5), (10, 0)], "doc_id long, toxic int")
    k = 7
    model = fit(df.select("doc_id", "text"), lab, k=k)
    got = {r.doc_id: r for r in score_toxicity(df, lab, k=k).select("*", held_out().alias("h")).collect()}
    assert len(got) == len(data) and got[10].doc_id_text == "y"

    blank = str.maketrans({c: " " for c in string.punctuation})
    terms = lambda w: [w, *(("first", n, w[:n]) for n in (5,) if len(w) > n)]
    bags = {i: collections.Counter(x for w in (t or "").lower().translate(blank).split() for x in terms(w)) for i, t in data}
    held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    examples = {i: y for i, y in labels if i not in held}
    frequency = collections.Counter(w for b in bags.values() for w in b)
    known = {w for i in examples for w in bags[i]}

    def vector(bag):
        v = {w: (1 + math.log(n)) * math.log(1 + len(data) / frequency[w]) for w, n in bag.items() if w in known}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / norm for w, x in v.items()}

    vectors = {i: vector(b) for i, b in bags.items()}
    for i, _ in data:
        cosine = {e: sum(x * vectors[e].get(w, 0) for w, x in vectors[i].items()) for e in examples}
        best = sorted((c for c in cosine.values() if c > 0), reverse=True)[:k]
        r = got[i]
        assert r.h == (i in held)
        assert [e.cosine for e in r.tox_evidence] == pytest.approx(best)
        assert all(e.cosine == pytest.approx(cosine[e.doc_id]) and e.toxic == examples[e.doc_id] for e in r.tox_evidence)
        share = sum(e.cosine * e.toxic for e in r.tox_evidence) / (sum(best) + 0.1)
        assert r.tox_score == pytest.approx(model.score(share)) and r.tox_predicted == (r.tox_score >= 0.5)
    # The curve minimises the weighted loss: all labelled rows are examples, so each weighs 1.
    bags = model.bags(pa.array([dict(data)[i] for i in model.ids.tolist()]))
    share = dict(zip(model.ids.tolist(), (s for s, _, _ in model.votes(bags, True))))
    loss = lambda a, b: sum(math.log1p(math.exp(-(a * s + b) * (2 * examples[i] - 1))) for i, s in share.items()) + 5e-3 * (a * a + b * b)
    here = loss(model.a, model.b)
    assert all(loss(model.a + x, model.b + y) >= here for x, y in ((0.1, 0), (-0.1, 0), (0, 0.1), (0, -0.1)))
    assert sum(got[i].tox_predicted == dict(labels)[i] for i in held) >= 0.9 * len(held)
    assert got[500].tox_predicted == got[501].tox_predicted == got[504].tox_predicted == 0 and got[502].tox_predicted == 1
    none = score_toxicity(df, lab.limit(0)).collect()
    assert len(none) == len(data) and not any(r.tox_predicted for r in none)
    assert score_toxicity(df.limit(0), lab).count() == 0


def test_block_max_search_is_exact():
    import numpy as np

    from flowlens.llm.blockmax import BlockMaxIndex

    rng = np.random.default_rng(3)
    term, ident = rng.integers(0, 30, 4000), rng.integers(0, 700, 4000)
    pairs = np.unique(np.stack([term, ident], 1), axis=0)
    impact = rng.integers(1, 5, len(pairs)) / 2
    index = BlockMaxIndex(pairs[:, 0], pairs[:, 1], impact, 30, 700, block=16, share=6)
    assert 0 < len(index.matrix) < 30
    for k in (1, 5, 50, 900):
        queries = [(rng.choice(30, 6, replace=False), rng.integers(0, 4, 6) / 2) for _ in range(20)]
        skip = rng.integers(0, 700, 20)
        got = index.top(np.repeat(np.arange(20), 6), np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries]), 20, k, skip, group=3)
        for (terms, weight), s, (ids, sums) in zip(queries, skip, got):
            score = np.zeros(700)
            for t, w in zip(terms, weight):
                m = pairs[:, 0] == t
                score[pairs[m, 1]] += w * impact[m]
            score[s] = 0
            want = [(i, s) for s, i in sorted((-s, i) for i, s in enumerate(score) if s > 0)][:k]
            assert [(i, -s) for i, s in want] == list(zip(ids.tolist(), sums.tolist()))


@pytest.mark.parametrize("limits", [{"SHARD": 30_000, "BLOCK_TERMS": 900, "CHUNK": 3, "GROUP": 2, "BLOCK": 4}, {}])
def test_bm25(spark, docs, rows, empty, monkeypatch, limits):
    """Ids, ranks and scores against plain Python; repeated queries are one, an id with two texts is two."""
    import math

    from flowlens.llm import search

    for name, value in limits.items():
        monkeypatch.setattr(search, name, value)
    k = 5
    more = [(0, "w1 w2 w3 w1", "", "", 0), (0, "w1 w2 w3 w1", "", "", 0), (10, None, "", "", 0), (20, "", "", "", 0), (30, "notaword", "", "", 0)]
    asked = docs.where("doc_id % 10 = 0 OR doc_id IS NULL").unionByName(spark.createDataFrame(more, SCHEMA))
    got = collections.defaultdict(list)
    for r in search.bm25_search(docs.withColumnRenamed("lang", "query_id"), asked, k).orderBy("query_id", "query_key", "rank").collect():
        got[r.query_id, r.query_key].append((r["rank"], r.doc_id, r.score))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bags = [(i, collections.Counter(words((t or "").translate(lower)))) for i, t, *_ in rows]
    mean = sum(sum(b.values()) for _, b in bags) / len(bags)
    df = collections.Counter(w for _, b in bags for w in b)
    want = []
    for _, t in {(i, t) for i, t, *_ in [*rows, *more] if i is not None and i % 10 == 0}:
        bag = collections.Counter(words((t or "").translate(lower)))
        scored = collections.Counter()
        for i, b in bags:
            if i is not None:
                s = sum(n * math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for w, n in bag.items() if w in b)
                if s > 0:
                    scored[i, round(s, 6)] += 1
        top = sorted(scored.elements(), key=lambda x: (-x[1], x[0]))[:k]
        if top:
            want.append([(j + 1, i, s) for j, (i, s) in enumerate(top)])
    plain = lambda lists: sorted([(r, i, round(s, 5)) for r, i, s in x] for x in lists)
    assert plain(got.values()) == plain(want)
    assert search.bm25_search(empty, empty).count() == 0


def test_licenses(spark):
    from flowlens.llm.licenses import scan_licenses

    long = "word " * 3000
    data = [
        (1, "x y Released under the MIT License. z"), (2, "released UNDER the mit license"), (3, None), (4, ""), (5, "Released"), (None, "Released under the MIT License"),
        (6, long + "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in full compliance with the License." + long),
        (7, "Permission is hereby granted, free of charge, to any person obtaining a copy of this thing and associated documentation files, to deal in the Software without restriction."),
    ]
    got = sorted((r.doc_id or 0, r.license, r.start_byte, r.end_byte, r.matched_words, r.license_words) for r in scan_licenses(spark.createDataFrame([(i, t, 0) for i, t in data], "doc_id long, text string, license int")).collect())
    assert [g[:2] for g in got] == [(0, "mit"), (1, "mit"), (2, "mit"), (6, "apache-2.0-notice"), (7, "mit-permission")]
    text = data[0][1].encode()
    assert text[got[1][2] : got[1][3]] == b"Released under the MIT License"
    assert got[3][5] - got[3][4] <= 1 and got[4][5] - got[4][4] == 1
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("text", ["Released under the BSD License.", "Released under the Apache License.", "It is released under the GPL license", "Licensed under CC BY-XX 4.0.", "Licensed under the Apache License, Version 1.1.", "This work is licensed under the GNU Lesser General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2."])
def test_licenses_without_a_template_are_not_misnamed(text):
    from flowlens.llm.licenses import Templates, all_templates

    assert Templates(all_templates()).scan(pa.array([f"some words {text} and more"]), 0.8) == []


def test_license_notices_by_brute_force():
    """Notices with edits, against whole local alignments of every template. Recall of what has GRAM + WINDOW - 1 template words in a row is 1."""
    import re

    from flowlens.llm.licenses import GRAM, TEMPLATES, WINDOW, Templates

    plain = lambda t: re.sub(r"[^0-9A-Za-z]+", " ", t).lower().split()

    def matched(template, text):
        """Words and span of the best local alignment (match 2, else -1)."""
        best, prev = (0, 0, 0, 0), [(0, 0, j) for j in range(len(text) + 1)]
        for i in range(len(template)):
            row = [(0, 0, 0)]
            for j in range(len(text)):
                same = template[i] == text[j]
                s, m, start = prev[j] if prev[j][0] > 0 else (0, 0, j)
                cell = max((s + 2, m + 1, start) if same else (s - 1, m, start), (prev[j + 1][0] - 1, *prev[j + 1][1:]), (row[j][0] - 1, *row[j][1:]), (0, 0, j + 1))
                row.append(cell)
                if same and cell[0] > best[0]:
                    best = (*cell, j + 1)
            prev = row
        return best[1:]

    rng = random.Random(7)
    index, short = Templates(TEMPLATES), {n: t for n, t in TEMPLATES.items()}
    texts = []
    for n, t in sorted(short.items()):
        for _ in range(4):
            w = t.replace("[", "").replace("]", "").split()
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], ["other"], [w[i], "added"]])
            texts.append(" ".join(["noise", "before", *w, "and", "after"]))
    got = index.scan(pa.array(texts), 0.8)
    names = collections.defaultdict(list)
    for row, name, *_, m, n in got:
        names[row].append((name, m))
    found = wanted = 0
    for i, text in enumerate(texts):
        w, options = plain(text), []
        for name, t in short.items():
            p = plain(t)
            m, start, end = matched(p, w)
            runs = {tuple(p[j : j + GRAM + WINDOW - 1]) for j in range(len(p) - GRAM - WINDOW + 2)} & {tuple(w[j : j + GRAM + WINDOW - 1]) for j in range(len(w))}
            groups = [plain(g) for g in re.findall(r"\[(.*?)\]", t)]
            if m >= 0.8 * len(p) and runs and all(any(w[j : j + len(g)] == g for j in range(start, end - len(g) + 1)) for g in groups):
                options.append((-m, len(p), name))
        if options:
            wanted += 1
            found += any(x == (sorted(options)[0][2], -sorted(options)[0][0]) for x in names[i])
            assert all(any(x == (name, -m) for m, _, name in options) for x in names[i])
        else:
            assert not names[i]
    assert wanted >= 60 and found == wanted


def test_license_bodies(spark):
    from flowlens.llm import licenses

    texts = {n: t for n, t in licenses.all_templates().items() if n.endswith("-text")}
    rng = random.Random(5)
    noise = " ".join(f"w{rng.randrange(10**4)}" for _ in range(400))

    def edited(t):
        w = t.split()
        for j in range(20, len(w), 30):
            w[j] = "edited"
        return " ".join(w[: len(w) // 2] + ["put", "in"] * 10 + w[len(w) // 2 :])

    names = sorted(texts)
    data = [(i, f"{noise} {texts[n]} {noise}") for i, n in enumerate(names)] + [(100 + i, f"{noise} {edited(texts[n])}") for i, n in enumerate(names)]
    data += [(200, f"{texts['mit-text']} {noise} {texts['mit-text']} {texts['isc-text']}"), (201, noise), (202, "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."), (203, "Licensed under CC BY 4.0.")]
    got = collections.defaultdict(list)
    for r in licenses.scan_licenses(spark.createDataFrame(data, "doc_id long, text string")).collect():
        got[r.doc_id].append((r.license, r.coverage))
    for i, n in enumerate(names):
        assert got[i] == [(n, 1.0)], (n, got[i])
        assert [x for x, _ in got[100 + i]] == [n] and got[100 + i][0][1] > 0.9, (n, got[100 + i])
    assert [x for x, _ in got[200]] == ["mit-text", "mit-text", "isc-text"] and 201 not in got
    assert [x for x, _ in got[202]] == ["cc-by-sa-3.0-notice"] and [x for x, _ in got[203]] == ["cc-by-4.0"]


def recording(text):
    import numpy as np

    from flowlens.llm.audio import tones

    return np.concatenate([np.zeros(0, np.float32), *tones(text)])


def test_audio(spark, monkeypatch):
    import numpy as np

    from flowlens.llm import audio

    rng = random.Random(4)
    a = " ".join(f"n{rng.randrange(60)}" for _ in range(120))
    x = recording(a)
    noise = np.random.default_rng(0).normal(0, 0.05, len(x))
    one, two = audio.fingerprint(x), audio.fingerprint(x + noise)
    offset, _, overlap, wrong = audio.align(one[30:], two)
    assert offset == 30 and overlap == len(one) - 30 and wrong < 0.1
    other = audio.fingerprint(recording(" ".join(f"m{rng.randrange(60)}" for _ in range(120))))
    assert audio.align(one, other)[3] > 0.3
    rows = [(50, 0, a[: len(a) // 2]), (50, 1, a[len(a) // 2 :]), (7, 0, a[: len(a) // 2]), (7, 1, a[len(a) // 2 :]), (8, 0, "start " * 4 + a), (9, 0, None), (10, 0, ""), (None, 0, a)]
    prints = audio.fingerprint_turns(spark.createDataFrame(rows, "conv_id long, turn long, text string"))
    got = audio.match_recordings(prints, prints.where("rec_id % 50 = 0")).collect()
    assert {(r.query_id, r.rec_id) for r in got if r.kind == "member"} == {(7, 50), (7, 7), (8, 8)}
    assert [(r.query_id, r.rec_id) for r in got if r.kind == "match"] == [(7, 8)]
    assert audio.match_recordings(prints.limit(0), prints.limit(0)).count() == 0
    monkeypatch.setattr(audio, "BLOCK_SAMPLES", 3000)
    assert (audio.fingerprint(audio.tones(a)) == one).all() and (audio.fingerprint(x) == one).all()


def test_audio_matches_by_brute_force(spark):
    """Every pair is aligned at every offset; excerpts with noise and other words around them are found."""
    import numpy as np

    from flowlens.llm.audio import fingerprint, match_recordings

    rng, noise = random.Random(9), np.random.default_rng(9)
    words_of = lambda n: [f"n{rng.randrange(400)}" for _ in range(n)]
    base = [words_of(60) for _ in range(12)]
    sound = [recording(" ".join(w)) for w in base]
    for k in range(12):  # an excerpt of each, from an odd place, with noise
        w = words_of(7) + base[k][10 + k : 50] + words_of(9)
        y = recording(" ".join(w))
        sound.append(y + noise.normal(0, 0.03, len(y)).astype(np.float32))
    prints = {i: fingerprint(y) for i, y in enumerate(sound)}
    df = spark.createDataFrame([(i, bytes(p.astype("<u4").tobytes())) for i, p in prints.items()], "rec_id long, prints binary")
    got = {(r.query_id, r.rec_id): (r.frame_offset, r.equal, r.overlap, r.bit_error) for r in match_recordings(df, df).where("kind = 'match'").collect()}
    want = {}
    for q, p in prints.items():
        for i, o in prints.items():
            if q != i:
                votes = collections.Counter(y - x for x, v in enumerate(p.tolist()) for y in np.flatnonzero(o == v).tolist())
                if votes:
                    n = max(votes.values())
                    offset = min(d for d, v in votes.items() if v == n)
                    a, b = p[max(0, -offset) :], o[max(0, offset) :]
                    m = min(len(a), len(b))
                    wrong = sum((int(x) ^ int(y)).bit_count() for x, y in zip(a[:m], b[:m])) / (32 * m)
                    if n >= 4 and m >= 16 and wrong <= 0.3:
                        want[q, i] = (offset, n, m, round(wrong, 6))
    assert got == want
    assert sum((k, 12 + k) in got for k in range(12)) >= 11 and all(abs(a - b) == 12 for a, b in got)


@pytest.mark.parametrize(("rate", "width", "channels"), [(4000, 2, 1), (8000, 2, 2), (22050, 1, 1), (11025, 4, 2)])
def test_wav_columns(spark, rate, width, channels):
    import io
    import wave

    import numpy as np

    from flowlens.llm.audio import align, decode_wav, fingerprint, fingerprint_media

    x = recording(" ".join(f"n{i * 7 % 40}" for i in range(60)))
    at = np.interp(np.arange(len(x) * rate // 4000) * 4000 / rate, np.arange(len(x)), x) / 2
    whole = np.repeat((at * ((1 << (8 * width - 1)) - 1)).astype(np.int64), channels)
    file = io.BytesIO()
    with wave.open(file, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes((whole + 128).astype(np.uint8).tobytes() if width == 1 else whole.astype(f"<i{width}").tobytes())
    data = file.getvalue()
    back = np.concatenate(list(decode_wav(data)))
    assert abs(len(back) - len(x)) <= 2 and np.abs(back[: len(x) - 4] - x[: len(back)][: len(x) - 4] / 2).mean() < 0.05
    rows = [(1, data), (2, None), (3, b""), (4, b"no wave"), (None, data)]
    got = {r.rec_id: np.frombuffer(r.prints, "<u4") for r in fingerprint_media(spark.createDataFrame(rows, "rec_id long, wav binary")).collect()}
    offset, _, _, wrong = align(fingerprint(x), got[1])
    assert offset == 0 and wrong < 0.1 and (got[None] == got[1]).all() and not any(len(got[i]) for i in (2, 3, 4))


def test_warc(spark, tmp_path):
    from flowlens.llm import warc
    from pyspark.sql import functions as F

    rows = [(i, f"http://x/{i}", "<p>" + "é" * (i % 7) * 300) for i in range(40)] + [(50, None, None), (51, "u", ""), (None, "u\r\nX: y", "<p>"), (3, "again", "<p>" + "é" * 900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit(1))
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    for least in (0, 100):
        want = collections.Counter()
        for i, _, h in rows:
            b = (h or "").encode()
            again = i is not None and len(b) >= least and first[h or ""] < i
            want[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None)] += 1
        assert collections.Counter(map(tuple, warc.page_round_trip(spark, pages, least).collect())) == want
    path = f"file://{tmp_path}/arc"
    warc.archive_pages(pages, path)
    only = warc.read_warc(spark, path, "record_id string, payload binary").where(F.col("record_id").isin("urn:page:5", "urn:page:6"))
    assert sorted((r.record_id, r.payload.decode()) for r in only.collect()) == [("urn:page:5", rows[5][2]), ("urn:page:6", rows[6][2])]
    assert warc.read_warc(spark, path).where("record_type = 'revisit' AND payload_bytes > 0").count() > 0
    assert not list(tmp_path.glob("arc/_tmp-*"))
    urls = collections.Counter(r.url for r in warc.read_warc(spark, path, "url string").collect())
    assert urls == collections.Counter(u for _, u, _ in rows)
    odd = warc.read_warc(spark, path, "url string, record_id string").where(F.col("url") == "u\r\nX: y")
    assert odd.count() == 1
    assert warc.page_round_trip(spark, pages.limit(0)).count() == 0


def test_warc_foreign_archives(tmp_path):
    import gzip
    import io

    from flowlens.llm.warc import record_bytes, records

    recs = [record_bytes({"record_type": "response", "record_id": f"urn:x:{i}", "url": "u", "date": "d", "payload": bytes([65 + i]) * (i * 9000)}) for i in range(6)]

    class File(io.BytesIO):
        def size(self):
            return len(self.getbuffer())

    for data in (b"".join(recs), b"".join(gzip.compress(r) for r in recs)):
        got = list(records(File(data), lambda f: f["warc-record-id"] != "<urn:x:3>"))
        assert [None if p is None else len(p) for _, p in got] == [0, 9000, 18000, None, 36000, 45000]
        assert len(list(records(File(data), lambda f: True if f["warc-record-id"] == "<urn:x:4>" else None))) == 1
    # Blank lines between records, as other writers leave them.
    for gap in (b"\r\n", b"\r\n\r\n", b"\n" * 9000):
        got = list(records(File(gap + gap.join(recs) + gap), lambda f: True))
        assert [len(p) for _, p in got] == [0, 9000, 18000, 27000, 36000, 45000]
    with pytest.raises(ValueError):
        list(records(File(recs[0] + b"no record"), lambda f: True))


def test_warc_reads_no_more_than_it_needs():
    import io
    import os
    import struct
    import zlib as z

    from flowlens.llm.warc import gzip_member, record_bytes, records

    recs = [record_bytes({"record_type": "response", "record_id": f"urn:x:{i}", "url": "u", "date": "d", "payload": os.urandom(200_000)}) for i in range(20)]

    class File(io.BytesIO):
        taken = 0

        def size(self):
            return len(self.getbuffer())

        def read(self, n=-1):
            out = super().read(n)
            self.taken += len(out)
            return out

    f = File(b"".join(gzip_member(r) for r in recs))
    assert len(list(records(f, lambda h: h["warc-record-id"] == "<urn:x:7>"))) == 20
    assert f.taken < 500_000  # of four million
    # A gzip header longer than what is read at first.
    body = z.compressobj(6, z.DEFLATED, -15)
    packed = body.compress(recs[0]) + body.flush()
    extra = b"xx" + struct.pack("<H", 6000) + bytes(6000) + b"sl" + struct.pack("<HII", 8, 10 + 2 + 6016 + len(packed) + 8, len(recs[0]))
    data = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + packed + struct.pack("<II", z.crc32(recs[0]), len(recs[0]))
    assert [len(p) for _, p in records(File(data + gzip_member(recs[1])), lambda h: True)] == [200_000, 200_000]


def test_components(spark):
    from flowlens.llm.graph import components

    edges = [(i + 1, i) for i in range(0, 30)] + [(100, 200), (200, 300), (7, 7)] + [(1000 + i, 999) for i in range(50)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert all(got[i] == 0 for i in range(31)) and got[300] == 100 and got[1010] == 999 and len(got) == 31 + 3 + 51


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for i, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == pipeline.COLUMNS, name
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.count() > 0
    assert pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() > 0
