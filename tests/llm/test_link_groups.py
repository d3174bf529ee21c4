"""Candidate groups stay near the links that they hold, and large ones are not merged entry by entry."""

import collections
import random

import numpy as np
import pytest

from flowlens.llm import ngram_join


def near_sets(seed, bases=8, copies=9):
    rng = np.random.default_rng(seed)
    sets = [np.zeros(0, np.uint64)]
    for _ in range(bases):
        b = np.unique(rng.integers(0, 300, 50))
        for _ in range(copies):
            s = b.copy()
            s[rng.integers(0, len(s), rng.integers(0, 14))] = rng.integers(1000, 5000)
            sets.append(np.unique(s[: rng.integers(len(s) // 2, len(s) + 1)]).astype(np.uint64))
    return [sets[i] for i in rng.permutation(len(sets))]


def names(k, links):
    label = list(range(k))
    for a, b in links:
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    return label


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("limits", [{}, {"TOGETHER": -1}, {"TOGETHER": -1, "ROWS": 5, "WIDE": 3, "LONG": 2}])
def test_links_of_sets_that_ask_together(monkeypatch, seed, limits):
    for k, v in limits.items():
        monkeypatch.setattr(ngram_join, k, v)
    sets = near_sets(seed)
    k = len(sets)
    similar = [(a, b) for a in range(k) for b in range(a) if len(sets[a]) and len(sets[b]) and 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    assert names(k, ngram_join.links(sets, 75)) == names(k, similar)
    label, asked = [i - i % 3 for i in range(k)], list(range(0, k, 2))
    known = list(zip(range(k), label, strict=True))
    assert names(k, known + ngram_join.links(sets, 75, label, asked)) == names(k, known + [(a, b) for a, b in similar if (a + b) % 2])


def test_no_merge_by_heap_in_a_group_of_near_copies(monkeypatch):
    """800 texts of a group took 22 s, and the time grew with their square."""
    calls = []
    monkeypatch.setattr(ngram_join, "occurrences", lambda *a: calls.append(a) or iter(()))
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 100)
    sets = []
    for _ in range(300):
        s = base.copy()
        s[rng.integers(0, 100, 14)] = rng.integers(0, 1 << 60, 14)
        sets.append(np.unique(s).astype(np.uint64))
    assert ngram_join.links(sets, 60) and not calls


def test_chains_of_sizes():
    """A piece sends a chain's sizes; what lies between them still meets the sets of other pieces."""
    low, high = np.array([10, 16, 40, 10]), np.array([24, 16, 60, 10])
    assert ngram_join._chains(np.array([1, 1, 1, 2]), low, high, 75).tolist() == [True, False, True, True]
    assert ngram_join._chains(np.array([1, 1, 1]), np.array([10, 16, 24]), np.array([10, 16, 24]), 75).all()


@pytest.mark.parametrize("parts", [1, 7])
def test_texts_that_share_passages_with_others_are_no_group(spark, monkeypatch, parts):
    """Each text shares 30 % with the one before and 30 % with the one after. That made all of them one group, joined in blocks against each other."""
    rng = random.Random(4)
    passages = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(80)]
    rows = [(i, f"{passages[i]} {' '.join(f'u{i}x{j}' for j in range(80))} {passages[i + 1]}") for i in range(79)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(0, 40, 8)]
    groups = []
    keep = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: groups.append(keep(df, name)) or groups[-1] if name == "candidate_groups" else keep(df, name))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs).collect()}
    assert got == {i: i % 100 if i >= 100 else i for i, _ in rows}
    assert max(collections.Counter(r.component for r in groups[0].collect()).values()) <= 4


def test_the_pipelines_stage_has_small_groups(spark, monkeypatch):
    import corpus_pipeline

    rng = random.Random(6)
    passages = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    rows = [(i, f"{passages[i]} {' '.join(f'u{i}x{j}' for j in range(80))} {passages[i + 1]}") for i in range(39)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(0, 30, 6)]
    groups, keep = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: groups.append(keep(df, name)) or groups[-1] if name == "candidate_groups" else keep(df, name))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == list(range(39))
    assert max(collections.Counter(r.component for r in groups[0].collect()).values()) <= 4
