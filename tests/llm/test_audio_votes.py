"""Equal integers by offset: any split into light and heavy ones counts the same, in bounded memory; filters against direct sums."""

import collections
import tracemalloc

import numpy as np
import pytest


def direct(queries, own):
    return dict(collections.Counter((q, i - j) for q, p in enumerate(queries) for i, a in enumerate(own.tolist()) for j, b in enumerate(p.tolist()) if a == b))


@pytest.mark.parametrize("heavy,pairs", [(0, 1), (3, 7), (40, 1 << 21), (1 << 18, 1 << 21)])
def test_votes(monkeypatch, heavy, pairs):
    from flowlens.llm.audio import Queries, align

    monkeypatch.setattr(Queries, "HEAVY", heavy)
    monkeypatch.setattr(Queries, "PAIRS", pairs)
    rng = np.random.default_rng(heavy)
    for _ in range(8):
        queries = [rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint32) for _ in range(3)]
        own = rng.integers(0, 6, rng.integers(1, 60)).astype(np.uint32)
        q, offset, n = Queries([(i, p) for i, p in enumerate(queries)]).votes(own)
        assert {(int(a), int(b)): int(c) for a, b, c in zip(q, offset, n)} == direct(queries, own)
        want = direct(queries[:1], own)
        best, equal, overlap, wrong = align(queries[0], own)
        assert (equal == 0 and not want) or (equal == max(want.values()) and best == min(o for (_, o), c in want.items() if c == equal) and 0 <= wrong <= 1 and overlap >= equal)
    assert len(Queries([]).votes(own)[0]) == 0 and len(Queries([(1, queries[0])]).votes(own[:0])[0]) == 0


def test_an_hour_of_silence_and_a_repeated_word(monkeypatch):
    from flowlens.llm.audio import Queries, fingerprint, tones

    silence = np.full(28_750, 7, np.uint32)  # an hour
    word = fingerprint(tones("again " * 20_000)).astype(np.uint32)
    assert len(word) > 10_000
    for prints in (silence, word):
        tracemalloc.start()
        found = Queries([(0, prints), (1, prints[: len(prints) // 2])]).match(9, prints, 4, 16, 0.3)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 500 << 20
        assert [(q, o, equal) for q, o, equal, _, _ in found][0] == (0, 0, len(prints)) and found[1][2] == len(prints) // 2
