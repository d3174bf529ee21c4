"""The conversation trie against plain Python; parentheses against a stack."""

import hashlib
import random
import zlib

import numpy as np
import pytest

SCHEMA = "conv_id long, turn long, role string, text string, digest string"


def conversations():
    rng = random.Random(11)
    rows = []
    openings = [("system", f"start {i} of it") for i in range(3)]
    for c in [*range(0, 70), *range(100, 119), 400, 421]:  # 421 has no base; 100's base is there
        kind = c % 7
        turns = [openings[kind % 3]] + [(rng.choice(["user", "assistant"]), rng.choice(["yes", "no it is", "a b c d", ""])) for _ in range(rng.choice([0, 1, 2, 5, 9]))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rows += [(200 + i, j, "user", f"copy {j}") for i in range(30) for j in range(6)]  # copies
    rows += [(140, i, "user", "long " * (i % 3)) for i in range(40)] + [(145, i, "user", "long " * (i % 3)) for i in range(43)]
    rows += [(141, None, None, None), (141, 1, None, "x"), (141, 1, "a", "x"), (141, 1, "a", "x"), (None, 1, "user", "nobody's")]
    return [(*r, "clash") for r in rows]


def brute(rows):
    digest = lambda t: hashlib.md5(f"{len(t[0].encode())}:{t[0]}{t[1]}".encode()).hexdigest()
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [t for *_, t in sorted(v, key=lambda r: (r[0], r[1], digest(r[2])))] for c, v in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    nodes = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    saved, leaves, kids = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(members) - 1) * (len(k[-1][1].split()) if k else 0)
            leaves[k[:d]] += kids[k] == 0
    ends = {k: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(full[c]) == len(k)).encode()).hexdigest() for k, m in nodes.items()}
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], ends[k]) for k, m in nodes.items())


@pytest.mark.parametrize("band,shard,ids", [(512, 1 << 16, 1 << 14), (9, 7, 2), (20, 1, 1)])
def test_trie(spark, monkeypatch, band, shard, ids):
    from flowlens.llm import trie

    for name, value in (("BAND", band), ("SHARD", shard), ("IDS", ids), ("BANDS", 100)):
        monkeypatch.setattr(trie, name, value)
    rows = conversations()
    got = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.dtypes == [(c, "string" if c == "ends_sha256" else "bigint") for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == sorted(brute(rows), key=lambda r: r[:2])


def test_trie_of_nothing(spark):
    from flowlens.llm.trie import conversation_trie

    assert conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert conversation_trie(spark.createDataFrame([(None, 1, "user", "x", "")], SCHEMA)).collect() == []
    # Its first turns come from a base that is not there: a conversation without turns.
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    got = conversation_trie(spark.createDataFrame([(c, 1, "user", "x", "")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


@pytest.mark.parametrize("block", [2, 5, 64])
def test_parens(block):
    from flowlens.llm.parens import Parens

    rng = random.Random(block)
    bits, deep, left = [], 0, 3000
    while left or deep:
        if left and (not deep or rng.random() < 0.55):
            bits, deep, left = [*bits, True], deep + 1, left - 1
        else:
            bits, deep = bits + [False], deep - 1
    tree, stack, close = Parens(np.array(bits), block), [], {}
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            close[stack.pop()] = i
    at = tree.findclose(tree.opens)
    assert dict(zip(tree.opens.tolist(), at.tolist(), strict=True)) == close
    for i, n in zip(tree.opens.tolist(), tree.leaves(tree.opens, at).tolist(), strict=True):
        if close[i] - i < 200:
            assert n == sum(bits[j] and not bits[j + 1] for j in range(i, close[i]))


@pytest.mark.parametrize("parts", [1, 7])
def test_numbered(spark, parts):
    from flowlens.llm.ordered import numbered

    rng = random.Random(parts)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["", "a", "b", "ü"]), rng.randrange(10**6), i) for i in range(2000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.i: r.n for r in numbered(spark.createDataFrame(rows, "g string, o long, i long"), "g", ["o", "i"], ["i"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    seen, want = {}, {}
    for g, o, i in sorted(rows, key=lambda r: (r[0].encode(), r[1], r[2])):
        want[i] = seen[g] = seen.get(g, -1) + 1
    assert got == want
