"""The Merkle manifest against plain Python."""

import hashlib
import random
import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, leaf int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(i, text, lang, source, n):
    return h(*map(field, (i, source, lang, n, text)))


def climb(levels, place, own):
    """The siblings from `place` of the first level up, and what `own` gives with them."""
    proof = ""
    for level in levels[:-1]:
        lo = place // 16 * 16
        run = level[lo : lo + 16]
        before, after = "".join(run[: place - lo]), "".join(run[place - lo + 1 :])
        proof, own, place = proof + before + after, h(before, own, after), place // 16
    return proof, own


def grow(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    trees = {}
    for i, text, lang, source, n in rows:
        own = leaf(i, text, lang, source, n)
        changed = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        trees.setdefault(source, []).append((i is not None, i or 0, own, leaf(i, text and text.translate(low), lang, source, n) if changed else own, i))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: grow([r[2] for r in sorted(trees[s])]) for s in order}
    top = grow([built[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for place, (_, _, own, other, i) in enumerate(sorted(trees[s])):
            proof, folded = climb(built[s], place, other)
            more, folded = climb(top, k, folded)
            out.append((i, own, built[s][-1][0], top[-1][0], h(proof, more), folded, folded == top[-1][0]))
    return out


def check(spark, rows, parts=3):
    from flowlens.llm.merkle import merkle_manifest

    got = merkle_manifest(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(parts))
    assert got.dtypes == [(c, "bigint" if c == "doc_id" else "boolean" if c == "verified" else "string") for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows)))


def test_manifest_of_several_levels(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["Upper Case", "lower case", "ÉÀ only", "", None]) and f"Text {i % 7}", rng.choice(["en", None]), "hot" if i % 3 else f"s{i % 40}", i) for i in range(700)]
    rows += [(1000, None, None, None, None), (1001, "", "fr", "", 0), (None, "No id", "en", "hot", 5), (5, rows[5][1], *rows[5][2:]), (5, "Another", "en", "hot", 7), (1002, "long " * 30000, "en", "é", 1), (1003, "A-Z ÀÉ" * 9, "de", "zz", 2)]
    check(spark, rows)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 33])
def test_manifest_of_one_source(spark, n):
    check(spark, [(i, f"T{i}", "en", "s", i) for i in range(n)], 2)


@pytest.mark.parametrize("n", [2, 17])
def test_manifest_of_lone_leaves(spark, n):
    check(spark, [(i, f"T{i}", "en", f"s{i}", i) for i in range(n)], 2)


def test_recursion_takes_more_rows_than_the_sessions_limit(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        check(spark, [(i, f"T{i}", "en", f"s{i % 2}", i) for i in range(600)])
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "50"
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
