"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures them.

Long templates (whole license texts) are measured by chains of equal runs of words, so that added or missing clauses
don't end a match. The templates are a parameter; their fingerprints form an inverted index that is as large as they are and goes to
every task. Texts are scanned where they lie: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.kernels import Words, grams, pieces, ranges

#: Words of a fingerprinted gram, and grams of a winnowing window: any shared run of GRAM + WINDOW - 1 words is found.
GRAM, WINDOW = 3, 2
#: Words by which an alignment may leave its diagonal, and words added around it.
BAND = 8
#: Templates of more words are measured by chains.
LONG = 32

#: Customary license notices. The texts in license_texts (bodies and standard headers) stand beside them.
#: What is in brackets names the license and its version: a match has these words as they are, without others between them.
TEMPLATES = {
    "apache-2.0": "Licensed under the [Apache] License, Version [2.0].",
    "cc-by-nc-4.0": "Licensed under [CC BY-NC 4.0].",
    "gpl-3.0": "This work is licensed under the [GNU General Public License], version [3].",
    "mit": "Released under the [MIT] License.",
    "apache-2.0-notice": 'Licensed under the [Apache] License, Version [2.0] (the "License"); you may not use this file except in compliance with the License.',
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
for _code, _name in {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}.items():
    TEMPLATES.setdefault(f"cc-{_code}-4.0", f"Licensed under [CC {_code.upper()} 4.0].")
    TEMPLATES[f"cc-{_code}-4.0-notice"] = f"This work is licensed under a [Creative Commons {_name} 4.0] International License."
    TEMPLATES[f"cc-{_code}-3.0-notice"] = f"This work is licensed under a [Creative Commons {_name} 3.0] Unported License."


def all_templates() -> dict[str, str]:
    """The notices and the texts of license_texts, by name."""
    return TEMPLATES | {f.stem: f.read_text() for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def winnow(g: np.ndarray, window: int) -> list[int]:
    """Positions of the fingerprints: the rightmost smallest hash of each window."""
    if not len(g):
        return []
    if len(g) <= window:
        return [int(np.flatnonzero(g == g.min())[-1])]
    return sorted({i + window - 1 - int(np.argmin(g[i : i + window][::-1])) for i in range(len(g) - window + 1)})


def align(template: list[int], text: list[int], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Best local alignment of the template with the text near text position - template position = diagonal.

    Matches count 2, mismatches and gaps -1. Returns matched words, start and end in the text.
    """
    best, prev = (0, 0, 0, 0), {}
    for i in range(len(template)):
        row = {}
        for j in range(max(0, i + diagonal - band), min(len(text), i + diagonal + band + 1)):
            same = template[i] == text[j]
            s, m, start = prev.get(j - 1, (0, 0, j))
            if s <= 0:
                s, m, start = 0, 0, j
            options = [(s + 2, m + 1, start)] if same else [(s - 1, m, start)]
            options += [(x[0] - 1, *x[1:]) for x in (prev.get(j), row.get(j - 1)) if x]  # a word left out of the text, or put in
            row[j] = max(options)
            if same and row[j][0] > best[0]:
                best = (*row[j], j + 1)
        prev = row
    return best[1], best[2], best[3]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    place: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        place[x] = place.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b.tolist():
        u = v & place.get(y, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def chain(template: np.ndarray, text: np.ndarray, q: np.ndarray, p: np.ndarray) -> tuple[int, int, int]:
    """Best chain of the runs that the equal grams (template place q, text place p) make up: matched words, start and end in the text.

    Words of runs count 2, a gap between two runs as many as its longer side has; words that match in order within a
    gap, and before the first and after the last run, are added.
    """
    order = np.lexsort((p, p - q))
    q, p = q[order], p[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] - q[1:] != p[:-1] - q[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(p))) + GRAM - 1
    q, p = q[first], p[first]
    longest = np.zeros(int((p + n).max()), np.int64)  # of the runs at each word; a short run inside a longer one is chance
    for i in np.argsort(n, kind="stable").tolist():
        longest[p[i] : p[i] + n[i]] = n[i]
    keep = np.flatnonzero([(longest[a : a + c] == c).any() for a, c in zip(p.tolist(), n.tolist(), strict=True)])
    keep = keep[np.lexsort((q[keep], p[keep]))]
    q, p, n = q[keep], p[keep], n[keep]
    score, before = 2 * n, np.full(len(n), -1)
    for j in range(1, len(n)):
        dq, dp = q[j] - q[:j] - n[:j], p[j] - p[:j] - n[:j]
        over = np.maximum(0, -np.minimum(dq, dp))  # words that both runs claim stay with the earlier one
        total = np.where((over < n[j]) & (q[j] > q[:j]) & (p[j] > p[:j]), score[:j] + 2 * (n[j] - over) - np.maximum(dq, dp) - over, -1)
        i = int(np.argmax(total))
        if total[i] > score[j]:
            score[j], before[j] = total[i], i
    path = [int(np.argmax(score))]
    while before[path[-1]] >= 0:
        path.append(int(before[path[-1]]))
    path.reverse()
    matched, (qe, pe) = 0, (int(q[path[0]]), int(p[path[0]]))
    qs, ps = qe, pe
    for j in path:
        a, b, c = int(q[j]), int(p[j]), int(n[j])
        over = max(0, qe - a, pe - b)
        a, b, c = a + over, b + over, c - over
        matched += c + (common(template[qe:a], text[pe:b]) if a > qe and b > pe else 0)
        qe, pe = a + c, b + c
    start, end = ps, pe
    rest = min(len(template) - qe, LONG)
    if rest and pe < len(text):
        m, _, e = align(template[qe : qe + rest].tolist(), text[pe : pe + rest + BAND].tolist(), 0)
        matched, end = matched + m, pe + e if m else pe
    lead = min(qs, LONG)
    if lead and ps:
        m, _, e = align(template[qs - lead : qs][::-1].tolist(), text[max(0, ps - lead - BAND) : ps][::-1].tolist(), 0)
        matched, start = matched + m, ps - e if m else ps
    return matched, start, end


class Templates:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        words = Words(pa.array([templates[n] for n in self.names], pa.string()), plain=True)
        h = words.hashes()
        self.words = [h[lo:hi] for lo, hi in zip(words.first[:-1], words.first[1:], strict=True)]
        groups = [re.findall(r"\[(.*?)\]", templates[n]) if len(own) <= LONG else [] for n, own in zip(self.names, self.words, strict=True)]
        self.named = [[Words(pa.array([g]), plain=True).hashes().tolist() for g in own] for own in groups]
        prints: dict[int, list[tuple[int, int]]] = {}
        for t, own in enumerate(self.words):
            if len(own) > LONG:
                continue
            g = grams(own, GRAM)
            for p in winnow(g, WINDOW):
                prints.setdefault(int(g[p]), []).append((t, p))
        self.keys = np.array(sorted(prints), np.uint64)
        self.postings = [prints[int(k)] for k in self.keys]
        long = [t for t, own in enumerate(self.words) if len(own) > LONG]
        g = [grams(self.words[t], GRAM) for t in long]
        every = np.concatenate([np.zeros(0, np.uint64), *g])
        order = np.argsort(every, kind="stable")
        self.long_keys, at = np.unique(every[order], return_index=True)
        self.long_first = np.append(at, len(every))
        self.long_t = np.repeat(np.array(long, np.int64), [len(x) for x in g])[order]
        self.long_q = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x in g)])[order].astype(np.int64)

    def is_named(self, t: int, text: list[int]) -> bool:
        """Whether the words that name the license are in the text as they are."""
        return all(any(text[i : i + len(g)] == g for i in range(len(text) - len(g) + 1)) for g in self.named[t])

    def chains(self, words: Words, h: np.ndarray, g: np.ndarray, least: float) -> Iterator[tuple[int, tuple]]:
        """Row and match of the long templates.

        With `least` of a template's words left, at least 3 * least - 2 of its grams are, if no words are put in;
        each word put in breaks two. A row with less than 0.15 under that is not looked into.
        """
        if not len(self.long_keys):
            return
        place = np.minimum(np.searchsorted(self.long_keys, g), len(self.long_keys) - 1)
        p = np.flatnonzero(self.long_keys[place] == g)
        p = p[p + GRAM <= words.first[1:][words.doc[p]]]
        n = self.long_first[place[p] + 1] - self.long_first[place[p]]
        at = np.repeat(self.long_first[place[p]], n) + ranges(n)
        p, t, q = np.repeat(p, n), self.long_t[at], self.long_q[at]
        size = np.array([len(w) for w in self.words])
        pair = words.doc[p].astype(np.int64) * len(self.words) + t
        order = np.argsort(pair, kind="stable")
        pair, p, q = pair[order], p[order], q[order]
        for part in np.split(np.arange(len(pair)), np.flatnonzero(np.diff(pair)) + 1) if len(pair) else []:
            row, t = divmod(int(pair[part[0]]), len(self.words))
            need = max((GRAM * least - GRAM + 1 - 0.15) * size[t], 0.05 * size[t], 1)
            base, end = int(words.first[row]), int(words.first[row + 1])
            a, b = q[part], p[part]
            while len(a) >= need and len(np.unique(a)) >= need:
                matched, lo, hi = chain(self.words[t], h[base:end], a, b - base)
                if matched < least * size[t]:
                    break
                yield row, (-matched, int(size[t]), t, base + lo, base + hi)
                left = (b + GRAM <= base + lo) | (b >= base + hi)
                a, b = a[left], b[left]

    def scan(self, texts: pa.Array, least: float) -> list[tuple[int, str, int, int, int, int]]:
        """(row, template, start and end byte, matched words, template words) of the matches; of overlapping ones the best."""
        words = Words(texts, plain=True)
        h = words.hashes()
        g = grams(h, GRAM)
        if not len(g):
            return []
        place = np.minimum(np.searchsorted(self.keys, g), max(len(self.keys) - 1, 0))
        seeds: set[tuple[int, int, int]] = set()
        for p in np.flatnonzero(self.keys[place] == g).tolist() if len(self.keys) else []:
            row = int(words.doc[p])
            if p + GRAM <= words.first[row + 1]:
                seeds.update((row, t, p - q) for t, q in self.postings[place[p]])
        found: dict[int, list[tuple]] = {}
        for row, t, diagonal in sorted(seeds):
            n = len(self.words[t])
            lo, hi = max(int(words.first[row]), diagonal - BAND), min(int(words.first[row + 1]), diagonal + n + BAND)
            matched, start, end = align(self.words[t].tolist(), h[lo:hi].tolist(), diagonal - lo)
            if matched >= least * n and self.is_named(t, h[lo + start : lo + end].tolist()):
                found.setdefault(row, []).append((-matched, n, t, lo + start, lo + end))
        for row, match in self.chains(words, h, g, least):
            found.setdefault(row, []).append(match)
        out = []
        for row, matches in found.items():
            taken: list[tuple[int, int]] = []
            for matched, n, t, start, end in sorted(matches):
                if all(end <= s or start >= e for s, e in taken):
                    taken.append((start, end))
                    base = words.offsets[row]
                    out.append((row, self.names[t], int(words.start[start] - base), int(words.end[end - 1] - base), -matched, n))
        return sorted(out, key=lambda x: (x[0], x[2]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each license found: doc_id, license, start_byte, end_byte, matched_words, license_words, coverage.

    Words are compared in lower case (A-Z), ASCII punctuation being space; spans count the text's UTF-8 bytes and
    leave the end out. A match has `least` of the template's words; of overlapping matches the one with more matched words
    stays (then the higher coverage). Null, empty and short texts have none; null ids are kept as null; repeated rows
    repeat their matches. An empty table or no templates give no row. Other columns are not read. A template with
    fewer than GRAM words, or a match without GRAM + WINDOW - 1 common words in a row, is not looked for; of templates
    of over LONG words the grams left must be those that Templates.chains asks for. In templates of up to LONG words,
    words in brackets must be in a match as they are, next to each other: names and versions. Without `templates`:
    all_templates().
    """
    index = Templates(templates if templates is not None else all_templates())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            ids = batch.column(0).to_pylist()
            rows = [(ids[m[0]], *m[1:]) for m in index.scan(batch.column(1), least)]
            c = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "license", "start_byte", "end_byte", "matched_words", "license_words"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=names)

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, license string, start_byte long, end_byte long, matched_words long, license_words long")
    return found.withColumn("coverage", F.round(F.col("matched_words") / F.col("license_words"), 6))
