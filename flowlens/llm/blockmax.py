"""An inverted index with block maxima, and exact search that opens long lists only where they can matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of them) for each start, in a row."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + count, count)


class BlockMaxIndex:
    """Postings of terms 0 .. n_terms - 1 over documents 0 .. n_docs - 1, given by term and document.

    Lists that a `share`-th of the documents or more are in are long: they are rows of a matrix, and the highest
    impact of each in every block of `block` documents is known.
    """

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int, block: int = 16, share: int = 16):
        self.docs, self.impact, self.block = docs, impact, block
        self.blocks = -(-n_docs // block)
        self.first = np.searchsorted(terms, np.arange(n_terms + 1))
        size = np.diff(self.first)
        long = np.flatnonzero(size * share >= max(n_docs, 1))
        self.row = np.full(n_terms, -1)
        self.row[long] = np.arange(len(long))
        self.matrix = np.zeros((len(long), self.blocks * block))
        at = spread(self.first[long], size[long])
        self.matrix[np.repeat(np.arange(len(long)), size[long]), self.docs[at]] = impact[at]
        self.maxima = self.matrix.reshape(len(long), self.blocks, block).max(2) if len(long) else np.zeros((0, self.blocks))

    def open(self, query: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, least: np.ndarray, group: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Sums of weight * impact of n queries, where they can reach least[query]: queries, first document, and the sums (queries x documents from there).

        The short lists are merged. WAND's condition is put to blocks: the merged sums and the block maxima of the long
        lists bound what is in a block. Groups of blocks come by falling bound; `least` may rise between them.
        """
        row = self.row[terms]
        asked = np.zeros((n, len(self.matrix)))
        asked[query[row >= 0], row[row >= 0]] = weights[row >= 0]
        query, terms, weights = query[row < 0], terms[row < 0], weights[row < 0]
        size = self.first[terms + 1] - self.first[terms]
        at = spread(self.first[terms], size)
        docs = self.blocks * self.block
        short = np.bincount(np.repeat(query.astype(np.int64) * docs, size) + self.docs[at], np.repeat(weights, size) * self.impact[at], n * docs).reshape(n, docs)
        bound = asked @ self.maxima + short.reshape(n, self.blocks, self.block).max(2)
        highest = np.maximum.reduceat(bound, np.arange(0, self.blocks, group), 1) * (1 + 1e-9) + 1e-6  # rounding may not hide a tie
        for g in np.argsort(-highest.max(0), kind="stable").tolist():
            rows = np.flatnonzero(highest[:, g] >= least)
            if len(rows):
                base, end = g * group * self.block, min((g + 1) * group * self.block, docs)
                yield rows, base, asked[rows] @ self.matrix[:, base:end] + short[rows, base:end]

    def top(self, query: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, k: int, skip: np.ndarray | None = None, group: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of n queries the k documents of the highest positive sums, rounded to 12 digits, and the sums; ties go to smaller documents. skip: for each query a document left out."""
        docs = self.blocks * self.block
        found, least = np.zeros((n, docs)), np.zeros(n)
        for rows, base, score in self.open(query, terms, weights, n, least, group):
            found[rows, base : base + score.shape[1]] = np.round(score, 12)
            if skip is not None:
                found[np.arange(n), skip] = 0
            if docs > k:
                least[rows] = np.partition(found[rows], docs - k, 1)[:, docs - k]
        good, ids = np.nonzero((found >= least[:, None]) & (found > 0))
        edges = np.searchsorted(good, np.arange(n + 1))
        out = []
        for q in range(n):
            own = ids[edges[q] : edges[q + 1]]
            sums = found[q, own]
            keep = np.lexsort((own, -sums))[:k]
            out.append((own[keep], sums[keep]))
        return out
