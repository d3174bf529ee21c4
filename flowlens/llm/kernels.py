"""Array helpers that run inside tasks: words of an Arrow column, their hashes, and what slides over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_PLAIN = _LOWER.copy()
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 0x20
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


#: Bytes of text that one set of arrays is made for; a longer text is taken alone.
PIECE = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most about PIECE bytes of the text column, so that memory does not grow with a batch."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // PIECE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a column of texts: byte ranges of one buffer, in order. Null texts have none.

    lower: A-Z in lower case; plain: also with ASCII punctuation as space.
    start, end: of each word in buf; doc: its row; first: index of each row's first word (one more entry than rows).
    """

    def __init__(self, texts: pa.Array, lower: bool = False, plain: bool = False):
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        if texts.null_count:
            texts = texts.fill_null(b"")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
        base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
        raw = np.frombuffer(texts.buffers()[2], np.uint8, size, base) if size else np.zeros(0, np.uint8)
        self.buf = np.zeros(size + 8, np.uint8)  # room to read 8 bytes anywhere
        raw = _PLAIN[raw] if plain else _LOWER[raw] if lower else raw
        self.buf[:size] = raw
        offsets = offsets - base
        solid = np.zeros(size + 1, bool)
        solid[:size] = ~_SPACE[raw]
        edge = np.zeros(size + 1, bool)
        edge[offsets] = True
        starts = solid.copy()
        starts[1:] &= ~solid[:-1] | edge[1:]
        ends = solid[:size] & (~solid[1:] | edge[1:])
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        self.rows, self.offsets = n, offsets

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """64 bits for each word, of its bytes and length."""
        return self._hashed(self.start, self.end - self.start)

    def _hashed(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        at, left = start.copy(), size.copy()
        h = left.astype(np.uint64) * _K1
        eights = np.ndarray((len(self.buf) - 7,), "<u8", self.buf.data, 0, (1,))
        h = mix(h ^ (eights[at] & _MASK[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        while len(more):
            at[more] += 8
            left[more] -= 8
            h[more] = mix((h[more] + _K1) ^ (eights[at[more]] & _MASK[np.minimum(left[more], 8)]))
            more = more[left[more] > 8]
        return h

    def stems(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of more than `most` characters, and 64 bits for each, of its first `most` characters; other bits than those of a word."""
        chars = np.flatnonzero((self.buf & 0xC0) != 0x80)  # where UTF-8 characters begin
        after = np.searchsorted(chars, self.start) + most
        long = np.flatnonzero(after < len(chars))
        long = long[chars[after[long]] < self.end[long]]
        start = self.start[long]
        return long, mix(self._hashed(start, chars[after[long]] - start) + np.uint64(most * int(_K2) % (1 << 64)))

    def text(self, lo: int, hi: int) -> bytes:
        """Words lo to hi (not included), joined by one space."""
        b = self.buf
        return b" ".join([b[s:e].tobytes() for s, e in zip(self.start[lo:hi], self.end[lo:hi])])


def term_counts(words: Words, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and frequency of each distinct term of a row, by row and hash. Terms are the words, and of longer words the first characters, as many as `stems` says."""
    h, d = words.hashes(), words.doc
    for most in stems:
        long, own = words.stems(most)
        h, d = np.concatenate([h, own]), np.concatenate([d, words.doc[long]])
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    return d[first], h[first], np.diff(np.append(first, len(h)))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive hashes; one for each place at which they fit (rows must be told apart by the caller)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * _K1
        out ^= out >> np.uint64(29)
    return mix(out)


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Index of the first smallest of each w consecutive values, by doubling."""
    n = len(x) - w + 1
    best = np.arange(len(x))
    span = 1
    while span < w:
        step = min(span, w - span)
        a, b = best[:-step], best[step:]
        best = np.where(x[b] < x[a], b, a)
        span += step
    return best[:n]


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. c-1 for each count, in a row."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)
