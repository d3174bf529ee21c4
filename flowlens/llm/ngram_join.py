"""N-gram Jaccard join by T-occurrence search (DivideSkip), and the components of its links.

1. Rows with the same words are one class, which is a node of the graph of links.
2. Of each class the shingles with the smallest hashes go to buckets, so many that a similar pair must share a known
   number of them. Classes that share fewer with all others together have no partner and leave.
3. Among those that stay the frequencies of all their shingles are counted exactly. A class that shares fewer than a
   similar pair must leaves. A pair must share one of the shingles that are left when each class drops the most frequent
   ones, one fewer than that number; classes of fitting sizes with such a shingle in common make up candidate groups.
   (With the shingles of step 2 alone, groups grow together to one as the corpus grows, and blocks of it are all pairs.)
4. Within a group each text asks an inverted index which texts have at least the required number of its shingles:
   short lists are merged by a heap that skips ahead, long ones probed by binary search. What links already join is not
   looked at again, so a text that is linked with one in the index stays out of the index. In groups with long lists
   many texts ask together: short lists are merged by counting, long ones are columns of a matrix.

A piece of text sends each shingle once, however many of its classes have it (a map-side combine), so a shingle that
a third of all rows have reaches its bucket once for each piece. What buckets send back is packed by receiver. Groups
over BLOCK shingles are joined in blocks: within each, then between the blocks' components, and only texts outside
the group's largest component travel to the other blocks.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.blockmax import spread
from flowlens.llm.common import partitions, written
from flowlens.llm.graph import components
from flowlens.llm.kernels import Words, grams, mix, pieces

#: Shingles that meet in one task, by number: larger groups are joined in blocks.
BLOCK = 2_000_000
#: The weight of probing against merging in the choice of long lists.
MU = 0.01
#: The sum of the squares of a group's lists over which its texts ask together. Then a list that a LONG-th of the texts are in is a column of a matrix, and ROWS texts ask WIDE at a time.
TOGETHER, LONG, ROWS, WIDE = 20_000, 64, 256, 8192


def need(n: np.ndarray | int, percent: int):
    """The least overlap that a set of n shingles has with any similar one: percent of the union at least."""
    return (n * percent + 99) // 100


def extra(n: np.ndarray | int):
    """How many shingles the prefix is longer than one that a similar set must meet once. Of a pair, the set whose prefix ends first shares 1 + extra() of its prefix at least, and these lie in both prefixes."""
    return n // 4


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """The sorted hashes of each row's distinct shingles."""
    h = words.hashes()
    g = grams(h, size)
    out = []
    for lo, hi in zip(words.first[:-1], words.first[1:], strict=True):
        if hi - lo >= size:
            out.append(np.unique(g[lo : hi - size + 1]))
        elif hi > lo:
            x = np.array([hi - lo], np.uint64)
            for w in h[lo:hi]:
                x = mix(x * np.uint64(5) + w)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def contents(words: Words) -> np.ndarray:
    """128 bits of each row's words, as two numbers."""
    h = words.hashes()
    digests = [xxhash.xxh3_128_digest(h[lo:hi].tobytes()) for lo, hi in zip(words.first[:-1], words.first[1:], strict=True)]
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


SETS = "doc_id long, text_key long, c1 long, c2 long, n_shingles long"


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 2):
        words = Words(batch.column(2), lower=True)
        c = contents(words)
        n = np.fromiter(map(len, shingle_sets(words, size)), np.int64, words.rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(n)], names=["doc_id", "text_key", "c1", "c2", "n_shingles"])


def prefix(s: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set that a similar one must share 1 + extra() of, in order of their hashes."""
    return s[: len(s) - need(len(s), percent) + 1 + extra(len(s))]


def _split(place: np.ndarray, n: int, *columns: np.ndarray) -> Iterator[tuple]:
    """The columns' bytes for each place 0 .. n-1 that occurs."""
    order = np.argsort(place, kind="stable")
    edges = np.searchsorted(place[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(edges)):
        at = order[edges[b] : edges[b + 1]]
        yield int(b), *(c[at].tobytes() for c in columns)


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 64], strict=True), kinds, strict=True)], names=names)


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    return pa.Table.from_batches(list(_rows(rows, names, kinds)), pa.schema(list(zip(names, kinds, strict=True))))


def _joined(group: pa.Table, column: str, kind: str) -> np.ndarray:
    """The numbers in all of a group's binaries, in a row."""
    return np.frombuffer(b"".join(group.column(column).to_pylist()), kind)


def _heads(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start flags and lengths of the runs of equal tokens, for each entry."""
    head = np.ones(len(token), bool)
    head[1:] = token[1:] != token[:-1]
    which = np.cumsum(head) - 1
    return head, np.bincount(which)[which] if len(token) else which


def _summed(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, inverse = np.unique(ids, return_inverse=True)
    return nodes, np.bincount(inverse, counts, len(nodes)).astype(np.int32)


#: To a bucket of shingles (from 0): a piece's shingles, for each one class and whether the piece has credited its classes. To a receiver of credits (-1, -2, ...): in `nodes` classes and in `tokens` their credits.
POSTINGS = ["bucket", "tokens", "nodes", "credited"]
POSTING_KINDS = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _prefixes(batches: Iterator[pa.RecordBatch], size: int, percent: int, buckets: int, receivers: int) -> Iterator[pa.RecordBatch]:
    """Each piece's shingles once. Those that several classes of the piece have are credited at once. Half of the hash will do: equal halves can only keep a class that could go, and so can credits that copies of a class get in several pieces."""
    for batch in pieces(batches, 0):
        words = Words(batch.column(0), lower=True)
        node, at = np.unique(contents(words)[:, 0], return_index=True)
        sets = shingle_sets(words, size)
        cut = [prefix(sets[i], percent) if len(sets[i]) else sets[i] for i in at]
        full = np.concatenate(cut) if cut else np.zeros(0, np.uint64)
        token, node = full >> np.uint64(32), np.repeat(node, [len(s) for s in cut])
        order = np.argsort(token, kind="stable")
        token, node = token[order].astype(np.uint32), node[order]
        head, length = _heads(token)
        known, credits = _summed(node[length > 1], np.ones(int((length > 1).sum())))
        rows = list(_split((mix(token[head].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), buckets, token[head], node[head], length[head] > 1))
        rows += [(-1 - r, c, n, b"") for r, n, c in _split(known % receivers, receivers, known, credits)]
        yield from _rows(rows, POSTINGS, POSTING_KINDS)


CREDITS = "receiver int, nodes binary, credits binary"


def _shared(key: tuple[pa.Scalar, ...], group: pa.Table, receivers: int) -> pa.Table:
    """How many shingles of the bucket each class shares with another, besides what its piece has credited."""
    bucket = key[0].as_py()
    if bucket < 0:
        out = [(-1 - bucket, *(x.tobytes() for x in _summed(_joined(group, "nodes", "<i8"), _joined(group, "tokens", "<i4"))))]
    else:
        token, node, done = _joined(group, "tokens", "<u4"), _joined(group, "nodes", "<i8"), _joined(group, "credited", bool)
        order = np.lexsort((~done, node, token))
        token, node, done = token[order], node[order], done[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, done = token[new], node[new], done[new]
        mine = (_heads(token)[1] > 1) & ~done
        known, credits = _summed(node[mine], np.ones(int(mine.sum())))
        out = list(_split(known % receivers, receivers, known, credits))
    return _table(out, ["receiver", "nodes", "credits"], [pa.int32(), pa.binary(), pa.binary()])


def _credited(group: pa.Table) -> pa.Table:
    node, shared = _summed(_joined(group, "nodes", "<i8"), _joined(group, "credits", "<i4"))
    return pa.table({"c1": pa.array(node), "shared": pa.array(shared.astype(np.int64))})


def _of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, n, text and piece of the rows whose words are those of the class: an id may have rows with other texts."""
    piece = TaskContext.get().partitionId() << 32
    for batch in pieces(batches, 2):
        want = np.stack([batch.column(i).to_numpy() for i in (3, 4)], 1)
        same = pa.array((contents(Words(batch.column(2), lower=True)) == want).all(1))
        kept = batch.select([0, 1, 2]).filter(same)
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.full(kept.num_rows, piece))], names=["node", "n", "text", "piece"])
        piece += 1


COUNTED = ["bucket", "piece", "tokens", "counts"]
COUNTED_KINDS = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def _counted(batches: Iterator[pa.RecordBatch], size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """How many classes of each piece have each of its shingles."""
    for batch in pieces(batches, 1):
        own = batch.column(0).to_numpy()
        sets = shingle_sets(Words(batch.column(1), lower=True), size)
        for piece in np.unique(own).tolist():
            token, n = np.unique(np.concatenate([sets[i] for i in np.flatnonzero(own == piece)]), return_counts=True)
            place = (mix(token) % np.uint64(buckets)).astype(np.int64)
            yield from _rows([(b, piece, t, c) for b, t, c in _split(place, buckets, token, n.astype(np.int32))], COUNTED, COUNTED_KINDS)


def _frequent(group: pa.Table) -> pa.Table:
    """To each piece: which of its shingles in this bucket two classes have at least, and how many have them."""
    sent = group.column("tokens").to_pylist()
    token = np.frombuffer(b"".join(sent), np.uint64)
    _, inverse = np.unique(token, return_inverse=True)
    total = np.bincount(inverse, _joined(group, "counts", "<i4"))[inverse].astype(np.int64)
    ends = np.cumsum([len(t) // 8 for t in sent])
    rows = []
    for piece, a, b in zip(group.column("piece").to_pylist(), np.append(0, ends[:-1]), ends, strict=True):
        several = total[a:b] > 1
        if several.any():
            rows.append((piece, token[a:b][several].tobytes(), total[a:b][several].tobytes()))
    return _table(rows, ["piece", "tokens", "counts"], [pa.int64(), pa.binary(), pa.binary()])


#: To a bucket of shingles (from 0): for each chain of a piece the shingle, the first node, and the least and the largest size. Below 0: edges, in `tokens` and `nodes`.
RARE = ["bucket", "tokens", "nodes", "low", "high"]
RARE_KINDS = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _chains(token: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> np.ndarray:
    """Start flags of the chains: runs of one token, in order of low, that are cut where all sets before are too small for the next. A similar pair is in one chain: its sizes fit, and so do those between them."""
    head = np.ones(len(token), bool)
    new = token[1:] != token[:-1]
    run = np.append(0, np.cumsum(new)) << 40  # sizes are smaller, so the running maximum starts anew with each token
    head[1:] = new | (np.maximum.accumulate(high + run[: len(high)])[:-1] - run[1 : len(high)] < need(low[1:], percent))
    return head


def _edges(head: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Edges between the first node of each run and the others."""
    first = node[head][np.cumsum(head) - 1] if len(node) else node
    return np.unique(np.stack([node[~head], first[~head]], 1), axis=0) if len(node) else np.zeros((0, 2), np.int64)


def _rare(texts: pa.Table, frequent: pa.Table, size: int, percent: int, buckets: int) -> pa.Table:
    """Each node's shared shingles without the most frequent ones, of which a partner has one more. Nodes of the piece that have one in common, and sizes that fit, get edges."""
    token, count = _joined(frequent, "tokens", np.uint64), _joined(frequent, "counts", "<i8")
    order = np.argsort(token)
    token, count = token[order], count[order]
    kept, nodes, sizes = [], [], []
    if texts.num_rows and len(token):
        for i, s in enumerate(shingle_sets(Words(_array(texts.column("text")), lower=True), size)):
            at = np.minimum(np.searchsorted(token, s), len(token) - 1)
            at = at[token[at] == s]
            spare = int(need(len(s), percent)) - 1
            if len(at) > spare:
                kept.append(token[at[np.lexsort((token[at], count[at]))[: len(at) - spare]]])
                nodes.append(i)
                sizes.append(len(s))
    rows = []
    if kept:
        each = [len(k) for k in kept]
        node, n = np.repeat(texts.column("node").to_numpy()[nodes], each), np.repeat(np.array(sizes, np.int64), each)
        token = np.concatenate(kept)
        order = np.lexsort((node, n, token))
        token, node, n = token[order], node[order], n[order]
        head, last = (h := _chains(token, n, n, percent)), np.append(h[1:], True)
        rows = list(_split((mix(token[head]) % np.uint64(buckets)).astype(np.int64), buckets, token[head], node[head], n[head], n[last]))
        edges = _edges(head, node)
        rows += [(-1 - b, u, v, b"", b"") for b, u, v in _split(edges[:, 1] % buckets, buckets, edges[:, 0], edges[:, 1])]
    return _table(rows, RARE, RARE_KINDS)


def _stars(key: tuple[pa.Scalar, ...], group: pa.Table, percent: int) -> pa.Table:
    """Edges between the first node of each chain of a shingle and the others."""
    token, node = _joined(group, "tokens", np.uint64), _joined(group, "nodes", "<i8")
    if key[0].as_py() < 0:
        return pa.table({"u": pa.array(token.view(np.int64)), "v": pa.array(node)})
    low, high = _joined(group, "low", "<i8"), _joined(group, "high", "<i8")
    order = np.lexsort((node, low, token))
    pairs = _edges(_chains(token[order], low[order], high[order], percent), node[order])
    return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})


def occurrences(lists: list[list[int]], least: int, low: int, high: int, skip, enough) -> Iterator[int]:
    """Numbers from low to below high that occur in enough(number) of the sorted lists, which is `least` at least.

    DivideSkip: the longest lists are put aside. A heap merges the others; numbers that too few of them have are
    skipped by binary search. What occurs often enough is looked up in the lists put aside. skip(number): not wanted.
    """
    spans = []
    for s in lists:
        a, b = bisect_left(s, low), len(s) if high > s[-1] else bisect_left(s, high)
        if b > a:
            spans.append((b - a, a, b, s))
    if len(spans) < least:
        return
    spans.sort(key=itemgetter(0))
    aside = min(least - 1, int(least / (MU * math.log2(spans[-1][0] + 1) + 1)))
    short, long = spans[: len(spans) - aside], spans[len(spans) - aside :]
    want = least - aside
    heap = [(s[a], k, a) for k, (_, a, _, s) in enumerate(short)]
    heapq.heapify(heap)

    def advance(k: int, at: int) -> None:
        if at < short[k][2]:
            heapq.heappush(heap, (short[k][3][at], k, at))

    while len(heap) >= want:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= want:
            if not skip(top):
                count, goal = len(popped), enough(top)
                for left, (_, a, b, s) in zip(range(len(long), 0, -1), long, strict=True):
                    if count >= goal or count + left < goal:
                        break
                    at = bisect_left(s, top, a, b)
                    count += at < b and s[at] == top
                if count >= goal:
                    yield top
            for _, k, at in popped:
                advance(k, at + 1)
        else:
            while heap and len(popped) < want - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            for _, k, at in popped:  # want - 1 lists are behind the next number: none of theirs before it can occur often enough
                advance(k, bisect_left(short[k][3], heap[0][0], at, short[k][2]))


class Overlaps:
    """How many elements sets share, for many pairs at once. Set i has token[first[i] : first[i + 1]]."""

    def __init__(self, first: np.ndarray, token: np.ndarray, n_tokens: int):
        k = len(first) - 1
        long = np.flatnonzero(np.bincount(token, minlength=n_tokens) * LONG >= k)
        column = np.full(n_tokens, -1)
        column[long] = np.arange(len(long))
        row, at = np.repeat(np.arange(k), np.diff(first)), column[token]
        self.matrix = np.zeros((k, len(long)), np.uint8)  # LONG bytes for each element of the sets at most
        self.matrix[row[at >= 0], at[at >= 0]] = 1
        self.kind = np.float32 if np.diff(first).max() < 1 << 24 else np.float64  # counts are exact
        row, self.token = row[at < 0], token[at < 0]
        self.first = np.searchsorted(row, np.arange(k + 1))
        order = np.argsort(self.token, kind="stable")
        self.sets, self.lists = row[order], np.searchsorted(self.token[order], np.arange(n_tokens + 1))
        self.place = np.empty(k, np.int64)

    def of(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The numbers of common elements, rows x others."""
        out = self.matrix[rows].astype(self.kind) @ self.matrix[others].astype(self.kind).T
        self.place[:] = -1
        self.place[others] = np.arange(len(others))
        n = self.first[rows + 1] - self.first[rows]
        token = self.token[spread(self.first[rows], n)]
        m = self.lists[token + 1] - self.lists[token]
        other = self.place[self.sets[spread(self.lists[token], m)]]
        asks = np.repeat(np.repeat(np.arange(len(rows)), n), m)
        return out + np.bincount((asks * len(others) + other)[other >= 0], minlength=out.size).reshape(out.shape)


def links(sets: list[np.ndarray], percent: int, label: list[int] | None = None, asked: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join what the similar pairs of sets join (a spanning forest), as places in sets.

    With `asked`: only pairs of one of these places and one of the others, whose labels differ.
    Else each set, from the smallest, asks an index of leaders; it becomes a leader itself if it is linked with none.
    Then sets outside the largest component ask for what leaders don't stand for: members that are linked elsewhere.
    """
    order = sorted((i for i in range(len(sets)) if len(sets[i])), key=lambda i: len(sets[i]))
    size = [len(sets[i]) for i in order]
    if not order:
        return []
    flat = np.concatenate([sets[i] for i in order])
    _, token, n = np.unique(flat, return_inverse=True, return_counts=True)
    several = n[token] > 1
    ends = np.cumsum(size)
    together = int((n[n > 1] ** 2).sum()) > TOGETHER
    own = [] if together else [token[e - s : e][several[e - s : e]].tolist() for s, e in zip(size, ends.tolist(), strict=True)]
    root = list(range(len(order)))
    found: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def unite(x: int, y: int) -> None:
        root[find(x)] = find(y)

    def ask(x: int, index: dict[int, list[int]], high: int) -> bool:
        """Link x with what the index has, once for each component."""
        least, hit = int(need(size[x], percent)), False
        if len(own[x]) < least:
            return False
        lists = [s for s in map(index.get, own[x]) if s]
        enough = lambda y: -(-percent * (size[x] + size[y]) // (100 + percent))
        for y in occurrences(lists, least, bisect_left(size, least), high, lambda y: find(y) == find(x), enough):
            found.append((order[x], order[y]))
            unite(x, y)
            hit = True
        return hit

    def add(x: int, index: dict[int, list[int]]) -> None:
        for t in own[x]:
            index[t].append(x)

    def join(x: int, y: int) -> None:
        if find(x) != find(y):
            found.append((order[x], order[y]))
            unite(x, y)

    def similar(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        return overlaps.of(xs, ys) >= -(-percent * (sizes[xs][:, None] + sizes[ys]) // (100 + percent))

    def ask_together(xs: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Link each of xs with what the index has, once for each component. Both are in order. Whether each has a similar set there."""
        hit = np.zeros(len(xs), bool)
        for lo in range(0, len(xs), ROWS):
            part = xs[lo : lo + ROWS]
            a, b = np.searchsorted(sizes[index], need(sizes[part[0]], percent)), np.searchsorted(sizes[index], sizes[part[-1]] * 100 // percent, "right")
            for at in range(a, b, WIDE):
                some = index[at : min(at + WIDE, b)]
                x, y = np.nonzero(similar(part, some))
                hit[lo + x] = True
                names = np.array([find(v) for v in some.tolist()])
                for i in np.unique(x * len(root) + names[y], return_index=True)[1].tolist():
                    join(int(part[x[i]]), int(some[y[i]]))
        return hit

    if together:
        sizes = np.array(size)
        overlaps = Overlaps(np.append(0, np.cumsum(np.add.reduceat(several, ends - sizes))), token[several], len(n))

    largest = lambda x: bisect_left(size, size[x] * 100 // percent + 1)
    if asked is not None:
        first: dict[int, int] = {}
        place = {i: x for x, i in enumerate(order)}
        for i, x in place.items():
            unite(x, first.setdefault(label[i], x))
        if together:
            asks = np.isin(order, asked)
            ask_together(np.flatnonzero(asks), np.flatnonzero(~asks))
            return found
        index, questions = defaultdict(list), set(asked)
        for x, i in enumerate(order):
            if i not in questions:
                add(x, index)
        for i in asked:
            if i in place:
                ask(place[i], index, largest(place[i]))
        return found
    leaders, members, rest = defaultdict(list), defaultdict(list), []
    heads = np.zeros(0, np.int64)
    for lo in range(0, len(order), ROWS) if together else ():
        part = np.arange(lo, min(lo + ROWS, len(order)))
        hit = ask_together(part, heads)
        alone, new = part[~hit], []
        near = similar(alone, alone)
        rest += part[hit].tolist()
        for i, x in enumerate(alone.tolist()):
            if len(to := np.flatnonzero(near[i, new])):
                rest.append(x)
                for j in to.tolist():
                    join(x, int(alone[new[j]]))
            else:
                new.append(i)
        heads = np.append(heads, alone[new])
    for x in () if together else range(len(order)):
        if ask(x, leaders, x):
            rest.append(x)
        else:
            add(x, leaders)
    if rest:
        weight: dict[int, int] = defaultdict(int)
        for x in range(len(order)):
            weight[find(x)] += size[x]
        top = max(weight, key=lambda r: (weight[r], r))
        others = [x for x in range(len(order)) if find(x) != top]
        if together:
            ask_together(np.array(others, np.int64), np.sort(rest))
            ask_together(np.array(sorted({*others} & {*rest}), np.int64), heads)
        elif others:
            for x in rest:
                add(x, members)
            joined = set(rest)
            for x in others:
                ask(x, members, largest(x))
                if x in joined:
                    ask(x, leaders, largest(x))
    return found


def _array(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


LINKS = "u long, v long"


def _link(group: pa.Table, size: int, percent: int) -> pa.Table:
    """Links in a group of node, text; with a column `asks`, those between rows that ask and the others, of different `label`."""
    if not group.num_rows:
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    sets = shingle_sets(Words(_array(group.column("text")), lower=True), size)
    node = group.column("node").to_numpy()
    if "asks" in group.column_names:
        got = links(sets, percent, group.column("label").to_pylist(), np.flatnonzero(group.column("asks").to_numpy()).tolist())
    else:
        got = links(sets, percent)
    u, v = (np.array([node[x[k]] for x in got], np.int64) for k in (0, 1))
    return pa.table({"u": pa.array(u), "v": pa.array(v)})


def _in_blocks(placed: DataFrame, size: int, percent: int) -> DataFrame:
    """Links of all groups. placed: component (the group), blocks, node, n, text.

    Each text meets its own block. For groups of several blocks, one text of each component within a block meets
    those of the other blocks; after that the texts outside the group's largest component meet every block.
    """
    hashed = F.xxhash64("node")
    own = placed.withColumn("block", F.pmod(hashed, F.col("blocks")).cast("int"))
    within = written(own.select("component", "block", "node", "text").groupBy("component", "block").applyInArrow(lambda g: _link(g, size, percent), LINKS), "links")
    large = own.where("blocks > 1")
    if large.isEmpty():
        return within

    def labelled(found: DataFrame) -> DataFrame:
        names = components(found, "labels").select("node", F.col("component").alias("label"))
        return large.join(names, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def slots(df: DataFrame, name: str) -> DataFrame:
        """How many slots of about BLOCK shingles the rows of each group fill."""
        return df.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias(name))

    heads = labelled(within).where("node = label")
    heads = heads.join(slots(heads, "slots"), "component").withColumn("slot", F.pmod(hashed, F.col("slots")).cast("int"))
    between = written(heads.select("component", "slot", "node", "text").groupBy("component", "slot").applyInArrow(lambda g: _link(g, size, percent), LINKS), "links_between")
    found = within.unionByName(between)
    rows = written(labelled(found), "labelled")
    top = rows.groupBy("component", "label").agg(F.sum("n").alias("n")).groupBy("component").agg(F.max_by("label", "n").alias("top"))
    rows = rows.join(top, "component")
    outside = rows.where("label <> top")
    # Home rows come once for each slot of the rows outside, these once for each block; both are few if one component holds most of a group.
    fill = written(slots(outside, "slots"), "outside")
    home = rows.join(fill, "component").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).withColumn("asks", F.lit(False))
    asking = outside.join(fill, "component").withColumn("slot", F.pmod(hashed, F.col("slots")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
    columns = ["component", "block", "slot", "node", "label", "asks", "text"]
    last = home.select(columns).unionByName(asking.select(columns)).groupBy("component", "block", "slot").applyInArrow(lambda g: _link(g, size, percent), LINKS)
    return found.unionByName(written(last, "links_outside"))


def _labelled_rows(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, component (the node that names it; null without shingles or id) and component_id of every row."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    rows = written(narrow.mapInArrow(lambda b: _sets(b, size), SETS), "sets")
    usable = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    one = usable.groupBy("c1", "c2").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"))
    classes = written(one.withColumn("node", F.monotonically_increasing_id()), "classes")  # as a table: the numbers stay
    named = narrow.where("doc_id IS NOT NULL")
    receivers = partitions(docs.sparkSession)
    buckets = 4 * receivers

    posted = named.select("text").mapInArrow(lambda b: _prefixes(b, size, percent, buckets, receivers), "bucket int, tokens binary, nodes binary, credited binary")
    credits = posted.groupBy("bucket").applyInArrow(lambda k, g: _shared(k, g, receivers), CREDITS)
    shared = credits.groupBy("receiver").applyInArrow(_credited, "c1 long, shared long")
    # A partner has at least percent of n shingles, and the pair shares 1 + extra() of the partner's number at least.
    least = F.floor(F.ceil(F.col("n") * percent / 100) / 4) + 1
    chosen = classes.join(shared, "c1").where(F.col("shared") >= least)
    met = named.join(chosen, "doc_id").groupBy("doc_id", "text_key", "node", "n", "c1", "c2").agg(F.first("text").alias("text"))  # equal rows once
    texts = written(met.select("node", "n", "text", "c1", "c2").mapInArrow(_of_class, "node long, n long, text string, piece long"), "candidates")

    counts = texts.select("piece", "text").mapInArrow(lambda b: _counted(b, size, buckets), "bucket int, piece long, tokens binary, counts binary")
    frequent = counts.groupBy("bucket").applyInArrow(_frequent, "piece long, tokens binary, counts binary")
    rare = texts.groupBy("piece").cogroup(frequent.groupBy("piece")).applyInArrow(lambda t, f: _rare(t, f, size, percent, buckets), "bucket int, tokens binary, nodes binary, low binary, high binary")
    stars = rare.groupBy("bucket").applyInArrow(lambda k, g: _stars(k, g, percent), LINKS)
    groups = written(components(stars, "candidate_groups"), "candidate_groups")

    grouped = texts.select("node", "n", "text").join(groups, "node")
    blocks = groups.join(classes.select("node", "n"), "node").groupBy("component").agg(F.greatest(F.ceil(F.sum("n") / BLOCK), F.lit(1)).cast("int").alias("blocks"))
    found = _in_blocks(grouped.join(written(blocks, "blocks"), "component"), size, percent)
    named_by = classes.join(components(found, "link_components"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named_by.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    member = named_by.join(smallest, "component").select("c1", "c2", "component", "component_id")
    out = rows.join(member, ["c1", "c2"], "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return out.select("doc_id", "text_key", "n_shingles", F.when(linked, F.col("component")).alias("component"), F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def ngram_components(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the smallest id that links between rows reach from it.

    A row's set: the distinct `size`-word shingles of its words, A-Z in lower case; with fewer words, all of them as
    one; a null or empty text has the empty set, linked with nothing. Rows link when the intersection is at least
    `percent` of the union. Rows without an id link with nothing and have a null component; rows with one id are
    rows of their own: those with different texts may be in different components. Repeated rows get equal results.
    An empty table gives no row. Other columns are not read.
    Exact up to collisions of 64-bit shingle hashes and 128-bit content hashes. No link between different texts is
    lost; links that join what is joined already are not searched for.
    """
    return _labelled_rows(docs, size, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of ngram_components() the row with the smallest id; its columns are those of docs.

    Of rows with that id in the component the one with the smallest text hash stays, and of equal rows (id and text)
    one. Rows without an id, and rows without words, are linked with nothing: all of them stay. An id whose rows have
    different texts in several components keeps one row for each. An empty table gives no row.
    """
    rows = _labelled_rows(docs, size, percent, id_col, text_col).where("component IS NOT NULL AND doc_id = component_id")
    first = rows.groupBy("component").agg(F.min("doc_id").alias("i"), F.min("text_key").alias("t"))
    # One struct of the row: no column of docs can clash with the names used here.
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("i"), F.xxhash64(text_col).alias("t"), F.coalesce(F.regexp_like(text_col, F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)).alias("words"))
    alone = packed.where("i IS NULL OR NOT words").select("row.*")
    kept = packed.where("i IS NOT NULL AND words").join(first.select("i", "t").distinct(), ["i", "t"], "left_semi").groupBy("i", "t").agg(F.first("row").alias("row"))
    return kept.select("row.*").unionByName(alone)
