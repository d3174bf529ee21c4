"""Conversation prefix trie: what conversations share from their start.

A conversation is the path of its turns' digests. Distinct paths, in order, go to tasks in ranges; each task takes
them in shards of bounded size, whose trie is a string of balanced parentheses. findclose() delimits a node's subtree,
rank counts its childless nodes, and cumulative arrays over the preorder give members and savings. Only the nodes on
a shard's first and last path (its spines) can go on in the next shard: they come as partial rows, which are merged
by key, less what both neighbours have counted.

Long conversations are cut into bands of turns: a band's tries hang below the last nodes of the band above, and hand
their totals up, the deepest band first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import word_count, written
from flowlens.llm.kernels import ranges
from flowlens.llm.ordered import numbered
from flowlens.llm.parens import Parens

#: Turns of a band; a path in a band has 16 bytes for each. More if there would be more than BANDS of them.
BAND, BANDS = 512, 16
#: Turns of a shard.
SHARD = 1 << 16
#: Ids that are joined to one text before they are hashed.
IDS = 1 << 14
NOTHING = hashlib.sha256(b"").hexdigest()


def node_key(block: str, path: bytes) -> str:
    """The key of the node at `path` below the node `block` (the root: '')."""
    return hashlib.md5(block.encode() + path).hexdigest() if path else block


def rebuild(turns: DataFrame, salt: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns (c, d, digest, words) of rebuilt conversations, d from 1, and their number (c, n).

    turns: conv_id, turn, role, text. Conversation c gets the first h turns of c - c % salt (h: CRC-32 of c as text,
    modulo heads), then its own without the first h.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    known = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").cast("string").alias("g"), F.col("conv_id").cast("long").alias("c"), "turn",
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"), word_count(text).cast("int").alias("words"),
    )
    placed = numbered(known, "g", ["turn", "digest"], ["c", "digest", "words"], "pos").withColumn("pos", F.col("pos") + 1)
    # c as a number: g is its text, by which the ranges were made.
    counts = placed.groupBy("c").agg(F.count("*").alias("own")).withColumns({"h": F.crc32(F.col("c").cast("string").cast("binary")) % heads, "base": F.col("c") - F.col("c") % salt})
    counts = written(counts, "conversations")
    bases = counts.where("c = base").select("base", F.col("own").alias("there"))
    info = written(counts.join(bases, "base", "left").select("c", "own", "h", "base", F.when(F.col("c") == F.col("base"), F.lit(0)).otherwise(F.least("h", F.coalesce("there", F.lit(0)))).alias("got"), (F.col("c") == F.col("base")).alias("whole")), "conversations")
    own = placed.join(info.select("c", "h", "got", "whole"), "c").where("whole OR pos > h")
    own = own.select("c", F.when(F.col("whole"), F.col("pos")).otherwise(F.col("pos") - F.col("h") + F.col("got")).alias("d"), "digest", "words")
    first = placed.where((F.col("pos") < heads) & (F.col("c") % salt == 0)).withColumnRenamed("c", "base")
    given = info.where("NOT whole AND got > 0").select("c", "base", "got").join(first, "base").where("pos <= got").select("c", F.col("pos").alias("d"), "digest", "words")
    totals = info.select("c", F.when(F.col("whole"), F.col("own")).otherwise(F.col("got") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("n"))
    return own.unionByName(given), totals


def _digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order, for each run of a node in texts of at most IDS ids."""
    node, ids = None, []
    made: list[tuple[str, int, str]] = []

    def out() -> pa.RecordBatch:
        rows, made[:] = list(made), []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["node", "first", "ids"])

    for batch in batches:
        nodes, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for k, i in zip(nodes, numbers, strict=True):
            if ids and (k != node or len(ids) == IDS):
                made.append((node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = k
            ids.append(i)
        if made:
            yield out()
    if ids:
        made.append((node, ids[0], ",".join(map(str, ids))))
        yield out()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's texts, joined by commas, as they stream by."""
    node, state = None, None
    for batch in batches:
        made: list[tuple[str, str]] = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if k == node:
                state.update(b",")
            else:
                if node is not None:
                    made.append((node, state.hexdigest()))
                node, state = k, hashlib.sha256()
            state.update(memoryview(ids.as_buffer()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], pa.string()) for i in (0, 1)], names=["node", "ends"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=["node", "ends"])


def end_digests(ends: DataFrame) -> DataFrame:
    """ends: node, c. For each node the SHA-256 of its ids in order, comma-joined.

    Ids are sorted in ranges of (node, id), so a hot node lies in many; each range joins its own to texts, and what
    hashes them, one after the other as SHA-256 must, gets a row for IDS ids.
    """
    texts = ends.select("node", "c").repartitionByRange("node", "c").sortWithinPartitions("node", "c").mapInArrow(_digits, "node string, first long, ids string")
    return texts.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(_hashed, "node string, ends string")


NODES = "kind int, part int, block string, depth int, key string, parent_key string, conv long, parent_conv long, n_convs long, n_children long, n_leaves long, saved long, ends string, path binary, words array<int>"
_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string(), pa.binary(), pa.list_(pa.int32())]
_NAMES = [c.split()[0] for c in NODES.split(", ")]
WHOLE, SPINE, FIRST, LAST = range(4)


def _batch(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[c].cast(t) if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)


class _Path:
    """One row of a shard: a path below the root of its block."""

    def __init__(self, block: str, path: bytes, words: np.ndarray):
        self.block, self.path, self.words = block, path, words

    def shared(self, other: "_Path") -> int:
        """Nodes that both have, with the block's root."""
        if self.block != other.block:
            return 0
        n = min(len(self.path), len(other.path)) // 16
        a, b = (np.frombuffer(x.path[: 16 * n], np.uint8).reshape(n, 16) for x in (self, other))
        wrong = np.flatnonzero((a != b).any(1))
        return 1 + (int(wrong[0]) if len(wrong) else n)

    def keys(self, upto: int) -> list[str]:
        return [node_key(self.block, self.path[: 16 * j]) for j in range(upto)]


def _overlap(before: _Path, after: _Path) -> pa.RecordBatch | None:
    """What two neighbouring shards have both counted, as rows to be added to the nodes that they share."""
    n = before.shared(after)
    if not n:
        return None
    keys, words = before.keys(n), np.array([0, *before.words[: n - 1]], np.int64)
    again = np.cumsum(words[::-1])[::-1]
    ended = int(len(before.path) // 16 + 1 == n)  # the last path before looked childless
    return _batch(n, kind=np.full(n, SPINE, np.int32), block=[before.block] * n, depth=np.arange(n, dtype=np.int32), key=keys, parent_key=[None, *keys[:-1]], n_convs=np.zeros(n, np.int64), n_children=np.array([-1] * (n - 1) + [0], np.int64), n_leaves=np.full(n, -ended, np.int64), saved=again)


def _lowest(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first .. last] for each pair, from minima of powers of two."""
    out, span, table = np.empty(len(first), values.dtype), 1, values
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[first[own]], table[last[own] - span + 1])
        if 2 * span <= len(values):
            table = np.minimum(table[:-span], table[span:])
        span *= 2
    return out


def _shard(block: pa.Array, path: pa.Array, words: pa.Array, conv: np.ndarray, count: np.ndarray, kids: np.ndarray, leaves: np.ndarray, savings: np.ndarray, ends: pa.Array) -> Iterator[pa.RecordBatch]:
    """The nodes of sorted distinct paths: whole ones, and partial ones on the first and the last path."""
    rows = len(block)
    blocks = block.to_pylist()
    names = np.array(blocks, object)
    paths = path.to_pylist()
    length = np.fromiter(map(len, paths), np.int64, rows) // 16
    turns = np.frombuffer(b"".join(paths), "<u8").reshape(-1, 2)
    start = np.cumsum(length) - length
    weight = words.flatten().to_numpy(zero_copy_only=False)
    # Nodes shared with the path before: the root of the block, and equal turns.
    same = np.zeros(rows, bool)
    same[1:] = names[1:] == names[:-1]
    most = np.where(same, np.minimum(length, np.roll(length, 1)), 0)
    row = np.repeat(np.arange(rows), most)
    at = ranges(most)
    wrong = (turns[start[row] + at] != turns[start[row - 1] + at]).any(1)
    shared = most.copy()
    np.minimum.at(shared, row[wrong], at[wrong])
    shared = np.where(same, shared + 1, 0)
    # The trie in preorder: what a path opens after closing what it does not share.
    size = length + 1
    opened = size - shared
    closed = np.append(np.where(np.arange(rows) > 0, np.roll(size, 1) - shared, 0), size[-1])
    bits = np.repeat(np.tile([False, True], rows + 1)[:-1], np.column_stack([closed, np.append(opened, 0)]).ravel()[:-1])
    tree = Parens(bits)
    node_row = np.repeat(np.arange(rows), opened)
    depth = shared[node_row] + ranges(opened)
    close = tree.findclose(tree.opens)
    n = len(node_row)
    after = np.arange(n) + (close - tree.opens + 1) // 2  # the first node in preorder that is not below
    end_row = node_row[after - 1]
    full = np.flatnonzero(depth == length[node_row])  # one for each row
    upto = np.concatenate([[0], np.cumsum(count)])
    members = upto[end_row + 1] - upto[node_row]
    least = _lowest(conv, node_row, end_row)
    w = np.where(depth > 0, weight[np.maximum(start[node_row] + depth - 1, 0)], 0) if len(weight) else np.zeros(n, np.int64)
    own_saved = (members - 1) * w
    own_saved[full] += savings
    more_leaves = np.zeros(n, np.int64)
    more_leaves[full] = np.where(kids > 0, leaves - 1, 0)  # a path that goes on in the next band looks childless here
    below = np.concatenate([[0], np.cumsum(own_saved)])
    extra = np.concatenate([[0], np.cumsum(more_leaves)])
    saved = below[after] - below[:-1]
    leaf = tree.leaves(tree.opens, close) + extra[after] - extra[:-1]
    # Parents: the node one less deep that opened last.
    parent = np.full(n, -1)
    order = np.argsort(depth, kind="stable")
    edge = np.searchsorted(depth[order], np.arange(int(depth.max()) + 2))
    for d in range(1, int(depth.max()) + 1):
        own, above = order[edge[d] : edge[d + 1]], order[edge[d - 1] : edge[d]]
        parent[own] = above[np.searchsorted(above, own) - 1]
    children = np.bincount(parent[parent >= 0], minlength=n)
    children[full] += kids
    spine = (node_row == 0) | (end_row == rows - 1)
    place = np.full(n, -1)
    place[full] = np.arange(rows)
    end_of = ends.take(pa.array(place, mask=place < 0))
    keys: dict[int, str] = {}
    for i in np.flatnonzero(spine).tolist():
        keys[i] = node_key(blocks[node_row[i]], paths[node_row[i]][: 16 * int(depth[i])])
    for kind in (WHOLE, SPINE):
        pick = np.flatnonzero(spine if kind else ~spine)
        if not len(pick):
            continue
        up = parent[pick]
        lost = np.array([kind == SPINE or p in keys for p in up.tolist()])
        yield _batch(
            len(pick), kind=np.full(len(pick), kind, np.int32), block=block.take(pa.array(node_row[pick])), depth=depth[pick].astype(np.int32),
            key=[keys.get(i) for i in pick.tolist()], parent_key=[keys.get(p) for p in up.tolist()], conv=least[pick], parent_conv=pa.array(least[up], mask=lost | (up < 0)),
            n_convs=members[pick], n_children=children[pick], n_leaves=leaf[pick], saved=saved[pick], ends=end_of.take(pa.array(pick)),
        )


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted paths in shards of at most SHARD turns (or one path); their nodes, and the task's first and last path."""
    part, last, held, size = TaskContext.get().partitionId(), None, [], 0

    def edge(batch: pa.RecordBatch, i: int) -> _Path:
        return _Path(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), np.array(batch.column(2)[i].as_py(), np.int64))

    def told(kind: int, p: _Path) -> pa.RecordBatch:
        return _batch(1, kind=[kind], part=[part], block=[p.block], path=[p.path], words=[p.words.tolist()])

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal last, held, size
        one = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        first = edge(one, 0)
        if last is None:
            yield told(FIRST, first)
        elif (both := _overlap(last, first)) is not None:
            yield both
        yield from _shard(one.column(0), one.column(1), one.column(2), *(one.column(i).to_numpy(zero_copy_only=False) for i in range(3, 8)), one.column(8))
        last, held, size = edge(one, one.num_rows - 1), [], 0

    for batch in batches:
        if not batch.num_rows:
            continue
        turns = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64) // 16 + 1)
        done = 0
        while done < batch.num_rows:
            room = SHARD - size
            before = int(turns[done - 1]) if done else 0
            upto = max(int(np.searchsorted(turns, before + room, "right")), done + (not held))
            if upto > done:
                held.append(batch.slice(done, upto - done))
                size += int(turns[upto - 1]) - before
                done = upto
            if done < batch.num_rows:
                yield from close()
    if held:
        yield from close()
    if last is not None:
        yield told(LAST, last)


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            a, b = (_Path(r[f"block{i}"], r[f"path{i}"], np.array(r[f"words{i}"], np.int64)) for i in (0, 1))
            if (both := _overlap(a, b)) is not None:
                yield both


def _band_nodes(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """paths: block, path, words, conv, n_convs, kids, leaves, saved, ends; distinct by (block, path). Returns the nodes with their parents' conv, and the blocks' roots."""
    sorted_paths = written(paths, "paths").repartitionByRange("block", "path").sortWithinPartitions("block", "path")
    nodes = written(sorted_paths.select("block", "path", "words", "conv", "n_convs", "kids", "leaves", "saved", "ends").mapInArrow(_shards, NODES), "trie")
    spark = nodes.sparkSession
    parts = [r["part"] for r in nodes.where(F.col("kind") == FIRST).select("part").orderBy("part").collect()]  # one number for each range
    pairs = F.broadcast(spark.createDataFrame(list(zip(parts, parts[1:])), "part0 int, part1 int"))
    sides = [nodes.where(F.col("kind") == k).select(*[F.col(c).alias(f"{c}{i}") for c in ("part", "block", "path", "words")]) for i, k in enumerate((LAST, FIRST))]
    overlaps = sides[0].join(pairs, "part0").join(sides[1], "part1").select("block0", "path0", "words0", "block1", "path1", "words1").mapInArrow(_between, NODES)
    partial = nodes.where(F.col("kind") == SPINE).unionByName(overlaps)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    spines = written(partial.groupBy("block", "depth", "key").agg(F.max("parent_key").alias("parent_key"), F.min("conv").alias("conv"), *sums, F.max("ends").alias("ends")), "spines")
    above = spines.select(F.col("key").alias("parent_key"), F.col("conv").alias("parent_conv"))
    columns = ["block", "depth", "conv", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    whole = nodes.where(F.col("kind") == WHOLE)
    out = whole.where("parent_key IS NULL").select(columns).unionByName(whole.where("parent_key IS NOT NULL").drop("parent_conv").join(above, "parent_key").select(columns))
    inner = spines.where("depth > 0").join(above, "parent_key").select(columns)
    roots = spines.where("depth = 0").withColumn("parent_conv", F.lit(None).cast("long")).select(columns).unionByName(whole.where("depth = 0").select(columns))
    return out.where("depth > 0").unionByName(inner), roots


def prefix_trie(turns: DataFrame, totals: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: c, d (1 .. n without gaps), digest (32 hexadecimal digits; equal digests are equal turns), words (a function
    of the digest). totals: c, n; one row for each conversation, those without turns too. A node is a distinct sequence
    of first turns; conversations that start with it are its members, conv_id the smallest. saved_tokens sums, over the
    node's subtree, words of the last turn times members less one. An empty table gives no row; no key may be null.
    """
    spark = turns.sparkSession
    deepest = totals.agg(F.max("n").alias("n")).first()["n"]
    band = max(BAND, -(-(deepest or 0) // BANDS))
    bands = (deepest or 0) // band + 1
    parts = turns.groupBy("c", F.floor((F.col("d") - 1) / band).cast("int").alias("band")).agg(F.sort_array(F.collect_list(F.struct("d", "digest", "words"))).alias("t"))  # at most `band` turns
    paths = parts.select("c", "band", F.unhex(F.array_join(F.transform("t", lambda t: t.digest), "")).alias("path"), F.transform("t", lambda t: t.words).alias("words"))
    stops = totals.where(F.col("n") % band == 0).select("c", (F.col("n") / band).cast("int").alias("band"), F.lit(b"").alias("path"), F.array().cast("array<int>").alias("words"))
    last = totals.select("c", F.floor(F.col("n") / band).cast("int").alias("last"))
    paths = written(paths.unionByName(stops).join(last, "c"), "paths")
    # Keys of the blocks, from the first band down.
    keyed, block = [], None
    node = F.when(F.length("path") == 0, F.col("block")).otherwise(F.md5(F.concat(F.col("block").cast("binary"), F.col("path"))))
    for b in range(bands):
        own = paths.where(F.col("band") == b)
        own = own.withColumn("block", F.lit("")) if block is None else own.join(block, "c")
        keyed.append(own.withColumn("node", node) if bands == 1 else written(own.withColumn("node", node), "keyed"))
        block = keyed[-1].where(F.col("last") > b).select("c", F.col("node").alias("block"))
    ends = keyed[0].where("band = last").select("node", "c")
    for k in keyed[1:]:
        ends = ends.unionByName(k.where("band = last").select("node", "c"))
    digests = written(end_digests(ends), "ends")
    result, below = None, None
    for b in reversed(range(bands)):
        distinct = keyed[b].groupBy("block", "path", "node").agg(F.min("c").alias("conv"), F.count("*").alias("n_convs"), F.first("words").alias("words"))
        # What stops at a later band's root has its digest in the band above.
        distinct = distinct.join(digests, "node", "left") if b == 0 else distinct.join(digests, "node", "left").withColumn("ends", F.when(F.length("path") > 0, F.col("ends")))
        if below is None:
            distinct = distinct.withColumns({"kids": F.lit(0).cast("long"), "leaves": F.lit(0).cast("long"), "saved": F.lit(0).cast("long")})
        else:
            distinct = distinct.join(below, "node", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("kids", "leaves", "saved")})
        nodes, roots = _band_nodes(distinct)
        nodes = nodes.withColumn("depth", (F.col("depth") + F.lit(b * band)).cast("long"))
        if b == 0:
            nodes = nodes.unionByName(roots.withColumn("depth", F.lit(0).cast("long")))
        result = nodes if result is None else result.unionByName(nodes)
        below = written(roots.select(F.col("block").alias("node"), F.col("n_children").alias("kids"), F.col("n_leaves").alias("leaves"), "saved"), "below")
    return result.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations (see rebuild()) of a table conv_id, turn, role, text.

    Turns of a conversation come by turn (null first); equal turns by the digest of role and text, and repeated rows are
    turns of their own. Null roles and texts are empty ones. Rows without conv_id are in no conversation. Texts of any
    length count as a digest and their words. Other columns are not read. An empty table gives no row.
    """
    turns, totals = rebuild(conversations.select("conv_id", "turn", "role", "text"))
    return prefix_trie(turns, totals)


#: CRC-32 of a number's decimal digits, as SQL.
CRC32_SQL = """xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(CAST({0} AS VARCHAR)) + 1), lambda k: CAST(ord(CAST({0} AS VARCHAR)[k]) AS BIGINT))),
 lambda c, b: list_reduce(list_concat([xor(c, b)], range(0, 8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)))"""

#: Prefixes by digests of digests; subtrees by pairs of a prefix and what a conversation has below it.
OP11_SQL = rf"""
WITH t AS (SELECT conv_id AS c, md5(octet_length(encode(r)) || ':' || r || x) AS g, CAST(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS BIGINT) AS w, turn FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
p AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) AS pos FROM t),
c AS (SELECT c, {CRC32_SQL.format("c")} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
f AS (SELECT c.c, p.pos, p.g, p.w FROM c JOIN p ON p.c = c.c - c.c % 20 AND p.pos <= c.h UNION ALL SELECT c.c, p.pos, p.g, p.w FROM c JOIN p ON p.c = c.c AND p.pos > c.h),
d AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, md5(string_agg(g, '') OVER (PARTITION BY c ORDER BY pos)) AS k, w FROM f UNION ALL SELECT c, 0, '', 0 FROM c),
l AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, max(d) OVER (PARTITION BY c) = d AS ends FROM d),
n AS (SELECT k, any_value(d) AS depth, min(c) AS conv_id, any_value(up) AS up, count(*) AS n_convs, any_value(w) AS w, string_agg(CASE WHEN ends THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS e FROM l GROUP BY k),
b AS (SELECT DISTINCT x.k AS top, y.k FROM l x JOIN l y ON x.c = y.c AND x.d <= y.d),
s AS (SELECT top, CAST(sum((n.n_convs - 1) * n.w) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE n.k NOT IN (SELECT up FROM n WHERE up IS NOT NULL)) AS n_leaves FROM b JOIN n USING (k) GROUP BY top)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, (SELECT count(*) FROM n x WHERE x.up = n.k) AS n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(n.e, '')) AS ends_sha256
FROM n JOIN s ON s.top = n.k LEFT JOIN n u ON u.k = n.up
"""
