"""Substring dedup: windows of k words that an earlier document has too, found by super-k-mers.

A window's minimiser is the smallest hash of the m-word grams in it. Consecutive windows of a document that share
one make up a super-k-mer. Only super-k-mers whose minimiser occurs in two documents can hold a repeated window, so
a first pass over the hashes drops the rest. Of equal super-k-mers the one in the smallest document stands for all:
those in other documents lie wholly in repeated windows, and those in the same document get the windows found for it.
Where different super-k-mers share a minimiser they travel as packed
strings to its bucket, and sorting their windows finds the equal ones. A minimiser with very many different
super-k-mers is split further: its windows travel alone, as digests, and are pre-aggregated before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import written
from flowlens.llm.kernels import Words, grams, mix, pieces, sliding_argmin

#: Words of the grams that minimisers are taken from.
GRAM = 8
#: Different super-k-mers of a minimiser that travel to one bucket (2 to 3 MB of text); with more, windows travel alone.
BUCKET = 5000
_NONE = -(1 << 63)


def super_kmers(words: Words, k: int) -> tuple[np.ndarray, ...]:
    """Row, first word in the row, windows, minimiser and content hash of each super-k-mer."""
    h = words.hashes()
    gram = min(GRAM, k)
    if len(h) < k:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    g = grams(h, gram)
    start = np.flatnonzero(np.arange(len(h)) + k <= words.first[1:][words.doc])
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    at = sliding_argmin(g, k - gram + 1)[start]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1] + 1) | (at[1:] != at[:-1]) | (words.doc[start[1:]] != words.doc[start[:-1]])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(start)))
    lo = start[first]
    content = n.astype(np.uint64)
    for s in (lo, lo + n - 1):  # the first and the last window cover all its words
        for i in range(k):
            content = mix(content * np.uint64(3) + h[s + i])
    doc = words.doc[lo]
    return doc, lo - words.first[doc], n, g[at[first]], content


KMERS = "doc_id long, key long, minimiser long, content long, start int, n int"


def _kmers(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 2):
        doc, start, n, low, content = super_kmers(Words(batch.column(2)), k)
        row = pa.array(doc)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(low.view(np.int64)), pa.array(content.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "key", "minimiser", "content", "start", "n"])


PACKED = "bucket long, packed binary, doc_id long, key long, start int, first int"


def _pack(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The wanted super-k-mers of each text as packed strings, or their windows as digests."""
    for batch in pieces(batches, 2):
        words = Words(batch.column(2))
        rows: list[tuple] = []
        for i, (doc_id, key, wanted) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            base = int(words.first[i])
            for x in wanted:
                s, n = x["start"], x["n"]
                if not x["alone"]:
                    rows.append((x["minimiser"], words.text(base + s, base + s + n + k - 1), doc_id, key, s, s))
                    continue
                for j in range(s, s + n):
                    d = xxhash.xxh3_128_digest(words.text(base + j, base + j + k))
                    rows.append((int.from_bytes(d[:8], "little", signed=True), d, doc_id, key, j, s))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["bucket", "packed", "doc_id", "key", "start", "first"])


#: first: the start of the super-k-mer that the span lies in.
SPANS = "doc_id long, key long, first int, start int, length int"


def _bucket(group: pa.Table, k: int) -> pa.Table:
    """Sort the windows of a bucket's strings; each window that a smaller document has too is a span."""
    windows: list[tuple[bytes, int, int, int]] = []
    ids, starts = group.column("doc_id").to_pylist(), group.column("start").to_pylist()
    for row, (packed, doc) in enumerate(zip(group.column("packed").to_pylist(), ids, strict=True)):
        at = [-1, *np.flatnonzero(np.frombuffer(packed, np.uint8) == 32).tolist(), len(packed)]
        windows += [(packed[at[i] + 1 : at[i + k]], doc, row, i) for i in range(len(at) - k)]
    windows.sort()
    hit: list[tuple[int, int]] = []
    last, least = None, 0
    for window, doc, row, i in windows:
        if window != last:
            last, least = window, doc
        elif doc > least:
            hit.append((row, i))
    hit.sort()
    spans: list[list[int]] = []
    for row, i in hit:
        if spans and spans[-1][0] == row and spans[-1][2] == i:
            spans[-1][2] = i + 1
        else:
            spans.append([row, i, i + 1])
    keys = group.column("key").to_pylist()
    return pa.table({"doc_id": pa.array([ids[r] for r, _, _ in spans], pa.int64()), "key": pa.array([keys[r] for r, _, _ in spans], pa.int64()), "first": pa.array([starts[r] for r, _, _ in spans], pa.int32()), "start": pa.array([starts[r] + i for r, i, _ in spans], pa.int32()), "length": pa.array([j - i + k - 1 for _, i, j in spans], pa.int32())})


def _cut(batches: Iterator[pa.RecordBatch], names: list[str], text: int) -> Iterator[pa.RecordBatch]:
    """n_words, n_removed and kept_text from the text and the spans, the column after `names`."""
    for batch in batches:
        total, gone, kept = [], [], []
        for text_of, spans in zip(batch.column(text), batch.column(len(names)), strict=True):
            words = text_of.as_buffer().to_pybytes().split() if text_of.is_valid else []
            total.append(len(words))
            spans = spans.as_py()
            if spans:
                keep = np.ones(len(words), bool)
                for s in spans:
                    keep[s["start"] : s["start"] + s["length"]] = False
                words = [words[i] for i in np.flatnonzero(keep)]
            gone.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        new = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *new], names=[*names, "n_words", "n_removed", "kept_text"])


def _packed(keyed: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """The chosen super-k-mers, cut from their texts."""
    wanted = chosen.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_list(F.struct("start", "n", "minimiser", "alone")).alias("_wanted"))
    return keyed.join(wanted, ["_id", "_key"]).select("_id", "_key", "_text", "_wanted").mapInArrow(lambda b: _pack(b, k), PACKED)


def dedup_substrings(docs: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_words, n_removed and kept_text (the words kept, joined by one space; columns of these names are replaced).

    A word is removed if it lies in a window of k words that also occurs in a document with a smaller id; windows
    are those of the input, not of what is left. Repeats within one document stay. Null texts and texts with fewer
    than k words lose nothing; a null text has no words and kept_text ''. Rows without an id neither remove nor
    lose words. Repeated rows (one id, one text) all get the same result; rows with one id and different texts are
    not compared with each other, since neither id is smaller. An empty table gives no row.

    Equality of super-k-mers is that of 64-bit content hashes under one 64-bit minimiser; windows are compared as
    strings, or as 128-bit digests for minimisers with over BUCKET different super-k-mers.
    """
    made = ["n_words", "n_removed", "kept_text"]
    names = [c for c in docs.columns if c not in made]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    ident: Column = F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE))
    others = [c for c in names if c not in (id_col, text_col)]
    # Without other columns the last join reads the same exchange of texts as the join that packs them.
    # One struct of them: none can clash with the names used here.
    keyed = docs.select(ident.alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text"), *([F.struct(*others).alias("_row")] if others else []))
    kmers = keyed.where(F.col("_id") != _NONE).select("_id", "_key", "_text").mapInArrow(lambda b: _kmers(b, k), KMERS)

    shared = kmers.groupBy("minimiser").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("minimiser")
    shared = written(shared, "shared_minimisers")  # as a table both sides of the join are exchanges, and Spark can split a hot minimiser
    kmers = written(kmers.join(shared, "minimiser", "left_semi"), "shared_kmers")
    firsts = kmers.groupBy("minimiser", "content").agg(F.min(F.struct("doc_id", "key", "start", "n")).alias("first"), F.max("doc_id").alias("hi"), F.count("*").alias("n_rows"))
    firsts = written(firsts.select("minimiser", "content", F.col("first.doc_id").alias("doc_id"), F.col("first.key").alias("key"), F.col("first.start").alias("start"), F.col("first.n").alias("n"), "hi", "n_rows"), "first_kmers")

    repeated = firsts.where("hi > doc_id").select("minimiser", "content", F.col("doc_id").alias("least"))
    copies = kmers.join(repeated, ["minimiser", "content"]).where("doc_id > least").select("doc_id", "key", "start", (F.col("n") + (k - 1)).alias("length"))

    several = firsts.groupBy("minimiser").agg(F.count("*").alias("different"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("top")).where("different > 1 AND lo < top").select("minimiser", "lo", (F.col("different") > BUCKET).alias("alone"))
    several = written(several, "buckets")
    inside = _packed(keyed, firsts.join(several.where("NOT alone"), "minimiser"), k).groupBy("bucket").applyInArrow(lambda g: _bucket(g, k), SPANS)
    if not several.where("alone").isEmpty():
        single = _packed(keyed, firsts.join(several.where("alone"), "minimiser"), k)
        least = single.groupBy("bucket", "packed").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("hi")).where("hi > least")
        inside = inside.unionByName(single.join(least, ["bucket", "packed"]).where("doc_id > least").select("doc_id", "key", "first", "start", F.lit(k).alias("length")))
    inside = written(inside, "spans")

    # The first's document may hold its words at other places, which have the same spans; the smallest document of a bucket has none.
    late = firsts.where("n_rows > 1").join(several, "minimiser").where("doc_id > lo").select("minimiser", "content", "doc_id", F.col("key").alias("first_key"), F.col("start").alias("first"))
    again = kmers.join(late, ["minimiser", "content", "doc_id"]).where("key <> first_key OR start <> first").select("doc_id", "first_key", "first", F.col("key").alias("_key"), F.col("start").alias("_start"))
    repeats = inside.withColumnRenamed("key", "first_key").join(again, ["doc_id", "first_key", "first"]).select("doc_id", F.col("_key").alias("key"), (F.col("_start") + F.col("start") - F.col("first")).alias("start"), "length")
    found = copies.unionByName(inside.drop("first")).unionByName(repeats)
    spans = found.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_set(F.struct("start", "length")).alias("_spans"))
    joined = keyed.join(spans, ["_id", "_key"], "left")
    own = {id_col: F.nullif("_id", F.lit(_NONE)).cast(docs.schema[id_col].dataType), text_col: F.col("_text")}
    back = [own.get(c, F.col("_row")[c]).alias(c) for c in names]
    rows = joined.select(*back, F.col("_spans").alias("".join(names) + "_spans"))  # a name that docs does not have
    return rows.mapInArrow(lambda b: _cut(b, names, names.index(text_col)), schema)
