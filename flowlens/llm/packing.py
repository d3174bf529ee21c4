"""Packing: concatenate and cut.

Documents are tokenised once into a table that also has each document's offset within its partition. A prefix
sum over the partitions' totals turns these into global offsets, and each document is then cut where the fixed
windows end. Nothing is shuffled; what crosses the driver is one number for each partition.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import written


class Encoder:
    """A byte-level BPE tokeniser: tiktoken when the file's vocabulary allows it (ids in merge order, no normaliser) and the text has none of its special tokens, else tokenizers; both give the same ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._ranked(spec)

    @staticmethod
    def _ranked(spec: dict):
        """The vocabulary as ranks for tiktoken; None when it can't be expressed so."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(printable))}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocab, special = model["vocab"], {t["content"] for t in spec.get("added_tokens", [])}
        order = [vocab[a + b] for a, b in merges]
        if order != sorted(order) or any(c not in to_byte for t in vocab if t not in special for c in t):
            return None
        import tiktoken

        ranks = {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


ENCODED = "doc_id long, ids binary, n_tokens long, part int, before long"


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's ids with end_id after them (little-endian; 2 bytes an id if the vocabulary allows, as n_tokens and the length tell), and its partition and offset there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        kind = "<u2" if max(enc.whole.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            ids = [np.array([*(enc.encode(t) if t else ()), end_id], kind) for t in batch.column(1).to_pylist()]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(before + np.cumsum(n) - n)], names=["doc_id", "ids", "n_tokens", "part", "before"])
            before += int(n.sum())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ENCODED)


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def concat_and_cut(docs: DataFrame, tokenizer: str, max_len: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in a row, cut into sequences of max_len tokens; one row for each piece of a document.

    Columns: doc_id, start (the document's tokens before the piece), length, ids (binary, little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset (in the sequence). Only the last sequence can be shorter than max_len.
    A null or empty text is the single token end_id. Repeated rows are packed as often as they occur; null ids are
    kept as null. A document longer than a sequence runs over as many as it needs. An empty table gives no row.
    Other columns are not read. The order is that of the partitions and of the rows in them.
    """
    encoded = written(encode_documents(docs, tokenizer, end_id, id_col, text_col), "encoded")
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row for each partition
    ends = np.cumsum([r["n"] for r in totals], dtype=np.int64)
    bases = encoded.sparkSession.createDataFrame([(r["part"], int(e - r["n"])) for r, e in zip(totals, ends, strict=True)], "part int, base long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            first, last = at // max_len, (at + n - 1) // max_len
            k = last - first + 1
            row = np.repeat(np.arange(len(n)), k)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            lo, hi = np.maximum(at[row], seq * max_len), np.minimum((at + n)[row], (seq + 1) * max_len)
            start, length = lo - at[row], hi - lo
            blobs = [memoryview(b.as_buffer()) for b in batch.column(1)]
            width = [len(b) // int(m) for b, m in zip(blobs, n, strict=True)]
            ids = [np.frombuffer(blobs[r], f"<u{width[r]}")[s : s + m].astype("<u4").tobytes() for r, s, m in zip(row, start, length, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(ids, pa.binary()), pa.array(n[row]), pa.array(seq), pa.array(lo - seq * max_len)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    placed = encoded.join(F.broadcast(bases), "part").select("doc_id", "ids", "n_tokens", (F.col("before") + F.col("base")).alias("at"))  # bases: one row for each input partition
    return placed.mapInArrow(cut, PIECES)
