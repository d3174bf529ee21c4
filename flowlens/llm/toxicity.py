"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine.

Examples are a bounded sample of the labelled rows. All their terms make up the vocabulary; document frequencies are
counted over all documents. The examples' vectors are an inverted index with block maxima, which goes to every task:
its size is bounded by the examples. Cosines weigh the votes, and a logistic curve makes the share a probability.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.blockmax import BlockMaxIndex
from flowlens.llm.common import written
from flowlens.llm.kernels import Words, pieces, term_counts

#: Terms are whole words and, for longer words, their first characters, so many: forms of a word share these.
STEMS = (5,)
#: Texts that are asked together.
CHUNK = 64


class Examples:
    """The labelled examples' vectors under an index, and the calibration of their votes.

    vocabulary: sorted hashes of the terms; frequency: documents (of n_docs) that have each. place, count: the examples'
    terms, one example after the other, as places in the vocabulary, and how often each has them; size: terms of each.
    """

    def __init__(self, ids: list[int], labels: list[int], place: np.ndarray, count: np.ndarray, size: np.ndarray, vocabulary: np.ndarray, frequency: np.ndarray, n_docs: int, k: int):
        self.ids, self.labels, self.k, self.vocabulary = np.array(ids, np.int64), np.array(labels, np.float64), k, vocabulary
        self.idf = np.log(1 + n_docs / np.maximum(frequency, 1))
        self.a, self.b = 0.0, 0.0
        ident = np.repeat(np.arange(len(size), dtype=np.int32), size)
        impact = (1 + np.log(count)) * self.idf[place]
        impact /= np.maximum(np.sqrt(np.bincount(ident, impact * impact, len(size))), 1e-300)[ident]
        order = np.argsort(place, kind="stable")
        ident, impact = ident[order], impact[order]
        self.index = BlockMaxIndex(place[order], ident, impact, len(vocabulary), len(size))

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights (1 + ln tf) * idf, of length 1."""
        w = (1 + np.log(counts)) * self.idf[terms]
        return terms, w / max(math.sqrt(float(w @ w)), 1e-300)

    def bags(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """The known terms of each text, and how often it has them."""
        row, term, n = term_counts(Words(texts, plain=True), STEMS)
        at = np.minimum(np.searchsorted(self.vocabulary, term), max(len(self.vocabulary) - 1, 0))
        known = self.vocabulary[at] == term if len(self.vocabulary) else np.zeros(len(term), bool)
        row, at, n = row[known], at[known], n[known]
        edges = np.searchsorted(row, np.arange(len(texts) + 1))
        return [(at[a:b], n[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def votes(self, bags: list[tuple[np.ndarray, np.ndarray]], own: bool = False) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """For each text the neighbours' toxic share, weighted by cosine (0.1 of a cosine of 1 counts as not toxic), and the neighbours with their cosines. own: the texts are the examples, which leave themselves out."""
        for lo in range(0, len(bags), CHUNK):
            rows = [self.vector(*b) for b in bags[lo : lo + CHUNK]]
            query = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
            term, weight = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
            skip = np.arange(lo, lo + len(rows)) if own else None
            for near, cosine in self.index.top(query, term, weight, len(rows), self.k, skip) if len(self.ids) else [(np.zeros(0, np.int64), np.zeros(0))] * len(rows):
                yield float(cosine @ self.labels[near]) / (float(cosine.sum()) + 0.1), near, cosine

    def calibrate(self, share: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression of the label on the share, by Newton steps, with a small ridge."""
        a = b = 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * share + b, -30, 30)))
            r, v = weight * (p - self.labels), weight * p * (1 - p)
            ga, gb = r @ share + 1e-2 * a, r.sum() + 1e-2 * b
            haa, hab, hbb = v @ (share * share) + 1e-2, v @ share, v.sum() + 1e-2
            det = haa * hbb - hab * hab
            a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
        self.a, self.b = max(a, 0.0), b

    def score(self, share: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.a * share + self.b))))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from all fitting: CRC-32 of its id as text, modulo 5, is 0. False for a null id, which has no label."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2_000, k: int = 50) -> Examples:
    """docs: doc_id, text. labels: doc_id, toxic. At most per_class labelled rows of each class, chosen by a hash of the id, and one of rows with equal text and label, are the examples."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    usable = written(usable, "labelled")
    known = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sample = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = written(sample[0].unionByName(sample[1]), "chosen")  # at most 2 * per_class ids
    found = docs.join(F.broadcast(chosen), "doc_id")
    place = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    one = found.groupBy(place.alias("place"), "toxic").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 3):
            row, term, n = term_counts(Words(batch.column(3), plain=True), STEMS)
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            blobs = [[x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)] for x in (term, n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(b, pa.binary()) for b in blobs)], names=["place", "doc_id", "toxic", "terms", "counts"])

    rows = one.select("place", "doc_id", "toxic", "text").mapInArrow(bags, "place string, doc_id long, toxic int, terms binary, counts binary").orderBy("place", "toxic").collect()  # at most 2 * per_class
    ids, marks = [r["doc_id"] for r in rows], [r["toxic"] for r in rows]
    size = np.array([len(r["terms"]) // 8 for r in rows], np.int64)
    count = np.frombuffer(b"".join(r["counts"] for r in rows), np.int32)
    every = np.frombuffer(b"".join(r["terms"] for r in rows), np.uint64)
    del rows  # what is kept is flat: the driver's memory is bounded by the examples
    vocabulary = np.unique(every)
    place = np.searchsorted(vocabulary, every).astype(np.int32)
    del every
    gc.collect()
    pa.default_memory_pool().release_unused()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of the examples' terms

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        seen, total = np.zeros(len(own), np.int64), 0
        for batch in pieces(batches, 0):
            _, term, _ = term_counts(Words(batch.column(0), plain=True), STEMS)
            total += batch.num_rows
            if len(own):
                at = np.minimum(np.searchsorted(own, term), len(own) - 1)
                seen += np.bincount(at[own[at] == term], minlength=len(own))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([*some, -1], pa.int64()), pa.array([*seen[some], total], pa.int64())], names=["term", "n"])

    counted = docs.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # one row for each term of the examples
    at, n = (counted.column(c).to_numpy() for c in ("term", "n"))
    frequency = np.zeros(len(vocabulary), np.int64)
    frequency[at[at >= 0]] = n[at >= 0]
    model = Examples(ids, marks, place, count, size, vocabulary, frequency, int(n[at < 0].sum()), k)
    toxic = int(model.labels.sum())
    clean = len(ids) - toxic
    if toxic and clean:
        ends = np.cumsum(size)
        own = [(place[e - m : e], count[e - m : e]) for e, m in zip(ends, size, strict=True)]
        share = np.array([s for s, _, _ in model.votes(own, True)])
        model.calibrate(share, np.where(model.labels == 1, known[1] / toxic, known[0] / clean))  # as often as in all labelled rows
    else:
        model.b = 30.0 if toxic else -30.0
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with tox_score (0 to 1), tox_predicted (score >= 0.5) and tox_evidence (the ten nearest neighbours: doc_id, cosine, toxic).

    Terms are words with A-Z in lower case and ASCII punctuation as space, and the first characters (STEMS) of longer
    words, told apart by 64-bit hashes. Vectors have all terms that any example has; other terms have no weight. Whole
    texts are read, of any length. Every row returns. Null and empty texts, and texts
    without such a term, have no neighbours and get the score of a share of 0. Labels with null id or a value other
    than 0 and 1 are not used; of several labels of one id the highest counts; labels of ids that docs lacks are
    ignored. Repeated rows get equal scores. Without labels of both classes all scores are near that of the one class
    (0 if none). Neighbours with equal cosine come in order of a hash of their texts, so that no id has a part in a
    score. Columns of docs named like the new ones are replaced, others kept. options: those of fit().
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(narrow, labels, **options))  # of at most 2 * per_class examples

    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
    made = ["tox_score", "tox_predicted", "tox_evidence"]
    names = [c for c in docs.columns if c not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in pieces(batches, len(names)):
            got = list(m.votes(m.bags(batch.column(len(names)))))
            score = np.array([m.score(s) for s, _, _ in got])
            near = [[{"doc_id": int(m.ids[i]), "cosine": float(c), "toxic": int(m.labels[i])} for i, c in zip(e[:10], x[:10], strict=True)] for _, e, x in got]
            new = [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), pa.array(near, evidence)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(names))), *new], names=[*names, *made])

    text = F.col(text_col).alias("".join(names) + "_text")  # a name that docs does not have
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*names).dtypes)
    return docs.select(*names, text).mapInArrow(run, f"{schema}, tox_score double, tox_predicted int, tox_evidence array<struct<doc_id:long,cosine:double,toxic:int>>")
