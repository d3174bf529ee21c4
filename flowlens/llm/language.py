"""Language identification: a linear-chain conditional random field that labels every word.

A word's features are its first and last bytes, the byte n-grams inside it and its entry in a lexicon; transitions
between the languages of neighbouring words are learned with them, from a stream in which short spans of different
texts follow each other, as in code-switched text. Forward-backward gives each word its probabilities over the whole
text; a text's language is the one with the highest mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import written
from flowlens.llm.kernels import _K1, _MASK, Words, mix, pieces, ranges

#: Rows of weights that the features share by hash.
HASHED = 1 << 16
#: Bytes of prefixes and suffixes, and of n-grams.
AFFIXES, GRAMS = (1, 2, 3, 4), (3, 4)
#: Words of a training span, and of a training sequence; groups that learn apart and are averaged.
SPAN, SEQUENCE, GROUPS = 8, 32, 8
#: Words of a chunk of a text in forward-backward.
CHUNK = 64
UNKNOWN = "und"


class Features:
    """Features of words: AFFIXES twice and one of the lexicon for each, as rows of weights, and n-grams as ragged lists."""

    def __init__(self, words: Words, pick: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray):
        buf = words.buf
        eights = np.ndarray((len(buf) - 7,), "<u8", buf.data, 0, (1,))
        start, end = words.start[pick], words.end[pick]
        size = end - start
        columns = []
        for k in AFFIXES:
            n = np.minimum(size, k)
            for salt, at in ((k, start), (k + 16, end - n)):
                columns.append(mix((eights[at] & _MASK[n]) * _K1 + np.uint64(salt)) % np.uint64(HASHED))
        place = np.minimum(np.searchsorted(lexicon, hashes), max(len(lexicon) - 1, 0))
        known = lexicon[place] == hashes if len(lexicon) else np.zeros(len(hashes), bool)
        columns.append(np.where(known, HASHED + 1 + place, HASHED).astype(np.uint64))
        self.fixed = np.column_stack(columns).astype(np.int32) if len(pick) else np.zeros((0, 2 * len(AFFIXES) + 1), np.int32)
        count = sum(np.maximum(size - k + 1, 0) for k in GRAMS)
        self.first = np.concatenate([[0], np.cumsum(count)])
        self.inner = np.zeros(int(self.first[-1]), np.int32)
        at = self.first[:-1].copy()
        for k in GRAMS:
            n = np.maximum(size - k + 1, 0)
            where = np.repeat(start, n) + ranges(n)
            self.inner[np.repeat(at, n) + ranges(n)] = mix((eights[where] & _MASK[k]) * _K1 + np.uint64(k + 32)) % np.uint64(HASHED)
            at += n
        letter = (buf >= 0x80) | ((buf >= 0x61) & (buf <= 0x7A))
        upto = np.concatenate([[0], np.cumsum(letter)])
        self.letters = upto[end] > upto[start]

    def scores(self, weights: np.ndarray, pick: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of the weights' rows for the picked words (0 for words without a letter); and the n-grams used, with the word of each."""
        pick = np.arange(len(self.fixed)) if pick is None else pick
        out = np.zeros((len(pick), weights.shape[1]), weights.dtype)
        for c in range(self.fixed.shape[1]):
            out += weights[self.fixed[pick, c]]
        n = self.first[pick + 1] - self.first[pick]
        word = np.repeat(np.arange(len(pick)), n)
        inner = self.inner[np.repeat(self.first[pick], n) + ranges(n)]
        some = np.flatnonzero(n)
        if len(some):
            out[some] += np.add.reduceat(weights[inner], (np.cumsum(n) - n)[some], 0)
        out[~self.letters[pick]] = 0
        return out, inner, word


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def train(texts: pa.Array, labels: np.ndarray, n_labels: int, lexicon: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.15, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by AdaGrad on the likelihood of the labels of spans that follow each other, in the order given."""
    words = Words(texts, plain=True)
    label = labels[words.doc]
    h = words.hashes()
    unique, first, word = np.unique(h, return_index=True, return_inverse=True)
    feats = Features(words, first, unique, lexicon)
    n = max(1, -(-len(word) // SEQUENCE)) * SEQUENCE
    room = np.resize(np.arange(max(len(word), 1)), n)  # the last sequence goes on with the first words
    weights = np.zeros((HASHED + 1 + len(lexicon), n_labels))
    moves, seen, seen_moves = np.zeros((n_labels, n_labels)), np.full(weights.shape, 1e-4), np.full((n_labels, n_labels), 1e-4)
    if not len(word):
        return weights, moves
    word, label = word[room].reshape(-1, SEQUENCE), label[room].reshape(-1, SEQUENCE)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        deal = order.permutation(len(word))
        for lo in range(0, len(deal), batch):
            w, y = word[deal[lo : lo + batch]], label[deal[lo : lo + batch]]
            b = len(w)
            score, inner, owner = feats.scores(weights, w.ravel())
            score = score.reshape(b, SEQUENCE, n_labels)
            e, t = np.exp(score - score.max(2, keepdims=True)), np.exp(moves)
            alpha, beta = np.empty_like(e), np.ones_like(e)
            state = np.full((b, n_labels), 1 / n_labels)
            for i in range(SEQUENCE):
                state = alpha[:, i] = _normal((state @ t) * e[:, i])
            pair = np.zeros_like(moves)
            for i in range(SEQUENCE - 1, 0, -1):
                back = e[:, i] * beta[:, i]
                joint = alpha[:, i - 1, :, None] * t * back[:, None, :]
                pair += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
                beta[:, i - 1] = _normal(back @ t.T)
            wrong = _normal(alpha * beta)
            wrong[np.arange(b)[:, None], np.arange(SEQUENCE), y] -= 1
            np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            wrong = wrong.reshape(-1, n_labels) * feats.letters[w.ravel(), None]
            rows = np.concatenate([feats.fixed[w.ravel()].ravel(), inner])
            by = np.concatenate([np.repeat(np.arange(len(wrong)), feats.fixed.shape[1]), owner])
            g = np.column_stack([np.bincount(rows, wrong[by, k], len(weights)) for k in range(n_labels)]) / b
            g += ridge * weights
            seen += g * g
            weights -= rate * g / np.sqrt(seen)
            pair = pair / b + 1e-3 * moves
            seen_moves += pair * pair
            moves -= 0.02 * pair / np.sqrt(seen_moves)
    return weights, moves


def posteriors(score: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each word's probabilities given all words of its text: texts are score[first[i] : first[i + 1]].

    Texts go in chunks of CHUNK words. Chunks of all texts are multiplied out together; what enters and leaves each is
    passed along the chunks of a text, and then forward and backward run inside all chunks together.
    """
    labels = score.shape[1]
    e = np.exp(score - score.max(1, keepdims=True)) if len(score) else score
    t = np.exp(moves - moves.max()).astype(score.dtype)
    size = np.diff(first)
    chunks = -(-size // CHUNK)
    text = np.repeat(np.arange(len(size)), chunks)
    inside = ranges(chunks)
    begin = first[:-1][text] + inside * CHUNK
    length = np.minimum(size[text] - inside * CHUNK, CHUNK)
    order = np.argsort(-length, kind="stable")
    begin, length, back = begin[order], length[order], np.argsort(order)
    active = [int(np.searchsorted(-length, -k, "left")) for k in range(CHUNK)]  # chunks of more than k words
    many = (chunks[text] > 1)[order]
    whole = np.tile(np.eye(labels, dtype=score.dtype), (len(begin), 1, 1)) if many.any() else None
    if whole is not None:
        for k in range(CHUNK):
            own = np.flatnonzero(many[: active[k]])
            if not len(own):
                break
            step = (whole[own].reshape(-1, labels) @ t).reshape(-1, labels, labels) * e[begin[own] + k][:, None, :]
            whole[own] = step / step.max((1, 2), keepdims=True)
    enter = np.full((len(begin), labels), 1 / labels, score.dtype)
    leave = np.full((len(begin), labels), 1 / labels, score.dtype)
    at = np.cumsum(chunks) - chunks
    longest = np.argsort(-chunks, kind="stable")
    for k in range(1, int(chunks.max()) if len(chunks) else 0):
        own = longest[: np.searchsorted(-chunks[longest], -k, "left")]
        here, before = back[at[own] + k], back[at[own] + k - 1]
        enter[here] = _normal(np.einsum("ij,ijk->ik", enter[before], whole[before]))
    for k in range((int(chunks.max()) if len(chunks) else 0) - 1, 0, -1):
        own = longest[: np.searchsorted(-chunks[longest], -k, "left")]
        here, before = back[at[own] + k], back[at[own] + k - 1]
        leave[before] = _normal(np.einsum("ijk,ik->ij", whole[here], leave[here]))
    out = np.empty_like(e)
    for k in range(CHUNK):
        n = active[k]
        if not n:
            break
        enter[:n] = _normal((enter[:n] @ t) * e[begin[:n] + k])
        out[begin[:n] + k] = enter[:n]
    for k in range(CHUNK - 1, -1, -1):
        n = active[k]
        if n:
            place = begin[:n] + k
            out[place] = _normal(out[place] * leave[:n])
            leave[:n] = _normal((e[place] * leave[:n]) @ t.T)
    return out


class Labeller:
    """Learned languages, weights and transitions."""

    def __init__(self, langs: list[str], lexicon: np.ndarray, weights: np.ndarray, moves: np.ndarray):
        self.langs, self.lexicon, self.weights, self.moves = langs, lexicon, weights.astype(np.float32), moves.astype(np.float32)

    def label(self, texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
        """The words of (lower-case) texts, their probabilities, and which have a letter."""
        words = Words(texts, plain=True)
        unique, first, word = np.unique(words.hashes(), return_index=True, return_inverse=True)
        feats = Features(words, first, unique, self.lexicon)
        score, _, _ = feats.scores(self.weights)
        return words, posteriors(score[word], self.moves, words.first), feats.letters[word]


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from all fitting: CRC-32 of its id as text, modulo 3, is 1. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _spans(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans of SPAN words of key, lang, text: all of them, or the `most` of a text with the least hashes, wherever they are."""
        for batch in pieces(batches, 2):
            words = Words(batch.column(2), plain=True)
            h = words.hashes()
            doc, rank, at, upto = [], [], [], []
            for d in range(batch.num_rows):
                lo, hi = int(words.first[d]), int(words.first[d + 1])
                start = np.arange(lo, hi, SPAN)
                place = mix(h[start] + np.arange(len(start), dtype=np.uint64) * _K1)
                keep = np.sort(np.argsort(place, kind="stable")[:most])
                doc += [d] * len(keep)
                rank += place[keep].view(np.int64).tolist()
                at += start[keep].tolist()
                upto += np.minimum(start[keep] + SPAN, hi).tolist()
            texts = [words.text(a, b) for a, b in zip(at, upto, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(doc, pa.int64())) for i in (0, 1)), pa.array(rank, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["key", "lang", "rank", "span"])

    return run


def fit(docs: DataFrame, per_lang: int = 1500, spans: int = 24, lexicon: int = 20_000) -> Labeller:
    """docs: text, lang (both not null) to learn from. Of each language the per_lang distinct texts with the least digests are used, of each text up to `spans` spans; the lexicon has up to `lexicon` words that three of these texts have.

    Spans are dealt to GROUPS groups by their hash, each learns a field, and the weights' means are the model: neither
    partitions nor batches have a part in it.
    """
    spark = docs.sparkSession
    key = F.md5(F.col("text").cast("binary"))
    ids = docs.select(key.alias("key"), "lang").distinct()
    chosen = written(ids.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("_r") <= per_lang).select("key", "lang"), "chosen")
    sample = docs.withColumn("key", key).join(F.broadcast(chosen), ["key", "lang"]).groupBy("key", "lang").agg(F.first("text").alias("text"))  # at most per_lang keys for each language
    lower = F.lower("text")
    cut = written(sample.select("key", "lang", lower.alias("text")).mapInArrow(_spans(spans), "key string, lang string, rank long, span string"), "spans")
    langs = [r["lang"] for r in chosen.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return Labeller([], np.zeros(0, np.uint64), np.zeros((HASHED + 1, 0)), np.zeros((0, 0)))
    found = cut.select("key", F.explode(F.split("span", " ")).alias("word")).distinct().groupBy("word").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "word").limit(lexicon)
    entries = [r["word"] for r in found.collect()]  # at most `lexicon` words
    known = np.unique(Words(pa.array(entries, pa.string()), plain=True).hashes()) if entries else np.zeros(0, np.uint64)
    shared = spark.sparkContext.broadcast((langs, known))

    def learn(rows: pa.Table) -> pa.Table:  # a bounded sample
        names, words = shared.value
        rows = rows.sort_by([("rank", "ascending"), ("key", "ascending"), ("lang", "ascending")])
        label = np.array([names.index(x) for x in rows.column("lang").to_pylist()])
        w, m = train(rows.column("span").combine_chunks(), label, len(names), words)
        return pa.table({"weights": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "moves": pa.array([m.tobytes()], pa.binary())})

    dealt = cut.withColumn("part", F.pmod("rank", F.lit(GROUPS)))
    got = dealt.groupBy("part").applyInArrow(learn, "weights binary, moves binary").collect()  # GROUPS rows of weights
    n = len(langs)
    weights, moves = np.zeros((HASHED + 1 + len(known), n)), np.zeros((n, n))
    for r in sorted(got, key=lambda r: bytes(r["moves"])):  # sums in one order
        weights += np.frombuffer(r["weights"], np.float32).reshape(-1, n) / len(got)
        moves += np.frombuffer(r["moves"]).reshape(n, n) / len(got)
    return Labeller(langs, known, weights, moves)


SPANS = "array<struct<lang:string,first_word:long,words:long,score:double>>"


def identify_languages(docs: DataFrame, model: Labeller, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score (the mean probability of that language over the words with a letter) and lang_spans.

    lang_spans: runs of words whose likeliest language is the same: lang, first_word, words (split at spaces and ASCII
    punctuation), score (mean probability). A text that is null or has no letter is 'und' with score 0, and so is all
    if nothing was learned; an empty text has no spans. Words without a letter take the language of their neighbours.
    Whole texts are read, of any length; ties go to the language that sorts first; repeated rows get equal results.
    Columns of docs named like the new ones are replaced, others kept.
    """
    made = ["lang_pred", "lang_score", "lang_spans"]
    names = [c for c in docs.columns if c not in made]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit()
    kind = pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        langs = pa.array([*m.langs, UNKNOWN])
        for batch in pieces(batches, len(names)):
            rows, good = batch.num_rows, batch.column(len(names) + 1).to_numpy(zero_copy_only=False) & bool(m.langs)
            if not m.langs:
                best, score, spans = np.zeros(rows, np.int64), np.zeros(rows), pa.array([[]] * rows, pa.list_(kind))
            else:
                words, p, letter = m.label(batch.column(len(names)))
                upto = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p * letter[:, None], 0, dtype=np.float64)])
                n = np.concatenate([[0], np.cumsum(letter)])
                mean = (upto[words.first[1:]] - upto[words.first[:-1]]) / np.maximum(n[words.first[1:]] - n[words.first[:-1]], 1)[:, None]
                best = mean.argmax(1)
                score = np.where(good, np.clip(mean[np.arange(rows), best], 0, 1), 0)
                tag = p.argmax(1)
                new = np.ones(len(tag), bool)
                new[1:] = (tag[1:] != tag[:-1]) | (words.doc[1:] != words.doc[:-1])
                at = np.flatnonzero(new)
                count = np.diff(np.append(at, len(tag)))
                sure = np.add.reduceat(p[np.arange(len(tag)), tag].astype(np.float64), at) / count if len(at) else np.zeros(0)
                struct = pa.StructArray.from_arrays([langs.take(pa.array(tag[at])), pa.array(at - words.first[words.doc[at]]), pa.array(count), pa.array(sure)], fields=list(kind))
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, words.first).astype(np.int32)), struct)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), langs.take(pa.array(np.where(good, best, len(m.langs)))), pa.array(score), spans], names=[*names, *made])

    text = F.col(text_col)
    extra = "".join(names)
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*names).dtypes)
    ready = docs.select(*names, F.lower(text).alias(f"{extra}_text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias(f"{extra}_letter"))
    return ready.mapInArrow(run, f"{schema}, lang_pred string, lang_score double, lang_spans {SPANS}")
