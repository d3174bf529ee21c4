"""Media columns: chroma fingerprints of recordings, and their alignment.

Frames of twelve pitch classes are summed into an integral image; sixteen rectangle filters, two bits each, make an
integer for every frame. Recordings that share integers align at the offset that most shared integers agree on, and
the bits that differ there measure how alike they are.
"""

from __future__ import annotations

import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import written
from flowlens.llm.kernels import ranges

RATE, FRAME, HOP = 4000, 1024, 500
#: Frames that a filter may span.
SPAN = 8
#: Kind (0: all; 1: upper - lower half of the classes; 2: later - earlier half; 3: checkerboard), first class, classes, frames.
FILTERS = [(0, 0, 3, 8), (0, 3, 3, 8), (0, 6, 3, 8), (0, 9, 3, 8), (1, 0, 12, 4), (1, 0, 6, 8), (1, 6, 6, 8), (1, 2, 8, 6), (2, 0, 4, 8), (2, 4, 4, 8), (2, 8, 4, 8), (2, 0, 12, 4), (3, 0, 6, 8), (3, 6, 6, 8), (3, 3, 6, 6), (3, 0, 12, 8)]
#: Quantiser limits of a filter's log ratio.
LIMITS = np.array([-0.35, 0.0, 0.35])
QUERY_FRAMES = 2_000_000
#: Samples that are held at once.
BLOCK_SAMPLES = 256_000


def chroma(blocks: Iterator[np.ndarray]) -> np.ndarray:
    """Energy of the twelve pitch classes in each frame, of length 1 (silence: zeros). Samples come in blocks; only the classes' energies grow with the recording."""
    shape = np.hanning(FRAME).astype(np.float32)
    freq = np.fft.rfftfreq(FRAME, 1 / RATE)
    use = np.flatnonzero((freq >= 100) & (freq <= 1800))
    pitch = np.round(12 * np.log2(freq[use] / 440)).astype(int) % 12
    parts, held, size = [np.zeros((0, 12))], [np.zeros(0, np.float32)], 0

    def frames(samples: np.ndarray) -> np.ndarray:
        n = (len(samples) - FRAME) // HOP + 1
        if n > 0:
            power = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * shape, axis=1)) ** 2
            parts.append(np.stack([power[:, use[pitch == c]].sum(1) for c in range(12)], 1))
        return samples[max(n, 0) * HOP :]

    for block in blocks:
        for lo in range(0, len(block), BLOCK_SAMPLES):
            held.append(block[lo : lo + BLOCK_SAMPLES])
            size += len(held[-1])
            if size >= BLOCK_SAMPLES:
                held = [frames(np.concatenate(held))]
                size = len(held[0])
    frames(np.concatenate(held))
    out = np.concatenate(parts)
    size = np.sqrt((out**2).sum(1, keepdims=True))
    return np.where(size > 1e-6, out / np.maximum(size, 1e-12), 0.0)


def fingerprint(samples: np.ndarray | Iterator[np.ndarray]) -> np.ndarray:
    """An unsigned 32-bit integer for each SPAN frames in a row of samples (RATE a second), given whole or in blocks. Fewer frames: none."""
    c = chroma(iter([samples]) if isinstance(samples, np.ndarray) else samples)
    n = len(c) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return image[t + t1, y1] - image[t + t0, y1] - image[t + t1, y0] + image[t + t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        mid, half = y + h // 2, w // 2
        if kind == 0:
            a, b = area(0, w, y, y + h), area(0, w, 0, 12) * h / 12
        elif kind == 1:
            a, b = area(0, w, mid, y + h), area(0, w, y, mid)
        elif kind == 2:
            a, b = area(half, w, y, y + h), area(0, half, y, y + h)
        else:
            a, b = area(0, half, y, mid) + area(half, w, mid, y + h), area(half, w, y, mid) + area(0, half, mid, y + h)
        level = np.searchsorted(LIMITS, np.log((a + 0.05) / (b + 0.05)))
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)  # Gray code: neighbouring levels differ in one bit
    return out


def tones(text: str) -> Iterator[np.ndarray]:
    """A text as a recording, in blocks: a quarter of a second of sound for each word, of a pitch that its letters give. An empty text is silent and has no block."""
    t = np.arange(RATE // 4) / RATE
    notes: dict[str, np.ndarray] = {}
    for w in text.split():
        if w not in notes:
            h = zlib.crc32(w.encode())
            f = 220 * 2 ** ((h % 24) / 12)
            if len(notes) >= 1000:
                notes.clear()
            notes[w] = (np.sin(2 * np.pi * f * t) + 0.5 * np.sin(2 * np.pi * f * 2 ** ((h >> 8) % 12 / 12) * t)).astype(np.float32)
        yield notes[w]


def decode_wav(data: bytes | None) -> Iterator[np.ndarray]:
    """Samples (RATE a second, one channel, -1 to 1) of a PCM WAV file of 8, 16 or 32 bits, in blocks. Null, empty and broken files, and other encodings, have none."""
    try:
        f = wave.open(io.BytesIO(data or b""))
    except (wave.Error, EOFError):
        return
    kind = {1: np.uint8, 2: "<i2", 4: "<i4"}.get(f.getsampwidth())
    if kind is None:
        return
    rate, scale, done, last = f.getframerate(), float(1 << (8 * f.getsampwidth() - 1)), 0, np.zeros(0, np.float32)
    while raw := f.readframes(BLOCK_SAMPLES):
        x = np.frombuffer(raw[: len(raw) // (f.getsampwidth() * f.getnchannels()) * f.getsampwidth() * f.getnchannels()], kind).reshape(-1, f.getnchannels()).mean(1)
        x = ((x - 128) / 128 if f.getsampwidth() == 1 else x / scale).astype(np.float32)
        # Places of the output samples that lie between the last sample of the block before and the last of this one.
        joined, start = np.concatenate([last, x]), done - len(last)
        lo, hi = -(-start * RATE // rate), ((done + len(x) - 1) * RATE) // rate
        at = np.arange(lo, hi + 1)
        at = at[at * rate > (done - 1) * RATE] if len(last) else at
        if len(at):
            yield np.interp(at * rate / RATE - start, np.arange(len(joined)), joined).astype(np.float32)
        done, last = done + len(x), x[-1:]


def fingerprint_media(media: DataFrame, id_col: str = "rec_id", media_col: str = "wav") -> DataFrame:
    """rec_id, prints of a column of WAV files. Files without samples (see decode_wav) or shorter than SPAN frames have empty prints; rows without an id are kept with a null; equal files get equal prints; an empty table gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time: files are large
                blob = fingerprint(decode_wav(batch.column(1)[i].as_py())).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([blob], pa.binary())], names=["rec_id", "prints"])

    return media.select(F.col(id_col).cast("long").alias("rec_id"), F.col(media_col).alias("media")).mapInArrow(run, "rec_id long, prints binary")


def align(query: np.ndarray, other: np.ndarray) -> tuple[int, int, int, float]:
    """Offset (place in other - place in query), equal integers there, overlap and share of differing bits. Of offsets with as many equal integers the smallest; without any: 0, 0, 0, 1."""
    _, offsets, votes = Queries([(0, query)]).votes(other)
    if not len(votes):
        return 0, 0, 0, 1.0
    best = int(offsets[np.argmax(votes)])
    a, b = query[max(0, -best) :], other[max(0, best) :]
    m = min(len(a), len(b))
    wrong = int(np.bitwise_count(a[:m] ^ b[:m]).sum())
    return best, int(votes.max()), m, wrong / (32 * m)


class Queries:
    """The integers of some recordings, sorted, with their owners and places.

    An integer that recordings hold so often that its pairs of places would be over HEAVY (silence, a held tone) is
    counted by a correlation of where it stands, for each query, in memory of their lengths; pairs of the others are
    taken PAIRS at a time.
    """

    HEAVY, PAIRS = 1 << 18, 1 << 21

    def __init__(self, held: list[tuple[int, np.ndarray]]):
        self.ids, self.prints = [q for q, _ in held], [p for _, p in held]
        items = np.concatenate(self.prints) if held else np.zeros(0, np.uint32)
        order = np.argsort(items, kind="stable")
        self.items = items[order]
        self.owner = np.repeat(np.arange(len(held)), [len(p) for p in self.prints])[order]
        self.place = np.concatenate([np.arange(len(p)) for p in self.prints])[order] if held else order

    def votes(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, offset (place in own - place in the query) and equal integers there, by query and offset."""
        width = 1 << 32
        lo, hi = np.searchsorted(self.items, own), np.searchsorted(self.items, own, "right")
        n = hi - lo
        if n.sum() <= min(self.HEAVY, self.PAIRS):  # few pairs: all at once
            at = np.repeat(lo, n) + ranges(n)
            key, total = np.unique(self.owner[at] * width + (np.repeat(np.arange(len(own)), n) - self.place[at] + (width >> 1)), return_counts=True)
            return key // width, key % width - (width >> 1), total
        value, group, count = np.unique(own, return_inverse=True, return_counts=True)
        lo, hi = np.searchsorted(self.items, value), np.searchsorted(self.items, value, "right")
        heavy = count * (hi - lo) > self.HEAVY
        found: list[tuple[np.ndarray, np.ndarray]] = []
        place = np.flatnonzero(~heavy[group])
        n = (hi - lo)[group[place]]
        for part in np.split(place, np.flatnonzero(np.diff(np.cumsum(n) // self.PAIRS)) + 1) if len(place) else []:
            first, m = lo[group[part]], (hi - lo)[group[part]]
            at = np.repeat(first, m) + ranges(m)
            found.append(np.unique(self.owner[at] * width + (np.repeat(part, m) - self.place[at] + (width >> 1)), return_counts=True))
        spectra: dict[int, np.ndarray] = {}
        room = {q: 1 << (len(own) + len(p)).bit_length() for q, p in enumerate(self.prints)}
        for v in np.flatnonzero(heavy).tolist():
            mine = np.flatnonzero(group == v)
            for q in np.unique(self.owner[lo[v] : hi[v]]).tolist():
                theirs = self.place[lo[v] : hi[v]][self.owner[lo[v] : hi[v]] == q]
                a, b = np.zeros(room[q]), np.zeros(room[q])
                a[mine], b[theirs] = 1, 1
                both = np.fft.rfft(a) * np.conj(np.fft.rfft(b))
                spectra[q] = spectra[q] + both if q in spectra else both
        for q, s in spectra.items():
            equal = np.rint(np.fft.irfft(s, room[q])).astype(np.int64)
            at = np.flatnonzero(equal)
            offset = np.where(at < len(own), at, at - room[q])
            found.append((q * width + offset + (width >> 1), equal[at]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        key, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        total = np.bincount(back, np.concatenate([c for _, c in found]), len(key)).astype(np.int64)
        return key // width, key % width - (width >> 1), total

    def match(self, rec: int, own: np.ndarray, hits: int, least: int, most_wrong: float) -> list[tuple]:
        """(query, offset, equal, overlap, bit error): of each query the offset that most equal integers agree on, if `hits` do."""
        owner, offsets, votes = self.votes(own)
        enough = votes >= hits
        owner, offsets, votes = owner[enough], offsets[enough], votes[enough]
        edges = np.searchsorted(owner, np.arange(len(self.ids) + 1))
        out = []
        for q in np.unique(owner).tolist():
            if self.ids[q] == rec:
                continue
            mine = slice(edges[q], edges[q + 1])
            best = int(np.argmax(votes[mine]))
            offset = int(offsets[mine][best])
            a, b = self.prints[q][max(0, -offset) :], own[max(0, offset) :]
            m = min(len(a), len(b))
            wrong = int(np.bitwise_count(a[:m] ^ b[:m]).sum()) / (32 * m)
            if m >= least and wrong <= most_wrong:
                out.append((self.ids[q], offset, int(votes[mine][best]), m, round(wrong, 6)))
        return out


def match_recordings(prints: DataFrame, queries: DataFrame, most_wrong: float = 0.3, least: int = 16, hits: int = 4) -> DataFrame:
    """prints: rec_id, prints (binary, little-endian 32-bit). queries: the rec_ids to look up.

    Rows of kind `member` give each recording's class (the smallest id with equal prints) as query_id; rows of kind
    `match` align a class that has a query (query_id) with another class (rec_id): frame_offset, equal, overlap,
    bit_error. At a match `hits` equal integers agree on the offset, and of the bits of at least `least` overlapping
    frames at most most_wrong differ. Recordings without
    prints (null, empty, short) and rows without an id are left out; copies are matched once, by class. Empty tables
    give no row. Queries travel in broadcast blocks of at most about QUERY_FRAMES integers.
    """
    spark = prints.sparkSession
    usable = prints.where("rec_id IS NOT NULL AND octet_length(prints) > 0").withColumn("_key", F.sha2("prints", 256))
    classes = written(usable.groupBy("_key").agg(F.min("rec_id").alias("query_id"), F.first("prints").alias("prints")), "recordings")
    member = usable.select("rec_id", "_key").join(classes.select("query_id", "_key"), "_key").select(F.lit("member").alias("kind"), "query_id", "rec_id", F.lit(0).alias("frame_offset"), F.lit(None).cast("long").alias("equal"), F.lit(None).cast("long").alias("overlap"), F.lit(0.0).alias("bit_error"))
    asked = member.join(queries.select("rec_id").distinct(), "rec_id", "left_semi").select("query_id").distinct()
    chosen = classes.join(asked, "query_id").select("query_id", "prints")
    chosen = written(chosen.withColumn("n", F.octet_length("prints") / 4), "query_prints")
    blocks = int(-(-(chosen.agg(F.sum("n").alias("n")).first()["n"] or 0) // QUERY_FRAMES))
    out = member
    for b in range(blocks):
        rows = chosen.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").toArrow()
        shared = spark.sparkContext.broadcast(Queries([(q, np.frombuffer(p, "<u4")) for q, p in zip(rows.column("query_id").to_pylist(), rows.column("prints").to_pylist(), strict=True)]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [("match", q, rec, *rest) for rec, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for q, *rest in shared.value.match(rec, np.frombuffer(blob, "<u4"), hits, least, most_wrong)]
                c = list(zip(*rows, strict=True)) or [()] * 7
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["kind", "query_id", "rec_id", "frame_offset", "equal", "overlap", "bit_error"])

        found = classes.select("query_id", "prints").mapInArrow(run, "kind string, query_id long, rec_id long, frame_offset int, equal long, overlap long, bit_error double")
        out = out.unionByName(written(found, "matches"))  # the block of queries can go
        shared.destroy()
    return out


def fingerprint_turns(turns: DataFrame) -> DataFrame:
    """rec_id, prints of each conversation: its turns in order, played as tones(). turns: conv_id, turn, text.

    Null and empty texts play nothing; equal turn numbers come in order of their texts, null ones first; repeated rows
    are played as often as they occur; rows without an id are left out. A conversation without words, or of few, has
    empty prints. An empty table gives no row. Long conversations are played in blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [fingerprint(tones(t or "")).astype("<u4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["rec_id", "prints"])

    texts = turns.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").alias("rec_id")).agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x.text)).alias("text"))
    return texts.select("rec_id", "text").mapInArrow(run, "rec_id long, prints binary")
