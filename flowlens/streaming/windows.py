"""Streams with windows in state: drift over the last rows, day-start adaptation, context columns.

All need the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from flowlens.operators.features import MAX_GAP

CHUNK = 1 << 16


class DriftWindow(StatefulProcessor):
    """The alert rate over a key's last `size` rows. State is a ring of bits: the flags of these rows, an eighth of a byte each."""

    SCHEMA = "key string, row long, state string, ratio double, recent long"

    def __init__(self, size: int, least: int, design: float):
        self.size, self.least, self.design = size, least, design

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flags = handle.getValueState("flags", "bits binary, held long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("row", kind="stable")
        old = np.zeros(0, np.uint8)
        if self.flags.exists():
            bits, held = self.flags.get()
            old = np.unpackbits(np.frombuffer(bits, np.uint8))[:held]
        every = np.concatenate([old, new["flag"].to_numpy(np.uint8)])
        upto = np.concatenate([[0], np.cumsum(every, dtype=np.int64)])
        end = np.arange(len(old) + 1, len(every) + 1)
        n = np.minimum(end, self.size)
        rate = (upto[end] - upto[end - n]) / n
        state = np.where(n < self.least, "insufficient", np.where(rate > 3 * self.design, "drifting", "ok"))
        last = every[-self.size :]
        self.flags.update((np.packbits(last).tobytes(), len(last)))
        yield pd.DataFrame({"key": key[0], "row": new["row"].to_numpy(), "state": state, "ratio": rate / self.design, "recent": n})

    def close(self) -> None:
        pass


def drift_stream(df: DataFrame, key: str, row: str, flagged: Column, design: float, size: int = 10_000, least: int = 1_000) -> DataFrame:
    """audit.drift() as rows arrive: key, row, state, ratio, and how many recent rows of the key it counts. Rows of a micro-batch come in order of `row`; a later micro-batch is later."""
    keyed = df.select(F.col(key).cast("string").alias("key"), F.col(row).cast("long").alias("row"), F.coalesce(flagged, F.lit(False)).cast("int").alias("flag")).groupBy("key")
    return keyed.transformWithStateInPandas(statefulProcessor=DriftWindow(size, least, design), outputStructType=StructType.fromDDL(DriftWindow.SCHEMA), outputMode="append", timeMode="None")


def exact_quantiles(chunks: Callable[[], Iterator[np.ndarray]], at: list[float]) -> tuple[list[float], int]:
    """Interpolated quantiles of the values in chunks(), and their number, in memory that doesn't grow with them.

    Doubles are counted by the leading 16 bits of a key in their order, then by the next 16 bits within the cells that
    hold a wanted place, and so on: four passes. Histograms of parts add up.
    """
    keyed = lambda v: (b := v.astype(np.float64).view(np.uint64)) ^ np.where(b >> np.uint64(63), np.uint64(2**64 - 1), np.uint64(1 << 63))
    n = sum(len(c) for c in chunks())
    if not n:
        return [float("nan")] * len(at), 0
    spots = [(n - 1) * q for q in at]
    places = sorted({int(f(s)) for s in spots for f in (np.floor, np.ceil)})
    cells = {p: (0, p) for p in places}  # leading bits so far, and the place among the values that have them
    for shift in (48, 32, 16, 0):
        counts = {lead: np.zeros(1 << 16, np.int64) for lead, _ in cells.values()}
        for c in chunks():
            k = keyed(c)
            lead, part = (k >> np.uint64(shift + 16)) if shift < 48 else np.zeros(len(k), np.uint64), ((k >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)
            for own, total in counts.items():
                total += np.bincount(part[lead == np.uint64(own)], minlength=1 << 16)
        for p, (lead, left) in cells.items():
            upto = np.cumsum(counts[lead])
            cell = int(np.searchsorted(upto, left, "right"))
            cells[p] = (lead << 16 | cell, left - int(upto[cell - 1] if cell else 0))
    back = lambda k: np.array([k ^ (1 << 63) if k >> 63 else k ^ (2**64 - 1)], np.uint64).view(np.float64)[0]
    value = {p: float(back(lead)) for p, (lead, _) in cells.items()}
    return [value[int(np.floor(s))] + (value[int(np.ceil(s))] - value[int(np.floor(s))]) * (s - np.floor(s)) for s in spots], n


class DayStart(StatefulProcessor):
    """Rows of a day wait until the watermark passes its first `window` seconds; their robust statistics then scale the others, which leave at once from then on."""

    SCHEMA = "day string, row long, sec long, adapted double, threshold double"

    def __init__(self, window: int, fpr: float):
        self.window, self.fpr = window, fpr

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "sec long")
        self.held = handle.getListState("held", "row long, sec long, score double")
        self.fitted = handle.getValueState("fitted", "med double, scale double, threshold double")

    def _scaled(self, day: str, row: np.ndarray, sec: np.ndarray, score: np.ndarray) -> pd.DataFrame:
        med, scale, limit = self.fitted.get()
        late = sec >= self.first.get()[0] + self.window
        return pd.DataFrame({"day": day, "row": row[late], "sec": sec[late], "adapted": (score[late] - med) / scale, "threshold": limit})

    def _chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        rows: list[tuple] = []
        for r in self.held.get():
            rows.append(r)
            if len(rows) == CHUNK:
                yield tuple(np.array(c, t) for c, t in zip(zip(*rows, strict=True), (np.int64, np.int64, np.float64), strict=True))
                rows = []
        if rows:
            yield tuple(np.array(c, t) for c, t in zip(zip(*rows, strict=True), (np.int64, np.int64, np.float64), strict=True))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for new in rows:
            row, sec, score = (new[c].to_numpy() for c in ("row", "sec", "score"))
            if self.fitted.exists():
                yield self._scaled(key[0], row, sec, score)
                continue
            first = int(sec.min())
            if self.first.exists():
                first = min(first, self.first.get()[0])
            self.first.update((first,))
            self.held.appendList([(int(a), int(b), float(c)) for a, b, c in zip(row, sec, score, strict=True)])
        if not self.fitted.exists():
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer((self.first.get()[0] + self.window) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = self.first.get()[0] + self.window
        score = lambda: (v[s < end] for _, s, v in self._chunks())
        (med,), _ = exact_quantiles(score, [0.5])
        (dev,), _ = exact_quantiles(lambda: (np.abs(v - med) for v in score()), [0.5])
        scale = dev * 1.4826 + 1e-6
        (limit,), _ = exact_quantiles(lambda: ((v - med) / scale for v in score()), [1 - self.fpr])
        self.fitted.update((med, scale, limit))
        for part in self._chunks():
            yield self._scaled(key[0], *part)
        self.held.clear()

    def close(self) -> None:
        pass


def adapt_stream(df: DataFrame, day: str, time: str, sec: str, row: str, score: str, window: int, fpr: float, late: str = "10 minutes") -> DataFrame:
    """scoring.adapt_by_day() on a stream: day, row, sec, adapted, threshold of rows after each day's first `window` seconds. Rows may come out of order by up to `late`; rows without a score or a time are left out. Each day is one key."""
    good = df.where(F.col(score).isNotNull() & F.col(sec).isNotNull()).withWatermark(time, late)
    keyed = good.select(F.col(day).cast("string").alias("day"), F.col(row).cast("long").alias("row"), F.col(sec).cast("long").alias("sec"), F.col(score).cast("double").alias("score"), time).groupBy("day")
    return keyed.transformWithStateInPandas(statefulProcessor=DayStart(window, fpr), outputStructType=StructType.fromDDL(DayStart.SCHEMA), outputMode="append", timeMode="EventTime")


class Context(StatefulProcessor):
    """The context of a day's seconds, from one row for each (port, shape, second) in order of time.

    State: for the day, each port and each (port, shape) its seconds in the trailing window and its last second; which of
    these were last seen in which minute, so that what is idle for MAX_GAP leaves without a scan; and the rows whose
    bucket of `wide` seconds is still open. The day's own state goes when it has been idle for MAX_GAP.
    """

    def __init__(self, short: int, long: int, wide: int):
        self.short, self.long, self.wide = short, long, wide

    @staticmethod
    def schema(short: int, long: int, wide: int) -> str:
        counts = ", ".join(f"ctx_{c}_{w}s long" for c in ("flows", "port_flows", "shape") for w in (short, long))
        return f"day string, ids array<long>, sec long, {counts}, ctx_port_gap double, ctx_shape_gap double, ctx_ports_{short}s long, ctx_ports_{wide}s long, ctx_port_share_{long}s double, ctx_shape_share_{long}s double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "sec long")
        self.recent = handle.getMapState("recent", "key string", "seconds binary")
        self.seen = handle.getMapState("seen", "minute long", "keys binary")
        self.open = handle.getListState("open", "rows binary")

    def _trail(self, kind: str, seconds: pd.DataFrame, by: list[str], minutes: dict[int, set]) -> pd.DataFrame:
        """seconds (by, sec, n) with counts of the trailing windows and the gap; the state of the keys that occur is read and renewed."""
        parts = []
        for key, g in seconds.groupby(by, sort=False) if by else [((), seconds)]:
            name = "|".join([kind, *map(str, key)])
            old = self.recent.getValue((name,)) if self.recent.containsKey((name,)) else None
            had = np.frombuffer(old[0], np.int64).reshape(-1, 2) if old is not None else np.zeros((0, 2), np.int64)
            g = g.sort_values("sec")
            t, n = g["sec"].to_numpy(np.int64), g["n"].to_numpy(np.int64)
            at, count = np.concatenate([had[:, 0], t]), np.concatenate([had[:, 1], n])
            upto = np.concatenate([[0], np.cumsum(count)])
            back = lambda w: upto[np.searchsorted(at, t, "right")] - upto[np.searchsorted(at, t - w, "right")]
            before = np.concatenate([had[-1:, 0], t])[-len(t) - 1 : -1] if len(had) else np.concatenate([[np.iinfo(np.int64).min // 2], t[:-1]])
            parts.append(g.assign(**{"a": back(self.short), "b": back(self.long), "gap": np.minimum(t - before, MAX_GAP).astype(np.float64)}))
            keep = np.flatnonzero(at > at[-1] - self.long)
            self.recent.updateValue((name,), (np.column_stack([at[keep], count[keep]]).tobytes(),))
            minutes.setdefault(int(at[-1]) // 60, set()).add(name)
        return pd.concat(parts)

    def _expire(self, now: int) -> None:
        """What was last seen over MAX_GAP before now goes."""
        for (minute,) in [m for m in self.seen.keys() if (m[0] + 1) * 60 + MAX_GAP < now]:
            for name in pickle.loads(self.seen.getValue((minute,))[0]):
                if self.recent.containsKey((name,)):
                    last = np.frombuffer(self.recent.getValue((name,))[0], np.int64)[-2]
                    if last // 60 <= minute:
                        self.recent.removeKey((name,))
            self.seen.removeKey((minute,))

    def _release(self, day: str, rows: pd.DataFrame, now: int) -> pd.DataFrame:
        """The rows whose bucket has ended; the others stay."""
        bucket = (rows["sec"] - self.first.get()[0]) // self.wide
        done = (self.first.get()[0] + (bucket + 1) * self.wide <= now).to_numpy()
        ready, left = rows[done].assign(bucket=bucket[done]), rows[~done]
        self.open.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if len(left):
            self.open.put([(pickle.dumps(left),)])
        ends = self.first.get()[0] + ((left["sec"].max() - self.first.get()[0]) // self.wide + 1) * self.wide if len(left) else now + int(MAX_GAP) + 60
        self.handle.registerTimer(int(ends) * 1000)
        s, l, w = self.short, self.long, self.wide  # noqa: E741
        ports = {f"ctx_ports_{s}s": ready.groupby((ready["sec"] - self.first.get()[0]) // s)["port"].transform("nunique"), f"ctx_ports_{w}s": ready.groupby("bucket")["port"].transform("nunique")}
        out = ready.assign(day=day, **ports)
        out[f"ctx_port_share_{l}s"] = out[f"ctx_port_flows_{l}s"] / out[f"ctx_flows_{l}s"]
        out[f"ctx_shape_share_{l}s"] = out[f"ctx_shape_{l}s"] / out[f"ctx_port_flows_{l}s"]
        return out[[c.split()[0] for c in self.schema(s, l, w).split(", ")]]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        if not self.first.exists():
            self.first.update((int(new["sec"].min()),))
        minutes: dict[int, set] = {}
        s, l = self.short, self.long  # noqa: E741
        day = self._trail("d", new.groupby("sec", as_index=False)["n"].sum(), [], minutes)
        port = self._trail("p", new.groupby(["port", "sec"], as_index=False)["n"].sum(), ["port"], minutes)
        shape = self._trail("s", new[["port", "shape", "sec", "n"]], ["port", "shape"], minutes)
        named = lambda d, of, gap=None: d.rename(columns={"a": f"ctx_{of}_{s}s", "b": f"ctx_{of}_{l}s", "gap": gap or "_"}).drop(columns=["n"] if gap else ["n", "_"])
        made = new.drop(columns="n").merge(named(day, "flows"), on="sec").merge(named(port, "port_flows", "ctx_port_gap"), on=["port", "sec"]).merge(named(shape, "shape", "ctx_shape_gap"), on=["port", "shape", "sec"])
        for m, names in minutes.items():
            had = pickle.loads(self.seen.getValue((m,))[0]) if self.seen.containsKey((m,)) else set()
            self.seen.updateValue((m,), (pickle.dumps(had | names),))
        now = timerValues.getCurrentWatermarkInMs() // 1000
        held = [pickle.loads(b[0]) for b in self.open.get()] if self.open.exists() else []
        yield self._release(key[0], pd.concat([*held, made], ignore_index=True), now)
        self._expire(now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // 1000
        held = [pickle.loads(b[0]) for b in self.open.get()] if self.open.exists() else []
        if held:
            yield self._release(key[0], pd.concat(held, ignore_index=True), now)
            self._expire(now)
        else:  # idle: the day leaves the state
            for s in (self.first, self.recent, self.seen, self.open):
                s.clear()

    def close(self) -> None:
        pass


def context_stream(df: DataFrame, day: str, time: str, port: str, shape: list[str], row: str, short: int = 1, long: int = 60, wide: int = 10, late: str = "10 minutes") -> DataFrame:
    """features.add_context() on a stream: day, row, sec and the twelve context columns, equal to the batch's for rows that come no later than `late` out of order.

    Two stateful operators in a chain: Spark counts rows by (day, port, shape, second) until the watermark has passed the
    second, with the ids of these rows, and Context adds what lies before. A row leaves when its bucket of `wide`
    seconds has ended. Keys and times must not be null; what is later than the watermark is left out by Spark.
    """
    shape_key = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in dict.fromkeys([port, *shape])])
    rows = df.withWatermark(time, late).select(F.col(day).cast("string").alias("day"), F.col(port).cast("string").alias("port"), shape_key.alias("shape"), F.col(row).cast("long").alias("id"), time)
    seconds = rows.groupBy(F.window(time, "1 second").alias("w"), "day", "port", "shape").agg(F.count("*").alias("n"), F.collect_list("id").alias("ids"))
    keyed = seconds.select("day", F.unix_seconds("w.start").alias("sec"), "port", "shape", "n", "ids", F.window_time("w").alias("at")).groupBy("day")
    out = keyed.transformWithStateInPandas(statefulProcessor=Context(short, long, wide), outputStructType=StructType.fromDDL(Context.schema(short, long, wide)), outputMode="append", timeMode="EventTime")
    return out.select(F.explode("ids").alias("row"), *[c for c in out.columns if c != "ids"])
