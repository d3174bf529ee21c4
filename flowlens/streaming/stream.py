"""Streams: the same scoring and grouping over readStream, and flow assembly with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from flowlens.operators.clean import rejection


def score_stream(df: DataFrame, required: list[str], duration: str | None, protocol: str, port: str, score: Column, threshold: float) -> DataFrame:
    """Stateless: reason (null if the row is sound), score and alert; a bad row never fails a batch."""
    out = df.withColumn("reason", rejection(df, required, duration, protocol, port))
    out = out.withColumn("score", F.when(F.col("reason").isNull(), score))
    return out.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("score").isNull() | F.isnan("score")), "score is not finite").otherwise(F.col("reason"))).withColumn("alert", F.coalesce(F.col("score") > threshold, F.lit(False)))


def two_sinks(scored: DataFrame, path: str, checkpoint: str):
    """Start writing scored and rejected rows of each micro-batch to path/scored and path/rejected."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        batch.where("reason IS NULL").drop("reason").write.mode("overwrite").parquet(f"{path}/scored/epoch={epoch}")  # a repeated epoch replaces itself
        batch.where("reason IS NOT NULL").write.mode("overwrite").parquet(f"{path}/rejected/epoch={epoch}")
        batch.unpersist()

    return scored.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def counters(scored: DataFrame) -> DataFrame:
    """Running totals: rows, scored, rejected, alerts. For outputMode complete."""
    return scored.groupBy().agg(F.count("*").alias("rows"), F.count("score").alias("scored"), F.count("reason").alias("rejected"), F.count_if("alert").alias("alerts"))


def alert_bins(df: DataFrame, time: str, entity: str, width: str, late: str = "10 minutes") -> DataFrame:
    """Alerts of each entity in tumbling windows; rows later than the watermark are dropped."""
    return df.withWatermark(time, late).groupBy(entity, F.window(time, width)).agg(F.count("*").alias("n"))


def incident_sessions(df: DataFrame, time: str, label: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of a label without a pause longer than gap."""
    return df.withWatermark(time, late).groupBy(label, F.session_window(time, gap)).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"))


class Assembly(StatefulProcessor):
    """Events of a flow id wait until their flow event comes; those that wait longer than `patience` of event time leave as orphans."""

    SCHEMA = "flow_id long, seq long, n_events int, types string, orphan boolean"

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "seq long, event_type string")

    def _row(self, key, seq: int, held: list[tuple], orphan: bool) -> pd.DataFrame:
        held = sorted(held)
        return pd.DataFrame([(key[0], seq, len(held), ",".join(t for _, t in held), orphan)], columns=["flow_id", "seq", "n_events", "types", "orphan"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(int(s), t) for s, t in self.waiting.get()] if self.waiting.exists() else []
        new = pd.concat(list(rows)).sort_values("seq")
        for seq, kind in zip(new["seq"], new["event_type"], strict=True):
            if kind == "flow":
                yield self._row(key, int(seq), held, False)
                held = []
            else:
                held.append((int(seq), kind))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held:
            self.waiting.put(held)
            self.handle.registerTimer(max(0, timerValues.getCurrentWatermarkInMs()) + self.patience_ms)
        else:
            self.waiting.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [(int(s), t) for s, t in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.clear()
        if held:
            yield self._row(key, held[-1][0], held, True)

    def close(self) -> None:
        pass


def assemble_stream(events: DataFrame, time: str, late: str = "10 minutes", patience_ms: int = 3_600_000) -> DataFrame:
    """events: flow_id, seq, event_type and a time. One row for each ended flow and each orphan. Needs the RocksDB state store."""
    keyed = events.withWatermark(time, late).select("flow_id", "seq", "event_type", time).groupBy("flow_id")
    return keyed.transformWithStateInPandas(statefulProcessor=Assembly(patience_ms), outputStructType=StructType.fromDDL(Assembly.SCHEMA), outputMode="append", timeMode="EventTime")
