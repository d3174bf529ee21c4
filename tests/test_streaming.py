"""Streams give what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import metrics
from flowlens.streaming import stream


@pytest.fixture()
def source(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, i % 5, ["dns", "http", "flow"][rng.randrange(3)], 100_000 + i * 7) for i in range(400)]
    df = spark.createDataFrame(rows, "seq long, flow_id long, event_type string, sec long").withColumn("ts", F.timestamp_seconds("sec"))
    for k in range(4):
        df.where((F.col("seq") >= k * 100) & (F.col("seq") < k * 100 + 100)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def run(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_scoring_and_counters(spark, source, tmp_path):
    df, s = source
    scored = stream.score_stream(s.withColumn("port", F.when(F.col("seq") % 10 == 0, 70000).otherwise(80)), ["sec"], "sec", "flow_id", "port", F.col("sec").cast("double"), 101000.0)
    got = run(spark, stream.counters(scored), "counted", tmp_path, "complete").first()
    assert got.asDict() == {"rows": 400, "scored": 360, "rejected": 40, "alerts": df.where("seq % 10 <> 0 AND sec > 101000").count()}
    q = stream.two_sinks(scored, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out/scored").count() == 360 and spark.read.parquet(f"{tmp_path}/out/rejected").count() == 40


def test_bins_and_sessions(spark, source, tmp_path):
    df, s = source
    got = run(spark, stream.alert_bins(s, "ts", "flow_id", "5 minutes", "0 seconds"), "binned", tmp_path)
    want = {(r.flow_id, r.bin): r.n_flagged for r in metrics.alert_groups(df.withColumn("y", F.lit(1)), "flow_id", "sec", 300, F.lit(True), "y").collect()}
    rows = {(r.flow_id, int(r.window.start.timestamp()) // 300): r.n for r in got.collect()}
    assert rows and all(want[k] == n for k, n in rows.items()) and len(rows) >= len(want) - 5
    ended = run(spark, stream.incident_sessions(s.where("flow_id = 1 AND (sec < 100900 OR sec > 101500)"), "ts", "event_type", "5 minutes", "0 seconds"), "sessions", tmp_path)
    assert ended.count() >= 1


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_assembly(spark, source, tmp_path, rocks):
    df, s = source
    got = run(spark, stream.assemble_stream(s, "ts", "0 seconds"), "assembled", tmp_path).where("NOT orphan")
    ends = sorted((r.flow_id, r.seq) for r in df.where("event_type = 'flow'").collect())
    assert sorted((r.flow_id, r.seq) for r in got.collect()) == ends
    last, want = {}, {}
    for r in df.orderBy("seq").collect():
        if r.event_type == "flow":
            want[(r.flow_id, r.seq)] = last.pop(r.flow_id, 0)
        else:
            last[r.flow_id] = last.get(r.flow_id, 0) + 1
    assert {(r.flow_id, r.seq): r.n_events for r in got.collect()} == want
