"""Windowed streams give what the batch operators give, over several micro-batches, also out of order."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import audit, features, scoring
from flowlens.streaming import windows


@pytest.fixture(autouse=True)
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def stream_of(spark, parts, schema, path):
    """One micro-batch for each list of rows."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("sec")).coalesce(1).write.parquet(f"{path}/in/{k}")
    whole = spark.createDataFrame([r for rows in parts for r in rows], schema).withColumn("ts", F.timestamp_seconds("sec"))
    return whole, spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")


def run(spark, df, name, path, once=True):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name), q


def test_drift_over_micro_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, 1000 + i, rng.random() < (0.02 if i < 300 else 0.4)) for i in range(700)]
    cuts = [0, 3, 140, 141, 500, 700]
    whole, s = stream_of(spark, [rows[a:b] for a, b in zip(cuts, cuts[1:])], "row_id long, sec long, flag boolean", tmp_path)
    got = {r.row: (r.state, round(r.ratio, 9)) for r in run(spark, windows.drift_stream(s.withColumn("site", F.lit("a")), "site", "row_id", F.col("flag"), 0.05, 100, 20), "drifted", tmp_path)[0].collect()}
    want = {r.row_id: (r.state, round(r.ratio, 9)) for r in audit.drift(whole, "row_id", F.col("flag"), 0.05, 100, 20).collect()}
    assert got == want and {s for s, _ in got.values()} == {"insufficient", "ok", "drifting"}


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_exact_quantiles(n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(0, 100, n), 1)
    values[rng.random(n) < 0.2] = 0.0
    got, count = windows.exact_quantiles(lambda: iter(np.array_split(values, 3)), [0, 0.05, 0.5, 0.95, 1])
    assert count == n and np.allclose(got, np.quantile(values, [0, 0.05, 0.5, 0.95, 1]), atol=1e-12)
    assert np.isnan(windows.exact_quantiles(lambda: iter([]), [0.5])[0][0])


def test_day_start_adaptation(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, "d1", 100_000 + 10 * i, round(rng.gauss(5, 2), 2)) for i in range(300)] + [(1000 + i, "d2", 101_000 + 13 * i, round(rng.gauss(50, 9), 2)) for i in range(200)]
    rows.sort(key=lambda r: r[2] + rng.randrange(-50, 50))  # out of order by less than the watermark's delay
    flush = [(5000, "d3", 200_000, 1.0)]
    parts = [rows[:120], rows[120:260], rows[260:], flush, [(5001, "d3", 210_000, 1.0)]]
    whole, s = stream_of(spark, parts, "row_id long, day string, sec long, score double", tmp_path)
    table, _ = run(spark, windows.adapt_stream(s, "day", "ts", "sec", "row_id", "score", 600, 0.05, "2 minutes"), "adapted", tmp_path)
    got = {r.row: (round(r.adapted, 6), round(r.threshold, 6)) for r in table.where("day <> 'd3'").collect()}
    want = {r.row_id: (round(r.adapted, 6), round(r.threshold, 6)) for r in scoring.adapt_by_day(whole.where("day <> 'd3'"), "day", "sec", "score", 600, 0.05).collect()}
    assert len(want) > 300 and got == want


def test_context_over_a_stream(spark, tmp_path):
    rng = random.Random(2)
    rows, t = [], 50_000
    for i in range(900):
        t += rng.choice([0, 0, 0, 1, 1, 2, 5]) + (4000 if i in (400, 700) else 0)
        rows.append((i, "d1" if i % 9 else "d2", t, rng.choice([80, 443, 22]), rng.randrange(2)))
    rows.sort(key=lambda r: r[2] + rng.randrange(-20, 20))
    parts = [rows[:200], rows[200:201], rows[201:500], rows[500:720], rows[720:], [(9000, "d9", t + 100, 1, 1)], [(9001, "d9", t + 20_000, 1, 1)], [(9002, "d9", t + 40_000, 1, 1)]]
    whole, s = stream_of(spark, parts, "row_id long, day string, sec long, port int, kind int", tmp_path)
    table, q = run(spark, windows.context_stream(s, "day", "ts", "port", ["port", "kind"], "row_id", late="1 minute"), "context", tmp_path)
    columns = [c for c in table.columns if c.startswith("ctx_")]
    assert len(columns) == 12
    got = {r.row: tuple(round(r[c], 9) for c in columns) for r in table.where("day <> 'd9'").collect()}
    batch = features.add_context(whole.where("day <> 'd9'"), "day", "sec", "port", ["port", "kind"])
    want = {r.row_id: tuple(round(r[c], 9) for c in columns) for r in batch.collect()}
    assert len(got) == 900 and got == want
    # Nothing is left of days that have been idle.
    state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "first").load(f"{tmp_path}/context")
    assert {r.key.day for r in state.collect()} <= {"d9"}
