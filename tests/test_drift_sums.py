"""Drift takes a step for each row, not one for each row of the frame."""

from pyspark.sql import functions as F

from flowlens.operators import audit


def test_rates_by_running_sums(spark):
    rows = [(i, None if i % 17 == 5 else i * 7919 % 10 > 6) for i in range(95)]
    df = spark.createDataFrame(rows, "i long, f boolean")
    out = audit.drift(df, "i", F.col("f"), 0.25, 20, 8)
    got = {r.i: (r.state, r.ratio) for r in out.collect()}
    for i, _ in rows:
        last = [f for _, f in rows[max(0, i - 19) : i + 1]]
        known = [f for f in last if f is not None]
        rate = sum(known) / len(known)
        want = "insufficient" if len(last) < 8 else "drifting" if rate > 0.75 else "ok"
        assert got[i][0] == want and abs(got[i][1] - rate / 0.25) < 1e-12
    assert "specifiedwindowframe(RowFrame, -19" not in out._jdf.queryExecution().optimizedPlan().toString()
