"""A band join repeats the rows of its right side only."""

from flowlens.operators import joins


def test_right_rows_are_repeated(spark):
    left = spark.createDataFrame([(1, "h", 10), (2, "h", 29), (3, "h", -1), (4, "g", 10)], "row_id long, host string, lt long")
    right = spark.createDataFrame([("h", 0, "a"), ("h", 20, "b"), ("g", 21, "c")], "host string, rt long, note string")
    pairs = joins.within(left, right, ["host"], "lt", "rt", 10)
    assert {(r.row_id, r.note) for r in pairs.collect()} == {(1, "a"), (1, "b"), (2, "b"), (3, "a")}
    line = next(x for x in pairs._jdf.queryExecution().analyzed().toString().splitlines() if "Generate explode" in x)
    assert "rt#" in line and "lt#" not in line
