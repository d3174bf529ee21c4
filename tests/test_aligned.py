"""Stores that fit together, and CSV files in chunks."""

import pytest
from pyspark.sql import functions as F

from flowlens.operators.clean import DataError
from flowlens.sources import aligned, io
from flowlens.streaming import stream


@pytest.fixture()
def stores(spark, tmp_path):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("label"), F.lit("test").alias("split"))
    made = {"a_split": df, "a_scores": df.select("id", F.rand(1).alias("score"), F.col("label").alias("y")), "a_short": df.where("id > 5").select("id", F.lit(0.0).alias("z")), "a_other": df.select("id", F.lit(7).alias("w"), F.when(F.col("id") == 3, 9).otherwise(F.col("label")).alias("v"))}
    for name, t in made.items():
        aligned.write_aligned(t, name, "id", 4, f"file://{tmp_path}/{name}")
    yield made
    for name in made:
        spark.sql(f"DROP TABLE {name}")


def test_stores_fit_without_a_shuffle(spark, stores):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = aligned.fitted(spark, "a_split", "a_scores", "id")
        both.collect()
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert "Exchange" not in plan, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert both.count() == 500 and both.columns == ["id", "label", "split", "score", "y"]
    assert aligned.check_fit(spark, "a_split", "a_scores", "id", "label", "y").count() == 500
    for right, labels, why in (("a_short", (), "'only_left': 6"), ("a_other", ("label", "v"), "'differ': 1")):
        with pytest.raises(DataError, match=why):
            aligned.check_fit(spark, "a_split", right, "id", *labels)
    with pytest.raises(DataError, match="both have"):
        aligned.fitted(spark, "a_split", "a_split", "id")


def test_split_and_score_stores(spark, tmp_path):
    df = spark.range(60).select("id", F.when(F.col("id") % 2 == 0, "val").otherwise("test").alias("split"), F.concat(F.lit("d"), F.col("id") % 3).alias("day"))
    io.write_splits(df, f"{tmp_path}/splits")
    assert io.read_splits(spark, f"{tmp_path}/splits", "val").count() == 30 and io.read_splits(spark, f"{tmp_path}/splits", "test", "d1").count() == 10
    scores = df.select("id", F.lit("knn").alias("method"), F.lit(0).alias("seed"), F.col("id").cast("double").alias("score"))
    io.write_scores(scores, f"{tmp_path}/scores")
    io.write_scores(scores.withColumn("seed", F.lit(1)), f"{tmp_path}/scores")
    assert spark.read.parquet(f"{tmp_path}/scores").count() == 120
    labels = df.select("id", (F.col("id") % 5 == 0).alias("y"))
    assert io.read_scores(spark, f"{tmp_path}/scores", labels, "id", "knn").where("y").count() == 24
    with pytest.raises(DataError):
        io.read_scores(spark, f"{tmp_path}/scores", labels.where("id < 50"), "id")
    io.write_tables({"t": df.withColumn("list", F.array("day")), "r": labels}, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv/t", header=True).where("list = '[\"d1\"]'").count() == 20


def test_csv_in_chunks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    head = " a , Role,proto,port\n"
    for k in range(3):
        (tmp_path / "in" / f"{k}.csv").write_text(head + "".join(f"{k * 10 + i},web,6,{80 if i else 70000}\n" for i in range(10)))

    def run():
        rows = aligned.scan_csv(spark, f"{tmp_path}/in", ["value"], "Role", {"a": "value"}, 1)
        assert rows.columns == ["value", "given_role", "proto", "port"]
        scored = stream.score_stream(rows, ["value"], None, "proto", "port", F.col("value").cast("double"), 15.0)
        q = stream.two_sinks(scored, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(200)
        return [sorted(int(r.value) for r in spark.read.parquet(f"{tmp_path}/out/{part}").collect()) for part in ("scored", "rejected")]

    assert run() == [[i for i in range(30) if i % 10], [0, 10, 20]]
    (tmp_path / "in" / "3.csv").write_text(head + "30,web,6,80\n")
    for _ in range(2):  # what was read is not read again
        assert run() == [[i for i in range(31) if i % 10 or i == 30], [0, 10, 20]]
    with pytest.raises(DataError):
        aligned.scan_csv(spark, f"{tmp_path}/in", ["missing"])
