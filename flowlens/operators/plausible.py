"""Whether an explanation names the right modality: replacement by the nearest benign row, and the modalities that an attack should touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def modality_replaced(alerts: DataFrame, near: DataFrame, refs: DataFrame, slices: dict[str, tuple[int, int]]) -> DataFrame:
    """Alerts (id, x) with one modality's features taken from the nearest benign row: id, modality, x. Modality '' is the alert itself, 'all' the benign row.

    near: id, ref_id. refs: id, x. slices: first and one past the last place of each modality. Alerts without a neighbour are out.
    """
    j = alerts.select("id", "x").join(near.select("id", "ref_id"), "id").join(refs.select(F.col("id").alias("ref_id"), F.col("x").alias("_r")), "ref_id")
    spans = F.array(*[F.struct(F.lit(m).alias("modality"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for m, (a, b) in {"": (0, 0), **slices}.items()], F.struct(F.lit("all").alias("modality"), F.lit(0).alias("lo"), F.lit(2**31 - 1).alias("hi")))
    j = j.withColumn("_s", F.explode(spans))
    places = F.arrays_zip(F.col("x").alias("v"), F.col("_r").alias("r"), F.sequence(F.lit(0), F.size("x") - 1).alias("i"))
    x = F.transform(places, lambda p: F.when((p["i"] >= F.col("_s.lo")) & (p["i"] < F.col("_s.hi")), p["r"]).otherwise(p["v"]).cast("double"))
    return j.select("id", F.col("_s.modality").alias("modality"), x.alias("x"))


def top_modality(shares: DataFrame) -> DataFrame:
    """id and its modality with the largest share (explain.modality_share()); ties: by name."""
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("share"), "modality"))
    return shares.withColumn("_r", first).where("_r = 1").select("id", "modality")


def modality_drop(scored: DataFrame, top: DataFrame, least: float = 0.5) -> DataFrame:
    """Share of the score above the benign row's that goes with the top modality, and the mean of the others': id, modality, drop, other_drop.

    scored: id, modality, score of modality_replaced(). Null where the alert scores less than `least` above its benign row.
    """
    s = scored.join(top.select("id", F.col("modality").alias("_top")), "id")
    m = F.col("modality")
    own = s.groupBy("id", F.col("_top").alias("modality")).agg(
        F.max(F.when(m == "", F.col("score"))).alias("_f"), F.max(F.when(m == "all", F.col("score"))).alias("_b"), F.max(F.when(m == F.col("_top"), F.col("score"))).alias("_t"), F.avg(F.when(~m.isin("", "all") & (m != F.col("_top")), F.col("score"))).alias("_o")
    )
    room = F.when(F.col("_f") - F.col("_b") >= least, F.col("_f") - F.col("_b"))
    return own.select("id", "modality", ((F.col("_f") - F.col("_t")) / room).alias("drop"), ((F.col("_f") - F.col("_o")) / room).alias("other_drop"))


def plausibility(top: DataFrame, labels: DataFrame, expected: DataFrame, modalities: int) -> DataFrame:
    """label, n, plausible (share of alerts whose top modality is an expected one of their label) and chance (expected ones over all). labels: id, label. expected: label, modality, a small table; labels without a row are left out."""
    size = expected.distinct().groupBy("label").agg(F.count("*").alias("_n"))
    hits = expected.distinct().withColumn("_hit", F.lit(1.0))
    j = top.join(labels, "id").join(F.broadcast(size), "label").join(F.broadcast(hits), ["label", "modality"], "left")
    return j.groupBy("label").agg(F.count("*").alias("n"), F.avg(F.coalesce("_hit", F.lit(0.0))).alias("plausible"), (F.max("_n") / modalities).alias("chance"))
