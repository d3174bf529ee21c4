"""Queries of the report tables, of exact neighbours by cells and of modality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import explain, metrics, neighbours, plausible, summaries
from flowlens.plans.score_queries import KNN, _emb
from flowlens.plans.views import flows, query, r6, scores, table

# --- neighbours -----------------------------------------------------------------------------------------------------


@query("j13_nearest_benign", "WITH " + KNN.format(on="a.label % 3 = b.label % 3 AND b.label < 7 AND a.label >= 7") + " SELECT id, ref_id, round(distance, 4) AS distance FROM k WHERE rank = 1")
def j13_nearest_benign(spark: SparkSession, d: str) -> DataFrame:
    """The nearest benign vector of the same role, for each other vector."""
    e = _emb(spark, d)
    return neighbours.nearest_by_cells(e.where("label >= 7"), e.where("label < 7"), 1, "role").select("id", "ref_id", F.round("distance", 4).alias("distance"))


PARTS = "v AS (SELECT p_partkey AS id, [CAST(round(p_retailprice) AS BIGINT), CAST(p_size AS BIGINT) * 10] AS x FROM part), n AS (SELECT a.id, b.id AS ref_id, (a.x[1] - b.x[1]) ** 2 + (a.x[2] - b.x[2]) ** 2 AS d FROM v a JOIN v b ON a.id <> b.id), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, ref_id) AS rank FROM n)"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.round("p_retailprice").cast("double"), F.col("p_size") * F.lit(10.0)).alias("x"))


@query("j14_part_neighbours", "WITH " + PARTS + " SELECT id, ref_id, round(sqrt(d), 4) AS distance, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3")
def j14_part_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Each part's three nearest parts, with many ties."""
    p = _parts(spark, d)
    return neighbours.nearest_by_cells(p, p, 3, exclude_self=True).withColumn("distance", F.round("distance", 4))


@query("q11_distance_shares", "WITH " + PARTS + " SELECT round(avg(CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(CASE WHEN d < 4 THEN 1.0 ELSE 0.0 END), 6) AS near, round(median(sqrt(d)), 4) AS median_distance, count(*) AS n FROM k WHERE rank = 1")
def q11_distance_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of parts with a copy and with a near part, and the median distance."""
    p = _parts(spark, d)
    near = neighbours.nearest_by_cells(p, p, 1, exclude_self=True)
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return near.agg(share(F.col("distance") == 0).alias("exact"), share(F.col("distance") < 2).alias("near"), F.round(F.median("distance"), 4).alias("median_distance"), F.count("*").alias("n"))


def _auc_sql(name: str, on: str) -> str:
    knn = KNN.format(on=on)
    return f"""SELECT '{name}' AS refs, (WITH {knn}, s AS (SELECT id, avg(distance) AS s FROM k WHERE rank <= 5 GROUP BY id), c AS (SELECT s, count(*) FILTER (label >= 7) AS p, count(*) FILTER (label < 7) AS q FROM s JOIN embeddings ON vec_id = id GROUP BY s),
     b AS (SELECT *, sum(q) OVER (ORDER BY s) AS below FROM c) SELECT round(sum(p * (below - q * 0.5)) / (sum(p) * sum(q)), 4) FROM b) AS roc_auc"""


@query("q21_knn_auc", _auc_sql("all", "a.vec_id <> b.vec_id AND b.label < 7") + " UNION ALL " + _auc_sql("same role", "a.vec_id <> b.vec_id AND a.label % 3 = b.label % 3 AND b.label < 7"))
def q21_knn_auc(spark: SparkSession, d: str) -> DataFrame:
    """How well the mean distance to benign vectors, of all roles or the same, tells the others."""
    e, out = _emb(spark, d), None
    labels = e.select("id", (F.col("label") >= 7).cast("int").alias("y"))
    for name, role in (("all", None), ("same role", "role")):
        s = neighbours.nearest_by_cells(e, e.where("label < 7"), 5, role, True).groupBy("id").agg(F.avg("distance").alias("s"))
        auc = metrics.roc_auc(s.join(labels, "id"), "y", "s").select(F.lit(name).alias("refs"), F.round("roc_auc", 4).alias("roc_auc"))
        out = auc if out is None else out.unionByName(auc)
    return out


# --- report tables --------------------------------------------------------------------------------------------------

WINDOWS = """lim AS (SELECT quantile_cont(score, 0.95) AS l FROM ev WHERE y = 0 AND user_id % 4 = 0),
 wv AS (SELECT role, sec // 3600 AS w, count(*) AS n, count(*) FILTER (score > l) AS k FROM ev, lim WHERE y = 0 AND user_id % 4 = 0 GROUP BY 1, 2),
 wt AS (SELECT role, day, sec // 3600 AS w, count(*) AS n, count(*) FILTER (score > l) AS k, max(y) AS y FROM ev, lim WHERE user_id % 4 <> 0 GROUP BY 1, 2, 3),
 nk AS (SELECT n, k, CASE WHEN k <= 0 THEN 0 ELSE -ln(least(1.0, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95))) FROM range(k, n + 1) r(i)))) END AS s FROM (SELECT n, k FROM wv UNION SELECT n, k FROM wt)),
 al AS (SELECT quantile_cont(s, 0.95) AS a, count(*) AS val_windows FROM wv JOIN nk USING (n, k)),
 t AS (SELECT wt.*, s > a + 1e-9 AS alert, k > 0 AS any_k FROM wt JOIN nk USING (n, k), al)"""


def _windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = flows(spark, d)
    return summaries.window_alerts(f.where("y = 0 AND user_id % 4 = 0"), f.where("user_id % 4 <> 0"), "role", "day", "sec", "score", "y", "event_type", 0.05, 3600)


@query(
    "g16_window_rates",
    "WITH {EV}, " + WINDOWS + """, h AS (SELECT sum(h) AS h FROM (SELECT (max(sec) - min(sec)) / 3600.0 AS h FROM ev WHERE user_id % 4 <> 0 GROUP BY day))
 SELECT round(count(*) FILTER (alert AND y = 0) / greatest(count(*) FILTER (y = 0), 1), 6) AS window_fpr, round(count(*) FILTER (alert AND y = 1) / greatest(count(*) FILTER (y = 1), 1), 6) AS window_recall,
  round(count(*) FILTER (any_k AND y = 0) / greatest(count(*) FILTER (y = 0), 1), 6) AS any_window_fpr, round(count(*) FILTER (any_k AND y = 1) / greatest(count(*) FILTER (y = 1), 1), 6) AS any_window_recall,
  count(*) FILTER (y = 0) AS benign_test_windows, count(*) FILTER (y = 1) AS attack_test_windows, (SELECT val_windows FROM al) AS val_windows,
  round(count(*) FILTER (alert AND y = 0) / (SELECT h FROM h), 6) AS false_alerts_per_h, round(count(*) FILTER (any_k AND y = 0) / (SELECT h FROM h), 6) AS any_false_alerts_per_h FROM t""",
)
def g16_window_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of windows that alert, and of windows with any flagged flow."""
    return r6(_windows(spark, d)[0])


@query("g16_covered", "WITH {EV}, " + WINDOWS + " SELECT event_type, count(*) AS n, round(avg(CASE WHEN alert THEN 1.0 ELSE 0.0 END), 6) AS covered FROM ev JOIN t ON ev.role = t.role AND ev.day = t.day AND sec // 3600 = t.w WHERE ev.y = 1 AND user_id % 4 <> 0 GROUP BY event_type")
def g16_covered(spark: SparkSession, d: str) -> DataFrame:
    """Share of each attack's flows that lie in an alerted window."""
    return r6(_windows(spark, d)[1])


@query(
    "g19_alert_volume",
    """WITH {EV}, a AS (SELECT CASE WHEN user_id % 10 = 0 THEN 'attacker' ELSE 'background' END AS side, event_type AS c, 'port ' || dst_port || ' ' || k AS s, sec FROM ev WHERE score > 80),
 g AS (SELECT side, 'total' AS kind, CAST(NULL AS VARCHAR) AS name, count(*) AS n FROM a GROUP BY 1 UNION ALL SELECT side, 'category', c, count(*) FROM a WHERE side = 'background' GROUP BY 1, 3
  UNION ALL (SELECT side, 'signature', s, count(*) AS n FROM a WHERE side = 'background' GROUP BY 1, 3 ORDER BY n DESC, s LIMIT 15)) SELECT *, round(n / ((SELECT max(sec) - min(sec) FROM a) / 3600.0), 6) AS per_hour FROM g""",
)
def g19_alert_volume(spark: SparkSession, d: str) -> DataFrame:
    """Alerts off the attackers by category and signature, and the totals of both sides."""
    a = flows(spark, d).where("score > 80").withColumn("sig", F.concat_ws(" ", F.lit("port"), "dst_port", "k"))
    return r6(summaries.alert_volume(a, F.col("user_id") % 10 == 0, "event_type", "sig", "sec"))


@query("g22_benign_day_alerts", "WITH {EV} SELECT count(*) AS flows, count(*) FILTER (k % 10 = 0) AS alerted_flows, round(avg(CASE WHEN k % 10 = 0 THEN 1.0 ELSE 0.0 END), 6) AS alerted_share, round(count(*) FILTER (k % 10 = 0) / ((max(sec) - min(sec)) / 3600.0), 6) AS alerted_flows_per_hour FROM ev WHERE day = (SELECT min(day) FROM ev) AND y = 0")
def g22_benign_day_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Signature alerts of the first day's benign flows, by hour too."""
    f = flows(spark, d)
    first = f.agg(F.min("day").alias("day"))
    return r6(summaries.benign_day_alerts(f.where("y = 0").join(F.broadcast(first), "day"), F.col("k") % 10 == 0, "sec"))


@query("g19_false_alarms", "WITH {EV}, s AS (SELECT 'signature' AS detector, count(*) FILTER (k % 10 = 0) AS n, (max(sec) - min(sec)) / 3600.0 AS hours FROM ev WHERE y = 0 UNION ALL SELECT 'model', count(*) FILTER (score > 95), (max(sec) - min(sec)) / 3600.0 FROM ev WHERE y = 0 AND event_type <> 'view') SELECT detector, n, round(hours, 6) AS hours, round(n / hours, 6) AS per_hour FROM s")
def g19_false_alarms(spark: SparkSession, d: str) -> DataFrame:
    """False alarms of two detectors, each by the hours that it saw."""
    f = flows(spark, d).where("y = 0")
    return r6(summaries.volume_per_hour({"signature": (f.withColumn("alarm", F.col("k") % 10 == 0), "sec"), "model": (f.where("event_type <> 'view'").withColumn("alarm", F.col("score") > 95), "sec")}))


@query(
    "m20_z_fusion",
    """WITH {SCORES}, m AS (SELECT method, median(score) AS med FROM sc WHERE seed = 0 AND is_val GROUP BY 1), e AS (SELECT method, med, 1.4826 * median(abs(score - med)) + 1e-9 AS mad FROM sc JOIN m USING (method) WHERE seed = 0 AND is_val GROUP BY 1, 2),
 z AS (SELECT row_id, method, (score - med) / mad AS z FROM sc JOIN e USING (method) WHERE seed = 0) SELECT row_id, 'mean' AS variant, round(avg(z), 5) AS score FROM z GROUP BY 1 UNION ALL SELECT row_id, 'max', round(max(z), 5) FROM z GROUP BY 1
 UNION ALL SELECT row_id, 'without ' || w, round(avg(z), 5) FROM z, (VALUES ('knn'), ('e1'), ('e2'), ('e3')) o(w) WHERE method <> w GROUP BY 1, 2""",
)
def m20_z_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Mean, largest and leave-one-out fusions of four detectors' robust z-scores."""
    out = summaries.z_fusion(scores(spark, d).where("seed = 0"), "row_id", "method", "score", "is_val")
    return out.withColumn("score", F.round("score", 5))


@query(
    "m30_ties_by_mcc",
    """WITH {SCORES}, s AS (SELECT method, seed, score, count(*) FILTER (y = 1) AS p, count(*) AS c FROM sc GROUP BY 1, 2, 3), t AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS a FROM s WINDOW w AS (PARTITION BY method, seed ORDER BY score DESC)), ap AS (SELECT method, seed, sum(p * tp / a) / sum(p) AS pr_auc FROM t GROUP BY 1, 2),
 c AS (SELECT method, seed, count(*) FILTER (score > 10 AND y = 1)::DOUBLE AS tp, count(*) FILTER (score > 10 AND y = 0)::DOUBLE AS fp, count(*) FILTER (score <= 10 AND y = 1)::DOUBLE AS fn, count(*) FILTER (score <= 10 AND y = 0)::DOUBLE AS tn FROM sc GROUP BY 1, 2),
 m AS (SELECT method, seed, CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END AS mcc FROM c),
 j AS (SELECT *, max(pr_auc) OVER (PARTITION BY seed) AS top FROM ap JOIN m USING (method, seed)), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY mcc DESC, pr_auc DESC, method) AS r FROM j WHERE top - pr_auc < 0.02) SELECT seed, method, round(pr_auc, 6) AS pr_auc, round(mcc, 6) AS mcc FROM r WHERE r = 1""",
)
def m30_ties_by_mcc(spark: SparkSession, d: str) -> DataFrame:
    """The method of each seed by area under precision and recall; near ties by Matthews' correlation."""
    s, keys = scores(spark, d), ["method", "seed"]
    m = metrics.average_precision(s, "y", "score", keys).join(metrics.confusion(s, "y", F.col("score") > 10, keys).select(*keys, "mcc"), keys)
    return r6(summaries.best_with_ties(m, "pr_auc", "mcc", "method", 0.02, ["seed"]).select("seed", "method", "pr_auc", "mcc"))


STUDY = """q AS (SELECT DISTINCT k AS alert, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS is_attack, CASE WHEN k % 3 = 0 THEN 'Scan' ELSE 'None' END AS category, CASE WHEN k % 2 = 1 THEN 'A' ELSE 'B' END AS f1, CASE WHEN k % 2 = 1 THEN 'B' ELSE 'A' END AS f2 FROM ev),
 r AS (SELECT CAST(user_id % 20 AS VARCHAR) AS participant, is_attack, CASE WHEN user_id % 2 = 0 THEN f1 ELSE f2 END AS condition, CASE WHEN (event_type = 'error') = (is_attack = 1) THEN 1.0 ELSE 0.0 END AS correct,
  CASE WHEN (CASE WHEN event_type = 'view' THEN 'none' ELSE 'scan' END) = lower(category) THEN 1.0 ELSE 0.0 END AS category_correct, score AS seconds, vbin % 5 + 1 AS trust FROM ev JOIN q ON k = alert)"""


@query(
    "g23_study_tables",
    "WITH {EV}, " + STUDY + """, l AS (SELECT 'condition' AS part, CAST(NULL AS VARCHAR) AS name, condition, unnest(['correct', 'category_correct', 'seconds']) AS measure, unnest([correct, category_correct, seconds]::DOUBLE[]) AS v FROM r
  UNION ALL SELECT 'truth', CAST(is_attack AS VARCHAR), condition, 'correct', correct FROM r UNION ALL SELECT 'participant', participant, condition, unnest(['correct', 'category_correct', 'seconds']), unnest([correct, category_correct, seconds]::DOUBLE[]) FROM r
  UNION ALL SELECT 'rating', NULL, condition, 'trust', trust FROM r WHERE condition = 'B') SELECT part, name, condition, measure, count(v) AS n, round(avg(v), 6) AS value FROM l GROUP BY ALL""",
)
def g23_study_tables(spark: SparkSession, d: str) -> DataFrame:
    """A questionnaire scored by condition, truth and participant, with ratings: events answer, their k is the alert."""
    f, k = flows(spark, d), F.col("alert")
    key = f.select(F.col("k").alias("alert")).distinct().select("alert", (k % 3 == 0).cast("int").alias("is_attack"), F.when(k % 3 == 0, "Scan").otherwise("None").alias("category"), F.when(k % 2 == 1, "A").otherwise("B").alias("condition_form_1"), F.when(k % 2 == 1, "B").otherwise("A").alias("condition_form_2"))
    answers = f.select(
        (F.col("user_id") % 20).alias("participant"), F.col("k").alias("alert"), (F.col("user_id") % 2 + 1).alias("form"), F.when(F.col("y") == 1, " Attack, sure").otherwise("benign").alias("decision"),
        F.when(F.col("event_type") == "view", "none ").otherwise(" SCAN").alias("category_answer"), F.col("score").alias("seconds"), (F.col("vbin") % 5 + 1).alias("trust"),
    )
    return r6(summaries.study_tables(answers, key, ["seconds"], ["trust"]))


@query(
    "g21_hypotheses",
    """WITH {SCORES}, m AS (SELECT method, seed, label, avg(score) AS v FROM sc GROUP BY 1, 2, 3), p AS (SELECT b.method AS name, a.v - b.v AS d FROM m a JOIN m b USING (seed, label) WHERE a.method = 'e1' AND b.method <> 'e1'),
 i AS (SELECT name, avg(d) AS diff, avg(d) - 1.96 * stddev_samp(d) / sqrt(count(*)) AS lo, avg(d) + 1.96 * stddev_samp(d) / sqrt(count(*)) AS hi FROM p GROUP BY 1) SELECT name, round(diff, 6) AS diff, round(lo, 6) AS lo, round(hi, 6) AS hi, lo > 0 AS supported, hi < 0 AS refuted, printf('%+.3f [%+.3f, %+.3f]', diff, lo, hi) AS result FROM i""",
)
def g21_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """Whether one method's mean score lies above each other's, by intervals of paired differences."""
    m = scores(spark, d).groupBy("method", "seed", "label").agg(F.avg("score").alias("v"))
    a, b = m.where("method = 'e1'").select("seed", "label", F.col("v").alias("_a")), m.where("method <> 'e1'")
    half = 1.96 * F.stddev_samp("d") / F.sqrt(F.count("*"))
    i = b.join(a, ["seed", "label"]).select(F.col("method").alias("name"), (F.col("_a") - F.col("v")).alias("d")).groupBy("name").agg(F.avg("d").alias("diff"), (F.avg("d") - half).alias("lo"), (F.avg("d") + half).alias("hi"))
    return r6(summaries.hypothesis_checks(i))


@query(
    "g21_side_by_side",
    """WITH {SCORES}, a AS (SELECT method, 'early' AS dataset, avg(score) AS mean, stddev_samp(score) AS std FROM sc WHERE is_val GROUP BY 1), b AS (SELECT method, 'late' AS dataset, avg(score) AS mean, CAST(NULL AS DOUBLE) AS std FROM sc WHERE NOT is_val GROUP BY 1), u AS (FROM a UNION ALL FROM b)
 SELECT method, dataset, round(mean, 6) AS mean, round(std, 6) AS std, CAST(rank() OVER (PARTITION BY dataset ORDER BY mean DESC) AS INTEGER) AS rank_mean, CASE WHEN std IS NOT NULL THEN CAST(rank() OVER (PARTITION BY dataset ORDER BY std DESC NULLS LAST) AS INTEGER) END AS rank_std FROM u""",
)
def g21_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    """Two datasets' tables as one, with ranks; the second lacks a measure."""
    s = scores(spark, d)
    early = s.where("is_val").groupBy("method").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"))
    late = s.where("NOT is_val").groupBy("method").agg(F.avg("score").alias("mean"))
    return r6(summaries.datasets_side_by_side({"early": early, "late": late}, "method", ["mean", "std"]))


@query(
    "q05_split_profile",
    """WITH l AS (SELECT CASE WHEN l_returnflag = 'R' OR l_linenumber = 7 THEN 1 ELSE 0 END AS label, CASE WHEN l_returnflag = 'R' THEN 'Scan' || repeat(' ', l_linenumber % 2) ELSE 'Benign' END AS cat, l_quantity AS a, nullif(l_discount, 0) AS b, nullif(l_tax, 0) AS c, l_linenumber FROM lineitem),
 x AS (SELECT * FROM l WHERE l_linenumber >= 4), g AS (SELECT a, b, c, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT DISTINCT a, b, c FROM l WHERE l_linenumber < 4)
 SELECT count(*) AS rows, count(*) FILTER (label = 1) AS attack_rows, count(*) FILTER ((label = 1) <> (trim(cat) <> 'Benign')) AS mismatch, count(*) FILTER (cat <> trim(cat)) AS padded, CAST(sum((b IS NULL)::INT + (c IS NULL)::INT) AS BIGINT) AS missing_cells, count(*) FILTER (b IS NULL OR c IS NULL) AS rows_with_missing,
 (SELECT CAST(sum(n) - count(*) AS BIGINT) FROM g) AS duplicate_rows, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM g WHERE EXISTS (SELECT 1 FROM t WHERE t.a IS NOT DISTINCT FROM g.a AND t.b IS NOT DISTINCT FROM g.b AND t.c IS NOT DISTINCT FROM g.c)) AS rows_seen_in_train FROM x""",
)
def q05_split_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profile of a test part against its training part."""
    n = F.col("l_linenumber")
    li = table(spark, d, "lineitem").select(
        ((F.col("l_returnflag") == "R") | (n == 7)).cast("int").alias("label"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Scan"), F.when(n % 2 == 1, " ").otherwise(""))).otherwise("Benign").alias("cat"),
        F.col("l_quantity").alias("a"), F.nullif("l_discount", F.lit(0)).alias("b"), F.nullif("l_tax", F.lit(0)).alias("c"), n,
    )
    return summaries.split_profile(li.where("l_linenumber >= 4"), "label", "cat", ["a", "b", "c"], li.where("l_linenumber < 4"))


# --- modalities -----------------------------------------------------------------------------------------------------

LINES = """v AS (SELECT row_id AS id, event_type AS label, y, score, [CAST(k AS BIGINT), CAST(vbin AS BIGINT) * 10, CAST(role AS BIGINT) * 10, CAST(proto AS BIGINT)] AS x FROM ev),
 p AS (SELECT a.id, a.label, a.x, b.x AS r, row_number() OVER (PARTITION BY a.id ORDER BY (a.x[1] - b.x[1]) ** 2 + (a.x[2] - b.x[2]) ** 2 + (a.x[3] - b.x[3]) ** 2 + (a.x[4] - b.x[4]) ** 2, b.id) AS rank FROM v a JOIN v b ON a.y = 1 AND a.score > 80 AND b.y = 0 AND b.score < 50),
 n AS (SELECT *, (x[1] ** 2 + x[2] ** 2) / 100.0 AS s1, (x[3] ** 2 + x[4] ** 2) / 100.0 AS s2, (r[1] ** 2 + r[2] ** 2) / 100.0 AS b1, (r[3] ** 2 + r[4] ** 2) / 100.0 AS b2, CASE WHEN abs(x[1]) + abs(x[2]) >= abs(x[3]) + abs(x[4]) THEN 'amount' ELSE 'rate' END AS modality FROM p WHERE rank = 1)"""

SLICES = {"amount": (0, 2), "rate": (2, 4)}


def _modal(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Alerts, benign rows and the alerts' top modality by shares of its values."""
    places = [F.col("k"), F.col("vbin") * 10, F.col("role") * 10, F.col("proto")]
    v = flows(spark, d).select(F.col("row_id").alias("id"), F.col("event_type").alias("label"), "y", "score", F.array(*[p.cast("double") for p in places]).alias("x"))
    alerts, benign = v.where("y = 1 AND score > 80"), v.where("y = 0 AND score < 50")
    values = alerts.select("id", F.posexplode("x").alias("p", "value")).select("id", F.concat(F.lit("f"), "p").alias("feature"), "value")
    names = spark.createDataFrame([("f0", "amount"), ("f1", "amount"), ("f2", "rate"), ("f3", "rate")], "feature string, modality string")
    return alerts, benign, plausible.top_modality(explain.modality_share(values, names))


@query("a07_modality_deletion", "WITH {EV}, " + LINES + """, q AS (SELECT id, modality, s1 + s2 AS f, b1 + b2 AS b, CASE WHEN modality = 'amount' THEN b1 + s2 ELSE s1 + b2 END AS t, CASE WHEN modality = 'amount' THEN s1 + b2 ELSE b1 + s2 END AS o FROM n)
 SELECT id, modality, round(CASE WHEN f - b >= 0.5 THEN (f - t) / (f - b) END, 6) AS drop, round(CASE WHEN f - b >= 0.5 THEN (f - o) / (f - b) END, 6) AS other_drop FROM q""")
def a07_modality_deletion(spark: SparkSession, d: str) -> DataFrame:
    """How much of an alert's score goes with its top modality, replaced by the nearest benign row's, and with the other."""
    alerts, benign, top = _modal(spark, d)
    near = neighbours.nearest_by_cells(alerts, benign, 1)
    gone = plausible.modality_replaced(alerts, near, benign, SLICES).withColumn("score", F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v) / 100)
    return r6(plausible.modality_drop(gone, top))


@query("a07_plausibility", "WITH {EV}, " + LINES + " SELECT label, count(*) AS n, round(avg(CASE WHEN modality = 'amount' THEN 1.0 ELSE 0.0 END), 6) AS plausible, 0.5 AS chance FROM n GROUP BY label")
def a07_plausibility(spark: SparkSession, d: str) -> DataFrame:
    """Share of alerts of a label whose top modality is one that its attack should touch."""
    alerts, _, top = _modal(spark, d)
    expected = spark.createDataFrame([("error", "amount"), ("error", "amount")], "label string, modality string")
    return r6(plausible.plausibility(top, alerts.select("id", "label"), expected, 2))
