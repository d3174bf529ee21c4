"""Scores, metrics, joins, audits and set operations over the views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.functions import columns as C
from flowlens.operators import audit, features, joins, metrics, scoring, split
from flowlens.operators.quantiles import quantiles
from flowlens.plans.views import connections, flows, order_flows, query, r6, schedule, scores, table
from flowlens.sources.scratch import written

# --- scores ---------------------------------------------------------------------------------------------------------

CAL = """g AS (SELECT median(v) AS gm FROM v), gs AS (SELECT gm, 1.4826 * median(abs(v - gm)) + 1e-6 AS gsc FROM v, g GROUP BY gm), m AS (SELECT role, median(v) AS med, count(*) AS n FROM v GROUP BY role),
 e AS (SELECT role, med, greatest(1.4826 * median(abs(v - med)) + 1e-6, 0.5 * any_value(gsc)) AS scale FROM v JOIN m USING (role), gs WHERE n >= 300 GROUP BY role, med)"""


@query("m13_calibrator", "WITH {EV}, v AS (SELECT row_id, role, ln(abs(score) + 1e-8) AS v FROM ev), " + CAL + " SELECT row_id, round((v - coalesce(med, gm)) / coalesce(scale, gsc), 6) AS z FROM v LEFT JOIN e USING (role), gs")
def m13_calibrator(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d).withColumn("c", F.abs("score"))
    whole, each = scoring.calibrator(f, "c", "role", 300)
    return r6(scoring.calibrated(f, "c", "role", whole, each)).select("row_id", "z")


@query("m14_tail", "WITH {EV}, r AS (SELECT score AS s FROM ev WHERE y = 0), n AS (SELECT count(*) AS n FROM r), c AS (SELECT score, (SELECT count(*) FROM r WHERE s <= t.score) AS a FROM (SELECT DISTINCT score FROM ev) t) SELECT row_id, round(-ln((n - a + 1) / (n + 1)), 6) AS tail FROM ev JOIN c USING (score), n")
def m14_tail(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d)
    return r6(scoring.tail_score(f, "score", f.where("y = 0"), "score", "tail")).select("row_id", "tail")


@query("m15_extended_tail", """WITH {EV}, r AS (SELECT score AS s, row_number() OVER (ORDER BY score) - 1 AS p, count(*) OVER () AS n FROM ev WHERE y = 0), kk AS (SELECT min(s) AS u, CASE WHEN avg(s) > min(s) THEN avg(s) - min(s) ELSE 1 END AS sc, CAST(floor(any_value(n) * 0.99) AS BIGINT) AS kq, any_value(n) AS n FROM r WHERE p >= floor(n * 0.99)),
 c AS (SELECT score, (SELECT count(*) FROM r WHERE s <= t.score) AS a FROM (SELECT DISTINCT score FROM ev) t)
 SELECT row_id, round(CASE WHEN score > u THEN -ln((n - kq) / (n + 1)) + (score - u) / sc ELSE -ln((n - a + 1) / (n + 1)) END, 6) AS tail FROM ev JOIN c USING (score), kk""")
def m15_extended_tail(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d)
    return r6(scoring.extended_tail(f, "score", f.where("y = 0"), "score", "tail")).select("row_id", "tail")


TAILS = """v AS (SELECT seed, method, score, count(*) AS c FROM sc WHERE is_val GROUP BY 1, 2, 3), vn AS (SELECT seed, method, sum(c) AS n FROM v GROUP BY 1, 2),
 u AS (SELECT seed, method, score, sum(c) AS c FROM (SELECT seed, method, score, c FROM v UNION ALL SELECT DISTINCT seed, method, score, 0 FROM sc) GROUP BY 1, 2, 3),
 a AS (SELECT seed, method, score, sum(c) OVER (PARTITION BY seed, method ORDER BY score) AS a FROM u),
 t AS (SELECT sc.row_id, sc.seed, sc.method, sc.is_val, -ln((n - a + 1) / (n + 1)) AS t FROM sc JOIN a USING (seed, method, score) JOIN vn USING (seed, method))"""


@query("m16_m17_experts", "WITH {SCORES}, " + TAILS + " SELECT row_id, seed, round(max(t), 6) AS score FROM t WHERE method <> 'knn' AND NOT is_val GROUP BY row_id, seed HAVING count(*) = 3")
def m16_m17_experts(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d).where("method <> 'knn'")
    t = scoring.tail_score(s.where("NOT is_val"), "score", s.where("is_val"), "score", "t", ["seed", "method"])
    return r6(scoring.fuse_long(t.select("row_id", "seed", F.col("t").alias("score")), ["row_id", "seed"], 3))


@query("m18_tail_ensemble", "WITH {SCORES}, " + TAILS + """, w AS (SELECT row_id, seed, is_val, max(CASE WHEN method = 'knn' THEN t END) AS knn, max(CASE WHEN method <> 'knn' THEN t END) AS ex FROM t GROUP BY 1, 2, 3),
 n AS (SELECT seed, count(*) AS n FROM w WHERE is_val GROUP BY seed), x AS (SELECT w.*, count(*) FILTER (is_val) OVER (PARTITION BY seed ORDER BY ex) AS a FROM w),
 b AS (SELECT x.*, greatest(knn, -ln((n - a + 1) / (n + 1))) AS b, n FROM x JOIN n USING (seed)), z AS (SELECT b.*, count(*) FILTER (is_val) OVER (PARTITION BY seed ORDER BY b) AS a2 FROM b)
 SELECT row_id, round(avg(-ln((n - a2 + 1) / (n + 1))), 6) AS score FROM z WHERE NOT is_val GROUP BY row_id""")
def m18_tail_ensemble(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d).select("seed", "row_id", "method", "score", "is_val")
    return r6(scoring.tail_ensemble(s.where("NOT is_val").drop("is_val"), s.where("is_val").drop("is_val"), "knn"))


@query("m20_m21_fusion", "WITH {SCORES}, " + TAILS + " SELECT row_id, round(avg(t), 6) AS mean_tail, round(max(CASE WHEN method <> 'e2' THEN t END), 6) AS without_e2 FROM t WHERE NOT is_val GROUP BY row_id")
def m20_m21_fusion(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    t = scoring.tail_score(s.where("NOT is_val"), "score", s.where("is_val"), "score", "t", ["seed", "method"])
    return r6(t.groupBy("row_id").agg(F.avg("t").alias("mean_tail"), F.max(F.when(F.col("method") != "e2", F.col("t"))).alias("without_e2")))


@query("m22_threshold", "WITH {SCORES} SELECT method, seed, round(quantile_cont(score, 0.99), 6) AS threshold FROM sc WHERE is_val AND y = 0 GROUP BY method, seed")
def m22_threshold(spark: SparkSession, d: str) -> DataFrame:
    return r6(scoring.threshold(scores(spark, d).where("is_val AND y = 0"), "score", 0.01, ["method", "seed"]))


ADAPT = """t AS (SELECT ev.*, sec < min(sec) OVER (PARTITION BY day) + 14400 AS ref FROM ev), m AS (SELECT day, median(score) AS med FROM t WHERE ref GROUP BY day), s AS (SELECT day, med, 1.4826 * median(abs(score - med)) + 1e-6 AS sc FROM t JOIN m USING (day) WHERE ref GROUP BY day, med),
 q AS (SELECT day, quantile_cont((score - med) / sc, 0.95) AS threshold FROM t JOIN s USING (day) WHERE ref GROUP BY day)"""


@query("m23_adaptation", "WITH {EV}, " + ADAPT + " SELECT row_id, round((score - med) / sc, 6) AS adapted, round(threshold, 6) AS threshold FROM t JOIN s USING (day) JOIN q USING (day) WHERE NOT ref")
def m23_adaptation(spark: SparkSession, d: str) -> DataFrame:
    return r6(scoring.adapt_by_day(flows(spark, d), "day", "sec", "score", 14400, 0.05)).select("row_id", "adapted", "threshold")


@query("m24_m25_hybrid", "WITH {EV} SELECT row_id, score + 1e6 * CAST(event_type = 'signup' AS DOUBLE) AS hybrid FROM ev")
def m24_m25_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).withColumn("sig", (F.col("event_type") == "signup").cast("double")).select("row_id", scoring.hybrid_or("score", "sig").alias("hybrid"))


@query("m27_recalibrate", "WITH {EV}, m AS (SELECT median(score) AS med FROM ev WHERE y = 0), s AS (SELECT med, 1.4826 * median(abs(score - med)) + 1e-6 AS scale, count(*) AS n FROM ev, m WHERE y = 0 GROUP BY med) SELECT round(med, 6) AS med, round(scale, 6) AS scale, n, round(quantile_cont((score - med) / scale, 0.99), 6) AS threshold FROM ev, s WHERE y = 0 GROUP BY med, scale, n HAVING n >= 2000")
def m27_recalibrate(spark: SparkSession, d: str) -> DataFrame:
    return r6(scoring.recalibrate(flows(spark, d).where("y = 0"), "score", 0.01))


@query("m28_alert_rate", "WITH {EV} SELECT round(avg(CASE WHEN score > 50 THEN 1.0 ELSE 0.0 END), 6) AS alert_rate, count(*) AS n FROM ev WHERE y = 0")
def m28_alert_rate(spark: SparkSession, d: str) -> DataFrame:
    return r6(scoring.alert_rate(flows(spark, d).where("y = 0"), "score", F.lit(50)))


@query("m30_selection", "WITH {EV}, a AS (SELECT event_type AS name, avg(score) AS v FROM ev GROUP BY 1), b AS (SELECT max(v) AS top, max_by(name, (v, name)) AS best, max(CASE WHEN name = 'view' THEN v END) AS base FROM a) SELECT CASE WHEN top > base + 0.002 THEN best ELSE 'view' END AS chosen, round(top, 6) AS top, round(base, 6) AS base FROM b")
def m30_selection(spark: SparkSession, d: str) -> DataFrame:
    a = flows(spark, d).groupBy(F.col("event_type").alias("name")).agg(F.avg("score").alias("v"))
    return r6(scoring.pick_best(a, "v", "view", 0.002))


# --- metrics --------------------------------------------------------------------------------------------------------

CONF = """c AS (SELECT event_type, CAST(sum(CASE WHEN score > 50 AND k % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN score > 50 AND k % 3 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN score <= 50 AND k % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN score <= 50 AND k % 3 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM ev GROUP BY 1)"""


@query("g01_g14_confusion", "WITH {EV}, " + CONF + """, r AS (SELECT *, tp / greatest(tp + fp, 1)::DOUBLE AS precision, tp / greatest(tp + fn, 1)::DOUBLE AS recall FROM c)
 SELECT event_type, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fp / greatest(fp + tn, 1)::DOUBLE, 6) AS fpr, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round((tp + fn) / (tp + fp + fn + tn)::DOUBLE, 6) AS attack_rate, round(2 * precision * recall / greatest(precision + recall, 1e-12), 6) AS f1,
  round(CASE WHEN (tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 6) AS mcc FROM r""")
def g01_g14_confusion(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d).withColumn("t", (F.col("k") % 3 == 0).cast("int"))
    return r6(metrics.confusion(f, "t", F.col("score") > 50, ["event_type"]))


AUC = """a AS (SELECT {g} s, sum(p) AS p, sum(q) AS q FROM ({src}) GROUP BY {g} s), b AS (SELECT *, sum(q) OVER ({pb} ORDER BY s) - q * 0.5 AS below FROM a)"""


@query("g02_g05_auc", "WITH {SCORES}, " + AUC.format(g="method, seed,", pb="PARTITION BY method, seed", src="SELECT method, seed, score AS s, y AS p, 1 - y AS q FROM sc") + ", r AS (SELECT method, seed, sum(p * below) / (sum(p) * sum(q)) AS roc_auc FROM b GROUP BY 1, 2) SELECT method, seed, round(roc_auc, 6) AS roc_auc, round(greatest(roc_auc, 1 - roc_auc), 6) AS folded FROM r")
def g02_g05_auc(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.roc_auc(scores(spark, d), "y", "score", ["method", "seed"]).withColumn("folded", metrics.folded("roc_auc")))


@query("g02_auc_global", "WITH {EV}, " + AUC.format(g="", pb="", src="SELECT score AS s, y AS p, 1 - y AS q FROM ev") + " SELECT round(sum(p * below) / (sum(p) * sum(q)), 6) AS roc_auc FROM b")
def g02_auc_global(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.roc_auc(flows(spark, d), "y", "score"))


@query("g03_average_precision", "WITH {SCORES}, a AS (SELECT method, seed, score AS s, sum(y) AS p, count(*) AS n FROM sc GROUP BY 1, 2, 3), b AS (SELECT *, sum(p) OVER (PARTITION BY method, seed ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY method, seed ORDER BY s DESC) AS al FROM a) SELECT method, seed, round(sum(p * tp / al) / sum(p), 6) AS pr_auc FROM b GROUP BY 1, 2")
def g03_average_precision(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.average_precision(scores(spark, d), "y", "score", ["method", "seed"]))


@query("g06_macro_auc", """WITH {EV}, q AS (SELECT score AS s, count(*) AS q FROM ev WHERE event_type = 'view' GROUP BY 1), p AS (SELECT event_type AS attack, score AS s, count(*) AS p FROM ev WHERE event_type <> 'view' GROUP BY 1, 2),
 b AS (SELECT s, sum(q) OVER (ORDER BY s) - q * 0.5 AS below FROM (SELECT s, max(q) AS q FROM (SELECT s, q FROM q UNION ALL SELECT DISTINCT score, 0 FROM ev) GROUP BY s)) SELECT attack, round(sum(p * below) / (sum(p) * (SELECT sum(q) FROM q)), 6) AS roc_auc FROM p JOIN b USING (s) GROUP BY attack""")
def g06_macro_auc(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d).withColumn("t", (F.col("event_type") != "view").cast("int"))
    return r6(metrics.auc_per_type(f, "t", "event_type", "score"))


@query("g07_oracle_recall", "WITH {SCORES}, t AS (" + " UNION ALL ".join(f"SELECT method, seed, {f} AS f, quantile_cont(score, 1 - {f}) AS t FROM sc WHERE y = 0 GROUP BY 1, 2" for f in (0.01, 0.02, 0.05)) + ") SELECT method, seed, CAST(f AS DOUBLE) AS fpr_target, round(avg(CASE WHEN score > t THEN 1.0 ELSE 0.0 END), 6) AS recall FROM sc JOIN t USING (method, seed) WHERE y = 1 GROUP BY 1, 2, 3")
def g07_oracle_recall(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    targets = [0.01, 0.02, 0.05]
    t = quantiles(s.where("y = 0"), "score", {f"t{i}": 1 - x for i, x in enumerate(targets)}, ["method", "seed"]).withColumn("t", F.array(*[f"t{i}" for i in range(len(targets))]))
    long = t.select("method", "seed", F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in targets]).alias("fpr_target"), F.col("t").alias("t"))).alias("x")).select("method", "seed", F.col("x.fpr_target").alias("fpr_target"), F.col("x.t").alias("t"))
    return r6(s.where("y = 1").join(F.broadcast(long), ["method", "seed"]).groupBy("method", "seed", "fpr_target").agg(F.avg((F.col("score") > F.col("t")).cast("double")).alias("recall")))


@query("g08_recall_pivot", "WITH {SCORES}, t AS (SELECT method, quantile_cont(score, 0.9) AS t FROM sc WHERE y = 0 GROUP BY 1) SELECT label, round(avg(CASE WHEN method = 'e1' THEN CASE WHEN score > t THEN 1.0 ELSE 0.0 END END), 6) AS e1, round(avg(CASE WHEN method = 'knn' THEN CASE WHEN score > t THEN 1.0 ELSE 0.0 END END), 6) AS knn FROM sc JOIN t USING (method) GROUP BY label")
def g08_recall_pivot(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    t = scoring.threshold(s.where("y = 0"), "score", 0.1, ["method"])
    hit = s.join(F.broadcast(t), "method").withColumn("hit", (F.col("score") > F.col("threshold")).cast("double"))
    return r6(hit.groupBy("label").pivot("method", ["e1", "knn"]).agg(F.avg("hit")))


@query("g09_trade_off", "WITH {SCORES}, t AS (" + " UNION ALL ".join(f"SELECT method, {f} AS f, quantile_cont(score, 1 - {f}) AS t FROM sc WHERE y = 0 AND is_val GROUP BY 1" for f in (0.001, 0.005, 0.01, 0.02, 0.05)) + ") SELECT method, CAST(f AS DOUBLE) AS fpr_target, round(avg(CASE WHEN y = 1 THEN CASE WHEN score > t THEN 1.0 ELSE 0.0 END END), 6) AS recall, round(avg(CASE WHEN y = 0 THEN CASE WHEN score > t THEN 1.0 ELSE 0.0 END END), 6) AS test_fpr FROM sc JOIN t USING (method) WHERE NOT is_val GROUP BY 1, 2")
def g09_trade_off(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    targets = [0.001, 0.005, 0.01, 0.02, 0.05]
    t = quantiles(s.where("y = 0 AND is_val"), "score", {f"t{i}": 1 - x for i, x in enumerate(targets)}, ["method"]).withColumn("t", F.array(*[f"t{i}" for i in range(len(targets))]))
    long = t.select("method", F.posexplode("t")).select("method", F.element_at(F.array(*[F.lit(x) for x in targets]), F.col("pos") + 1).alias("fpr_target"), F.col("col").alias("t"))
    hit = (F.col("score") > F.col("t")).cast("double")
    out = s.where("NOT is_val").join(F.broadcast(long), "method").groupBy("method", "fpr_target")
    return r6(out.agg(F.avg(F.when(F.col("y") == 1, hit)).alias("recall"), F.avg(F.when(F.col("y") == 0, hit)).alias("test_fpr")))


@query("g10_time_to_detect", "WITH {EV} SELECT day, event_type, CAST(min(CASE WHEN score > 80 THEN sec END) - min(sec) AS BIGINT) AS seconds_to_first_detection FROM ev GROUP BY 1, 2")
def g10_time_to_detect(spark: SparkSession, d: str) -> DataFrame:
    return metrics.time_to_detect(flows(spark, d).withColumn("hit", F.col("score") > 80), ["day", "event_type"], "sec", "hit")


INC = """n AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY day, event_type ORDER BY sec) > 1800 THEN 1 ELSE 0 END AS new FROM ev WHERE event_type IN ('error', 'signup')), g AS (SELECT *, sum(new) OVER (PARTITION BY day, event_type ORDER BY sec) AS incident FROM n),
 inc AS (SELECT day, event_type, incident, min(sec) AS start, max(sec) - min(sec) AS duration, count(*) AS n_rows, count(*) FILTER (score > 80) AS n_flagged, min(sec) FILTER (score > 80) - min(sec) AS seconds_to_detect, count(*) FILTER (score > 80) > 0 AS detected FROM g GROUP BY 1, 2, 3)"""


def _incidents(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d).where("event_type IN ('error', 'signup')").withColumn("hit", F.col("score") > 80)
    return metrics.incidents(f, "day", "event_type", "sec", "hit", 1800)


@query("g11_incidents", "WITH {EV}, " + INC + " SELECT day, event_type, CAST(incident AS BIGINT) AS incident, start, duration, n_rows, n_flagged, seconds_to_detect, detected FROM inc")
def g11_incidents(spark: SparkSession, d: str) -> DataFrame:
    return _incidents(spark, d)


@query("g12_incident_summary", "WITH {EV}, " + INC + " SELECT event_type, count(*) AS incidents, count(*) FILTER (detected) AS detected, round(median(seconds_to_detect), 6) AS median_seconds FROM inc GROUP BY 1")
def g12_incident_summary(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.incident_summary(_incidents(spark, d), ["event_type"]))


@query("g13_false_alerts", "WITH {EV}, x AS (SELECT day, (max(sec) - min(sec)) / 3600.0 AS h, count(*) FILTER (score > 80 AND y = 0) AS f FROM ev GROUP BY day) SELECT round(sum(f) / greatest(sum(h), 1e-9), 6) AS false_alerts_per_hour FROM x")
def g13_false_alerts(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.false_alerts_per_hour(flows(spark, d), "day", "sec", (F.col("score") > 80) & (F.col("y") == 0)))


@query("g15_alert_groups", "WITH {EV} SELECT user_id, sec // 3600 AS bin, count(*) AS n_flagged, max(y) AS is_true FROM ev WHERE score > 80 GROUP BY 1, 2")
def g15_alert_groups(spark: SparkSession, d: str) -> DataFrame:
    return metrics.alert_groups(flows(spark, d), "user_id", "sec", 3600, F.col("score") > 80, "y")


@query("g16_window_alerts", """WITH {EV}, w AS (SELECT role, sec // 3600 AS bin, count(*) AS n, count(*) FILTER (score > 90) AS k FROM ev GROUP BY 1, 2),
 t AS (SELECT role, bin, n, k, CASE WHEN k <= 0 THEN 0 ELSE -ln(least(1.0, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95))) FROM range(k, n + 1) r(i)))) END AS score FROM w) SELECT role, bin, n, k, round(abs(score), 4) AS score FROM t""")
def g16_window_alerts(spark: SparkSession, d: str) -> DataFrame:
    w = flows(spark, d).groupBy("role", F.floor(F.col("sec") / 3600).alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("score") > 90).alias("k"))
    return metrics.binomial_tail(w, "k", "n", 0.05, "score").withColumn("score", F.round(F.abs("score"), 4))


@query("g17_seed_summary", "WITH {SCORES}, m AS (SELECT method, seed, avg(score) AS v FROM sc WHERE NOT (method = 'e3' AND seed = 1) GROUP BY 1, 2) SELECT method, round(avg(v), 6) AS v_mean, round(stddev_samp(v), 6) AS v_std FROM m GROUP BY method HAVING count(DISTINCT seed) = 2")
def g17_seed_summary(spark: SparkSession, d: str) -> DataFrame:
    m = scores(spark, d).where("NOT (method = 'e3' AND seed = 1)").groupBy("method", "seed").agg(F.avg("score").alias("v"))
    return r6(metrics.seed_summary(m, ["method"], "seed", ["v"]))


@query("g18_g20_flag_rates", "WITH {EV} SELECT event_type, count(*) AS n, round(avg(CASE WHEN score > 80 THEN 1.0 ELSE 0.0 END), 6) AS ml, round(avg(CASE WHEN k % 10 = 0 THEN 1.0 ELSE 0.0 END), 6) AS sig, round(avg(CASE WHEN score > 80 OR k % 10 = 0 THEN 1.0 ELSE 0.0 END), 6) AS either_one FROM ev GROUP BY 1")
def g18_g20_flag_rates(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("score") > 80, F.col("k") % 10 == 0
    return r6(flows(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), *[F.avg(x.cast("double")).alias(n) for x, n in ((a, "ml"), (b, "sig"), (a | b, "either_one"))]))


@query("g19_volume", "WITH {EV}, x AS (SELECT dst_port, count(*) AS n FROM ev WHERE score > 80 GROUP BY 1) SELECT dst_port, n, round(n / ((SELECT max(sec) - min(sec) FROM ev) / 3600.0), 6) AS per_hour FROM x ORDER BY n DESC, dst_port LIMIT 15")
def g19_volume(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d)
    span = f.agg(((F.max("sec") - F.min("sec")) / 3600).alias("h"))
    n = f.where("score > 80").groupBy("dst_port").agg(F.count("*").alias("n")).crossJoin(F.broadcast(span))
    return r6(n.select("dst_port", "n", (F.col("n") / F.col("h")).alias("per_hour")).orderBy(F.desc("n"), "dst_port").limit(15))


@query("g21_tables", "WITH {SCORES}, m AS (SELECT method, seed, avg(score) AS v FROM sc GROUP BY 1, 2) SELECT seed, round(max(CASE WHEN method = 'knn' THEN v END), 6) AS knn, round(max(CASE WHEN method = 'e1' THEN v END), 6) AS e1, max(CASE WHEN method = 'knn' THEN v END) > max(CASE WHEN method = 'e1' THEN v END) AS knn_wins FROM m GROUP BY seed")
def g21_tables(spark: SparkSession, d: str) -> DataFrame:
    m = scores(spark, d).groupBy("seed").pivot("method", ["knn", "e1"]).agg(F.avg("score"))
    return r6(m.withColumn("knn_wins", F.col("knn") > F.col("e1")))


@query("g22_benign_day", "WITH {EV} SELECT count(*) FILTER (k % 10 = 0) AS hits, round(avg(CASE WHEN k % 10 = 0 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM ev WHERE day = (SELECT min(day) FROM ev) AND y = 0")
def g22_benign_day(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d)
    first = f.agg(F.min("day").alias("day"))
    return r6(f.where("y = 0").join(F.broadcast(first), "day").agg(F.count_if(F.col("k") % 10 == 0).alias("hits"), F.avg((F.col("k") % 10 == 0).cast("double")).alias("rate")))


@query("g23_study", "SELECT role, round(avg(CASE WHEN length(text) % 2 = 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(DISTINCT conv_id) AS participants FROM conversations GROUP BY role")
def g23_study(spark: SparkSession, d: str) -> DataFrame:
    return r6(table(spark, d, "conversations").groupBy("role").agg(F.avg((F.length("text") % 2 == 0).cast("double")).alias("accuracy"), F.count_distinct("conv_id").alias("participants")))


@query("g24_describe", " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_tax")))
def g24_describe(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.describe(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]))


@query("b02_b03_bins", """WITH {EV}, r AS (SELECT *, rank() OVER (ORDER BY score) - 1 AS rk, count(*) OVER () AS n FROM ev), b AS (SELECT CAST(floor(rk * 200 / n) AS BIGINT) AS bin, sum(y) AS p, sum(1 - y) AS q FROM (SELECT rk::DOUBLE AS rk, n, y FROM r) GROUP BY 1), c AS (SELECT *, sum(q) OVER (ORDER BY bin) - q * 0.5 AS below FROM b)
 SELECT round(sum(p * below) / (sum(p) * sum(q)), 6) AS roc_auc FROM c""")
def b02_b03_bins(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.roc_auc(metrics.rank_bins(flows(spark, d), "score", 200), "y", "bin"))


# --- joins ----------------------------------------------------------------------------------------------------------


@query("j01_inner", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def j01_inner(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("j02_both_ways", """WITH {EV}, f AS (SELECT row_id, user_id % 50 AS a, dst_port % 50 AS b, sec FROM ev WHERE k % 2 = 0), c AS (SELECT row_id AS uid, dst_port % 50 AS a, user_id % 50 AS b, sec AS t FROM ev WHERE k % 2 = 1)
 SELECT DISTINCT row_id, uid FROM f JOIN c ON ((f.a = c.a AND f.b = c.b) OR (f.a = c.b AND f.b = c.a)) AND abs(f.sec - c.t) <= 900""")
def j02_both_ways(spark: SparkSession, d: str) -> DataFrame:
    e = flows(spark, d)
    f = e.where("k % 2 = 0").select("row_id", (F.col("user_id") % 50).alias("a"), (F.col("dst_port") % 50).cast("long").alias("b"), "sec")
    c = e.where("k % 2 = 1").select(F.col("row_id").alias("uid"), (F.col("dst_port") % 50).cast("long").alias("a"), (F.col("user_id") % 50).alias("b"), F.col("sec").alias("t"))
    return joins.both_ways(f, c, "a", "b", "sec", "t", 900).select("row_id", "uid").distinct()


@query("j03_band", """WITH {CONN}, p AS (SELECT row_id, note, abs(sec - start_sec) AS dist FROM fl JOIN conn USING (host) WHERE abs(sec - start_sec) <= 864000) SELECT row_id, note FROM (SELECT row_id, note, row_number() OVER (PARTITION BY row_id ORDER BY dist, note) AS r FROM p) WHERE r = 1""")
def j03_band(spark: SparkSession, d: str) -> DataFrame:
    return joins.nearest_within(order_flows(spark, d), connections(spark, d), "row_id", ["host"], "sec", "start_sec", 864000, "note")


ASOF = """o AS (SELECT host, start_sec, max(uid) AS uid, max_by(len, uid) AS len FROM conn GROUP BY 1, 2), j AS (SELECT fl.row_id, fl.sec, o.start_sec, o.uid, o.len FROM fl ASOF LEFT JOIN o ON fl.host = o.host AND fl.sec + 2 >= o.start_sec)"""


@query("j04_j05_as_of", "WITH {CONN}, " + ASOF + " SELECT row_id, start_sec AS asof_start_sec, uid, coalesce(sec <= start_sec + len + 5, false) AS inside FROM j")
def j04_j05_as_of(spark: SparkSession, d: str) -> DataFrame:
    out = joins.as_of(order_flows(spark, d), connections(spark, d), ["host"], "sec", "start_sec", ["uid", "len"], 2)
    return out.select("row_id", "asof_start_sec", "uid", F.coalesce(F.col("sec") <= F.col("asof_start_sec") + F.col("len") + 5, F.lit(False)).alias("inside"))


@query("j07_j08_semi_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS big, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS silent FROM customer")
def j07_j08_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max((F.col("o_totalprice") > 300000)).alias("b"), F.lit(True).alias("seen"))
    return table(spark, d, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("b", F.lit(False)).alias("big"), F.col("seen").isNull().alias("silent"))


@query("j09_full_outer", "SELECT coalesce(a.k, b.k) AS nation, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k")
def j09_full_outer(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "outer").na.fill(0, ["customers", "suppliers"])


@query("j10_dimension", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j10_dimension(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")  # 25 nations


@query("j11_j12_s14_aligned", "WITH a AS (SELECT event_id, event_type FROM events WHERE event_id % 11 <> 0), b AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'x' ELSE event_type END AS t FROM events WHERE event_id % 7 <> 0) SELECT count(*) FILTER (a.event_id IS NULL) AS only_right, count(*) FILTER (b.event_id IS NULL) AS only_left, count(*) FILTER (event_type <> t) AS differ FROM a FULL JOIN b USING (event_id)")
def j11_j12_s14_aligned(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    a = e.where("event_id % 11 <> 0").select("event_id", F.col("event_type").alias("label"))
    b = e.where("event_id % 7 <> 0").select("event_id", F.when(F.col("event_id") % 13 == 0, "x").otherwise(F.col("event_type")).alias("label"))
    return audit.alignment(a, b, "event_id", "label")


KNN = "p AS (SELECT a.vec_id AS id, b.vec_id AS ref_id, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))) AS distance FROM embeddings a JOIN embeddings b ON {on}), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, ref_id) AS rank FROM p)"


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), (F.col("label") % 3).alias("role"), "label")


@query("m11_latent_knn", "WITH " + KNN.format(on="a.label % 3 = b.label % 3 AND b.label < 7") + " SELECT id, round(avg(distance), 4) AS score FROM k WHERE rank <= 5 GROUP BY id")
def m11_latent_knn(spark: SparkSession, d: str) -> DataFrame:
    e = _emb(spark, d)
    return joins.nearest_of_all(e, e.where("label < 7"), 5, "role").groupBy("id").agg(F.round(F.avg("distance"), 4).alias("score"))


@query("j13_j14_self_knn", "WITH " + KNN.format(on="a.vec_id <> b.vec_id") + " SELECT id, ref_id, round(distance, 4) AS distance, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 2")
def j13_j14_self_knn(spark: SparkSession, d: str) -> DataFrame:
    e = _emb(spark, d)
    return joins.nearest_of_all(e, e, 2, None, True).withColumn("distance", F.round("distance", 4))


@query("q11_near_duplicates", "WITH " + KNN.format(on="a.vec_id <> b.vec_id") + " SELECT round(avg(CASE WHEN distance < 0.1 THEN 1.0 ELSE 0.0 END), 6) AS near, round(median(distance), 4) AS median_distance FROM k WHERE rank = 1")
def q11_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    e = _emb(spark, d)
    return joins.nearest_of_all(e, e, 1, None, True).agg(F.round(F.avg((F.col("distance") < 0.1).cast("double")), 6).alias("near"), F.round(F.median("distance"), 4).alias("median_distance"))


@query("q21_purity", "WITH " + KNN.format(on="a.vec_id <> b.vec_id") + " SELECT a.label, round(avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END), 6) AS purity FROM k JOIN embeddings a ON a.vec_id = id JOIN embeddings b ON b.vec_id = ref_id WHERE rank <= 5 GROUP BY a.label")
def q21_purity(spark: SparkSession, d: str) -> DataFrame:
    e = _emb(spark, d)
    near = joins.nearest_of_all(e, e, 5, None, True)
    own, other = e.select("id", "label"), e.select(F.col("id").alias("ref_id"), F.col("label").alias("other"))
    return r6(near.join(own, "id").join(other, "ref_id").groupBy("label").agg(F.avg((F.col("label") == F.col("other")).cast("double")).alias("purity")))


@query("q21_ratio", "WITH x AS (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i, vec_id FROM embeddings), c AS (SELECT a.i AS i, b.i AS j, covar_pop(a.v, b.v) AS c FROM x a JOIN x b USING (vec_id) GROUP BY 1, 2) SELECT round(sum(CASE WHEN i = j THEN c ELSE 0 END) ** 2 / sum(c * c), 4) AS participation_ratio FROM c")
def q21_ratio(spark: SparkSession, d: str) -> DataFrame:
    return audit.participation_ratio(table(spark, d, "embeddings"), "embedding").select(F.round("participation_ratio", 4).alias("participation_ratio"))


# --- sets, windows, scalars -----------------------------------------------------------------------------------------


@query("x01_x04_sets", "SELECT (SELECT count(*) FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)) AS united, (SELECT count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)) AS common, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS without_orders, (SELECT count(*) - count(DISTINCT text) FROM documents) AS duplicates")
def x01_x04_sets(spark: SparkSession, d: str) -> DataFrame:
    docs, bench, cust, sup, orders = (table(spark, d, t) for t in ("documents", "benchmark", "customer", "supplier", "orders"))
    parts = [
        docs.select("text").unionByName(bench.select("text")).agg(F.count("*").alias("united")),
        cust.select("c_nationkey").intersect(sup.select("s_nationkey")).agg(F.count("*").alias("common")),
        cust.select("c_custkey").subtract(orders.select("o_custkey")).agg(F.count("*").alias("without_orders")),
        docs.agg((F.count("*") - F.count_distinct("text")).alias("duplicates")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


@query("x05_jaccard", "SELECT round(len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1), 6) AS jaccard, u FROM (SELECT user_id AS u, list(DISTINCT event_type) AS a FROM events WHERE event_id % 2 = 0 GROUP BY 1) JOIN (SELECT user_id AS u, list(DISTINCT event_type) AS b FROM events WHERE event_id % 2 = 1 GROUP BY 1) USING (u)")
def x05_jaccard(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("user_id", "u")
    a = e.where("event_id % 2 = 0").groupBy("u").agg(F.collect_set("event_type").alias("a"))
    b = e.where("event_id % 2 = 1").groupBy("u").agg(F.collect_set("event_type").alias("b"))
    return r6(a.join(b, "u").select(C.jaccard("a", "b").alias("jaccard"), "u"))


@query("w01_w06_windows", "WITH {EV} SELECT row_id, round(sum(score) OVER (PARTITION BY event_type ORDER BY sec, row_id ROWS UNBOUNDED PRECEDING), 4) AS running, CAST(rank() OVER (PARTITION BY event_type ORDER BY score) AS INTEGER) AS place, round(cume_dist() OVER (PARTITION BY event_type ORDER BY score), 6) AS share, round(sum(score) OVER (PARTITION BY user_id), 4) AS user_sum FROM ev")
def w01_w06_windows(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("event_type")
    return flows(spark, d).select("row_id", F.round(F.sum("score").over(by.orderBy("sec", "row_id").rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"), F.rank().over(by.orderBy("score")).alias("place"), F.round(F.cume_dist().over(by.orderBy("score")), 6).alias("share"), F.round(F.sum("score").over(Window.partitionBy("user_id")), 4).alias("user_sum"))


@query("w07_w10_bins", "WITH {EV} SELECT day, (sec % 86400) // 3600 AS hour, count(*) AS n, arg_min(row_id, (sec, row_id)) AS first_row, arg_max(row_id, (sec, row_id)) AS last_row FROM ev GROUP BY 1, 2")
def w07_w10_bins(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct("sec", "row_id")
    return flows(spark, d).groupBy("day", F.floor(F.pmod("sec", F.lit(86400)) / 3600).alias("hour")).agg(F.count("*").alias("n"), F.min_by("row_id", order).alias("first_row"), F.max_by("row_id", order).alias("last_row"))


@query("l01_l03_text", r"SELECT page_id, lower(url) LIKE 'https%' AS tls, length(url) AS n, split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS host, contains(lower(html), '<p') AS has_p, list_aggregate(regexp_extract_all(url, '[a-z]+')[1:3], 'string_agg', ',') AS parts FROM pages")
def l01_l03_text(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.lower(u).startswith("https").alias("tls"), F.length(u).cast("long").alias("n"), F.split(F.regexp_replace(u, "^[a-z]+://", ""), "/")[0].alias("host"), F.lower("html").contains("<p").alias("has_p"), F.array_join(F.slice(F.regexp_extract_all(u, F.lit("([a-z]+)"), 1), 1, 3), ",").alias("parts"))


@query("l04_l07_scalars", "WITH {EV} SELECT row_id, dayname(ts) AS dow, date_trunc('hour', ts) AS h, round(sign(score - 50) * ln(1 + abs(score - 50)), 6) AS slog, (k >> 1) & 1 AS bit, CASE WHEN k <= 2 THEN '1-2' WHEN k <= 5 THEN '3-5' WHEN k <= 10 THEN '6-10' WHEN k <= 100 THEN '11-100' ELSE '>100' END AS bin FROM ev")
def l04_l07_scalars(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d).withColumn("s", F.col("score") - 50)
    return f.select("row_id", F.date_format("ts", "EEEE").alias("dow"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h"), F.round(C.signed_log("s"), 6).alias("slog"), F.shiftright("k", 1).bitwiseAND(F.lit(1)).alias("bit"), C.size_bin("k").alias("bin"))


@query("l09_l10_arrays", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS norm2, round(list_sum(embedding[1:8]::DOUBLE[]), 4) AS head FROM embeddings")
def l09_l10_arrays(spark: SparkSession, d: str) -> DataFrame:
    head = F.aggregate(F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    return table(spark, d, "embeddings").select("vec_id", F.round(C.dot("embedding", "embedding"), 4).alias("norm2"), F.round(head, 4).alias("head"))


# --- audits ---------------------------------------------------------------------------------------------------------


@query("s19_diff", "WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS q, l_returnflag AS f FROM lineitem WHERE l_orderkey % 50 <> 0), b AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity + CASE WHEN l_orderkey % 17 = 0 THEN 0.5 ELSE 0 END AS q, CASE WHEN l_orderkey % 19 = 0 THEN NULL ELSE l_returnflag END AS f FROM lineitem WHERE l_orderkey % 60 <> 0), j AS (SELECT a.id AS ai, b.id AS bi, a.q AS aq, b.q AS bq, a.f AS af, b.f AS bf FROM a FULL JOIN b ON a.id = b.id)"
       " SELECT 'q' AS name, count(*) FILTER (ai IS NULL) AS extra, count(*) FILTER (bi IS NULL) AS missing, count(*) FILTER (ai IS NOT NULL AND bi IS NOT NULL AND (aq IS NULL) <> (bq IS NULL)) AS null_differs, count(*) FILTER (abs(aq - bq) > 1e-6) AS differs FROM j UNION ALL SELECT 'f', count(*) FILTER (ai IS NULL), count(*) FILTER (bi IS NULL), count(*) FILTER (ai IS NOT NULL AND bi IS NOT NULL AND (af IS NULL) <> (bf IS NULL)), count(*) FILTER (af <> bf) FROM j")
def s19_diff(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    a = li.where("l_orderkey % 50 <> 0").select("id", F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("f"))
    b = li.where("l_orderkey % 60 <> 0").select("id", (F.col("l_quantity") + F.when(F.col("l_orderkey") % 17 == 0, 0.5).otherwise(0.0)).alias("q"), F.when(F.col("l_orderkey") % 19 != 0, F.col("l_returnflag")).alias("f"))
    return audit.diff_tables(a, b, ["id"])


@query("q01_profile", "WITH {DIRTY} SELECT count(*) AS rows, count(*) FILTER (label = 'label') AS headers, count(*) FILTER (duration IS NULL) AS missing, count(*) FILTER (TRY_CAST(duration AS DOUBLE) < 0) AS negative, count(*) FILTER (TRY_CAST(port AS DOUBLE) > 65535) AS bad_ports, count(*) - count(DISTINCT (label, duration, port, proto, stamp)) AS duplicates, count(DISTINCT trim(label)) AS labels FROM dirty")
def q01_profile(spark: SparkSession, d: str) -> DataFrame:
    from flowlens.plans.views import dirty

    return audit.profile(dirty(spark, d), "label", "duration", "port", ["label", "duration", "port", "proto", "stamp"])


@query("q02_q03_quality", " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) FILTER ({c} IS NULL) AS missing, count(*) FILTER (isinf({c})) AS infinite, count(*) FILTER ({c} < 0) AS negative, round(avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) <= 1 AS is_constant FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def q02_q03_quality(spark: SparkSession, d: str) -> DataFrame:
    return r6(audit.quality(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]))


@query("q04_q07_conflicts", "WITH j AS (SELECT text, quality FROM documents JOIN labels USING (doc_id)), g AS (SELECT text, count(*) AS n FROM j GROUP BY text HAVING count(DISTINCT quality) > 1) SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM g")
def q04_q07_conflicts(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return audit.conflicts(j, ["text"], "quality")


@query("q06_label_windows", "WITH {EV}, b AS (SELECT day, min(sec) AS lo, max(sec) AS hi FROM ev WHERE y = 1 GROUP BY day) SELECT day, count(*) FILTER (y = 0 AND sec BETWEEN lo AND hi) AS inside, count(*) FILTER (y = 0 AND NOT sec BETWEEN lo AND hi) AS outside, round(avg(CASE WHEN y = 0 AND sec BETWEEN lo AND hi THEN CASE WHEN dst_port >= 49152 THEN 1.0 ELSE 0.0 END END), 6) AS ephemeral FROM ev JOIN b USING (day) GROUP BY day")
def q06_label_windows(spark: SparkSession, d: str) -> DataFrame:
    return r6(audit.label_windows(flows(spark, d), "day", "sec", "y", "dst_port"))


@query("q08_splits", "WITH {EV}, x AS (SELECT CASE WHEN day < (SELECT min(day) + 20 FROM ev) THEN 'train' ELSE 'test' END AS split, * FROM ev) SELECT split, day, count(*) AS rows, CAST(sum(y) AS BIGINT) AS attacks, min(sec) AS first, max(sec) AS last, min(sec) > (SELECT max(sec) FROM x WHERE split = 'train') AS after_train FROM x GROUP BY 1, 2")
def q08_splits(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d)
    first = f.agg(F.date_add(F.min("day"), 20).alias("_d"))
    return audit.split_integrity(f.crossJoin(F.broadcast(first)).withColumn("split", F.when(F.col("day") < F.col("_d"), "train").otherwise("test")), "split", "day", "sec", "y")


@query("q10_q14_overlap", "WITH {EV}, x AS (SELECT user_id, event_type, day < (SELECT min(day) + 15 FROM ev) AS tr FROM ev), t AS (SELECT DISTINCT user_id FROM x WHERE tr) SELECT event_type, count(*) AS n, round(avg(CASE WHEN t.user_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS seen FROM x LEFT JOIN t USING (user_id) WHERE NOT tr GROUP BY 1")
def q10_q14_overlap(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d)
    first = f.agg(F.date_add(F.min("day"), 15).alias("_d"))
    x = f.crossJoin(F.broadcast(first)).withColumn("tr", F.col("day") < F.col("_d"))
    return r6(audit.seen_before(x.where("NOT tr"), x.where("tr"), ["user_id"], "event_type"))


@query("q13_shortcuts", "WITH {EV}, e AS (SELECT y, avg(y) OVER (PARTITION BY user_id) AS s FROM ev), " + AUC.format(g="", pb="", src="SELECT s, y AS p, 1 - y AS q FROM e") + ", r AS (SELECT sum(p * below) / (sum(p) * sum(q)) AS a FROM b) SELECT round(greatest(a, 1 - a), 6) AS folded_auc FROM r")
def q13_shortcuts(spark: SparkSession, d: str) -> DataFrame:
    return r6(audit.identifier_auc(flows(spark, d), "user_id", "y"))


Q15 = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS s, y FROM li" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


@query("q15_single_features", "WITH li AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem), " + AUC.format(g="feature,", pb="PARTITION BY feature", src="SELECT feature, s, y AS p, 1 - y AS q FROM (" + Q15 + ")") + ", r AS (SELECT feature, sum(p * below) / (sum(p) * sum(q)) AS a FROM b GROUP BY 1) SELECT feature, round(greatest(a, 1 - a), 6) AS folded_auc FROM r ORDER BY 2 DESC, 1 LIMIT 2")
def q15_single_features(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return r6(audit.single_feature_auc(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "y")).orderBy(F.desc("folded_auc"), "feature").limit(2)


@query("q17_build_audit", """WITH {EV}, {SCHED}, p AS (SELECT e.row_id, e.sec, e.dst_port, r.rule FROM ev e JOIN rules r ON e.user_id BETWEEN a_lo AND a_hi AND sec >= "start" AND sec < "end") SELECT rule, count(*) AS n, min(sec) AS first, max(sec) AS last, count(DISTINCT dst_port) AS ports FROM p GROUP BY rule""")
def q17_build_audit(spark: SparkSession, d: str) -> DataFrame:
    r = F.broadcast(schedule(spark, d))  # 25 rules
    p = flows(spark, d).join(r, F.col("user_id").between(F.col("a_lo"), F.col("a_hi")) & (F.col("sec") >= F.col("start")) & (F.col("sec") < F.col("end")))
    return p.groupBy("rule").agg(F.count("*").alias("n"), F.min("sec").alias("first"), F.max("sec").alias("last"), F.count_distinct("dst_port").alias("ports"))


@query("q18_errors", "WITH {EV}, x AS (SELECT 'role' AS factor, CAST(role AS VARCHAR) AS level, y, score FROM ev UNION ALL SELECT 'proto', CAST(proto AS VARCHAR), y, score FROM ev UNION ALL SELECT 'day', CAST(day AS VARCHAR), y, score FROM ev) SELECT factor, level, count(*) FILTER (y = 1 AND score <= 80) AS misses, count(*) FILTER (y = 0 AND score > 80) AS false_alarms, count(*) FILTER (y = 1) AS attacks FROM x GROUP BY 1, 2")
def q18_errors(spark: SparkSession, d: str) -> DataFrame:
    return audit.errors_by_factor(flows(spark, d), ["role", "proto", "day"], "y", F.col("score") > 80)


@query("q19_complementarity", "WITH {EV}, f AS (SELECT CASE WHEN score > 80 THEN 1 ELSE 0 END AS a, CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS b, CASE WHEN role = 0 THEN 1 ELSE 0 END AS c FROM ev WHERE y = 1) SELECT round(avg(CASE WHEN a + b + c > 0 THEN 1.0 ELSE 0.0 END), 6) AS any_one, round(avg(CASE WHEN a + b + c = 3 THEN 1.0 ELSE 0.0 END), 6) AS all_of_them, round(avg(CASE WHEN a + b + c = 0 THEN 1.0 ELSE 0.0 END), 6) AS none, round(avg(CASE WHEN a = 1 AND a + b + c = 1 THEN 1.0 ELSE 0.0 END), 6) AS only_a FROM f")
def q19_complementarity(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d).where("y = 1").select((F.col("score") > 80).cast("int").alias("a"), (F.col("k") % 10 == 0).cast("int").alias("b"), (F.col("role") == 0).cast("int").alias("c"))
    n = F.col("a") + F.col("b") + F.col("c")
    return r6(f.agg(F.avg((n > 0).cast("double")).alias("any_one"), F.avg((n == 3).cast("double")).alias("all_of_them"), F.avg((n == 0).cast("double")).alias("none"), F.avg(((F.col("a") == 1) & (n == 1)).cast("double")).alias("only_a")))


@query("q20_seed_flips", "WITH {SCORES}, t AS (SELECT seed, quantile_cont(score, 0.9) AS t FROM sc WHERE method = 'e2' GROUP BY seed), f AS (SELECT row_id, max(CASE WHEN score > t THEN 1 ELSE 0 END) <> min(CASE WHEN score > t THEN 1 ELSE 0 END) AS flips FROM sc JOIN t USING (seed) WHERE method = 'e2' GROUP BY row_id) SELECT count(*) FILTER (flips) AS flips, count(*) AS n FROM f")
def q20_seed_flips(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d).where("method = 'e2'")
    hit = s.join(F.broadcast(scoring.threshold(s, "score", 0.1, ["seed"])), "seed").withColumn("hit", (F.col("score") > F.col("threshold")).cast("int"))
    return hit.groupBy("row_id").agg((F.max("hit") != F.min("hit")).alias("f")).agg(F.count_if("f").alias("flips"), F.count("*").alias("n"))


@query("e21_class_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1, 2")
def e21_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("z01_drift", "WITH {EV}, w AS (SELECT row_id, count(*) OVER o AS n, avg(CASE WHEN score > 80 THEN 1.0 ELSE 0.0 END) OVER o AS rate FROM ev WINDOW o AS (ORDER BY row_id ROWS BETWEEN 1999 PRECEDING AND CURRENT ROW)) SELECT row_id, CASE WHEN n < 1000 THEN 'insufficient' WHEN rate > 3 * 0.05 THEN 'drifting' ELSE 'ok' END AS state, round(rate / 0.05, 6) AS ratio FROM w")
def z01_drift(spark: SparkSession, d: str) -> DataFrame:
    return r6(audit.drift(flows(spark, d), "row_id", F.col("score") > 80, 0.05, 2000, 1000))


@query("z06_tumbling", "WITH {EV} SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS n FROM ev WHERE score > 80 GROUP BY 1, 2")
def z06_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).where("score > 80").groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("w"), "n")


@query("z07_sessions", "WITH {EV}, a AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM ev WHERE y = 1), g AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT event_type, min(ts) AS first, count(*) AS n FROM g GROUP BY event_type, s")
def z07_sessions(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).where("y = 1").groupBy("event_type", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts").alias("first"), F.count("*").alias("n")).select("event_type", "first", "n")


FLAG = """WITH {EV}, {CUT}, x AS (SELECT ev.*, cutoff, count(*) OVER (PARTITION BY day, event_type ORDER BY sec RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS load FROM ev JOIN c USING (day)), v AS (SELECT * FROM x WHERE y = 0 AND sec >= cutoff),
 m AS (SELECT median(load) AS med FROM v), s AS (SELECT med, 1.4826 * median(abs(load - med)) + 1e-6 AS sc FROM v, m GROUP BY med), q AS (SELECT quantile_cont((load - med) / sc, 0.95) AS t FROM v, s)
 SELECT user_id, sec // 3600 AS bin, count(*) AS n_flagged, max(y) AS is_true FROM x, s, q WHERE (load - med) / sc > t GROUP BY 1, 2"""


@query("flagship_alerts", FLAG.replace("{CUT}", "r AS (SELECT day, sec, row_number() OVER (PARTITION BY day ORDER BY sec, row_id) - 1 AS p, count(*) OVER (PARTITION BY day) AS n FROM ev WHERE y = 0), c AS (SELECT day, sec AS cutoff FROM r WHERE p = CAST(floor(n * 0.8) AS BIGINT))"))
def flagship_alerts(spark: SparkSession, d: str) -> DataFrame:
    f = features.trailing_count(flows(spark, d), ["day", "event_type"], "sec", {"load": 3600}).withColumn("benign", F.col("y") == 0)
    f = written(split.time_split(f, "day", "sec", "row_id", 0.2, "benign").select("user_id", "sec", "load", "split", "y"), "flagship")
    limit = scoring.robust_threshold(f.where("split = 'val'"), "load", 0.05)
    scored = f.crossJoin(F.broadcast(limit)).withColumn("z", (F.col("load") - F.col("med")) / F.col("scale"))  # one row
    return metrics.alert_groups(scored, "user_id", "sec", 3600, F.col("z") > F.col("threshold"), "y")
