"""Detectors, explanations, event assembly and bootstrap over the views."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import detectors, events, explain, features, joins, metrics, resample, split
from flowlens.plans.views import flows, query, r6, table

MODALITIES = {"volume": ["l_quantity", "l_extendedprice"], "rate": ["l_discount", "l_tax"]}
SLICES = {"volume": (0, 2), "rate": (2, 4)}


def vectors(spark: SparkSession, d: str, **more: Column) -> DataFrame:
    """Line items in the feature space. more: further columns, computed on the item's own row, as row_id may repeat."""
    li = table(spark, d, "lineitem").withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumn("y", (F.col("l_returnflag") == "R").cast("int")).withColumn("role", (F.col("l_suppkey") % 9).cast("int"))
    space = features.fit_space(li, MODALITIES).orderBy("pos").collect()  # a row for each feature
    return features.apply_space(li, space).select("row_id", "x", "y", "role", *[c.alias(n) for n, c in more.items()])


@query("m07_isolation_forest")
def m07_isolation_forest(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return detectors.score_isolation_forest(v, detectors.fit_isolation_forest(v.where("y = 0"), "row_id", 25)).select("row_id", F.round("score", 6).alias("score"))


@query("m08_pca")
def m08_pca(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    mean, parts = detectors.fit_pca(v.where("y = 0"), 4, 0.8)
    return detectors.score_pca(v, mean, parts).select("row_id", F.round("score", 6).alias("score"))


@query("m09_random_forest")
def m09_random_forest(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return detectors.score_random_forest(v, detectors.fit_random_forest(v, "y", 5, 5)).select("row_id", F.round("score", 6).alias("score"))


@query("m01_m06_encoder")
def m01_m06_encoder(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    w, _ = detectors.train_encoder(v.where("y = 0"), SLICES, "row_id")
    return detectors.encode(v, w, SLICES).select("row_id", F.round("rec", 6).alias("rec"), F.round("xmod", 6).alias("xmod"))


@query(
    "m12_m19_references",
    """WITH e AS (SELECT vec_id AS row_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, label % 3 AS role, label FROM embeddings),
    b AS (SELECT role, list_transform(x, lambda v: round(v, 5)) AS x, min(row_id) AS id FROM e WHERE label < 7 GROUP BY 1, 2),
    h AS (SELECT *, CAST('0x' || substr(md5(CAST(id AS VARCHAR) || '|0'), 1, 15) AS BIGINT) AS h, count(*) OVER (PARTITION BY role) AS n FROM b),
    refs AS (SELECT id, x, CAST(-1 AS BIGINT) AS role FROM (SELECT * FROM h ORDER BY h, id LIMIT 200) UNION ALL SELECT id, x, role FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY h, id) AS r FROM h WHERE n >= 50) WHERE r <= 100),
    a AS (SELECT row_id, x, CASE WHEN role IN (SELECT role FROM refs) THEN role ELSE -1 END AS role FROM e),
    d AS (SELECT row_id, list_distance(a.x, refs.x) AS d, row_number() OVER (PARTITION BY row_id ORDER BY list_distance(a.x, refs.x), id) AS p FROM a JOIN refs USING (role))
    SELECT row_id, round(avg(d), 6) AS score FROM d WHERE p <= 5 GROUP BY row_id""",
)
def m12_m19_references(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("x"), (F.col("label") % 3).alias("role"), "label")
    refs = detectors.fit_references(e.where("label < 7"), "role", "row_id", 200, 100, 50, digits=5)
    return detectors.latent_distance(e, refs, "role", "row_id").withColumn("score", F.round("score", 6))


@query("m29_synthetic")
def m29_synthetic(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select("row_id", "x")
    made = detectors.synthetic_anomalies(v, SLICES, "rate", "row_id")
    size = F.aggregate("x", F.lit(0.0), lambda s, a: s + a * a)
    both = v.withColumn("kind", F.lit("benign")).unionByName(made).withColumn("s", size)
    out = [metrics.roc_auc(both.where(F.col("kind").isin("benign", k)).withColumn("y", (F.col("kind") == k).cast("int")), "y", "s").withColumn("kind", F.lit(k)) for k in ("swap", "extreme")]
    return r6(out[0].unionByName(out[1]))


PRODUCT = """WITH a AS (SELECT vec_id AS id, embedding AS x FROM embeddings), b AS (SELECT embedding AS b FROM embeddings ORDER BY CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR) || '|0'), 1, 15) AS BIGINT), vec_id LIMIT 20),
 s AS (SELECT id, list_sum(x[1:32]::DOUBLE[]) AS p, list_sum(x[33:64]::DOUBLE[]) AS q, list_sum(b[1:32]::DOUBLE[]) AS u, list_sum(b[33:64]::DOUBLE[]) AS v FROM a, b),
 m AS (SELECT id, avg(u * v) AS m0, avg(p * v) AS m1, avg(u * q) AS m2, avg(p * q) AS m3 FROM s GROUP BY id)
 SELECT id, 'first' AS modality, round(((m1 - m0) + (m3 - m2)) / 2, 4) AS value FROM m UNION ALL SELECT id, 'second', round(((m2 - m0) + (m3 - m1)) / 2, 4) FROM m"""


@query("a03_group_shapley", PRODUCT)
def a03_group_shapley(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    product = lambda m: m[:, :32].sum(1) * m[:, 32:].sum(1)
    out = explain.group_shapley(e, split.cap(e, 20, "id"), product, {"first": (0, 32), "second": (32, 64)})
    return out.withColumn("value", F.round("value", 4))


#: Rows of a background, chosen by a hash of the id.
BACKGROUND = 500


def alerts_and_background(v: DataFrame, score: explain.Score, limit: float) -> tuple[DataFrame, DataFrame]:
    """All rows whose score is over the limit, and the background sample."""
    v = v.select(F.col("row_id").alias("id"), "x")
    return explain.scored(v, score).where(F.col("score") > limit).select("id", "x"), split.cap(v, BACKGROUND, "id")


@query("a02_shapley")
def a02_shapley(spark: SparkSession, d: str) -> DataFrame:
    score = lambda m: np.abs(m).sum(1)
    return r6(explain.permutation_shapley(*alerts_and_background(vectors(spark, d), score, 6.0), score, 4, 10))


@query("a04_surrogate")
def a04_surrogate(spark: SparkSession, d: str) -> DataFrame:
    score = lambda m: m.sum(1)
    return r6(explain.local_surrogate(*alerts_and_background(vectors(spark, d), score, 3.5), score, 4, 60))


EVENTS_SQL = """WITH l AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM events)
 SELECT user_id AS flow_id, f AS flow_seq, count(*) FILTER (event_type = 'view') AS n_http, count(*) FILTER (event_type = 'click') AS n_dns, count(*) FILTER (event_type = 'error' AND event_id % 4 <> 0) > 0 AS alerted, count(*) FILTER (event_type = 'error' AND event_id % 4 = 0) AS n_engine_alerts FROM l WHERE f IS NOT NULL GROUP BY 1, 2"""


def event_lines(spark: SparkSession, d: str) -> DataFrame:
    """The driver's events as sensor records: a purchase ends a flow, views are HTTP, clicks DNS, errors alerts."""
    kind = F.col("event_type")
    name = F.when(kind == "purchase", "flow").when(kind == "view", "http").when(kind == "click", "dns").when(kind == "error", "alert").otherwise("anomaly")
    parts = {
        "event_type": name, "flow_id": F.col("user_id"), "proto": F.lit("TCP"), "src_ip": F.lit("10.0.0.1"), "dest_ip": F.lit("10.0.0.2"),
        "flow": F.when(name == "flow", F.struct(F.lit(3).alias("pkts_toserver"), F.col("value").alias("bytes_toserver"))), "http": F.when(name == "http", F.struct(F.lit("GET").alias("http_method"))),
        "dns": F.when(name == "dns", F.struct(F.lit(3).alias("version"), F.lit("request").alias("type"))), "alert": F.when(name == "alert", F.struct(F.when(F.col("event_id") % 4 == 0, 2200001).otherwise(2000001).alias("signature_id"))),
    }
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()])).alias("value"))


@query("s04_e04_e05_assembly", EVENTS_SQL)
def s04_e04_e05_assembly(spark: SparkSession, d: str) -> DataFrame:
    out = events.assemble(events.parse_events(event_lines(spark, d)))
    return out.select("flow_id", "flow_seq", F.col("n_http").cast("long").alias("n_http"), F.col("n_dns").cast("long").alias("n_dns"), "alerted", "n_engine_alerts")


@query("e06_counts", "SELECT CASE event_type WHEN 'purchase' THEN 'flow' WHEN 'view' THEN 'http' WHEN 'click' THEN 'dns' WHEN 'error' THEN 'alert' ELSE 'anomaly' END AS event_type, count(*) AS n FROM events GROUP BY 1")
def e06_counts(spark: SparkSession, d: str) -> DataFrame:
    return events.event_counts(events.parse_events(event_lines(spark, d)))


@query("e07_orphans", "WITH l AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS f FROM events) SELECT count(DISTINCT CASE WHEN event_type <> 'error' THEN user_id END) AS flows, count(DISTINCT CASE WHEN event_type = 'error' AND event_id % 4 <> 0 THEN user_id END) AS alert_flows FROM l WHERE event_type <> 'purchase' AND (f IS NULL OR event_id > f)")
def e07_orphans(spark: SparkSession, d: str) -> DataFrame:
    return events.orphans(events.parse_events(event_lines(spark, d)))


#: A row's Poisson weight in a resample, from a hash.
DRAWN = """d AS (SELECT *, (CASE WHEN u > 0.36787944117 THEN 1 ELSE 0 END) + (CASE WHEN u > 0.73575888234 THEN 1 ELSE 0 END) + (CASE WHEN u > 0.91969860293 THEN 1 ELSE 0 END) + (CASE WHEN u > 0.98101184312 THEN 1 ELSE 0 END) + (CASE WHEN u > 0.99634015317 THEN 1 ELSE 0 END) + (CASE WHEN u > 0.99940581518 THEN 1 ELSE 0 END) + (CASE WHEN u > 0.99991675884 THEN 1 ELSE 0 END) AS w FROM (SELECT *, (CAST('0x' || substr(md5(CAST(row_id AS VARCHAR) || '|' || CAST(resample AS VARCHAR) || '|0'), 1, 15) AS BIGINT) + 0.5::DOUBLE) / 1152921504606846976::DOUBLE AS u FROM %s, range(1, 51) r(resample)))"""
INTERVAL = "round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(v) AS defined, count(*) AS resamples"


@query(
    "b01_b04_bootstrap",
    """WITH {EV}, f AS (SELECT day, CAST(floor(sec / 600.0) AS BIGINT) AS b, y, (rank() OVER (ORDER BY score) - 1) * 20000 // count(*) OVER () AS s FROM ev),
    k AS (SELECT day, b, row_number() OVER (PARTITION BY day ORDER BY b) - 1 AS p, count(*) OVER (PARTITION BY day) AS n FROM (SELECT DISTINCT day, b FROM f)),
    h AS (SELECT day, resample, CAST('0x' || substr(md5(CAST(day AS VARCHAR) || '|' || CAST(p AS VARCHAR) || '|' || CAST(resample AS VARCHAR) || '|0'), 1, 15) AS BIGINT) % n AS p FROM k, range(1, 201) r(resample)),
    w AS (SELECT day, b, resample, count(*) AS weight FROM h JOIN k USING (day, p) GROUP BY ALL),
    g AS (SELECT resample, s, sum(CASE WHEN y = 1 THEN weight ELSE 0 END) AS p, sum(CASE WHEN y = 1 THEN 0 ELSE weight END) AS q FROM f JOIN w USING (day, b) GROUP BY 1, 2),
    c AS (SELECT *, sum(q) OVER (PARTITION BY resample ORDER BY s) AS below FROM g), m AS (SELECT sum(p * (below - q * 0.5)) / nullif(sum(p) * sum(q), 0) AS v FROM c GROUP BY resample) SELECT """ + INTERVAL + " FROM m",
)
def b01_b04_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the ROC area over 200 resamples of blocks of 600 s, with 20,000 score bins."""
    return r6(resample.interval(resample.bootstrap_auc(flows(spark, d), "day", "sec", "y", "score"), "roc_auc", []))


@query("b06_b07_row_bootstrap", "WITH {EV}, " + DRAWN % "(SELECT * FROM ev WHERE y = 1)" + ", m AS (SELECT resample, CASE WHEN count(*) >= 3 THEN sum(score * w) / sum(w) END AS v FROM d GROUP BY resample) SELECT " + INTERVAL + " FROM m")
def b06_b07_row_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return r6(resample.interval(resample.row_bootstrap_mean(flows(spark, d).where("y = 1"), "score", "row_id", 50), "mean", []))


@query(
    "b06_row_auc",
    "WITH {EV}, " + DRAWN % "(SELECT row_id, y, (rank() OVER (ORDER BY score) - 1) * 20000 // count(*) OVER () AS score FROM ev)" + """, s AS (SELECT resample, score, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS p, sum(CASE WHEN y = 1 THEN 0 ELSE w END) AS q FROM d GROUP BY 1, 2),
    b AS (SELECT *, sum(q) OVER (PARTITION BY resample ORDER BY score) AS below FROM s), m AS (SELECT sum(p * (below - q * 0.5)) / nullif(sum(p) * sum(q), 0) AS v FROM b GROUP BY resample) SELECT """ + INTERVAL + " FROM m",
)
def b06_row_auc(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the ROC area under resampling of rows."""
    return r6(resample.interval(resample.row_bootstrap_auc(flows(spark, d), "y", "score", "row_id", 50), "roc_auc", []))


@query(
    "b04_paired",
    """WITH f AS (SELECT l_linenumber AS day, CAST(floor(l_orderkey / 600.0) AS BIGINT) AS b, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, method, CASE method WHEN 'price' THEN round(l_extendedprice / 1000) ELSE l_quantity END AS score FROM lineitem, (VALUES ('price'), ('quantity')) m(method)),
    k AS (SELECT day, b, row_number() OVER (PARTITION BY day ORDER BY b) - 1 AS p, count(*) OVER (PARTITION BY day) AS n FROM (SELECT DISTINCT day, b FROM f)),
    h AS (SELECT day, resample, CAST('0x' || substr(md5(CAST(day AS VARCHAR) || '|' || CAST(p AS VARCHAR) || '|' || CAST(resample AS VARCHAR) || '|0'), 1, 15) AS BIGINT) % n AS p FROM k, range(1, 41) r(resample)),
    w AS (SELECT day, b, resample, count(*) AS weight FROM h JOIN k USING (day, p) GROUP BY ALL),
    s AS (SELECT method, resample, score, sum(CASE WHEN y = 1 THEN weight ELSE 0 END) AS p, sum(CASE WHEN y = 1 THEN 0 ELSE weight END) AS q FROM f JOIN w USING (day, b) GROUP BY 1, 2, 3),
    c AS (SELECT *, sum(q) OVER (PARTITION BY method, resample ORDER BY score) AS below FROM s),
    a AS (SELECT method, resample, sum(p * (below - q * 0.5)) / nullif(sum(p) * sum(q), 0) AS auc FROM c GROUP BY 1, 2),
    m AS (SELECT a.method, r.auc - a.auc AS v FROM a JOIN a r USING (resample) WHERE a.method <> 'price' AND r.method = 'price') SELECT method, """ + INTERVAL + " FROM m GROUP BY method",
)
def b04_paired(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the difference of two methods' areas over shared resamples of time blocks."""
    methods = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), c.alias("score")) for m, c in (("price", F.round(F.col("l_extendedprice") / 1000)), ("quantity", F.col("l_quantity")))]))
    f = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("day"), F.col("l_orderkey").alias("sec"), (F.col("l_returnflag") == "R").cast("int").alias("y"), methods.alias("m")).select("day", "sec", "y", "m.method", "m.score")
    return r6(resample.paired_difference(resample.bootstrap_auc(f, "day", "sec", "y", "score", "method", 600, 40), "method", "price", "roc_auc"))


@query(
    "e03_e09_event_text",
    """SELECT event_id AS seq, event_type = 'purchase' AS is_flow, CASE event_type WHEN 'purchase' THEN 'event_type: flow, proto: TCP, flow_pkts_toserver: 3, flow_bytes_toserver: ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
     WHEN 'view' THEN 'event_type: http, http_hostname: h,x, http_http_method: GET' WHEN 'click' THEN 'event_type: dns, dns_type: query, dns_id: ' || CAST(event_id AS VARCHAR) || ', dns_rrname: a ;b, dns_rrtype: ' ELSE 'event_type: anomaly' END AS text,
     CASE event_type WHEN 'purchase' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS bytes FROM events WHERE event_type <> 'error'""",
)
def e03_e09_event_text(spark: SparkSession, d: str) -> DataFrame:
    """Events as text, with separators taken out of values and the detector's decision left out; the text parses back."""
    kind, n = F.col("event_type"), F.floor("value").cast("long").cast("string")
    line = F.when(kind == "purchase", F.concat(F.lit('{"event_type":"flow","flow_id":1,"proto":"TCP","flow":{"pkts_toserver":3,"bytes_toserver":'), n, F.lit(',"start":"t","end":"t","alerted":true}}')))
    line = line.when(kind == "view", '{"event_type":"http","flow_id":1,"http":{"hostname":"h, x","http_method":"GET"}}').when(kind == "error", '{"event_type":"alert","flow_id":1,"alert":{"signature_id":1}}')
    line = line.when(kind == "click", F.concat(F.lit('{"event_type":"dns","flow_id":1,"dns":{"version":3,"type":"request","id":'), F.col("event_id").cast("string"), F.lit(',"queries":[{"rrname":"a ; b"}]}}'))).otherwise('{"event_type":"anomaly","flow_id":1}')
    text = events.event_text(table(spark, d, "events").select(F.col("event_id").alias("seq"), line.alias("value")))
    back = events.parse_log(text.withColumn("log", F.col("text")))
    return back.select("seq", (F.col("event_type") == "flow").alias("is_flow"), "text", F.try_element_at(F.col("events")[0], F.lit("flow_bytes_toserver")).alias("bytes"))


@query("e08_flow_ids", "SELECT event_id AS seq, '10.0.' || CAST(user_id % 7 AS VARCHAR) || '.1-' || CASE WHEN event_id % 3 = 0 THEN '0' ELSE CAST(user_id AS VARCHAR) END || '-10.0.0.2-' || CAST(event_id % 5 AS VARCHAR) || '-' || CASE event_id % 4 WHEN 0 THEN '6' WHEN 1 THEN '17' WHEN 2 THEN '1' ELSE 'GRE' END AS flow_key FROM events")
def e08_flow_ids(spark: SparkSession, d: str) -> DataFrame:
    """Flow ids from endpoints, missing ports and protocol names of either case."""
    i, u = F.col("event_id"), F.col("user_id")
    proto = F.when(i % 4 == 0, "tcp").when(i % 4 == 1, "UDP").when(i % 4 == 2, "Icmp").otherwise("GRE")
    e = table(spark, d, "events").select(i.alias("seq"), F.concat(F.lit("10.0."), (u % 7).cast("string"), F.lit(".1")).alias("src_ip"), F.when(i % 3 != 0, u.cast("int")).alias("src_port"), F.lit("10.0.0.2").alias("dest_ip"), (i % 5).cast("int").alias("dest_port"), proto.alias("proto"))
    return e.select("seq", events.flow_id_text().alias("flow_key"))


@query(
    "j06_e18_networks",
    """WITH r AS (SELECT n_nationkey AS rule, (10::BIGINT * 256 * 256 * 256) + (n_nationkey % 4) * 65536 + (n_nationkey * 16) % 256 * 256 AS a_lo, 4095 AS a_size, n_nationkey % 2 = 0 AS everything FROM nation),
    x AS (SELECT rule, a_lo - a_lo % 4096 AS lo, a_lo - a_lo % 4096 + a_size AS hi, everything FROM r UNION ALL SELECT rule, 167772161 + rule, 167772161 + rule, everything FROM r),
    e AS (SELECT event_id AS row_id, (10::BIGINT * 256 * 256 * 256) + (user_id % 4) * 65536 + user_id % 50 * 256 + event_id % 250 AS ip FROM events)
    SELECT row_id, min(rule) AS rule, count(*) AS hits FROM e JOIN x ON ip BETWEEN lo AND hi GROUP BY row_id""",
)
def j06_e18_networks(spark: SparkSession, d: str) -> DataFrame:
    """Addresses against rules with lists of networks; bad entries and other versions are skipped."""
    k, s = F.col("n_nationkey"), lambda c: c.cast("string")
    nets = F.concat(F.lit("10."), s(k % 4), F.lit("."), s(k * 16 % 256), F.lit(".7/20; nonsense ;2001:db8::/32;10.0.0.300;10.0.0.0/40; 10.0.0."), s(k + 1))
    rules = joins.networks(table(spark, d, "nation").select(k.alias("rule"), nets.alias("nets")), "nets", "lo", "hi")
    i, u = F.col("event_id"), F.col("user_id")
    e = table(spark, d, "events").select(i.alias("row_id"), joins.ipv4(F.concat(F.lit("10."), s(u % 4), F.lit("."), s(u % 50), F.lit("."), s(i % 250))).alias("ip"))
    hit = e.join(F.broadcast(rules), F.col("ip").between(F.col("lo"), F.col("hi")))  # a schedule: some rows
    return hit.groupBy("row_id").agg(F.min("rule").alias("rule"), F.count("*").alias("hits"))


@query(
    "e19_local_windows",
    """WITH r AS (SELECT n_nationkey AS rule, epoch(CAST((SELECT min(ts) FROM events) AS DATE) + CAST(n_nationkey AS INTEGER)) + (n_nationkey % 20) * 3600 + 5 * 60 + 3 * 3600 AS a, epoch(CAST((SELECT min(ts) FROM events) AS DATE) + CAST(n_nationkey AS INTEGER)) + (n_nationkey % 20 + 3) * 3600 + 59 * 60 + 3 * 3600 AS b FROM nation)
    SELECT rule, CAST(a AS BIGINT) AS "start", CAST(b AS BIGINT) AS "end", count(event_id) AS n FROM r LEFT JOIN events ON floor(epoch(ts)) >= a AND floor(epoch(ts)) < b + 60 GROUP BY 1, 2, 3""",
)
def e19_local_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows on a local clock three hours behind UTC, with their end minute, and the events in them."""
    k = F.col("n_nationkey")
    clock = lambda h, m: F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(f":{m:02d}"))
    first = table(spark, d, "events").agg(F.min(F.to_date("ts")).alias("day"))
    rules = table(spark, d, "nation").crossJoin(F.broadcast(first)).select(k.alias("rule"), F.date_add("day", k.cast("int")).alias("day"), clock(k % 20, 5).alias("start"), clock(k % 20 + 3, 59).alias("end"))  # one row
    rules = rules.withColumns(joins.local_window(F.col("day"), "start", "end", "-03:00"))
    e = flows(spark, d).select("row_id", "sec")
    n = e.join(F.broadcast(rules), (F.col("sec") >= F.col("start")) & (F.col("sec") < F.col("end") + 60)).groupBy("rule").agg(F.count("*").alias("n"))
    return rules.join(n, "rule", "left").select("rule", "start", "end", F.coalesce("n", F.lit(0)).alias("n"))
