"""Labels, ids, event texts, evidence and runs of methods over the views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.functions import columns as C
from flowlens.operators import audit, batch, clean, detectors, events, explain, features, joins, metrics, split
from flowlens.operators.quantiles import quantiles
from flowlens.plans.model_queries import MODALITIES, SLICES, event_lines, vectors
from flowlens.plans.views import connections, flows, order_flows, query, r6, schedule, table
from flowlens.sources import io
from flowlens.sources.scratch import dealt
from flowlens.streaming import stream


@query("s03_scan", "SELECT event_id, value FROM events WHERE event_type = 'error'")
def s03_scan(spark: SparkSession, d: str) -> DataFrame:
    return io.read_flow_parquet(spark, f"{d}/events.parquet").where("event_type = 'error'").select("event_id", "value")


@query("c08_labels", "SELECT event_id, CASE WHEN l IN ('BENIGN', 'Normal') THEN 'Benign' ELSE l END AS label FROM (SELECT event_id, trim(CASE event_type WHEN 'view' THEN ' BENIGN ' WHEN 'click' THEN 'Normal' ELSE event_type || ' ' END) AS l FROM events)")
def c08_labels(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_type") == "view", " BENIGN ").when(F.col("event_type") == "click", "Normal").otherwise(F.concat("event_type", F.lit(" ")))
    return table(spark, d, "events").select("event_id", clean.trim_label(raw).alias("label"))


@query("c21_flow_parts", "WITH {EV} SELECT row_id, 'fe80-' || user_id AS src, CAST(k AS VARCHAR) AS sport, '10.0.0.1' AS dst, CAST(dst_port AS VARCHAR) AS dport, CAST(proto AS VARCHAR) AS proto FROM ev WHERE k >= 0")
def c21_flow_parts(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d).where("k >= 0").withColumn("id", F.concat_ws("-", F.lit("fe80"), F.col("user_id").cast("string"), F.col("k").cast("string"), F.lit("10.0.0.1"), F.col("dst_port").cast("string"), F.col("proto").cast("string")))
    return f.select("row_id", *[c.alias(n) for n, c in C.flow_parts("id").items()])


@query("e09_parse_log", "WITH {EV} SELECT row_id, event_type, CAST(k AS VARCHAR) AS age, 'a,b' AS note FROM ev")
def e09_parse_log(spark: SparkSession, d: str) -> DataFrame:
    log = F.concat(F.lit("event_type: "), "event_type", F.lit(", flow_age: "), F.col("k").cast("string"), F.lit(" ; event_type: dns, dns_note: a,b"))
    out = events.parse_log(flows(spark, d).select("row_id", log.alias("log")))
    return out.select("row_id", F.col("events")[0]["event_type"].alias("event_type"), F.col("events")[0]["flow_age"].alias("age"), F.col("events")[1]["dns_note"].alias("note"))


@query("e10_e16_features", """WITH l AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM events)
 SELECT user_id AS flow_id, f AS flow_seq, CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) AS http_get, CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) AS n_dns_query, CAST(count(*) FILTER (event_type = 'signup') AS DOUBLE) AS n_anomaly, 3.0::DOUBLE AS pkts_ts, round(coalesce(max(CASE WHEN event_type = 'purchase' THEN value END), 0) / 3, 6) AS bytes_per_pkt_ts,
  round(1 / (coalesce(max(CASE WHEN event_type = 'purchase' THEN value END), 0) + 1), 6) AS dir_ratio FROM l WHERE f IS NOT NULL GROUP BY 1, 2""")
def e10_e16_features(spark: SparkSession, d: str) -> DataFrame:
    out = events.assemble(events.parse_events(event_lines(spark, d)))
    return r6(out.select("flow_id", "flow_seq", "http_get", "n_dns_query", "n_anomaly", "pkts_ts", "bytes_per_pkt_ts", "dir_ratio"))


@query("e20_day_build", """WITH {EV}, {SCHED}, p AS (SELECT e.row_id, e.sec, r.* FROM ev e JOIN rules r ON (e.user_id BETWEEN a_lo AND a_hi AND e.dst_port BETWEEN v_lo AND v_hi) OR (direction = 'any' AND e.dst_port BETWEEN a_lo AND a_hi AND e.user_id BETWEEN v_lo AND v_hi)),
 h AS (SELECT row_id, min(CASE WHEN sec >= "start" AND sec < "end" + 60 THEN rule END) AS rule, bool_or(outside = 'drop') AS dropped FROM p GROUP BY row_id),
 b AS (SELECT ev.day, coalesce(r.label, 'Benign') AS label FROM ev LEFT JOIN h USING (row_id) LEFT JOIN rules r ON r.rule = h.rule WHERE h.rule IS NOT NULL OR NOT coalesce(h.dropped, false)) SELECT day, label, count(*) AS n FROM b GROUP BY 1, 2""")
def e20_day_build(spark: SparkSession, d: str) -> DataFrame:
    built = joins.label_by_schedule(flows(spark, d).drop("label"), schedule(spark, d), "user_id", "dst_port", "sec", "row_id")
    return built.groupBy("day", "label").agg(F.count("*").alias("n"))


@query("j15_cross", "SELECT n_name, r_name, n_regionkey = r_regionkey AS own FROM nation CROSS JOIN region")
def j15_cross(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").crossJoin(F.broadcast(table(spark, d, "region"))).select("n_name", "r_name", (F.col("n_regionkey") == F.col("r_regionkey")).alias("own"))  # 5 regions


@query("t05_t07_top", "SELECT l_orderkey, l_linenumber, list_aggregate(list_transform(list_sort([{'o': -abs(l_quantity - 25), 'p': 0, 'n': 'quantity'}, {'o': -abs(l_discount * 300), 'p': 1, 'n': 'discount'}, {'o': -abs(l_tax * 200 - 5), 'p': 2, 'n': 'tax'}])[1:2], lambda s: s.n), 'string_agg', ',') AS top FROM lineitem")
def t05_t07_top(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumns({"a": F.col("l_quantity") - 25, "b": F.col("l_discount") * 300, "c": F.col("l_tax") * 200 - 5})
    top = C.top_k_by_size(["quantity", "discount", "tax"], ["a", "b", "c"], 2)
    return li.select("l_orderkey", "l_linenumber", F.array_join(F.transform(top, lambda s: s["name"]), ",").alias("top"))


@query("l08_l13_hashes", "SELECT count(DISTINCT text) AS texts, (SELECT min(sha256(text)) FROM documents) AS first_digest FROM documents")
def l08_l13_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count_distinct(C.row_hash(["text"])).alias("texts"), F.min(F.sha2(F.col("text").cast("binary"), 256)).alias("first_digest"))


@query(
    "l11_l12_wording",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.5) AS t, quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM lineitem),
    d AS (SELECT quantile_cont(l_discount - 0.05, 0.5) AS t, quantile_cont(l_discount - 0.05, 0.05) AS lo, quantile_cont(l_discount - 0.05, 0.95) AS hi FROM lineitem),
    m AS (SELECT *, l_extendedprice * l_extendedprice * l_quantity AS b, CAST(l_extendedprice * 100 AS BIGINT) AS us, CAST(l_quantity * l_quantity * l_quantity AS BIGINT) AS n FROM lineitem)
    SELECT l_orderkey, l_linenumber,
     CASE WHEN l_extendedprice > q.hi THEN CASE WHEN q.t <= 0 OR l_extendedprice / q.t > 10 THEN 'far above normal' ELSE 'above normal' END
      WHEN l_extendedprice < q.lo THEN CASE WHEN q.t > 0 AND l_extendedprice < 0.1 * q.t THEN 'well below normal' ELSE 'below normal' END ELSE 'normal alone, unusual in combination' END AS words,
     CASE WHEN l_discount - 0.05 > d.hi THEN CASE WHEN d.t <= 0 OR (l_discount - 0.05) / d.t > 10 THEN 'far above normal' ELSE 'above normal' END
      WHEN l_discount - 0.05 < d.lo THEN CASE WHEN d.t > 0 AND l_discount - 0.05 < 0.1 * d.t THEN 'well below normal' ELSE 'below normal' END ELSE 'normal alone, unusual in combination' END AS around_zero,
     CASE WHEN b >= 1e9 THEN format('{:.1f} GB', b / 1e9) WHEN b >= 1e6 THEN format('{:.1f} MB', b / 1e6) WHEN b >= 1e3 THEN format('{:.1f} KB', b / 1e3) ELSE format('{:.0f} B', b) END AS bytes,
     CASE WHEN us / 1e6 < 1 THEN format('{:.0f} ms', us / 1e6 * 1000) ELSE format('{:.1f} s', us / 1e6) END AS us,
     CASE WHEN l_tax * 20 < 1 THEN format('{:.0f} ms', l_tax * 20 * 1000) ELSE format('{:.1f} s', l_tax * 20) END AS secs,
     format('{:,} /s', n) AS rate, format('{:,}', n) AS count, CASE WHEN l_discount * 10 >= 0.5 THEN 'yes' ELSE 'no' END AS flag,
     CASE WHEN n < 100 THEN format('{:.2f}', CAST(n AS DOUBLE)) ELSE format('{:,}', n) END AS num
    FROM m, q, d""",
)
def l11_l12_wording(spark: SparkSession, d: str) -> DataFrame:
    """Words for two columns against their quantiles, and texts of every unit."""
    around = F.col("l_discount") - 0.05
    li = table(spark, d, "lineitem")
    at = {"mid": 0.5, "low": 0.05, "high": 0.95}
    q, c = (quantiles(li.select(v.alias("v")), "v", at, []).select(F.array(*at).alias(n)) for n, v in (("q", F.col("l_extendedprice")), ("d", around)))
    q = q.crossJoin(c)  # one row each
    words = C.wording("l_extendedprice", F.col("q")[0], F.col("q")[1], F.col("q")[2])
    n = (F.col("l_quantity") * F.col("l_quantity") * F.col("l_quantity")).cast("long")
    units = {"bytes": (F.col("l_extendedprice") * F.col("l_extendedprice") * F.col("l_quantity"), "bytes"), "us": (F.round(F.col("l_extendedprice") * 100).cast("long"), "us"), "secs": (F.col("l_tax") * 20, "s"), "rate": (n, "rate"), "count": (n, "count"), "flag": (F.col("l_discount") * 10, "flag"), "num": (n, "num")}
    texts = [C.format_unit(v, u).alias(c) for c, (v, u) in units.items()]
    return li.crossJoin(F.broadcast(q)).select("l_orderkey", "l_linenumber", words.alias("words"), C.wording(around, F.col("d")[0], F.col("d")[1], F.col("d")[2]).alias("around_zero"), *texts)


def lines(spark: SparkSession, d: str) -> DataFrame:
    """One row for each (order, line number), which the table may repeat."""
    li = table(spark, d, "lineitem")
    names = ("l_quantity", "l_discount", "l_tax")
    rows = dealt(li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), *names), li.count(), "id")
    return rows.groupBy("id").agg(*[F.max(c).alias(c) for c in names])


def values(spark: SparkSession, d: str) -> DataFrame:
    li = lines(spark, d)
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("value")) for n, c in (("quantity", F.col("l_quantity") - 25), ("discount", F.col("l_discount") * 300), ("tax", F.col("l_tax") * 200 - 5))])
    return li.select("id", F.explode(rows).alias("x")).select("id", "x.feature", "x.value")


@query("a10_modality_share", "WITH li AS (SELECT l_orderkey * 10 + l_linenumber AS id, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount, max(l_tax) AS l_tax FROM lineitem GROUP BY 1), v AS (SELECT id, abs(l_quantity - 25) AS a, abs(l_discount * 300) AS b, abs(l_tax * 200 - 5) AS c FROM li) SELECT id, 'volume' AS modality, round(a / greatest(a + b + c, 1e-12), 6) AS share FROM v UNION ALL SELECT id, 'rate', round((b + c) / greatest(a + b + c, 1e-12), 6) FROM v")
def a10_modality_share(spark: SparkSession, d: str) -> DataFrame:
    of = spark.createDataFrame([("quantity", "volume"), ("discount", "rate"), ("tax", "rate")], "feature string, modality string")
    return r6(explain.modality_share(values(spark, d), of))


@query(
    "a06_agreement",
    """WITH li AS (SELECT l_orderkey * 10 + l_linenumber AS id, max(l_quantity) AS q, max(l_discount) AS d, max(l_tax) AS t FROM lineitem GROUP BY 1),
    v AS (SELECT id, run, f, v FROM li, LATERAL (SELECT unnest([{'r': 0, 'f': 'quantity', 'v': q - 25}, {'r': 0, 'f': 'discount', 'v': d * 300}, {'r': 0, 'f': 'tax', 'v': t * 200 - 5},
      {'r': 1, 'f': 'quantity', 'v': (q - 25) * 0.5}, {'r': 1, 'f': 'discount', 'v': d * 300 - 20}, {'r': 1, 'f': 'tax', 'v': (t * 200 - 5) * 2}]) AS x) u, LATERAL (SELECT x.r AS run, x.f AS f, x.v AS v) y),
    o AS (SELECT *, row_number() OVER (PARTITION BY id, run ORDER BY abs(v) DESC, f) AS p FROM v),
    n AS (SELECT id, count(*) FILTER (n = 2) AS shared, count(*) AS either FROM (SELECT id, f, count(*) AS n FROM o WHERE p <= 2 GROUP BY 1, 2) GROUP BY id)
    SELECT id, round(shared / either, 6) AS agreement FROM n""",
)
def a06_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Top two features of two runs that weigh the columns differently."""
    v, name = values(spark, d), F.col("feature")
    other = F.when(name == "quantity", F.col("value") * 0.5).when(name == "discount", F.col("value") - 20).otherwise(F.col("value") * 2)
    return r6(explain.agreement(v, v.withColumn("value", other), 2))


@query("a11_a12_evidence", """WITH li AS (SELECT l_orderkey * 10 + l_linenumber AS id, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount, max(l_tax) AS l_tax FROM lineitem GROUP BY 1), v AS (SELECT id, unnest([{'f': 'quantity', 'v': l_quantity - 25, 'r': l_quantity}, {'f': 'discount', 'v': l_discount * 300, 'r': l_discount}, {'f': 'tax', 'v': l_tax * 200 - 5, 'r': l_tax}]) AS x FROM li),
 b AS (SELECT x.f AS f, quantile_cont(x.r, 0.5) AS t, quantile_cont(x.r, 0.95) AS hi FROM v GROUP BY 1), o AS (SELECT id, x.f AS f, x.v AS v, x.r AS r, row_number() OVER (PARTITION BY id ORDER BY x.v DESC, x.f) AS p FROM v WHERE x.v > 0)
 SELECT id, string_agg(DISTINCT h, ',' ORDER BY h) AS hypotheses FROM (SELECT id, CASE WHEN f = 'quantity' AND r > hi THEN 'bulk' WHEN f = 'discount' AND r > hi THEN 'bargain' WHEN f = 'tax' AND r < t * 0.5 THEN 'exempt' END AS h FROM o JOIN b USING (f) WHERE p <= 2) WHERE h IS NOT NULL GROUP BY id""")
def a11_a12_evidence(spark: SparkSession, d: str) -> DataFrame:
    li = lines(spark, d)
    raw = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"l_{n}").alias("raw")) for n in ("quantity", "discount", "tax")])
    rows = li.select("id", F.lit(0).alias("role"), F.explode(raw).alias("x")).select("id", "role", "x.feature", "x.raw")
    base = features.raw_baseline(li.withColumnsRenamed({f"l_{n}": n for n in ("quantity", "discount", "tax")}).withColumn("role", F.lit(0)), ["quantity", "discount", "tax"], "role", 1 << 60)
    v = values(spark, d)
    everything = v.groupBy("id").agg(F.collect_set("feature").alias("top"))
    found = explain.evidence(v, rows, base, everything, 2)
    groups = spark.createDataFrame([("quantity", "high", "bulk"), ("discount", "high", "bargain"), ("tax", "low", "exempt")], "feature string, direction string, hypothesis string")
    return explain.hypotheses(found, groups).select("id", F.array_join("hypotheses", ",").alias("hypotheses"))


@query("a13_a15_reports", """WITH {EV}, s AS (SELECT *, CASE WHEN k % 7 = 0 THEN 1 ELSE 3 END AS severity, k % 7 = 0 OR k % 11 = 0 AS sig FROM ev WHERE score > 60)
 SELECT row_id AS id, CASE WHEN sig AND severity <= 2 THEN 'HIGH' WHEN sig OR score / 30 >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS priority, CASE WHEN sig THEN 'confirmed' ELSE 'anomaly_only' END AS verdict, round(score / 30, 6) AS ratio FROM s""")
def a13_a15_reports(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    a = flows(spark, d).where("score > 60").select(F.col("row_id").alias("id"), "score", F.lit(30.0).alias("threshold"), F.when(k % 7 == 0, 1).otherwise(3).alias("severity"), ((k % 7 == 0) | (k % 11 == 0)).alias("has_signature"))
    none = spark.createDataFrame([], "id long, place int, feature string, value double, typical double, stable boolean")
    return explain.report(a, none, spark.createDataFrame([], "id long, hypotheses array<string>")).select("id", "priority", "verdict", "ratio")


@query(
    "q09_parity",
    "WITH s AS (SELECT * FROM lineitem WHERE l_linenumber <= 2), b AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS f, abs((SELECT avg(v) FROM (SELECT sign({c}) * ln(1 + abs({c})) AS v FROM lineitem)) - (SELECT avg(v) FROM (SELECT sign({c}) * ln(1 + abs({c})) AS v FROM s))) > 0.002 AS m, abs((SELECT stddev_pop(v) FROM (SELECT sign({c}) * ln(1 + abs({c})) AS v FROM lineitem)) - (SELECT stddev_pop(v) FROM (SELECT sign({c}) * ln(1 + abs({c})) AS v FROM s))) > 0.002 AS s" for c in ("l_quantity", "l_extendedprice", "l_discount"))
    + ") SELECT name, 0::BIGINT AS extra, 1::BIGINT AS missing, 0::BIGINT AS null_differs, CASE name WHEN 'pos' THEN 0 WHEN 'mean' THEN (SELECT count(*) FILTER (m) FROM b) ELSE (SELECT count(*) FILTER (s) FROM b) END AS differs FROM (VALUES ('pos'), ('mean'), ('std')) v(name)",
)
def q09_parity(spark: SparkSession, d: str) -> DataFrame:
    """Stored statistics of all features against a refit of three of them on other rows: one is missing, others differ."""
    li = table(spark, d, "lineitem")
    refit = {m: [c for c in cs if c != "l_tax"] for m, cs in MODALITIES.items()}
    return audit.diff_tables(features.fit_space(li, MODALITIES).drop("modality"), features.fit_space(li.where("l_linenumber <= 2"), refit).drop("modality"), ["name"], 0.002)


@query(
    "q22_batch_duplicates",
    """WITH v AS (SELECT *, CAST('0x' || substr(md5(CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) || '|0'), 1, 15) AS BIGINT) % greatest(1, (SELECT count(*) FROM lineitem) // 256) AS b FROM lineitem),
    n AS (SELECT 'volume' AS modality, count(*) AS n FROM v GROUP BY b, l_quantity, l_extendedprice UNION ALL SELECT 'rate', count(*) FROM v GROUP BY b, l_discount, l_tax)
    SELECT modality, round(coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 6) AS share FROM n GROUP BY modality""",
)
def q22_batch_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return r6(batch.batch_duplicates(vectors(spark, d), SLICES, "row_id"))


@query(
    "q21_cka",
    "WITH f AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings), a AS (SELECT vec_id, unnest(range(1, 9)) AS i, unnest(x[1:8]) AS v FROM f), b AS (SELECT vec_id, unnest(range(1, 7)) AS i, unnest(list_transform(x[5:10], lambda v: v * v + v)) AS v FROM f), "
    + ", ".join(f"{n} AS (SELECT sum(c * c) AS s FROM (SELECT covar_pop(p.v, q.v) * count(*) AS c FROM {p} p JOIN {q} q USING (vec_id) GROUP BY p.i, q.i))" for n, p, q in (("ab", "a", "b"), ("aa", "a", "a"), ("bb", "b", "b")))
    + " SELECT round(ab.s / sqrt(aa.s * bb.s), 6) AS cka FROM ab, aa, bb",
)
def q21_cka(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of the first eight places of the vectors and a bent copy of places five to ten."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x"))
    return r6(batch.linear_cka(e.withColumn("x", F.slice("x", 1, 8)), e.withColumn("x", F.transform(F.slice("x", 5, 6), lambda v: v * v + v)), "row_id"))


@query(
    "j05_matched",
    """WITH {CONN}, c AS (SELECT *, row_number() OVER (PARTITION BY host, start_sec ORDER BY len DESC, uid DESC) AS r FROM conn),
    j AS (SELECT fl.row_id, fl.sec, fl.row_id % 5 AS port, c.start_sec, c.len, c.uid, c.uid % 5 AS resp FROM fl ASOF LEFT JOIN (SELECT * FROM c WHERE r = 1) c ON fl.host = c.host AND fl.sec + 2 >= c.start_sec)
    SELECT row_id, coalesce(sec <= start_sec + len + 5 AND port = resp, false) AS matched, CASE WHEN coalesce(sec <= start_sec + len + 5 AND port = resp, false) THEN uid END AS uid FROM j""",
)
def j05_matched(spark: SparkSession, d: str) -> DataFrame:
    """The connection of a flow's host that began last, if it still ran and answers on the flow's port."""
    left = order_flows(spark, d).withColumn("port", F.col("row_id") % 5)
    right = connections(spark, d).withColumn("resp", F.col("uid") % 5)
    return joins.as_of_match(left, right, ["host"], "sec", "start_sec", "len", ["uid"], {"port": "resp"}).select("row_id", "matched", "uid")


@query(
    "t01_t03_orders",
    """WITH {EV}, o AS (SELECT * FROM (VALUES ('signup', 1), ('view', 2), ('click', 3), ('purchase', 4)) v(event_type, place))
    SELECT row_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY coalesce(place, 5), day, row_id) AS INTEGER) AS r FROM ev LEFT JOIN o USING (event_type)""",
)
def t01_t03_orders(spark: SparkSession, d: str) -> DataFrame:
    """A stable order by a category's place in a list, then by day; ties stay in input order. Categories that the list lacks come last."""
    place = C.order_of("event_type", ["signup", "view", "click", "purchase"])
    return flows(spark, d).select("row_id", F.row_number().over(Window.partitionBy("user_id").orderBy(place, "day", "row_id")).alias("r"))


@query(
    "p11_dev_test",
    """WITH {EV}, k AS (SELECT day, CAST(row_number() OVER (ORDER BY day) AS BIGINT) AS i FROM (SELECT DISTINCT day FROM ev)), s AS (SELECT ev.*, CASE WHEN i % 3 = 0 THEN 'test' ELSE 'dev' END AS part FROM ev JOIN k USING (day)),
    u AS (SELECT part, m, CASE WHEN m = 'a' THEN score ELSE score * (1 + k) END AS s, y FROM s, (VALUES ('a'), ('b')) v(m)), c AS (SELECT part, m, s, sum(y) AS p, sum(1 - y) AS q FROM u GROUP BY 1, 2, 3), b AS (SELECT *, sum(q) OVER (PARTITION BY part, m ORDER BY s) AS below FROM c),
    a AS (SELECT part, m, sum(p * (below - q * 0.5)) / nullif(sum(p) * sum(q), 0) AS auc FROM b GROUP BY 1, 2)
    SELECT d.m AS method, round(d.auc, 6) AS dev_auc, round(t.auc, 6) AS test_auc, d.auc = (SELECT max(auc) FROM a WHERE part = 'dev') AS chosen FROM a d JOIN a t USING (m) WHERE d.part = 'dev' AND t.part = 'test'""",
)
def p11_dev_test(spark: SparkSession, d: str) -> DataFrame:
    """Methods are chosen on development days; the choice is recorded beside their areas on days kept for testing."""
    f = flows(spark, d)
    days = f.select("day").distinct().withColumn("i", F.row_number().over(Window.orderBy("day")))  # a row for each day
    test = [r["day"] for r in days.where("i % 3 = 0").collect()]
    long = f.withColumn("m", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("s", F.when(F.col("m") == "a", F.col("score")).otherwise(F.col("score") * (1 + F.col("k"))))
    return r6(split.dev_test(long, "day", test, lambda part: metrics.roc_auc(part, "y", "s", ["m"]), "m", "roc_auc")).withColumnsRenamed({"m": "method", "dev_roc_auc": "dev_auc", "test_roc_auc": "test_auc"})


@query("m10_m32_methods")
def m10_m32_methods(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    specs = {"autoencoder": detectors.METHODS["autoencoder"], **detectors.expert_specs(["rate"])}
    return r6(batch.run_methods(v.where("y = 0"), v, SLICES, "row_id", [0, 1], specs))


def _m26_sql() -> str:
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    logs = ", ".join(f"sign({c}) * ln(1 + abs({c})) AS g{i}" for i, c in enumerate(names))
    stats = ", ".join(f"avg(g{i}) AS m{i}, stddev_pop(g{i}) AS s{i}" for i in range(4))
    clipped = ", ".join(f"greatest(-8, least(8, (g{i} - m{i}) / s{i})) AS x{i}" for i in range(4))
    square = " + ".join(f"(f.x{i} - r.x{i}) * (f.x{i} - r.x{i})" for i in range(4))
    return f"""WITH l AS (SELECT ((l_orderkey * 100000 + l_partkey) * 100000 + l_suppkey) * 10 + l_linenumber AS row_id, l_orderkey % 3 = 0 AS is_val, l_returnflag <> 'R' AS benign, l_linenumber = 7 AS bad, {logs} FROM lineitem),
     s AS (SELECT {stats} FROM l WHERE benign AND NOT is_val), f AS (SELECT row_id, is_val, benign, bad, {clipped} FROM l, s),
     r AS (SELECT * FROM f WHERE benign AND NOT is_val ORDER BY CAST('0x' || substr(md5(CAST(row_id AS VARCHAR) || '|0'), 1, 15) AS BIGINT), row_id LIMIT 5000),
     d AS (SELECT f.row_id, f.is_val, f.benign, f.bad, f.x1, list_avg(min(sqrt({square}), 5)) AS d FROM f, r GROUP BY ALL),
     m AS (SELECT median(d) AS med FROM d WHERE benign AND is_val), k AS (SELECT med, 1.4826 * (SELECT median(abs(d - med)) FROM d, m WHERE benign AND is_val) + 1e-6 AS sc FROM m),
     t AS (SELECT quantile_cont((d - med) / sc, 0.99) AS t FROM d, k WHERE benign AND is_val)
     SELECT row_id, CASE WHEN NOT bad THEN round((d - med) / sc, 6) END AS score, CASE WHEN NOT bad THEN (d - med) / sc > t END AS alert, CASE WHEN bad THEN 'negative ' || chr(39) || 'proto' || chr(39) END AS reason FROM d, k, t"""


@query("m26_batch_scoring", _m26_sql())
def m26_batch_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Scores, alerts and rejections of all line items, by distances in the feature space to 5,000 references of their role."""
    li = table(spark, d, "lineitem").withColumn("row_id", ((F.col("l_orderkey") * 100_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).withColumns({"port": F.lit(443), "proto": F.when(F.col("l_linenumber") == 7, -1).otherwise(6), "role": F.lit(0)})
    fit, val = li.where("l_returnflag <> 'R' AND l_orderkey % 3 <> 0"), li.where("l_returnflag <> 'R' AND l_orderkey % 3 = 0")
    model = batch.fit_model(fit, val, MODALITIES, "role", "row_id")
    good, bad = batch.score_batch(li.drop("role"), model, "row_id", None, "proto", "port")
    return good.select("row_id", F.round("score", 6).alias("score"), "alert").unionByName(bad.select("row_id", "reason"), allowMissingColumns=True)


@query("p10_families")
def p10_families(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d, family=F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")))
    return r6(batch.lofo(v, "family", ["F"], "row_id", trees=3))


@query("z02_z03_counters", "WITH {EV}, s AS (SELECT CASE WHEN user_id % 100 = 0 THEN 70000 ELSE dst_port END AS p, score FROM ev) SELECT count(*) AS rows, count(*) FILTER (p <= 65535) AS scored, count(*) FILTER (p > 65535) AS rejected, count(*) FILTER (p <= 65535 AND score > 80) AS alerts FROM s")
def z02_z03_counters(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d).withColumn("p", F.when(F.col("user_id") % 100 == 0, 70000).otherwise(F.col("dst_port")))
    f = f.withColumn("v", F.col("score")).drop("score")
    return stream.counters(stream.score_stream(f, ["v"], None, "proto", "p", F.col("v"), 80.0))
