"""Cleaning, features and splits over the flow views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.functions import columns as C
from flowlens.operators import clean, features, split
from flowlens.plans.views import dirty, flows, query, r6, schedule, table


@query("s01_c01_headers", "WITH {DIRTY} SELECT row_id, label, duration FROM dirty WHERE label <> 'label'")
def s01_c01_headers(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_repeated_headers(dirty(spark, d), "label").select("row_id", "label", "duration")


NUM = "CASE WHEN isfinite(TRY_CAST({c} AS DOUBLE)) THEN TRY_CAST({c} AS DOUBLE) END"
GOOD = f"num AS (SELECT row_id, label, {NUM.format(c='duration')} AS duration, {NUM.format(c='port')} AS port, {NUM.format(c='proto')} AS proto FROM dirty WHERE label <> 'label')"


@query("c02_c04_numeric", "WITH {DIRTY}, " + GOOD + " SELECT row_id, duration, port, proto FROM num WHERE duration IS NOT NULL AND port IS NOT NULL AND proto IS NOT NULL")
def c02_c04_numeric(spark: SparkSession, d: str) -> DataFrame:
    out = clean.numeric(clean.drop_repeated_headers(dirty(spark, d), "label"), ["duration", "port", "proto"])
    return out.dropna(subset=["duration", "port", "proto"]).select("row_id", "duration", "port", "proto")


@query("c03_timestamps", "WITH {DIRTY} SELECT row_id, CASE WHEN year(t) <> 1970 THEN CAST(epoch(t) AS BIGINT) END AS sec FROM (SELECT row_id, strptime(stamp, '%d/%m/%Y %H:%M:%S') AS t FROM dirty)")
def c03_timestamps(spark: SparkSession, d: str) -> DataFrame:
    t = dirty(spark, d).withColumn("ts", F.expr("try_to_timestamp(stamp, 'dd/MM/yyyy HH:mm:ss')").cast("timestamp_ntz"))
    return t.select("row_id", F.when(F.year("ts") != 1970, F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")).alias("sec"))


@query("c05_c06_clean_day", "WITH {DIRTY}, " + GOOD + ", x AS (SELECT min(row_id) AS row_id, label, duration, port, proto FROM num WHERE duration >= 0 AND proto >= 0 AND port IS NOT NULL AND duration IS NOT NULL AND proto IS NOT NULL GROUP BY ALL)"
       " SELECT row_id, l AS label, duration, port, proto, CASE WHEN l <> 'Benign' THEN 1 ELSE 0 END AS attack FROM (SELECT *, CASE WHEN trim(label) IN ('BENIGN', 'Normal') THEN 'Benign' ELSE trim(label) END AS l FROM x)")
def c05_c06_clean_day(spark: SparkSession, d: str) -> DataFrame:
    out, _ = clean.clean_day(dirty(spark, d).drop("stamp"), ["duration", "port", "proto"], "label", "row_id", ["duration", "proto"])
    return out.select("row_id", "label", "duration", "port", "proto", "attack")


@query("c07_unwrap", "WITH {EV} SELECT row_id, sec + CASE WHEN (sec % 86400) // 3600 < 8 THEN 43200 ELSE 0 END AS sec12 FROM ev")
def c07_unwrap(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).select("row_id", C.unwrap_12h("sec").alias("sec12"))


REASON = """CASE WHEN d IS NULL THEN 'non-numeric, missing or infinite value in ''duration''' WHEN p IS NULL THEN 'non-numeric, missing or infinite value in ''port''' WHEN q IS NULL THEN 'non-numeric, missing or infinite value in ''proto'''
  WHEN d < 0 THEN 'negative ''duration''' WHEN q < 0 THEN 'negative ''proto''' WHEN p < 0 OR p > 65535 THEN '''port'' outside 0-65535' END"""
REJECT = f"rej AS (SELECT row_id, {REASON} AS reason FROM (SELECT row_id, {NUM.format(c='duration')} AS d, {NUM.format(c='port')} AS p, {NUM.format(c='proto')} AS q FROM dirty))"


def _rejected(spark: SparkSession, d: str) -> DataFrame:
    df = dirty(spark, d)
    return df.withColumn("reason", clean.rejection(df, ["duration", "port", "proto"], "duration", "proto", "port"))


@query("c11_validate", "WITH {DIRTY}, " + REJECT + " SELECT row_id, reason FROM rej")
def c11_validate(spark: SparkSession, d: str) -> DataFrame:
    return _rejected(spark, d).select("row_id", "reason")


@query("c12_rejections", "WITH {DIRTY}, " + REJECT + " SELECT reason, count(*) AS n FROM rej WHERE reason IS NOT NULL GROUP BY reason ORDER BY n DESC, reason LIMIT 10")
def c12_rejections(spark: SparkSession, d: str) -> DataFrame:
    return clean.rejection_summary(_rejected(spark, d))


@query("c13_c16_roles", "WITH {EV} SELECT row_id, role, CASE WHEN user_id % 7 = 0 THEN 5 ELSE role END AS role2, CAST(proto = 6 AS DOUBLE) AS proto_6, CAST(proto = 17 AS DOUBLE) AS proto_17, CAST(1 AS DOUBLE) - CAST(proto = 6 AS DOUBLE) - CAST(proto = 17 AS DOUBLE) AS proto_other FROM ev")
def c13_c16_roles(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d).withColumn("given", F.when(F.col("user_id") % 7 == 0, "database"))
    return f.withColumns(C.one_hot("proto", [6, 17], "proto")).select("row_id", "role", C.role_override("given", "role").alias("role2"), "proto_6", "proto_17", "proto_other")


@query("c14_endpoint_role", "WITH {EV} SELECT row_id, CASE WHEN p IN (80, 443) THEN 0 WHEN p = 22 THEN 1 WHEN p = 445 THEN 2 WHEN p = 53 THEN 3 WHEN p = 25 THEN 4 WHEN p IN (3306, 1433) THEN 5 WHEN p >= 49152 THEN 8 WHEN p >= 1024 THEN 7 ELSE 6 END AS role FROM (SELECT row_id, least(dst_port, 2001 + user_id * 100) AS p FROM ev WHERE user_id > 0)")
def c14_endpoint_role(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).where("user_id > 0").withColumn("src", 2001 + F.col("user_id") * 100).select("row_id", C.role_of_endpoints("src", "dst_port").alias("role"))


@query("c17_c18_services", "WITH {EV} SELECT row_id, CAST(event_type = 'view' AS DOUBLE) AS svc_view, CAST(event_type = 'click' AS DOUBLE) AS svc_click, CAST(event_type NOT IN ('view', 'click') AS DOUBLE) AS svc_other, CASE event_type WHEN 'view' THEN 0 WHEN 'signup' THEN 4 ELSE 6 END AS role FROM ev")
def c17_c18_services(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(F.lit("view"), F.lit(0), F.lit("signup"), F.lit(4))
    return flows(spark, d).withColumns(C.one_hot("event_type", ["view", "click"], "svc")).select("row_id", "svc_view", "svc_click", "svc_other", F.coalesce(F.try_element_at(names, F.col("event_type")), F.lit(6)).alias("role"))


@query("c20_clock", "SELECT event_id AS row_id, CAST(epoch(CAST(ts AS TIMESTAMP) - TIMESTAMP '1970-01-01 00:00:00') AS BIGINT) % 86400 + 86400 * (event_id % 5) AS sec FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def c20_clock(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("row_id"), F.date_format("ts", "HH:mm:ss").alias("t"), (F.col("event_id") % 5).alias("n"))
    return e.select("row_id", C.clock_seconds("t", "n").alias("sec"))


@query("c22_label_errors", """WITH {EV}, b AS (SELECT day, min(sec) AS lo, max(sec) AS hi FROM ev WHERE event_type = 'error' GROUP BY day)
 SELECT row_id, event_type FROM ev WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.day = ev.day AND ev.event_type = 'view' AND ev.sec BETWEEN lo AND hi AND dayofmonth(b.day) % 2 = 0)""")
def c22_label_errors(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d)
    rules = f.select("day").distinct().where(F.dayofmonth("day") % 2 == 0).select("day", F.lit("view").alias("label"), F.lit("error").alias("during"))
    return clean.drop_label_errors(f, "day", "event_type", "sec", rules).select("row_id", "event_type")


COUNT = "count(*) OVER (PARTITION BY {keys} ORDER BY sec RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)"


@query("f01_trailing_count", "WITH {EV} SELECT row_id, " + COUNT.format(keys="day, event_type", w=3599) + " AS n, " + COUNT.format(keys="day", w=3599) + " AS load FROM ev")
def f01_trailing_count(spark: SparkSession, d: str) -> DataFrame:
    out = features.trailing_count(flows(spark, d), ["day", "event_type"], "sec", {"n": 3600})
    return features.trailing_count(out, ["day"], "sec", {"load": 3600}).select("row_id", "n", "load")


@query("f02_gap", """WITH {EV}, s AS (SELECT DISTINCT event_type, sec FROM ev), g AS (SELECT event_type, sec, least(coalesce(sec - lag(sec) OVER (PARTITION BY event_type ORDER BY sec), 3600), 3600) AS gap FROM s)
 SELECT row_id, CAST(gap AS DOUBLE) AS gap FROM ev JOIN g USING (event_type, sec)""")
def f02_gap(spark: SparkSession, d: str) -> DataFrame:
    return features.trailing_count(flows(spark, d), ["event_type"], "sec", {}, "gap").select("row_id", "gap")


@query("f03_distinct_bucket", """WITH {EV}, f AS (SELECT day, min(sec) AS t0 FROM ev GROUP BY day), b AS (SELECT row_id, day, dst_port, (sec - t0) // 3600 AS b FROM ev JOIN f USING (day))
 SELECT row_id, n FROM b JOIN (SELECT day, b, count(DISTINCT dst_port) AS n FROM b GROUP BY day, b) USING (day, b)""")
def f03_distinct_bucket(spark: SparkSession, d: str) -> DataFrame:
    return features.distinct_per_bucket(flows(spark, d), ["day"], "dst_port", "sec", 3600, "n").select("row_id", "n")


CTX = ", ".join([
    COUNT.format(keys="day", w=599) + " AS ctx_flows_600s", COUNT.format(keys="day", w=3599) + " AS ctx_flows_3600s",
    COUNT.format(keys="day, dst_port", w=599) + " AS ctx_port_flows_600s", COUNT.format(keys="day, dst_port", w=3599) + " AS ctx_port_flows_3600s",
    COUNT.format(keys="day, dst_port, event_type, vbin", w=599) + " AS ctx_shape_600s", COUNT.format(keys="day, dst_port, event_type, vbin", w=3599) + " AS ctx_shape_3600s",
])
CTX_SQL = """WITH {EV}, f AS (SELECT day, min(sec) AS t0 FROM ev GROUP BY day), c AS (SELECT ev.*, (sec - t0) // 600 AS b1, (sec - t0) // 1800 AS b2, """ + CTX + """ FROM ev JOIN f USING (day)),
 p AS (SELECT day, dst_port, sec, least(coalesce(sec - lag(sec) OVER (PARTITION BY day, dst_port ORDER BY sec), 3600), 3600) AS g FROM (SELECT DISTINCT day, dst_port, sec FROM ev)),
 s AS (SELECT day, dst_port, event_type, vbin, sec, least(coalesce(sec - lag(sec) OVER (PARTITION BY day, dst_port, event_type, vbin ORDER BY sec), 3600), 3600) AS g FROM (SELECT DISTINCT day, dst_port, event_type, vbin, sec FROM ev)),
 d1 AS (SELECT day, b1, count(DISTINCT dst_port) AS n1 FROM c GROUP BY 1, 2), d2 AS (SELECT day, b2, count(DISTINCT dst_port) AS n2 FROM c GROUP BY 1, 2)
 SELECT row_id, ctx_flows_600s, ctx_flows_3600s, ctx_port_flows_600s, ctx_port_flows_3600s, ctx_shape_600s, ctx_shape_3600s, CAST(p.g AS DOUBLE) AS ctx_port_gap, CAST(s.g AS DOUBLE) AS ctx_shape_gap, n1 AS ctx_ports_600s, n2 AS ctx_ports_1800s,
  round(ctx_port_flows_3600s / ctx_flows_3600s, 6) AS ctx_port_share_3600s, round(ctx_shape_3600s / ctx_port_flows_3600s, 6) AS ctx_shape_share_3600s
 FROM c JOIN p USING (day, dst_port, sec) JOIN s USING (day, dst_port, event_type, vbin, sec) JOIN d1 USING (day, b1) JOIN d2 USING (day, b2)"""


@query("f04_f07_context", CTX_SQL)
def f04_f07_context(spark: SparkSession, d: str) -> DataFrame:
    out = features.add_context(flows(spark, d), "day", "sec", "dst_port", ["event_type", "vbin"], 600, 3600, 1800)
    return r6(out.select("row_id", *[c for c in out.columns if c.startswith("ctx_")]))


MODALITIES = {"volume": ["l_quantity", "l_extendedprice"], "rate": ["l_discount", "l_tax"]}
SLOG = "sign({c}) * ln(1 + abs({c}))"
LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("f08_f09_space", "WITH s AS (" + " UNION ALL ".join(f"SELECT {i} AS pos, '{'volume' if i < 2 else 'rate'}' AS modality, '{c}' AS name, avg({SLOG.format(c=c)}) AS mean, stddev_pop({SLOG.format(c=c)}) AS std FROM lineitem" for i, c in enumerate(LI)) + ") SELECT pos, modality, name, round(mean, 6) AS mean, round(std, 6) AS std FROM s WHERE std > 1e-6")
def f08_f09_space(spark: SparkSession, d: str) -> DataFrame:
    return r6(features.fit_space(table(spark, d, "lineitem"), MODALITIES)).select("pos", "modality", "name", "mean", "std")


@query("f10_transform", "WITH s AS (SELECT " + ", ".join(f"avg({SLOG.format(c=c)}) AS m{i}, stddev_pop({SLOG.format(c=c)}) AS s{i}" for i, c in enumerate(LI)) + " FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(greatest(-8.0, least(8.0, ({SLOG.format(c=c)} - m{i}) / s{i})), 5) AS x{i}" for i, c in enumerate(LI)) + " FROM lineitem, s")
def f10_transform(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    out = features.apply_space(li, features.fit_space(li, MODALITIES).orderBy("pos").collect())  # a row for each feature
    return out.select("l_orderkey", "l_linenumber", *[F.round(F.col("x")[i], 5).alias(f"x{i}") for i in range(4)])


@query("f11_robust", "WITH {EV}, m AS (SELECT event_type, median(score) AS med FROM ev GROUP BY 1) SELECT event_type, round(med, 6) AS med, round(1.4826 * median(abs(score - med)) + 1e-6, 6) AS scale, count(*) AS n FROM ev JOIN m USING (event_type) GROUP BY event_type, med")
def f11_robust(spark: SparkSession, d: str) -> DataFrame:
    return r6(features.robust_stats(flows(spark, d), F.col("score"), ["event_type"])).select("event_type", "med", "scale", "n")


@query("f12_baseline", "WITH b AS (SELECT NULL::INTEGER AS role, count(*) AS n, quantile_cont(l_quantity, [0.5, 0.05, 0.95]) AS q, quantile_cont(l_tax, [0.5, 0.05, 0.95]) AS t FROM lineitem UNION ALL SELECT CAST(l_suppkey % 9 AS INTEGER), count(*), quantile_cont(l_quantity, [0.5, 0.05, 0.95]), quantile_cont(l_tax, [0.5, 0.05, 0.95]) FROM lineitem GROUP BY 1 HAVING count(*) >= 50)"
       " SELECT role, n, 'l_quantity' AS feature, round(q[1], 6) AS typical, round(q[2], 6) AS p5, round(q[3], 6) AS p95 FROM b UNION ALL SELECT role, n, 'l_tax', round(t[1], 6), round(t[2], 6), round(t[3], 6) FROM b")
def f12_baseline(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("role", (F.col("l_suppkey") % 9).cast("int"))
    return r6(features.raw_baseline(li, ["l_quantity", "l_tax"], "role", 50))


CUT = "r AS (SELECT day, sec, row_number() OVER (PARTITION BY day ORDER BY sec, row_id) - 1 AS p, count(*) OVER (PARTITION BY day) AS n FROM ev WHERE y = 0), c AS (SELECT day, sec AS cutoff FROM r WHERE p = CAST(floor(n * 0.8) AS BIGINT))"


@query("p01_p02_split", "WITH {EV}, " + CUT + " SELECT row_id, cutoff, CASE WHEN y = 0 THEN CASE WHEN sec < cutoff THEN 'train' ELSE 'val' END WHEN sec < cutoff THEN 'sup' END AS split FROM ev JOIN c USING (day)")
def p01_p02_split(spark: SparkSession, d: str) -> DataFrame:
    return split.time_split(flows(spark, d).withColumn("benign", F.col("y") == 0), "day", "sec", "row_id", 0.2, "benign").select("row_id", "cutoff", "split")


@query("p03_cap", "WITH {EV} SELECT row_id FROM ev ORDER BY CAST('0x' || substr(md5(CAST(row_id AS VARCHAR) || '|7'), 1, 15) AS BIGINT), row_id LIMIT 500")
def p03_cap(spark: SparkSession, d: str) -> DataFrame:
    return split.cap(flows(spark, d), 500, "row_id", 7).select("row_id")


@query("p04_split_summary", "WITH {EV} SELECT day, count(*) AS rows, CAST(sum(CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 0 END) AS BIGINT) AS attacks, coalesce(string_agg(DISTINCT CASE WHEN event_type IN ('error', 'signup') THEN event_type END, ', ' ORDER BY CASE WHEN event_type IN ('error', 'signup') THEN event_type END), '') AS types FROM ev GROUP BY day")
def p04_split_summary(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d).withColumn("attack", F.col("event_type").isin("error", "signup"))
    return split.split_summary(f, "day", "event_type", "attack")


@query("p05_roles", "WITH {EV} SELECT role, count(*) AS n FROM ev GROUP BY role")
def p05_roles(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).groupBy("role").agg(F.count("*").alias("n"))


@query("p06_p09_per_class", "WITH {EV} SELECT row_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY CAST('0x' || substr(md5(CAST(row_id AS VARCHAR) || '|3'), 1, 15) AS BIGINT), row_id) AS r FROM ev) WHERE r <= 100")
def p06_p09_per_class(spark: SparkSession, d: str) -> DataFrame:
    return split.cap_per_class(flows(spark, d), "event_type", 100, "row_id", 3).select("row_id", "event_type")


@query("p07_halves", "WITH {EV}, m AS (SELECT event_type, median(sec) AS m FROM ev GROUP BY 1) SELECT row_id, sec >= m AS late FROM ev JOIN m USING (event_type)")
def p07_halves(spark: SparkSession, d: str) -> DataFrame:
    return split.halves(flows(spark, d), "event_type", "sec").select("row_id", "late")


@query("p08_last_part", "WITH {EV}, q AS (SELECT quantile_cont(sec, 0.8) AS q FROM ev) SELECT row_id, sec >= q AS held FROM ev, q")
def p08_last_part(spark: SparkSession, d: str) -> DataFrame:
    return split.last_part(flows(spark, d), "sec", "row_id", 0.2).select("row_id", "held")


@query("w09_trailing_distinct", "WITH {EV} SELECT a.row_id, count(DISTINCT b.dst_port) AS n FROM ev a JOIN ev b ON a.day = b.day AND b.sec BETWEEN a.sec - 3599 AND a.sec GROUP BY a.row_id")
def w09_trailing_distinct(spark: SparkSession, d: str) -> DataFrame:
    return features.trailing_distinct(flows(spark, d), ["day"], "dst_port", "sec", 3600, "n").select("row_id", "n")


@query("q16_future_check", """WITH {EV}, f AS (SELECT day, min(sec) AS t0 FROM ev GROUP BY day), b AS (SELECT row_id, day, y, dst_port, (sec - t0) // 3600 AS b FROM ev JOIN f USING (day)),
 n AS (SELECT row_id, n FROM b JOIN (SELECT day, b, count(DISTINCT dst_port) AS n FROM b GROUP BY day, b) USING (day, b)),
 t AS (SELECT a.row_id, count(DISTINCT b.dst_port) AS t FROM ev a JOIN ev b ON a.day = b.day AND b.sec BETWEEN a.sec - 3599 AND a.sec GROUP BY a.row_id)
 SELECT round(avg(CASE WHEN n <> t THEN 1.0 ELSE 0.0 END), 6) AS differs, round(corr(n, t), 6) AS correlation FROM n JOIN t USING (row_id)""")
def q16_future_check(spark: SparkSession, d: str) -> DataFrame:
    out = features.distinct_per_bucket(flows(spark, d), ["day"], "dst_port", "sec", 3600, "n")
    out = features.trailing_distinct(out, ["day"], "dst_port", "sec", 3600, "t")
    return r6(out.agg(F.avg((F.col("n") != F.col("t")).cast("double")).alias("differs"), C.correlation("n", "t").alias("correlation")))


@query("e17_e19_schedule", """WITH {EV}, {SCHED}, p AS (SELECT e.row_id, e.sec, r.* FROM ev e JOIN rules r ON (e.user_id BETWEEN a_lo AND a_hi AND e.dst_port BETWEEN v_lo AND v_hi) OR (direction = 'any' AND e.dst_port BETWEEN a_lo AND a_hi AND e.user_id BETWEEN v_lo AND v_hi)),
 h AS (SELECT row_id, min(CASE WHEN sec >= "start" - 600 AND sec < "end" + 660 THEN rule END) AS rule, bool_or(outside = 'drop') AS dropped FROM p GROUP BY row_id)
 SELECT ev.row_id, coalesce(r.label, 'Benign') AS label, h.rule, coalesce(NOT (ev.sec >= r."start" AND ev.sec < r."end" + 60), false) AS pad_zone FROM ev LEFT JOIN h USING (row_id) LEFT JOIN rules r ON r.rule = h.rule
 WHERE h.rule IS NOT NULL OR NOT coalesce(h.dropped, false)""")
def e17_e19_schedule(spark: SparkSession, d: str) -> DataFrame:
    from flowlens.operators.joins import label_by_schedule

    f = flows(spark, d).drop("label")
    return label_by_schedule(f, schedule(spark, d), "user_id", "dst_port", "sec", "row_id", 600).select("row_id", "label", "rule", "pad_zone")


@query("t01_t04_sorts", "WITH {EV} SELECT day, event_type, n, CAST(place AS INTEGER) AS place FROM (SELECT day, event_type, count(*) AS n, row_number() OVER (PARTITION BY day ORDER BY count(*) DESC, event_type) AS place FROM ev GROUP BY day, event_type) WHERE place <= 3")
def t01_t04_sorts(spark: SparkSession, d: str) -> DataFrame:
    n = flows(spark, d).groupBy("day", "event_type").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "event_type"))).where("place <= 3")
