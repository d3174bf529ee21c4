"""Views of the driver's tables as flows, features, schedules and connections, in Spark and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.columns import role_from_port

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


#: Dates and times that queries return as text, so that any client compares them alike.
AS_TEXT = {
    "p04_split_summary": ["day"], "t01_t04_sorts": ["day"], "g10_time_to_detect": ["day"], "g11_incidents": ["day"], "q06_label_windows": ["day"], "q08_splits": ["day"],
    "w07_w10_bins": ["day"], "e20_day_build": ["day"], "l04_l07_scalars": ["h"], "z06_tumbling": ["w"], "z07_sessions": ["first"],
}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its SQL. {EV} and the like stand for the views' definitions."""

    texts = AS_TEXT.get(name, [])

    def put(f: Query) -> Query:
        QUERIES[name] = (lambda spark, d: f(spark, d).withColumns({c: F.col(c).cast("string") for c in texts})) if texts else f
        if sql is not None:
            casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in texts)
            whole = f"SELECT * REPLACE ({casts}) FROM ({sql})" if texts else sql
            SQL[name] = whole.replace("{EV}", EV).replace("{DIRTY}", DIRTY).replace("{SCHED}", SCHED).replace("{SCORES}", SCORES).replace("{CONN}", CONN)
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str | Column) -> Column:
    """Seconds since 1970 of a time without zone."""
    c = ts if isinstance(ts, str) else "ts"
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits."""
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


PORTS = [80, 443, 22, 53, 3306, 445, 25, 1433, 40000, 60000]

EV = """ev AS (SELECT *, CASE WHEN dst_port IN (80, 443) THEN 0 WHEN dst_port = 22 THEN 1 WHEN dst_port = 445 THEN 2 WHEN dst_port = 53 THEN 3 WHEN dst_port = 25 THEN 4
   WHEN dst_port IN (3306, 1433) THEN 5 WHEN dst_port >= 49152 THEN 8 WHEN dst_port >= 1024 THEN 7 ELSE 6 END AS role FROM (
  SELECT event_id AS row_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(ts AS DATE) AS day, user_id, event_type, value AS score,
   CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
   [80, 443, 22, 53, 3306, 445, 25, 1433, 40000, 60000][CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 + 1] AS dst_port,
   CASE WHEN user_id % 5 = 0 THEN 17 ELSE 6 END AS proto, CASE WHEN event_type = 'error' THEN 'Error' ELSE 'Benign' END AS label,
   CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, CAST(floor(value / 10) AS BIGINT) AS vbin FROM events))"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    ports = F.array(*[F.lit(p) for p in PORTS])
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), "ts", seconds("ts").alias("sec"), F.col("ts").cast("date").alias("day"), "user_id", "event_type", F.col("value").alias("score"), k.alias("k"),
        F.element_at(ports, k % 10 + 1).alias("dst_port"), F.when(F.col("user_id") % 5 == 0, 17).otherwise(6).alias("proto"), F.when(F.col("event_type") == "error", "Error").otherwise("Benign").alias("label"),
        (F.col("event_type") == "error").cast("int").alias("y"), F.floor(F.col("value") / 10).alias("vbin"),
    )
    return e.withColumn("role", role_from_port("dst_port"))


#: Flows as text, with repeated headers, bad and missing values, bad ports and duplicates.
DIRTY = """dirty AS (SELECT event_id AS row_id, CASE WHEN event_id % 97 = 1 THEN 'label' WHEN event_id % 97 = 7 THEN ' ' || event_type || ' ' WHEN event_id % 97 = 8 THEN 'BENIGN' ELSE event_type END AS label,
   CASE WHEN event_id % 97 = 2 THEN 'abc' WHEN event_id % 97 = 3 THEN NULL WHEN event_id % 97 = 4 THEN '-5' WHEN event_id % 97 = 5 THEN 'Infinity' WHEN event_id % 97 = 9 THEN 'NaN' ELSE CAST(user_id AS VARCHAR) END AS duration,
   CASE WHEN event_id % 97 = 6 THEN '70000' WHEN event_id % 97 = 10 THEN 'x' ELSE CAST(user_id % 50000 AS VARCHAR) END AS port,
   CASE WHEN event_id % 97 = 11 THEN '-1' ELSE CAST(CASE WHEN user_id % 5 = 0 THEN 17 ELSE 6 END AS VARCHAR) END AS proto,
   strftime(CASE WHEN event_id % 97 = 12 THEN TIMESTAMP '1970-01-01 00:00:00' ELSE ts END, '%d/%m/%Y %H:%M:%S') AS stamp FROM events)"""


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, e = F.col("event_id") % 97, table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("row_id"),
        F.when(m == 1, "label").when(m == 7, F.concat(F.lit(" "), "event_type", F.lit(" "))).when(m == 8, "BENIGN").otherwise(F.col("event_type")).alias("label"),
        F.when(m == 2, "abc").when(m == 3, None).when(m == 4, "-5").when(m == 5, "Infinity").when(m == 9, "NaN").otherwise(F.col("user_id").cast("string")).alias("duration"),
        F.when(m == 6, "70000").when(m == 10, "x").otherwise((F.col("user_id") % 50000).cast("string")).alias("port"),
        F.when(m == 11, "-1").otherwise(F.when(F.col("user_id") % 5 == 0, "17").otherwise("6")).alias("proto"),
        F.date_format(F.when(m == 12, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")).otherwise(F.col("ts")), "dd/MM/yyyy HH:mm:ss").alias("stamp"),
    )


#: A schedule with a rule for each nation: a day's window, and member ranges of users in the place of addresses.
SCHED = """rules AS (SELECT n_nationkey AS rule, 'A' || n_regionkey AS label, n_nationkey * 40 AS a_lo, n_nationkey * 40 + 59 AS a_hi, 0 AS v_lo, 443 AS v_hi,
   CAST(floor(epoch((SELECT min(ts) FROM events))) AS BIGINT) + n_nationkey * 86400 AS "start", CAST(floor(epoch((SELECT min(ts) FROM events))) AS BIGINT) + n_nationkey * 86400 + 43200 AS "end",
   CASE WHEN n_nationkey % 2 = 0 THEN 'any' ELSE 'one' END AS direction, CASE WHEN n_nationkey % 3 = 0 THEN 'drop' ELSE 'keep' END AS outside FROM nation)"""


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "events").agg(F.min("ts").alias("ts")).select(seconds("ts").alias("t0"))
    n, key = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    return n.crossJoin(F.broadcast(first)).select(
        key.alias("rule"), F.concat(F.lit("A"), F.col("n_regionkey").cast("string")).alias("label"), (key * 40).alias("a_lo"), (key * 40 + 59).alias("a_hi"), F.lit(0).alias("v_lo"), F.lit(443).alias("v_hi"),
        (F.col("t0") + key * 86400).alias("start"), (F.col("t0") + key * 86400 + 43200).alias("end"), F.when(key % 2 == 0, "any").otherwise("one").alias("direction"), F.when(key % 3 == 0, "drop").otherwise("keep").alias("outside"),
    )


#: A long table of scores of five methods and two seeds for each line item; `val` are the lines shipped early.
SCORES = """sc AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, seed, method, CASE method WHEN 'knn' THEN l_extendedprice WHEN 'e1' THEN l_quantity * (seed + 1) WHEN 'e2' THEN l_discount * 100 + l_tax * seed ELSE l_tax * 1000 - l_quantity END AS score,
   l_orderkey % 3 = 0 AS is_val, l_returnflag AS label, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem, (VALUES (0), (1)) s(seed), (VALUES ('knn'), ('e1'), ('e2'), ('e3')) m(method))"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array(*[F.struct(F.lit(s).alias("seed"), F.lit(m).alias("method")) for s in (0, 1) for m in ("knn", "e1", "e2", "e3")])
    li = table(spark, sf_dir, "lineitem").withColumn("x", F.explode(items)).withColumns({"seed": F.col("x.seed"), "method": F.col("x.method")})
    m = F.col("method")
    score = F.when(m == "knn", F.col("l_extendedprice")).when(m == "e1", F.col("l_quantity") * (F.col("seed") + 1)).when(m == "e2", F.col("l_discount") * 100 + F.col("l_tax") * F.col("seed")).otherwise(F.col("l_tax") * 1000 - F.col("l_quantity"))
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), "seed", "method", score.alias("score"), (F.col("l_orderkey") % 3 == 0).alias("is_val"), F.col("l_returnflag").alias("label"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


#: Orders as connections of a customer, and line items as flows of their order's customer.
CONN = """conn AS (SELECT o_custkey AS host, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS start_sec, o_orderkey AS uid, CAST(floor(o_totalprice) AS BIGINT) AS len, o_orderpriority AS note FROM orders),
 fl AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, o_custkey AS host, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS sec, l_returnflag AS label FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("host"), seconds("o_orderdate").alias("start_sec"), F.col("o_orderkey").alias("uid"), F.floor("o_totalprice").alias("len"), F.col("o_orderpriority").alias("note"))


def order_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.col("o_custkey").alias("host"), seconds("l_shipdate").alias("sec"), F.col("l_returnflag").alias("label"))
