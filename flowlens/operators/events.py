"""Sensor events: one parse of each JSON line, flows with their application events, and features of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.columns import flag_bits

#: Protocol numbers, event types of a flow, signatures of the sensor's own rules, and picked counters.
PROTOCOLS = {"TCP": 6, "UDP": 17, "ICMP": 1, "IPV6-ICMP": 58, "SCTP": 132}
APP_EVENTS = ["dns", "http", "fileinfo", "tls", "ssh", "ftp", "anomaly"]
ENGINE_SIDS = (2200000, 2299999)
COUNTERS = [("decoder", "pkts"), ("decoder", "invalid"), ("flow", "total"), ("flow", "memcap"), ("tcp", "ssn_memcap_drop"), ("tcp", "reassembly_gap"), ("detect", "alert"), ("detect", "alert_queue_overflow")]

SCHEMA = """event_type string, flow_id long, timestamp string, proto string, src_ip string, src_port int, dest_ip string, dest_port int,
 flow struct<pkts_toserver:double,pkts_toclient:double,bytes_toserver:double,bytes_toclient:double,start:string,end:string,age:double,state:string,reason:string>,
 tcp struct<tcp_flags:string,tcp_flags_ts:string,tcp_flags_tc:string,state:string>,
 dns struct<version:int,type:string,id:int,rrname:string,rrtype:string,rcode:string,queries:array<struct<rrname:string,rrtype:string>>,answers:array<struct<rrname:string,rrtype:string,ttl:double>>>,
 http struct<hostname:string,url:string,http_user_agent:string,http_refer:string,http_method:string,status:string,length:double>,
 fileinfo struct<size:double>, tls struct<version:string,sni:string,session_resumed:boolean,subject:string,issuerdn:string,notbefore:string,notafter:string>,
 ssh struct<client:struct<software_version:string>>, ftp struct<completion_code:array<string>>, anomaly struct<type:string>,
 alert struct<signature_id:long,signature:string,category:string,severity:int>, stats map<string,map<string,double>>"""


def parse_events(lines: DataFrame, line: str = "value", seq: str = "seq") -> DataFrame:
    """seq and the event's fields; a line that is no event has nulls. DNS version 3 records get the layout of version 2."""
    e = lines.select(seq, F.from_json(line, SCHEMA).alias("e")).select(seq, "e.*")
    q, v3 = F.try_element_at("dns.queries", F.lit(1)), F.coalesce(F.col("dns.version"), F.lit(2)) >= 3
    kind = F.when(v3, F.when(F.col("dns.type") == "request", "query").otherwise("answer")).otherwise(F.col("dns.type"))
    name, rrtype = F.when(v3, F.coalesce(q["rrname"], F.lit(""))).otherwise(F.col("dns.rrname")), F.when(v3, F.coalesce(q["rrtype"], F.lit(""))).otherwise(F.col("dns.rrtype"))
    return e.withColumn("dns", F.when(F.col("dns").isNotNull(), F.struct(kind.alias("type"), F.col("dns.id").alias("id"), name.alias("rrname"), rrtype.alias("rrtype"), F.col("dns.rcode").alias("rcode"), F.col("dns.answers").alias("answers"))))


def _as_text(schema: T.DataType) -> T.DataType:
    """The schema with texts in the place of numbers, so that they stay as they are written."""
    if isinstance(schema, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType)) for f in schema])
    if isinstance(schema, T.ArrayType):
        return T.ArrayType(_as_text(schema.elementType))
    return T.MapType(T.StringType(), _as_text(schema.valueType)) if isinstance(schema, T.MapType) else T.StringType()


def pairs(value: Column, kind: T.DataType, key: Column) -> Column:
    """`key: value` texts of a nested value: keys joined by _, list items by their place. The separators of the text form are taken out of values. Missing values have none."""
    if isinstance(kind, T.StructType):
        parts = [pairs(value[f.name], f.dataType, F.concat(key, F.lit(f"_{f.name}"))) for f in kind]
        return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.concat(*parts))
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x, i: pairs(x, kind.elementType, F.concat(key, F.lit("_"), i.cast("string"))))
        return F.coalesce(F.flatten(items), F.array().cast("array<string>"))
    text = F.replace(F.replace(value.cast("string"), F.lit(" ; "), F.lit(" ;")), F.lit(", "), F.lit(","))
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(key, F.lit(": "), text)))


#: Fields of a flow event that its text leaves out (the detector's decision and absolute times).
FLOW_DROP = ["alerted", "start", "end"]


def event_text(lines: DataFrame, line: str = "value", seq: str = "seq") -> DataFrame:
    """seq, flow_id, event_type and text (`event_type: flow, proto: TCP, flow_age: 3`) of the events that parse_log() reads: flow and application events. Fields come in the schema's order."""
    schema = _as_text(T.StructType.fromDDL(SCHEMA))
    e = lines.select(seq, F.from_json(line, schema).alias("e")).select(seq, "e.*").where(F.col("event_type").isin("flow", *APP_EVENTS))
    q, v3 = F.try_element_at("dns.queries", F.lit(1)), F.coalesce(F.col("dns.version").try_cast("int"), F.lit(2)) >= 3
    answer = F.col("dns.type") != "request"
    dns3 = F.struct(F.when(answer, "answer").otherwise("query").alias("type"), F.col("dns.id").alias("id"), F.coalesce(q["rrname"], F.lit("")).alias("rrname"), F.coalesce(q["rrtype"], F.lit("")).alias("rrtype"), F.when(answer, F.coalesce("dns.rcode", F.lit(""))).alias("rcode"), F.when(answer, F.col("dns.answers")).alias("answers"))
    e = e.withColumn("_dns3", F.when(v3, dns3))
    body = F.array().cast("array<string>")
    for name in APP_EVENTS:
        own = pairs(F.col(name), schema[name].dataType, F.lit(name))
        if name == "dns":
            own = F.when(v3, pairs(F.col("_dns3"), e.schema["_dns3"].dataType, F.lit(name))).otherwise(own)
        body = F.when(F.col("event_type") == name, own).otherwise(body)
    flow = schema["flow"].dataType
    kept = T.StructType([f for f in flow if f.name not in FLOW_DROP])
    proto = F.array(F.concat(F.lit("proto: "), F.coalesce("proto", F.lit(""))))
    flow_pairs = F.concat(proto, pairs(F.col("flow"), kept, F.lit("flow")), pairs(F.col("tcp"), schema["tcp"].dataType, F.lit("tcp")))
    body = F.when(F.col("event_type") == "flow", flow_pairs).otherwise(body)
    head = F.array(F.concat(F.lit("event_type: "), "event_type"))
    return e.select(seq, F.col("flow_id").cast("long").alias("flow_id"), "event_type", F.array_join(F.concat(head, body), ", ").alias("text"))


def with_flow(events: DataFrame, seq: str = "seq") -> DataFrame:
    """Events of flows with flow_seq: the place of the flow event that ends theirs, null if it never ends. Batch form of the assembly: an event belongs to the next flow event of its id."""
    later = Window.partitionBy("flow_id").orderBy(seq).rowsBetween(0, Window.unboundedFollowing)
    own = events.where(F.col("flow_id").isNotNull() & F.col("event_type").isin("flow", "alert", *APP_EVENTS))
    return own.withColumn("flow_seq", F.min(F.when(F.col("event_type") == "flow", F.col(seq))).over(later))


def flow_id_text() -> Column:
    number = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in PROTOCOLS.items() for x in (F.lit(k), F.lit(str(v)))]), F.upper("proto")), F.col("proto"))
    return F.concat_ws("-", "src_ip", F.coalesce("src_port", F.lit(0)).cast("string"), "dest_ip", F.coalesce("dest_port", F.lit(0)).cast("string"), number)


def is_engine() -> Column:
    return F.col("alert.signature_id").between(*ENGINE_SIDS)


def assemble(events: DataFrame, seq: str = "seq") -> DataFrame:
    """One row for each flow event: flow_key, event_types in order (flow first), alerted, signatures, n_engine_alerts, start, age and all features."""
    e = with_flow(events, seq).where("flow_seq IS NOT NULL")
    t = F.col("event_type")
    app = t.isin(APP_EVENTS)
    n = lambda c: F.count_if(c).cast("double")
    most = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("double")
    last = lambda c, of: F.coalesce(F.max_by(F.when(t == of, c), F.when(t == of, F.col(seq))), F.lit(0)).cast("double")
    one = lambda c: F.first(F.when(t == "flow", c), ignorenulls=True)
    value = lambda c: F.coalesce(one(F.col(c)), F.lit(0.0))
    is_text = lambda c, *v: F.coalesce(one(F.col(c).isin(*v).cast("double")), F.lit(0.0))
    query, answer = (t == "dns") & (F.col("dns.type") == "query"), (t == "dns") & (F.coalesce(F.col("dns.type"), F.lit("")) != "query")
    rr, method, status = F.col("dns.rrtype"), F.col("http.http_method"), F.col("http.status")
    ttl = F.array_min(F.transform(F.col("dns.answers"), lambda a: a["ttl"]))
    days = F.floor((F.unix_timestamp(F.try_to_timestamp("tls.notafter")) - F.unix_timestamp(F.try_to_timestamp("tls.notbefore"))) / 86400)
    aggs = {
        "flow_key": one(flow_id_text()), "src_ip": one(F.col("src_ip")), "dst_ip": one(F.col("dest_ip")), "start": one(F.col("flow.start")), "age": value("flow.age"),
        "event_types": F.concat(F.array(F.lit("flow")), F.transform(F.array_sort(F.collect_list(F.when(app, F.struct(F.col(seq), t.alias("t"))))), lambda x: x["t"])),
        "alerted": F.coalesce(F.bool_or((t == "alert") & ~F.coalesce(is_engine(), F.lit(False))), F.lit(False)), "n_engine_alerts": F.count_if((t == "alert") & is_engine()),
        "signatures": F.transform(F.array_sort(F.collect_list(F.when((t == "alert") & ~F.coalesce(is_engine(), F.lit(False)), F.struct(F.col(seq), F.col("alert").alias("a"))))), lambda x: x["a"]),
        "pkts_ts": value("flow.pkts_toserver"), "pkts_tc": value("flow.pkts_toclient"), "bytes_ts": value("flow.bytes_toserver"), "bytes_tc": value("flow.bytes_toclient"),
        "proto_tcp": is_text("proto", "TCP"), "proto_udp": is_text("proto", "UDP"), "proto_icmp": F.coalesce(one(F.col("proto").startswith("ICMP").cast("double")), F.lit(0.0)),
        **{f"state_{s}": is_text("flow.state", s) for s in ("new", "established", "closed")}, **{f"reason_{s}": is_text("flow.reason", s) for s in ("timeout", "forced", "shutdown")},
        "has_tcp": F.coalesce(one(F.col("tcp.tcp_flags").isNotNull().cast("double")), F.lit(0.0)), "tcp_closed": is_text("tcp.state", "closed"), "tcp_established": is_text("tcp.state", "established"),
        **{f"{d}_{b}": F.coalesce(one(c), F.lit(0)).cast("double") for d in ("ts", "tc") for b, c in flag_bits(f"tcp.tcp_flags_{d}").items()},
        "n_dns": n(t == "dns"), "n_dns_query": n(query), "n_dns_answer": n(answer), "dns_name_len": most(F.length("dns.rrname")),
        "dns_A": n(query & (rr == "A")), "dns_AAAA": n(query & (rr == "AAAA")), "dns_PTR": n(query & (rr == "PTR")), "dns_other_type": n(query & ~F.coalesce(rr, F.lit("")).isin("A", "AAAA", "PTR")),
        "dns_nxdomain": n(answer & (F.col("dns.rcode") == "NXDOMAIN")), "dns_servfail": n(answer & (F.col("dns.rcode") == "SERVFAIL")),
        "dns_n_answers": F.coalesce(F.sum(F.when(answer, F.size("dns.answers"))), F.lit(0)).cast("double"), "dns_ttl_min": F.coalesce(F.min(F.when(answer, ttl)), F.lit(0.0)),
        "n_http": n(t == "http"), "http_get": n(method == "GET"), "http_post": n(method == "POST"), "http_other_method": n(~method.isin("GET", "POST")),
        **{f"http_{c}xx": n(status.startswith(c)) for c in "2345"}, "http_url_len": most(F.length("http.url")), "http_host_len": most(F.length("http.hostname")), "http_ua_len": most(F.length("http.http_user_agent")),
        "http_has_referer": most(F.col("http.http_refer").isNotNull().cast("int")), "http_length": most(F.col("http.length")),
        "n_fileinfo": n(t == "fileinfo"), "fileinfo_size": most(F.col("fileinfo.size")),
        "has_tls": most((t == "tls").cast("int")), **{f"tls_v1{v}": last(F.col("tls.version").endswith(f"1.{v}").cast("int"), "tls") for v in (0, 1, 2)},
        "tls_sni_len": last(F.coalesce(F.length("tls.sni"), F.lit(0)), "tls"), "tls_resumed": last(F.coalesce(F.col("tls.session_resumed"), F.lit(False)).cast("int"), "tls"),
        "tls_self_signed": last(F.coalesce(F.col("tls.subject") == F.col("tls.issuerdn"), F.lit(False)).cast("int"), "tls"), "tls_valid_days": F.coalesce(F.max_by(days, F.when((t == "tls") & days.isNotNull(), F.col(seq))), F.lit(0)).cast("double"),
        "has_ssh": most((t == "ssh").cast("int")), "ssh_sw_len": last(F.coalesce(F.length("ssh.client.software_version"), F.lit(0)), "ssh"),
        "n_ftp": n(t == "ftp"), "ftp_err": n(F.try_element_at("ftp.completion_code", F.lit(1)).rlike("^[45]")), "n_anomaly": n(t == "anomaly"),
    }
    out = e.groupBy("flow_id", "flow_seq").agg(*[c.alias(k) for k, c in aggs.items()])
    big = F.lit(1.0)
    return out.withColumns({"bytes_per_pkt_ts": F.col("bytes_ts") / F.greatest("pkts_ts", big), "bytes_per_pkt_tc": F.col("bytes_tc") / F.greatest("pkts_tc", big), "dir_ratio": (F.col("bytes_tc") + 1) / (F.col("bytes_ts") + 1)})


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def last_counters(events: DataFrame, seq: str = "seq") -> DataFrame:
    """The picked counters of the last stats record."""
    stats = events.where("event_type = 'stats'").agg(F.max_by("stats", seq).alias("s"))
    return stats.select(*[F.try_element_at(F.try_element_at("s", F.lit(a)), F.lit(b)).alias(f"{a}_{b}") for a, b in COUNTERS])


def orphans(events: DataFrame, seq: str = "seq") -> DataFrame:
    """Flow ids with application events, and with alerts, that no flow event ends."""
    o = with_flow(events, seq).where("flow_seq IS NULL")
    return o.agg(F.count_distinct(F.when(F.col("event_type").isin(APP_EVENTS), F.col("flow_id"))).alias("flows"), F.count_distinct(F.when((F.col("event_type") == "alert") & ~is_engine(), F.col("flow_id"))).alias("alert_flows"))


def parse_log(df: DataFrame, log: str = "log") -> DataFrame:
    """df with events: a map for each event of the text form `k: v, k: v ; k: v`."""
    one = lambda x: F.str_to_map(x, F.lit(", (?=[a-z][a-z_0-9]*: )"), F.lit(": "))
    return df.withColumn("events", F.transform(F.split(log, " ; "), one))
