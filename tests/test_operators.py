"""Operators by hand-made cases and properties."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions import columns as C
from flowlens.operators import audit, clean, detectors, events, explain, features, joins, metrics, resample, scoring, split
from flowlens.sources import io


def test_aliases_keep_a_canonical_column(spark):
    df = spark.createDataFrame([(1, 2, 3)], [" Destination Port", "Dst Port", "Total Fwd Packets "])
    assert clean.canonical_columns(df).columns == ["Destination Port", "Dst Port", "Tot Fwd Pkts"]
    assert clean.canonical_columns(df.select(F.lit(1).alias("theirs")), {"theirs": "ours"}).columns == ["ours"]
    several = spark.createDataFrame([(1, 2, 3)], ["a", " b", "c"])
    assert clean.canonical_columns(several, {"a": "c", "b": "d"}).columns == ["a", "d", "c"]
    assert clean.canonical_columns(several.drop("c"), {"a": "d", "b": "d"}).columns == ["d", "b"]


def test_missing_columns_are_named(spark):
    with pytest.raises(clean.MissingColumns, match="'a' or 'b'") as e:
        clean.require_columns(spark.range(1), ["b", "a", "id"])
    assert e.value.names == ["a", "b"]
    with pytest.raises(clean.DataError):
        clean.require_rows({"rows": 0})


def test_rejection_gives_the_first_reason(spark):
    df = spark.createDataFrame([("1", "6", "80"), ("x", "6", "80"), ("inf", "6", "80"), ("1", "6", "70000"), ("-1", "6", "80"), ("1", "-6", "99999")], ["d", "p", "t"])
    got = [r.reason for r in df.select(clean.rejection(df, ["d", "p", "t"], "d", "p", "t").alias("reason")).collect()]
    assert got[0] is None and "'d'" in got[1] and "'d'" in got[2] and "outside" in got[3] and got[4] == "negative 'd'" and got[5] == "negative 'p'"


def test_roles():
    assert len(C.ROLE_NAMES) == 9 and set(C.ROLE_PORTS) == set(range(6))


def test_context_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, 1, rng.randrange(300), rng.choice([80, 443, 22]), rng.randrange(3)) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, day int, sec long, port int, s int")
    got = {r.row_id: r for r in features.add_context(df, "day", "sec", "port", ["s"]).collect()}
    t0 = min(r[2] for r in rows)
    for i, _, sec, port, s in rows[::10]:
        near = [r for r in rows if sec - 59 <= r[2] <= sec]
        own = [r for r in near if r[3] == port]
        assert got[i].ctx_flows_60s == len(near) and got[i].ctx_port_flows_60s == len(own)
        assert got[i].ctx_shape_60s == sum(r[4] == s for r in own)
        before = [r[2] for r in rows if r[3] == port and r[2] < sec]
        assert got[i].ctx_port_gap == (min(sec - max(before), 3600) if before else 3600)
        assert got[i].ctx_ports_10s == len({r[3] for r in rows if (r[2] - t0) // 10 == (sec - t0) // 10})


def test_space_drops_constant_columns(spark):
    df = spark.createDataFrame([(float(i), 3.0, float(i % 7)) for i in range(50)], ["a", "c", "b"])
    space = features.fit_space(df, {"m": ["a", "c"], "n": ["b"]}).orderBy("pos").collect()
    assert [r.name for r in space] == ["a", "b"] and features.slices(space) == {"m": (0, 1), "n": (1, 2)} and features.subset(space, ["n"]) == ([1], {"n": (0, 1)})
    assert all(abs(v) <= 8 for r in features.apply_space(df, space).collect() for v in r.x)


def test_splits(spark):
    with pytest.raises(clean.DataError):
        split.check_days(["Mon", "Tue"], ["Tue"])
    assert split.leave_one_out(["a", "b"]) == [("a", ["b"]), ("b", ["a"])]
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    a, b = (sorted(r.row_id for r in split.cap(df.repartition(n), 100, "row_id").collect()) for n in (2, 7))
    assert a == b and len(a) == 100


def test_min_p_keeps_the_target_rate(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.normal(size=4000), rng.lognormal(size=4000)))]
    df = spark.createDataFrame(rows, "row_id long, a double, b double")
    out = scoring.tail_score(scoring.tail_score(df, "a", df, "a", "ta"), "b", df, "b", "tb").withColumn("m", F.greatest("ta", "tb"))
    t = scoring.threshold(out, "m", 0.01).first()[0]
    assert 0.005 <= out.agg(F.avg((F.col("m") > t).cast("double"))).first()[0] <= 0.01


def test_tail_by_brute_force(spark):
    ref = [1.0, 2.0, 2.0, 5.0]
    df, r = spark.createDataFrame([(x,) for x in (0.0, 2.0, 3.0, 9.0)], "s double"), spark.createDataFrame([(x,) for x in ref], "r double")
    got = {x.s: x.t for x in scoring.tail_score(df, "s", r, "r", "t").collect()}
    assert all(math.isclose(t, -math.log((4 - sum(v <= s for v in ref) + 1) / 5), abs_tol=1e-12) for s, t in got.items())


def test_auc_and_average_precision(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(2), float(rng.randrange(8))) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    assert math.isclose(metrics.roc_auc(df, "y", "s").first()[0], want, abs_tol=1e-12)
    ap = sum(sum(p == t for p in pos) / len(pos) * sum(p >= t for p in pos) / sum(s >= t for _, s in rows) for t in {s for _, s in rows})
    assert math.isclose(metrics.average_precision(df, "y", "s").first()[0], ap, abs_tol=1e-12)


def test_incidents(spark):
    rows = [("d", "A", float(t), f) for t, f in ((0, False), (100, True), (1000, False), (1300, False), (2000, True))]
    got = metrics.incidents(spark.createDataFrame(rows, "day string, label string, ts double, f boolean"), "day", "label", "ts", "f", 300).orderBy("start").collect()
    assert [(r.start, r.n_rows, r.detected, r.seconds_to_detect) for r in got] == [(0, 2, True, 100), (1000, 2, False, None), (2000, 1, True, 0)]


def test_binomial_tail(spark):
    got = {(r.k, r.n): r.s for r in metrics.binomial_tail(spark.createDataFrame([(0, 5), (1, 1), (3, 10)], "k long, n long"), "k", "n", 0.1, "s").collect()}
    exact = sum(math.comb(10, i) * 0.1**i * 0.9 ** (10 - i) for i in range(3, 11))
    assert got[(0, 5)] == 0 and math.isclose(got[(1, 1)], -math.log(0.1)) and math.isclose(got[(3, 10)], -math.log(exact))


def test_as_of_and_band(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 4), (3, "b", 9)], "i int, k string, t long")
    right = spark.createDataFrame([("a", 5, 1), ("a", 10, 2), ("a", 10, 3), ("a", 11, 4)], "k string, rt long, v int")
    assert {r.i: r.v for r in joins.as_of(left, right, ["k"], "t", "rt", ["v"]).collect()} == {1: 3, 2: None, 3: None}
    assert {(r.i, r.v) for r in joins.within(left, right, ["k"], "t", "rt", 1).collect()} == {(1, 2), (1, 3), (1, 4), (2, 1)}


def test_addresses(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("256.1.1.1",), ("::1",), (None,)], "a string")
    assert [r[0] for r in df.select(joins.ipv4("a")).collect()] == [16909060, None, None, None]
    assert joins.cidr_ranges("10.0.0.0/30; bad ;2001:db8::/32;1.1.1.1") == [(167772160, 167772163), (16843009, 16843009)]


def test_isolation_forest_and_pca_find_outliers(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(600, 2))
    x = np.c_[z, z @ rng.normal(size=(2, 4)) + rng.normal(0, 0.05, (600, 4))]
    x[-30:] += rng.normal(0, 6, (30, 6))
    df = spark.createDataFrame([(i, v.tolist(), int(i >= 570)) for i, v in enumerate(x)], "row_id long, x array<double>, y int")
    forest = detectors.fit_isolation_forest(df.where("y = 0"), "row_id", 40, 128)
    assert metrics.roc_auc(detectors.score_isolation_forest(df, forest, 128), "y", "score").first()[0] > 0.9
    mean, parts = detectors.fit_pca(df.where("y = 0"), 6)
    assert len(parts) < 6 and metrics.roc_auc(detectors.score_pca(df, mean, parts), "y", "score").first()[0] > 0.9
    near = detectors.latent_distance(df.withColumn("role", F.lit(0)), detectors.fit_references(df.where("y = 0").withColumn("role", F.lit(0)), "role", "row_id", 300, 300, 50), "role", "row_id")
    assert metrics.roc_auc(near.join(df, "row_id"), "y", "score").first()[0] > 0.9


def test_encoder_gradient_is_exact():
    rng = np.random.default_rng(0)
    slices = {"a": (0, 3), "b": (3, 5)}
    w = detectors.init_encoder(slices, 3, 6, 4, 1)
    x, role = rng.normal(size=(7, 5)), rng.integers(0, 3, 7)
    masked = np.where(rng.random(x.shape) < 0.2, 0, x)
    _, g = detectors.loss_and_gradient(w, slices, x, masked, role, 0.5)
    for k in w:
        ix = tuple(rng.integers(0, s) for s in w[k].shape)
        old, e = w[k][ix], 1e-5
        w[k][ix] = old + e
        up = detectors.loss_and_gradient(w, slices, x, masked, role, 0.5)[0]
        w[k][ix] = old - e
        down = detectors.loss_and_gradient(w, slices, x, masked, role, 0.5)[0]
        w[k][ix] = old
        assert abs((up - down) / (2 * e) - g[k][ix]) < 1e-6, k


def test_encoder_training_lowers_the_loss(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(400, 2))
    x = np.tanh(z @ rng.normal(size=(2, 6)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, x array<double>").repartition(2)
    slices = {"a": (0, 3), "b": (3, 6)}
    w, history = detectors.train_encoder(df, slices, "row_id", epochs=8, batch=64, rate=1e-2)
    assert history[-1] < 0.8 * history[0]
    out = detectors.encode(df, w, slices).first()
    assert len(out.feat_err) == 6 and math.isclose(out.rec, sum(out.feat_err) / 6)


def test_shapley_identities(spark):
    rng = np.random.default_rng(0)
    df = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, x array<double>")
    a, b, w = rng.normal(size=(3, 6)), rng.normal(size=(20, 6)), rng.normal(size=6)
    slices = {"p": (0, 2), "q": (2, 4), "r": (4, 6)}
    got = {(r.id, r.modality): r.value for r in explain.group_shapley(df(a), df(b), lambda m: m @ w, slices).collect()}
    for i in range(3):
        for k, (lo, hi) in slices.items():
            assert math.isclose(got[(i, k)], ((a[i] - b.mean(0)) * w)[lo:hi].sum(), abs_tol=1e-9)
    walk = {(r.id, r.feature): r.value for r in explain.permutation_shapley(df(a), df(b[:1]), lambda m: m @ w, 6, 5).collect()}
    assert all(math.isclose(walk[(i, f)], (a[i, f] - b[0, f]) * w[f], abs_tol=1e-9) for i in range(3) for f in range(6))
    near = {(r.id, r.feature): r.value for r in explain.local_surrogate(df(a), df(b[:1]), lambda m: m @ w, 6, 400, 1e-6).collect()}
    assert all(math.isclose(near[(i, f)], (a[i, f] - b[0, f]) * w[f], abs_tol=1e-3) for i in range(3) for f in range(6))
    drop = {r.id: r for r in explain.deletion(df(a), spark.createDataFrame([(0, [0, 1])], "id long, top array<int>"), [0.0] * 6, lambda m: np.abs(m).sum(1), 2).collect()}
    assert math.isclose(drop[0]["drop"], np.abs(a[0, :2]).sum() / np.abs(a[0]).sum())


def test_explanations_tables(spark):
    v = spark.createDataFrame([(1, "a", 3.0), (1, "b", -4.0), (1, "c", 0.5)], "id long, feature string, value double")
    assert explain.top_features(v, 2).first().top == ["b", "a"]
    assert explain.agreement(v, v, 2).first().agreement == 1
    assert math.isclose(explain.rank_correlation(v, v).first().spearman, 1)
    share = {r.modality: r.share for r in explain.modality_share(v, spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "n")], "feature string, modality string")).collect()}
    assert math.isclose(share["m"], 7 / 7.5)
    rows = spark.createDataFrame([(1, 2, "a", 99.0), (1, 2, "c", 1.0)], "id long, role int, feature string, raw double")
    base = spark.createDataFrame([(None, "a", 5.0, 1.0, 9.0), (2, "a", 6.0, 2.0, 10.0), (None, "c", 5.0, 1.0, 9.0)], "role int, feature string, typical double, p5 double, p95 double")
    found = explain.evidence(v, rows, base, explain.top_features(v, 2))
    got = {r.feature: r for r in found.collect()}
    assert got["a"].typical == 6 and got["a"].stable and not got["c"].stable
    groups = spark.createDataFrame([("a", "high", "flood")], "feature string, direction string, hypothesis string")
    alerts = spark.createDataFrame([(1, 9.0, 2.0, 3, False)], "id long, score double, threshold double, severity int, has_signature boolean")
    r = explain.report(alerts, found, explain.hypotheses(found, groups)).first()
    assert (r.priority, r.verdict, r.confidence, r.hypotheses) == ("MEDIUM", "anomaly_only", "medium", ["flood"])
    rules = spark.createDataFrame([(1, "scan", "probing"), (2, "web", "web attack")], "order int, keyword string, meaning string")
    sig = spark.createDataFrame([("ET SCAN web", "x"), ("other", "y")], "n string, c string")
    assert {r.n: r.meaning for r in explain.signature_meaning(sig, "n", "c", rules).collect()}["ET SCAN web"] == "probing"


def test_event_assembly(spark):
    recs = [
        {"event_type": "dns", "flow_id": 1, "dns": {"version": 3, "type": "request", "queries": [{"rrname": "a.example", "rrtype": "A"}]}},
        {"event_type": "dns", "flow_id": 1, "dns": {"version": 3, "type": "response", "rcode": "NXDOMAIN", "answers": [{"rrname": "a", "ttl": 7}]}},
        {"event_type": "alert", "flow_id": 1, "alert": {"signature_id": 2200003}},
        {"event_type": "tls", "flow_id": 1, "tls": {"version": "TLS 1.2", "sni": "abc", "subject": "s", "issuerdn": "s", "notbefore": "2020-01-01T00:00:00", "notafter": "2020-01-31T00:00:00"}},
        {"event_type": "flow", "flow_id": 1, "proto": "TCP", "src_ip": "1.1.1.1", "src_port": 5, "dest_ip": "2.2.2.2", "dest_port": 80, "flow": {"pkts_toserver": 4, "bytes_toserver": 100, "pkts_toclient": 0, "state": "closed", "reason": "timeout"}, "tcp": {"tcp_flags": "1b", "tcp_flags_ts": "1b", "tcp_flags_tc": "02"}},
        {"event_type": "http", "flow_id": 1, "http": {"http_method": "GET"}},
        {"event_type": "alert", "flow_id": 2, "alert": {"signature_id": 2000001}},
        {"event_type": "flow", "flow_id": 2, "proto": "UDP", "flow": {}},
        {"event_type": "stats", "stats": {"decoder": {"pkts": 12}}},
    ]
    e = events.parse_events(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(recs)], "seq long, value string"))
    got = {r.flow_id: r for r in events.assemble(e).collect()}
    one = got[1]
    assert one.event_types == ["flow", "dns", "dns", "tls"] and not one.alerted and one.n_engine_alerts == 1 and got[2].alerted
    assert (one.flow_key, one.n_dns_query, one.n_dns_answer, one.dns_nxdomain, one.dns_name_len, one.dns_ttl_min) == ("1.1.1.1-5-2.2.2.2-80-6", 1, 1, 1, 9, 7)
    assert (one.ts_fin, one.ts_syn, one.ts_rst, one.ts_ack, one.tc_syn, one.tls_v12, one.tls_self_signed, one.tls_valid_days, one.n_http) == (1, 1, 0, 1, 1, 1, 1, 30, 0)
    assert (one.bytes_per_pkt_ts, one.bytes_per_pkt_tc, one.dir_ratio) == (25, 0, 1 / 101)
    assert tuple(events.orphans(e).first()) == (1, 0) and events.last_counters(e).first().decoder_pkts == 12
    log = events.parse_log(spark.createDataFrame([("event_type: flow, flow_age: 3 ; event_type: dns, dns_id: 4",)], ["log"])).first()
    assert log.events == [{"event_type": "flow", "flow_age": "3"}, {"event_type": "dns", "dns_id": "4"}]


def test_bootstrap(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), 1, int(i) * 30, int(y), float(rng.normal(2.0 * y))) for i, y in enumerate(rng.integers(0, 2, 1500))]
    df = spark.createDataFrame(rows, "row_id long, day int, sec long, y int, s double")
    r = resample.interval(resample.bootstrap_auc(df, "day", "sec", "y", "s", None, 600, 60, 400), "roc_auc", []).first()
    assert r.low < metrics.roc_auc(df, "y", "s").first()[0] < r.high and r.defined == 60
    w = resample.block_weights(df.select("day", F.floor(F.col("sec") / 600).alias("b")).distinct(), "day", "b", 5)
    assert {x[1] for x in w.groupBy("resample").agg(F.sum("weight")).collect()} == {75}


def test_audit(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, label string")
    with pytest.raises(ValueError, match="aligned"):
        audit.check_aligned(a, a.where("k = 1"), "k", "label")
    audit.check_aligned(a, a, "k", "label")
    assert audit.suspicious_names(["src_ip", "bytes", "label_code"]) == ["src_ip", "label_code"]
    assert audit.suspicious_names([*audit.IDENTIFIERS, *audit.LABEL_LIKE, "n_bytes"]) == [*audit.IDENTIFIERS, *audit.LABEL_LIKE]


def test_sources(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("a, Label \n1,x\n")
    assert io.read_flow_csv(spark, str(p), ["Label"]).first().asDict() == {"a": "1", "Label": "x"}
    assert io.read_first(spark, [str(tmp_path / "no.csv"), str(p)]).count() == 1
    z = tmp_path / "conn.log"
    z.write_text("#separator x\n#fields\tts\tuid\n1.5\tC1\n2.5\t-\n#close\n")
    assert [tuple(r) for r in io.read_zeek(spark, str(z)).collect()] == [("1.5", "C1"), ("2.5", None)]
    s = tmp_path / "s.csv"
    s.write_text("day,label,attacker,victim,start,end,direction,outside_window\nMon,A,1.1.1.1,2.2.2.2,09:00,10:00,sideways,keep\n")
    with pytest.raises(clean.DataError, match="sideways"):
        io.load_schedule(spark, str(s), ["Mon"])
    with pytest.raises(clean.DataError):
        io.column_map("[1]")
    t = tmp_path / "t.csv"
    t.write_bytes("Source IP, Label\n1.1.1.1,caf\xe9\n2.2.2.2,\n".encode("latin-1"))
    assert [tuple(r) for r in io.read_traffic_labels(spark, str(t), ["Source IP", "Label"]).collect()] == [("1.1.1.1", "café")]
    made = []
    make = lambda: (made.append(1), spark.range(3))[1]
    assert io.cached_day(spark, f"{tmp_path}/cache", "Mon", make).count() == io.cached_day(spark, f"{tmp_path}/cache", "Mon", make).count() == 3 and made == [1]
    io.save_bundle(spark, f"{tmp_path}/b", {"refs": spark.range(5)}, {"threshold": 2})
    tables, about = io.load_bundle(spark, f"{tmp_path}/b")
    assert tables["refs"].count() == 5 and about == {"threshold": 2}
    spark.range(6).write.mode("overwrite").parquet(f"{tmp_path}/b/refs")
    with pytest.raises(clean.DataError, match="checksum"):
        io.load_bundle(spark, f"{tmp_path}/b")


def test_batch_scoring(spark):
    from flowlens.operators import batch

    rng = np.random.default_rng(5)
    latent = rng.normal(size=(400, 2))
    x = np.exp(1 + 0.4 * latent @ rng.normal(size=(2, 4)) + 0.05 * rng.normal(size=(400, 4)))
    rows = [(i, *map(str, v.tolist()), "6", "80") for i, v in enumerate(x)]
    rows += [(1000 + i, *map(str, (x[i] * 100).tolist()), "6", "80") for i in range(10)] + [(2000, "x", "1", "1", "1", "6", "80"), (2001, "1", "1", "1", "1", "6", "70000")]
    df = spark.createDataFrame(rows, "row_id long, a string, b string, c string, d string, proto string, port string")
    num = clean.numeric(df.where("row_id < 400"), ["a", "b", "c", "d"]).withColumn("role", F.lit(0))
    for encoder in (None, {"epochs": 4, "batch": 64}):
        m = batch.fit_model(num.where("row_id < 300"), num.where("row_id >= 300"), {"p": ["a", "b"], "q": ["c", "d"]}, "role", "row_id", 0.05, encoder, 50)
        good, bad = batch.score_batch(df, m, "row_id", None, "proto", "port", None, 2)
        got = {r.row_id: r for r in good.collect()}
        assert len(got) == 410 and {r.row_id for r in bad.collect()} == {2000, 2001}
        assert all(got[1000 + i].alert and len(got[1000 + i].top_features) == 2 for i in range(10)) and sum(got[i].alert for i in range(400)) < 60
    x4 = num.withColumn("x", F.array("a", "b", "c", "d")).select("row_id", "x")
    assert math.isclose(batch.linear_cka(x4, x4, "row_id").first().cka, 1, abs_tol=1e-9)
    assert {r.modality: r.share for r in batch.batch_duplicates(x4.unionByName(x4), {"p": (0, 2)}, "row_id").collect()}["p"] == 1
    probe = batch.linear_probe(x4.withColumn("y", (F.col("x")[0] > 3).cast("int")), "y", "row_id").first().accuracy
    assert probe > 0.8
    step = batch.replaced(x4.where("row_id < 2").withColumnRenamed("row_id", "id"), spark.createDataFrame([(0, 5), (1, 6)], "id long, ref_id long"), x4.withColumnRenamed("row_id", "id"), spark.createDataFrame([(0, [1, 0]), (1, [2])], "id long, top array<int>"))
    s = explain.scored(step, lambda v: v.sum(1)).withColumn("threshold", F.lit(1e9))
    assert {r.id: r.counterfactual_size for r in batch.aopc(s).collect()} == {0: 0, 1: 0}
    assert 0 <= batch.pseudo_time(x4, "row_id").agg(F.min("ts")).first()[0] < 1


@pytest.mark.parametrize("n", [1, 3, 7, 400])
def test_nearest_sums(n):
    from flowlens.operators.detectors import nearest_sums

    rng = np.random.default_rng(n)
    x, m = np.round(rng.normal(size=(300, 3)), 1), np.round(rng.normal(size=(n, 3)), 1)  # many ties
    ids = rng.permutation(n)
    got, errors = nearest_sums(x, m, ids, 5)
    d = np.sqrt(((x[:, None] - m[None]) ** 2).sum(2))
    near = np.array([np.lexsort((ids, row))[:5] for row in d])
    assert np.allclose(got, np.take_along_axis(d, near, 1).mean(1)) and np.allclose(errors, ((x[:, None] - m[near]) ** 2).mean(1))


def test_seen_and_unseen_families(spark):
    from flowlens.operators import batch

    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=3) + [0, 0, 0]).tolist(), 0, None) for i in range(200)] + [(200 + i, (rng.normal(size=3) + [4 * (i % 2), 4 * (1 - i % 2), 0]).tolist(), 1, "ab"[i % 2]) for i in range(100)]
    df = spark.createDataFrame(rows, "row_id long, x array<double>, y int, family string")
    got = {(r.family, r.seen): r.roc_auc for r in batch.lofo(df, "family", ["a"], "row_id", trees=5).collect()}
    assert got[("a", True)] > 0.9 and set(got) == {("a", True), ("a", False)}


@pytest.mark.parametrize(("name", "score", "limit"), [("a02_shapley", lambda x: np.abs(x).sum(), 6.0), ("a04_surrogate", lambda x: x.sum(), 3.5)])
def test_every_alert_is_explained(spark, name, score, limit):
    from flowlens.plans import model_queries

    d = "/root/testdata/sf0.001"
    want = [r.row_id for r in model_queries.vectors(spark, d).collect() if score(np.array(r.x, float)) > limit]
    got = [(r.id, r.feature) for r in getattr(model_queries, name)(spark, d).collect()]
    assert want and sorted(got) == sorted((i, k) for i in want for k in range(4))
