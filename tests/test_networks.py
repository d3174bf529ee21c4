"""Addresses, networks and schedules of networks against the ipaddress module."""

import ipaddress
import random

from pyspark.sql import functions as F

from flowlens.operators import networks

ADDRESSES = ["1.2.3.4", "255.255.255.255", "256.1.1.1", "01.2.3.4", "1.2.3", "", None, "::", "::1", "fe80::1", "FE80::A:1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", "1:2:3:4:5:6:7:8:9", "::ffff:1.2.3.4", "::ffff:1.2.3.400", "12345::", "g::", "fe80::1%eth0", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", " 10.0.0.1 ", "text", "1.2.3.4:80", ":1", "1:"]


def parsed(text):
    try:
        a = ipaddress.ip_address((text or "").strip())
    except ValueError:
        return None
    return None if "%" in text else f"{a.version}{int(a):0{a.max_prefixlen}b}"


def test_address_bits(spark):
    rng = random.Random(1)
    rows = [*ADDRESSES, *[str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128))) for _ in range(60)], *[str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(30)]]
    got = {r.a: r.b for r in spark.createDataFrame([(t,) for t in rows], "a string").select("a", networks.address_bits("a").alias("b")).collect()}
    assert got == {t: parsed(t) for t in rows}


RULES = [
    (0, "d1", "A", "10.0.0.0/22; bad;2001:db8::/33", "192.168.0.0/29", 100, 200, "any", "drop"),
    (1, "d1", "B", "10.0.1.7", "192.168.0.0/16;::1", 150, 400, "fwd", "benign"),
    (2, "d2", "C", "0.0.0.0/0", "192.168.0.1/32", 0, 50, "fwd", "drop"),
    (3, "d2", "D", "::/0", "::/0;0.0.0.0/0", 300, 310, "any", "benign"),
]


def brute(row, pad):
    _, src, dst, day, t = row

    def inside(a, nets):
        try:
            a = ipaddress.ip_address(a)
        except ValueError:
            return False
        for n in nets.split(";"):
            try:
                n = ipaddress.ip_network(n.strip(), strict=False)
            except ValueError:
                continue
            if a.version == n.version and a in n:
                return True
        return False

    drop = False
    for rule, d, label, a, v, start, end, direction, outside in RULES:
        pair = inside(src, a) and inside(dst, v) or direction == "any" and inside(dst, a) and inside(src, v)
        if d != day or not pair:
            continue
        if start - pad <= t < end + 60 + pad:
            return label, rule, not start <= t < end + 60, False
        drop |= outside == "drop"
    return "Benign", None, False, drop


def test_labels_by_networks(spark):
    rng = random.Random(3)
    pool = ["10.0.1.7", "10.0.3.255", "10.0.4.0", "192.168.0.1", "192.168.0.9", "192.168.0.7", "2001:db8::5", "2001:db8:8000::5", "::1", "", "bad"]
    rows = [(i, rng.choice(pool), rng.choice(pool), rng.choice(["d1", "d2", "d3"]), rng.randrange(0, 500)) for i in range(900)]
    flows = spark.createDataFrame([*rows, (1000, None, None, None, None)], "id long, src string, dst string, day string, t long").repartition(3)
    rules = spark.createDataFrame(RULES, "rule int, day string, label string, attacker string, victim string, start long, end long, direction string, outside string")
    out = networks.label_by_networks(flows, rules, "src", "dst", "day", "t", "id", 20)
    got = {r.id: (r.label, r.rule, r.pad_zone, r.dropped) for r in out.collect()}
    assert len(got) == 901 and got.pop(1000) == ("Benign", None, False, False)
    assert got == {r[0]: brute(r, 20) for r in rows} and len({v[0] for v in got.values()}) == 5
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    audit = {r.rule: r for r in networks.build_audit(out.withColumn("alerted", F.col("id") % 2 == 0), rules, "t", "day", "alerted").collect()}
    assert {k: audit[k].flows for k in range(4)} == {k: sum(v[1] == k for v in got.values()) for k in range(4)}
    kept, dropped = networks.day_build(out.withColumn("alerted", F.lit(False)), "t", "id", "alerted")
    assert dropped.count() == sum(v[3] for v in got.values()) and kept.count() + dropped.count() == 901
    assert networks.label_by_networks(flows.limit(0), rules, "src", "dst", "day", "t", "id").count() == 0
