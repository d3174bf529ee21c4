"""Labels from a schedule of networks: addresses of both versions, longest lists, local clocks, as hash joins.

An address is the digit of its version and its bits, as text; a network is a prefix of that. Each distinct address
meets the networks by one hash join on its prefixes of the lengths that the schedule has, and flows meet the members
by hash joins on (address, day) and (address, rule): no row is compared with all rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from flowlens.functions.columns import col
from flowlens.sources.scratch import written


def _bits(number: Column, base: int, width: int) -> Column:
    return F.lpad(F.conv(number, base, 2), width, "0")


def address_bits(address: str | Column) -> Column:
    """'4' or '6' and the address's 32 or 128 bits; null for what is no address. IPv6 with :: and with an IPv4 tail is understood, zones are not."""
    text = F.lower(F.trim(col(address)))
    parts = F.split(text, r"\.")
    four = (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike(r"^(0|[1-9][0-9]{0,2})$") & (p.try_cast("int") <= 255))
    # An IPv4 tail becomes the last two groups.
    tail = F.split(F.regexp_extract(text, r":([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1), r"\.")
    octet = lambda i: F.lpad(F.lower(F.hex(F.get(tail, F.lit(i)).try_cast("int"))), 2, "0")
    good_tail = F.forall(tail, lambda p: p.rlike(r"^(0|[1-9][0-9]{0,2})$") & (p.try_cast("int") <= 255))
    long = F.when(text.rlike(r"\."), F.when((F.size(tail) == 4) & good_tail, F.concat(F.regexp_extract(text, r"^(.*:)[0-9.]+$", 1), octet(0), octet(1), F.lit(":"), octet(2), octet(3)))).otherwise(text)
    halves = F.split(long, "::")
    groups = lambda half: F.when(F.coalesce(half, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))
    left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    gap = F.lit(8) - F.size(left) - F.size(right)
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right)
    six = F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$")) & F.when(F.size(halves) == 2, gap >= 1).when(F.size(halves) == 1, gap == 0).otherwise(F.lit(False))
    return F.when(four, F.concat(F.lit("4"), F.array_join(F.transform(parts, lambda p: _bits(p, 10, 8)), ""))).when(F.coalesce(six, F.lit(False)) & text.contains(":"), F.concat(F.lit("6"), F.array_join(F.transform(whole, lambda g: _bits(g, 16, 16)), "")))


def network_prefixes(rules: DataFrame, networks: str, keep: list[str]) -> DataFrame:
    """keep and prefix: a row for each good entry of a ;-separated list of networks or addresses (bits after the length don't count); bad entries are skipped."""
    entry = rules.select(*keep, F.explode(F.split(networks, ";")).alias("_n")).withColumn("_n", F.trim("_n"))
    bits = address_bits(F.split_part("_n", F.lit("/"), F.lit(1)))
    size = F.split_part("_n", F.lit("/"), F.lit(2))
    most = F.length(bits) - 1
    length = F.when(~F.contains("_n", F.lit("/")), most).when(size.rlike("^[0-9]{1,3}$"), size.try_cast("int"))
    found = entry.select(*keep, bits.alias("_b"), F.when(length <= most, length).alias("_l")).where("_b IS NOT NULL AND _l IS NOT NULL")
    return found.select(*keep, F.expr("substr(_b, 1, _l + 1)").alias("prefix")).distinct()


def members(addresses: DataFrame, address: str, rules: DataFrame, networks: str, keep: list[str]) -> DataFrame:
    """The rows of distinct addresses (text) and rules such that an address is in one of the rule's networks: address, keep."""
    nets = written(network_prefixes(rules, networks, keep), "networks")
    lengths = nets.select(F.length("prefix").alias("_l"), F.substring("prefix", 1, 1).alias("_v")).distinct()  # at most 33 and 129 rows
    own = addresses.select(address, address_bits(address).alias("_b")).where("_b IS NOT NULL")
    placed = own.join(F.broadcast(lengths), F.substring("_b", 1, 1) == F.col("_v")).select(address, F.expr("substr(_b, 1, _l)").alias("prefix"))
    return placed.join(nets, "prefix").select(address, *keep).distinct()


def label_by_networks(flows: DataFrame, rules: DataFrame, src: str, dst: str, day: str, time: str, row_id: str, pad: int = 0, minute: int = 60) -> DataFrame:
    """flows with label, rule, pad_zone and dropped from a schedule of networks.

    rules: rule (order), day, label, attacker, victim (;-separated networks of either version), start, end (seconds;
    see joins.local_window() for a local clock), direction (any: both ways), outside (drop: rows of its pairs that no
    window of the day explains are dropped). A rule of the flow's day hits if start - pad <= time < end + minute + pad;
    the first wins. pad_zone: hit only thanks to pad. Rows without a hit are Benign; all rows return once if row_id is
    unique, those with null or odd addresses as Benign.
    """
    known = flows.select(row_id, F.col(src).alias("_s"), F.col(dst).alias("_d"), F.col(day).alias("_day"), F.col(time).alias("_t"))
    ends = written(known.select(F.col("_s").alias("_a")).union(known.select("_d")).distinct(), "addresses")
    a = written(members(ends, "_a", rules.withColumnRenamed("day", "_day"), "attacker", ["rule", "_day", "direction"]), "attackers")
    v = written(members(ends, "_a", rules, "victim", ["rule"]), "victims")

    def pairs(attacker: str, victim: str, who: DataFrame) -> DataFrame:
        near = known.join(who.withColumnRenamed("_a", attacker), [attacker, "_day"])
        return near.join(v.withColumnRenamed("_a", victim), [victim, "rule"]).select(row_id, "_t", "rule")

    both = pairs("_s", "_d", a).unionByName(pairs("_d", "_s", a.where("direction = 'any'"))).distinct()
    both = both.join(rules.select("rule", "label", "start", "end", F.col("outside")), "rule")
    t, start, end = F.col("_t"), F.col("start"), F.col("end") + minute
    hit, core = (t >= start - pad) & (t < end + pad), (t >= start) & (t < end)
    best = both.groupBy(row_id).agg(F.min(F.when(hit, F.struct("rule", F.col("label").alias("label"), (~core).alias("pad_zone")))).alias("_h"), F.max(F.col("outside") == "drop").alias("_drop"))
    out = flows.join(best, row_id, "left")
    return out.select(*flows.columns, F.coalesce("_h.label", F.lit("Benign")).alias("label"), F.col("_h.rule").alias("rule"), F.coalesce("_h.pad_zone", F.lit(False)).alias("pad_zone"), (F.col("_h").isNull() & F.coalesce("_drop", F.lit(False))).alias("dropped"))


def _top(df: DataFrame, by: list[str], item: list[str], k: int, text: Column) -> DataFrame:
    """by and top: the k items with most rows as text, by falling count and then by item. Each task keeps k items of a group before they meet."""
    n = df.groupBy(*by, *item).agg(F.count("*").alias("_n"))
    first = n.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_n"), *item))).where(F.col("_r") <= k)
    return first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", text.alias("t")))), lambda x: x["t"]), "; ").alias("top"))


def build_audit(labelled: DataFrame, rules: DataFrame, time: str, port: str, alerted: str) -> DataFrame:
    """For each rule: label, flows, in_pad, first and last (times), alerted_share and the four most frequent ports as `port:n`. labelled: of label_by_networks()."""
    hit = labelled.where("rule IS NOT NULL AND NOT dropped").drop("label")
    stats = hit.groupBy("rule").agg(F.count("*").alias("flows"), F.count_if("pad_zone").alias("in_pad"), F.min(time).alias("first"), F.max(time).alias("last"), F.avg(F.col(alerted).cast("double")).alias("alerted_share"))
    ports = _top(hit, ["rule"], [port], 4, F.concat_ws(":", F.col(port).cast("string"), F.col("_n").cast("string")))
    out = rules.select("rule", "label").join(stats, "rule", "left").join(ports, "rule", "left")
    return out.select("rule", "label", F.coalesce("flows", F.lit(0)).alias("flows"), F.coalesce("in_pad", F.lit(0)).alias("in_pad"), "first", "last", "alerted_share", F.col("top").alias("top_ports"))


def talkers(flows: DataFrame, rules: DataFrame, src: str, dst: str, day: str, time: str, row_id: str, k: int = 5, minute: int = 60) -> DataFrame:
    """For each rule the k most frequent pairs of ends among all flows of its day that touch a victim inside its window, as `a -> b: n`; rules without one are left out."""
    known = flows.select(F.col(row_id).alias("_id"), F.col(src).alias("_s"), F.col(dst).alias("_d"), F.col(day).alias("_day"), F.col(time).alias("_t"))
    ends = written(known.select(F.col("_s").alias("_a")).union(known.select("_d")).distinct(), "addresses")
    v = written(members(ends, "_a", rules.withColumnRenamed("day", "_day"), "victim", ["rule", "_day", "start", "end"]), "victims")
    inside = (F.col("_t") >= F.col("start")) & (F.col("_t") < F.col("end") + minute)
    touch = [known.join(v.withColumnRenamed("_a", side), [side, "_day"]).where(inside).select("rule", "_id", "_s", "_d") for side in ("_s", "_d")]
    both = touch[0].unionByName(touch[1]).distinct()  # a flow between two victims counts once
    return _top(both, ["rule"], ["_s", "_d"], k, F.concat(F.col("_s"), F.lit(" -> "), F.col("_d"), F.lit(": "), F.col("_n").cast("string"))).withColumnRenamed("top", "talkers")


def day_build(labelled: DataFrame, time: str, row_id: str, alerted: str) -> tuple[DataFrame, DataFrame]:
    """The table of a build, in order of time (ties by id): rows with a label, truth (is an attack), detected; and the dropped rows, for themselves."""
    kept = labelled.where("NOT dropped").withColumns({"truth": F.col("label") != "Benign", "detected": F.coalesce(F.col(alerted).cast("boolean"), F.lit(False))})
    return kept.orderBy(time, row_id), labelled.where("dropped").drop("label", "rule", "pad_zone", "dropped")
