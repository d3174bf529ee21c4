"""Column expressions: numbers, text, bins, roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Role names, the ports that name a role, and the limits of the other roles.
ROLE_NAMES = ["web", "remote_admin", "file_transfer", "name_directory", "mail", "database", "other_system", "registered", "ephemeral"]
ROLE_PORTS = {
    0: [80, 443, 8080, 8443, 8000, 8888],
    1: [22, 23, 3389, 5900],
    2: [20, 21, 69, 137, 138, 139, 445, 2049],
    3: [53, 67, 68, 88, 123, 389, 636, 5353],
    4: [25, 110, 143, 465, 587, 993, 995],
    5: [1433, 1521, 3306, 5432, 6379, 27017],
}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def role_from_port(port: str | Column) -> Column:
    """0 to 8: a listed port's role, else system, registered or ephemeral by range."""
    p = col(port)
    out = F
    for role, ports in ROLE_PORTS.items():
        out = out.when(p.isin(ports), role)
    return out.when(p >= 49152, 8).when(p >= 1024, 7).otherwise(6)


def role_of_endpoints(src: str | Column, dst: str | Column) -> Column:
    """The role of the smaller port."""
    return role_from_port(F.least(col(src), col(dst)))


def role_override(given: str | Column, derived: str | Column) -> Column:
    """A role name given by the caller wins; null keeps the derived role."""
    table = F.create_map(*[x for i, n in enumerate(ROLE_NAMES) for x in (F.lit(n), F.lit(i))])
    return F.coalesce(F.try_element_at(table, col(given)), col(derived))


def one_hot(c: str | Column, values: list, prefix: str, other: bool = True) -> dict[str, Column]:
    """A 0/1 column for each value, and one for all the rest."""
    out = {f"{prefix}_{v}": (col(c) == F.lit(v)).cast("double") for v in values}
    if other:
        out[f"{prefix}_other"] = F.lit(1.0) - sum(out.values(), F.lit(0.0))
    return out


def signed_log(c: str | Column) -> Column:
    return F.signum(col(c)) * F.log1p(F.abs(col(c)))


def clip(c: str | Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def unwrap_12h(sec: str | Column) -> Column:
    """Seconds of a 12-hour clock: hours before 8 belong to the afternoon."""
    return col(sec) + F.when(F.floor(F.pmod(col(sec), F.lit(86400)) / 3600) < 8, 43200).otherwise(0)


def clock_seconds(text: str | Column, day: str | Column) -> Column:
    """HH:MM:SS and a day's index as seconds."""
    p = F.split(col(text), ":")
    return col(day) * 86400 + p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int")


def finite(c: str | Column) -> Column:
    """The number, or null where it is NaN or infinite."""
    x = col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def number(c: str | Column) -> Column:
    """A text as a finite number, else null."""
    return finite(col(c).try_cast("double"))


def size_bin(c: str | Column, limits: tuple[int, ...] = (2, 5, 10, 100)) -> Column:
    """Right-closed bins: 1-2, 3-5, ..., >100."""
    out, low = F, 1
    for x in limits:
        out = out.when(col(c) <= x, f"{low}-{x}")
        low = x + 1
    return out.otherwise(f">{limits[-1]}")


def flow_parts(flow_id: str | Column) -> dict[str, Column]:
    """src, sport, dst, dport and proto of src-sport-dst-dport-proto, split from the right."""
    pattern = r"^(.*)-(\d*)-(.*)-(\d*)-(\w*)$"
    return {n: F.regexp_extract(col(flow_id), pattern, i + 1) for i, n in enumerate(("src", "sport", "dst", "dport", "proto"))}


def flag_bits(hex_text: str | Column) -> dict[str, Column]:
    """TCP flags of a hexadecimal byte."""
    v = F.conv(col(hex_text), 16, 10).cast("int")
    return {n: F.shiftright(v, i).bitwiseAND(F.lit(1)) for i, n in enumerate(("fin", "syn", "rst", "psh", "ack", "urg"))}


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: str | Column, b: str | Column) -> Column:
    def part(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.aggregate(F.zip_with(col(a), col(b), part), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def top_k_by_size(names: list[str], values: list[str], k: int) -> Column:
    """The k names with the largest absolute values, as structs name, value; ties by place."""
    items = F.array(*[F.struct((-F.abs(F.col(v))).alias("order"), F.lit(i).alias("place"), F.lit(n).alias("name"), F.col(v).alias("value")) for i, (n, v) in enumerate(zip(names, values, strict=True))])
    return F.transform(F.slice(F.array_sort(items), 1, k), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))


def jaccard(a: str | Column, b: str | Column) -> Column:
    return F.size(F.array_intersect(col(a), col(b))) / F.greatest(F.size(F.array_union(col(a), col(b))), F.lit(1))


#: The phrases for a value against its usual range.
WORDS = {"far": "far above normal", "above": "above normal", "well": "well below normal", "below": "below normal", "within": "normal alone, unusual in combination"}


def wording(value: str | Column, typical: str | Column, low: str | Column, high: str | Column) -> Column:
    """How a value lies against its usual range: far above if over ten times the typical value (or that is not positive), well below if under a tenth of a positive one."""
    v, t, lo, hi = map(col, (value, typical, low, high))
    above = F.when((t > 0) & (v / t <= 10), WORDS["above"]).otherwise(WORDS["far"])
    below = F.when((t > 0) & (v < t * 0.1), WORDS["well"]).otherwise(WORDS["below"])
    return F.when(v > hi, above).when(v < lo, below).otherwise(WORDS["within"])


def decimals(v: Column, n: int, grouped: bool = False) -> Column:
    """A number with n decimals, half to even; grouped: commas between thousands."""
    text = F.format_number(v, n)
    return text if grouped else F.translate(text, ",", "")


def format_unit(value: str | Column, unit: str) -> Column:
    """bytes, us, s, rate, flag, count or plain numbers as text."""
    v = col(value).cast("double")
    if unit == "bytes":
        text = F
        for name, size in (("GB", 1e9), ("MB", 1e6), ("KB", 1e3)):
            text = text.when(F.abs(v) >= size, F.concat(decimals(v / size, 1), F.lit(f" {name}")))
        return text.otherwise(F.concat(decimals(v, 0), F.lit(" B")))
    if unit in ("us", "s"):
        sec = v / 1e6 if unit == "us" else v
        return F.when(sec < 1, F.concat(decimals(sec * 1000, 0), F.lit(" ms"))).otherwise(F.concat(decimals(sec, 1), F.lit(" s")))
    if unit == "rate":
        return F.concat(decimals(v, 0, True), F.lit(" /s"))
    if unit == "flag":
        return F.when(v >= 0.5, "yes").otherwise("no")
    if unit == "count":
        return decimals(v, 0, True)
    return F.when(F.abs(v) < 100, decimals(v, 2, True)).otherwise(decimals(v, 0, True))


def order_of(c: str | Column, values: list[str]) -> Column:
    """A category's place in a list, for sorting; those that the list lacks come after it, nulls last."""
    place = F.array_position(F.array(*[F.lit(v) for v in values]), col(c))
    return F.when(place > 0, place).when(col(c).isNotNull(), len(values) + 1).otherwise(len(values) + 2)


def row_hash(columns: list[str], seed: int = 0) -> Column:
    """A number under 2 ** 60 from the MD5 of the columns' texts and the seed, joined by |; the same in any engine that has MD5. Nulls count as empty texts."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson's correlation as an aggregate; NaN where a side does not vary (F.corr raises there under ANSI), null without rows."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread == 0, float("nan")).otherwise(F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0)))
