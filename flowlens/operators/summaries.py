"""Tables that a study reports: window alerts, alert volumes, fusion variants, selection, questionnaires, checks of hypotheses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators import metrics
from flowlens.operators.quantiles import quantiles
from flowlens.sources.scratch import written


def _hours(time: str) -> Column:
    return (F.max(time) - F.min(time)) / 3600


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def window_alerts(val: DataFrame, test: DataFrame, role: str, day: str, time: str, score: str, y: str, label: str, q: float = 0.01, width: int = 600) -> tuple[DataFrame, DataFrame]:
    """Alerts for windows of a role instead of single flows: a row of rates, and the share of each attack's flows in alerted windows.

    A flow is flagged above the (1 - q) quantile of validation scores; a window scores -ln P(Binomial(n, q) >= flagged) and
    alerts above the (1 - q) quantile of validation windows. A window with an attack row is an attack window; any_* are
    the rates of windows with any flagged flow. Test windows are told apart by day. Rows without a score count as not
    flagged; rows without a time, role or day in no window. Empty denominators give 0, no hours null.
    """
    limit = quantiles(val, score, {"_limit": 1 - q}, []).select("_limit")  # one row

    def windows(df: DataFrame, keys: list[str]) -> DataFrame:
        placed = df.withColumn("_w", F.floor(F.col(time) / width)).dropna(subset=[role, "_w", *keys]).crossJoin(F.broadcast(limit))
        hit = F.coalesce(F.col(score) > F.col("_limit"), F.lit(False))
        counted = placed.groupBy(role, *keys, "_w").agg(F.count("*").alias("_size"), F.count_if(hit).alias("_hits"), F.max(F.coalesce(F.col(y), F.lit(0)) if y in df.columns else F.lit(0)).alias("_y"))
        return metrics.binomial_tail(counted, "_hits", "_size", q, "_score")

    of_val = written(windows(val, []), "windows")
    alarm = quantiles(of_val, "_score", {"_alarm": 1 - q}, []).select("_alarm", F.col("n").alias("val_windows"))
    w = windows(test, [day]).crossJoin(F.broadcast(alarm))
    w = written(w.withColumns({"_alert": F.coalesce(F.col("_score") > F.col("_alarm"), F.lit(False)), "_any": F.col("_hits") > 0, "_att": F.col("_y") == 1}), "windows")
    hours = test.dropna(subset=[day, time]).groupBy(day).agg(_hours(time).alias("_h")).agg(F.sum("_h").alias("_h"))
    n = lambda c: F.count_if(c)
    att, ben = n(F.col("_att")), n(~F.col("_att"))
    sums = w.agg(*[x.alias(c) for kind, c in (("_alert", ""), ("_any", "any_")) for c, x in ((f"{c}window_fpr", _share(n(F.col(kind) & ~F.col("_att")), ben)), (f"{c}window_recall", _share(n(F.col(kind) & F.col("_att")), att)), (f"_{c}fp", n(F.col(kind) & ~F.col("_att"))))], ben.alias("benign_test_windows"), att.alias("attack_test_windows"))
    rates = sums.crossJoin(F.broadcast(hours)).crossJoin(F.broadcast(alarm.select("val_windows")))  # one row each
    per_hour = {f"{c}false_alerts_per_h": F.col(f"_{c}fp") / F.nullif(F.col("_h"), F.lit(0)) for c in ("", "any_")}
    rates = rates.withColumns(per_hour).drop("_fp", "_any_fp", "_h")
    flows = test.where(F.col(y) == 1).withColumn("_w", F.floor(F.col(time) / width)).join(w.select(role, day, "_w", "_alert"), [role, day, "_w"], "left")
    return rates, flows.groupBy(label).agg(F.count("*").alias("n"), F.avg(F.coalesce("_alert", F.lit(False)).cast("double")).alias("covered"))


def alert_volume(alerts: DataFrame, attacker: Column, category: str, signature: str, time: str, top: int = 15) -> DataFrame:
    """Volume of alerts off the attackers: side (all), kind (total, category, signature), name, n and per_hour over the span of all alerts.

    Totals are given for both sides, categories whole, signatures as the `top` most frequent (ties: by name), as a report
    has them. A null source is not an attacker's; null names stay as a name of their own. Without a span per_hour is null.
    """
    side = F.when(F.coalesce(attacker, F.lit(False)), "attacker").otherwise("background")
    counted = written(alerts.groupBy(side.alias("side"), F.col(category).alias("_c"), F.col(signature).alias("_s")).agg(F.count("*").alias("n"), F.min(time).alias("_lo"), F.max(time).alias("_hi")), "volume")
    span = counted.agg(F.nullif((F.max("_hi") - F.min("_lo")) / 3600, F.lit(0.0)).alias("_h"))

    def by(kind: str, name: Column, rows: DataFrame) -> DataFrame:
        return rows.groupBy("side", F.lit(kind).alias("kind"), name.alias("name")).agg(F.sum("n").alias("n"))

    back = counted.where("side = 'background'")
    frequent = by("signature", F.col("_s"), back).orderBy(F.desc("n"), "name").limit(top)
    out = by("total", F.lit(None).cast("string"), counted).unionByName(by("category", F.col("_c"), back)).unionByName(frequent)
    return out.crossJoin(F.broadcast(span)).withColumn("per_hour", F.col("n") / F.col("_h")).drop("_h")


def benign_day_alerts(flows: DataFrame, alerted: Column, time: str) -> DataFrame:
    """Signature alerts on a day without attacks, all of them false: flows, alerted_flows, alerted_share, alerted_flows_per_hour (null without a span)."""
    hit = F.coalesce(alerted, F.lit(False))
    out = flows.agg(F.count("*").alias("flows"), F.count_if(hit).alias("alerted_flows"), F.avg(hit.cast("double")).alias("alerted_share"), _hours(time).alias("_h"))
    return out.withColumn("alerted_flows_per_hour", F.col("alerted_flows") / F.nullif(F.col("_h"), F.lit(0.0))).drop("_h")


def volume_per_hour(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """detector, n, hours and per_hour of the false alarms of several detectors. sources: rows with `alarm` (boolean) and the time column, whose span is the detector's."""
    rows = [df.agg(F.count_if("alarm").alias("n"), _hours(t).alias("hours")).select(F.lit(name).alias("detector"), "n", "hours", (F.col("n") / F.nullif(F.col("hours"), F.lit(0.0))).alias("per_hour")) for name, (df, t) in sources.items()]
    return reduce(DataFrame.unionByName, rows)


def z_fusion(scores: DataFrame, row_id: str, member: str, score: str, is_val: str) -> DataFrame:
    """Robust z-scores of several detectors, against the validation rows of each, fused: row_id, variant (mean, max, without <member>), score.

    The scale is 1.4826 times the median deviation plus 1e-9. A row's missing members are left out of its means. Rows of
    a member without validation scores get no z. members: few, they become the variants.
    """
    val = scores.where(F.col(is_val) & F.col(score).isNotNull())
    med = quantiles(val, score, {"_med": 0.5}, [member]).drop("n")  # a row for each member
    off = quantiles(val.join(F.broadcast(med), member).withColumn("_d", F.abs(F.col(score) - F.col("_med"))), "_d", {"_dev": 0.5}, [member]).drop("n")
    stats = written(med.join(off, member), "members")
    z = scores.join(F.broadcast(stats), member).withColumn("_z", (F.col(score) - F.col("_med")) / (1.4826 * F.col("_dev") + 1e-9)).where("_z IS NOT NULL")
    names = sorted(r[member] for r in stats.select(member).collect())
    parts = [F.struct(F.lit("mean").alias("variant"), F.col("_mean").alias("score")), F.struct(F.lit("max").alias("variant"), F.col("_max").alias("score"))]
    wide = z.groupBy(row_id).agg(F.avg("_z").alias("_mean"), F.max("_z").alias("_max"), *[F.avg(F.when(F.col(member) != m, F.col("_z"))).alias(f"_without_{i}") for i, m in enumerate(names)])
    parts += [F.struct(F.lit(f"without {m}").alias("variant"), F.col(f"_without_{i}").alias("score")) for i, m in enumerate(names)]
    return wide.select(row_id, F.explode(F.array(*parts)).alias("_p")).select(row_id, "_p.variant", "_p.score").where("score IS NOT NULL")


def best_with_ties(candidates: DataFrame, first: str, second: str, name: str, tie: float = 0.005, groups: list[str] | None = None) -> DataFrame:
    """The candidate of each group with the largest `first`; of those less than `tie` below it, the one with the largest `second` (then by name). Candidates without `first` are out."""
    keys = groups or []
    top = F.max(first).over(Window.partitionBy(*keys))
    near = candidates.where(F.col(first).isNotNull()).withColumn("_top", top).where(F.col("_top") - F.col(first) < tie)
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(second), F.desc(first), name)
    return near.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_top", "_r")


def study_tables(responses: DataFrame, key: DataFrame, measures: list[str], ratings: list[str]) -> DataFrame:
    """A questionnaire's scores in one table: part (condition, truth, participant, rating), name, condition, measure, n, value.

    responses: participant, alert, form (1, 2), decision, category_answer, the measures and ratings. key, a row for each
    alert: alert, is_attack (0, 1), category, condition_form_1, condition_form_2. A decision is right if it starts with
    "attack" just when the alert is one. Measures `correct` and `category_correct` are added. Ratings are of condition B
    alone. Means leave nulls out; a null decision is a wrong one for an attack and right else, answers without a key go.
    """
    r = responses.join(F.broadcast(key), "alert")  # a questionnaire's alerts
    says = F.coalesce(F.lower(F.trim("decision")).startswith("attack"), F.lit(False)).cast("int")
    r = r.withColumns({"condition": F.when(F.col("form") == 1, F.col("condition_form_1")).otherwise(F.col("condition_form_2")), "correct": (says == F.col("is_attack")).cast("double")})
    r = r.withColumn("category_correct", F.coalesce(F.lower(F.trim("category_answer")) == F.lower("category"), F.lit(False)).cast("double"))

    def means(rows: DataFrame, part: str, name: Column, columns: list[str]) -> DataFrame:
        items = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns])
        long = rows.select(F.lit(part).alias("part"), name.cast("string").alias("name"), "condition", F.explode(items).alias("_m")).select("part", "name", "condition", "_m.*")
        return long.groupBy("part", "name", "condition", "measure").agg(F.count("v").alias("n"), F.avg("v").alias("value"))

    every = ["correct", "category_correct", *measures]
    tables = [means(r, "condition", F.lit(None), every), means(r, "truth", F.col("is_attack"), ["correct"]), means(r, "participant", F.col("participant"), every), means(r.where("condition = 'B'"), "rating", F.lit(None), ratings)]
    return reduce(DataFrame.unionByName, tables)


def hypothesis_checks(intervals: DataFrame, margin: float = 0.0) -> DataFrame:
    """Paired differences (name, diff, lo, hi) with supported (the interval lies above margin), refuted (below -margin) and result as text; intervals with a null end are neither."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    text = F.format_string("%+.3f [%+.3f, %+.3f]", "diff", "lo", "hi")
    return intervals.withColumns({"supported": ok(F.col("lo") > margin), "refuted": ok(F.col("hi") < -margin), "result": F.when(F.col("diff").isNotNull() & F.col("lo").isNotNull() & F.col("hi").isNotNull(), text)})


def datasets_side_by_side(tables: dict[str, DataFrame], key: str, measures: list[str]) -> DataFrame:
    """Metric tables of several datasets as one: key, dataset, the measures, and rank_<measure> (largest first) within the dataset; a dataset that lacks a measure has nulls."""
    rows = []
    for name, df in tables.items():
        rows.append(df.select(key, F.lit(name).alias("dataset"), *[(F.col(m).cast("double") if m in df.columns else F.lit(None).cast("double")).alias(m) for m in measures]))
    out = reduce(DataFrame.unionByName, rows)
    return out.withColumns({f"rank_{m}": F.when(F.col(m).isNotNull(), F.rank().over(Window.partitionBy("dataset").orderBy(F.desc_nulls_last(m)))) for m in measures})  # a row for each method


def split_profile(df: DataFrame, label: str, category: str, features: list[str], train: DataFrame | None = None, benign: str = "Benign") -> DataFrame:
    """Profile of a labelled part: rows, attack_rows, mismatch (label 1 and a benign category, or the reverse), padded (categories with blanks around), missing_cells, rows_with_missing, duplicate_rows, and with train the rows whose features occur there.

    Features compare by value, nulls alike, each row of this part once. A null category is no match for an attack's.
    """
    name = F.trim(category)
    attack, empty = F.coalesce(F.col(label) == 1, F.lit(False)), [F.col(c).isNull().cast("int") for c in features]
    base = df.agg(
        F.count("*").alias("rows"), F.count_if(attack).alias("attack_rows"), F.count_if(attack != F.coalesce(name != benign, F.lit(False))).alias("mismatch"), F.count_if(F.col(category) != name).alias("padded"),
        F.coalesce(F.sum(sum(empty, F.lit(0))), F.lit(0)).alias("missing_cells"), F.count_if(sum(empty, F.lit(0)) > 0).alias("rows_with_missing"),
    )
    counted = df.groupBy(*features).agg(F.count("*").alias("_n"))
    out = base.crossJoin(F.broadcast(counted.agg((F.coalesce(F.sum("_n"), F.lit(0)) - F.count("*")).alias("duplicate_rows"))))
    if train is None:
        return out
    named = [f"_t{i}" for i in range(len(features))]
    known = train.select(*[F.col(c).alias(t) for c, t in zip(features, named, strict=True)]).distinct()
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(t)) for c, t in zip(features, named, strict=True)])
    return out.crossJoin(F.broadcast(counted.join(known, same, "left_semi").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_seen_in_train"))))
