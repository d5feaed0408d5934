"""Row and group features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rollcall.functions import spread
from rollcall.functions.scalar import array_mean, clip, ladder, moment


def feat_temporal(df: DataFrame, ts: str, epoch: str = "2020-01-01") -> DataFrame:
    """Hour, weekday (Monday 0), day, month, quarter, year, and flags for odd times."""
    h, d, wd = F.hour(ts), F.dayofmonth(ts), F.weekday(ts)
    flag = lambda c: c.cast("int")
    return df.withColumns({
        "hour": h, "day_of_week": wd, "day": d, "month": F.month(ts), "quarter": F.quarter(ts), "year": F.year(ts),
        "is_weekend": flag(wd >= 5), "is_business_hours": flag(h.between(9, 18)), "is_night": flag((h >= 22) | (h <= 5)),
        "is_month_end": flag(d >= 25), "is_month_start": flag(d <= 5),
        "days_since_epoch": F.datediff(F.col(ts).cast("date"), F.to_date(F.lit(epoch)))})


def feat_calendar(df: DataFrame, date: str) -> DataFrame:
    """True calendar month edges and days since the first date of the table."""
    out = spread.with_totals(df, F.min(date).alias("_first"))
    return out.withColumns({
        "is_month_end": (F.col(date) == F.last_day(date)).cast("int"),
        "is_month_start": (F.dayofmonth(date) == 1).cast("int"),
        "days_since_start": F.datediff(date, F.col("_first"))}).drop("_first")


def group_activity(df: DataFrame, key: str, prefix: str, distinct: str | None = None) -> DataFrame:
    """Rows per group, z over the groups (sample std) and distinct places, mapped back on the rows."""
    aggs = [F.count(F.lit(1)).alias(f"{prefix}_count")]
    if distinct:
        aggs.append(F.countDistinct(distinct).alias(f"{prefix}_{distinct}s"))
    g = spread.pin(df.groupBy(key).agg(*aggs))
    c = F.col(f"{prefix}_count")
    g = spread.with_totals(g, F.avg(c).alias("_m"), F.stddev_samp(c).alias("_s"))
    g = g.withColumn(f"{prefix}_z", (c - F.col("_m")) / F.nullif("_s", F.lit(0.0))).drop("_m", "_s")
    return spread.join_stats(df, g, [key])


def feat_id_updates(df: DataFrame, key: str, p: float = 0.95) -> DataFrame:
    """Updates per id and a flag above the p95 of the id counts."""
    g = spread.pin(df.groupBy(key).agg(F.count(F.lit(1)).alias("id_updates")))
    cut = spread.quantiles(g, ["id_updates"], [p])
    g = spread.with_global(g, cut).withColumn("is_frequent", (F.col("id_updates") > F.col("id_updates_q0")).cast("int")).drop("id_updates_q0")
    return spread.join_stats(df, g, [key])


def feat_geo_counts(df: DataFrame, keys: Sequence[str] = ("state", "district", "pincode")) -> DataFrame:
    """Count, share of all rows and z over the groups, per geography."""
    out = df
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    for key in keys:
        out = group_activity(out, key, key)
    out = spread.with_global(out, n)
    return out.withColumns({f"{k}_pct": F.col(f"{k}_count") * 100.0 / F.col("_n") for k in keys}).drop("_n")


def feat_pincode_region(df: DataFrame, pincode: str = "pincode") -> DataFrame:
    return df.withColumn("pincode_region", F.substring(pincode, 1, 2))


def feat_age(df: DataFrame, ages: Sequence[str]) -> DataFrame:
    """Total, shares over total + 1, entropy of the shares."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in ages])
    out = df.withColumn("total", total)
    out = out.withColumns({f"{c}_ratio": F.col(c) / (F.col("total") + 1) for c in ages})
    entropy = reduce(lambda a, b: a + b, [-F.col(f"{c}_ratio") * F.log(F.col(f"{c}_ratio") + 1e-10) for c in ages])
    return out.withColumn("age_entropy", entropy)


def feat_enrolment(df: DataFrame) -> DataFrame:
    out = df.withColumn("total_enrolments", F.expr("age_0_5+age_5_17+age_18_greater"))
    out = out.withColumns({f"{c}_ratio": F.coalesce(F.col(c) / F.nullif("total_enrolments", F.lit(0)), F.lit(0.0))
                           for c in ("age_0_5", "age_5_17", "age_18_greater")})
    return out.withColumn("child_heavy", (F.col("age_0_5") + F.col("age_5_17") > F.col("age_18_greater")).cast("int"))


def feat_update_mix(df: DataFrame, demo: Sequence[str], bio: Sequence[str]) -> DataFrame:
    """Demographic and biometric totals, shares over sum + 1, z (sample std, 0 becomes 1)."""
    add = lambda cols: reduce(lambda a, b: a + b, [F.col(c) for c in cols])
    out = df.withColumn("demo_total", add(demo)).withColumn("bio_total", add(bio))
    both = F.col("demo_total") + F.col("bio_total") + 1
    out = out.withColumns({"demo_share": F.col("demo_total") / both, "bio_share": F.col("bio_total") / both,
                           "bio_demo": F.col("bio_total") / (F.col("demo_total") + 1)})
    out = spread.with_totals(out, *[f(c).alias(f"_{n}_{c}") for c in ("demo_total", "bio_total") for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = {f"{c}_z": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.coalesce(f"_s_{c}", F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"_s_{c}"))
         for c in ("demo_total", "bio_total")}
    return out.withColumns(z).drop(*[f"_{n}_{c}" for c in ("demo_total", "bio_total") for n in "ms"])


def feat_row_stats(df: DataFrame, columns: Sequence[str], ddof: int = 0) -> DataFrame:
    """Sum, mean, std, max, min, range, skew and kurtosis across the columns of a row."""
    out = df.withColumn("_a", F.array(*[F.col(c).cast("double") for c in columns]))
    a, n = F.col("_a"), float(len(columns))
    out = out.withColumn("row_mean", array_mean(a))
    out = out.withColumn("_m2", moment(a, F.col("row_mean"), 2))
    m2 = F.col("_m2")
    out = out.withColumns({
        "row_sum": F.col("row_mean") * n, "row_std": F.sqrt(m2 * n / (n - ddof)), "row_max": F.array_max(a), "row_min": F.array_min(a),
        "row_range": F.array_max(a) - F.array_min(a),
        "row_skew": F.coalesce(moment(a, F.col("row_mean"), 3) / F.nullif(F.pow(m2, F.lit(1.5)), F.lit(0.0)), F.lit(0.0)),
        "row_kurtosis": F.coalesce(moment(a, F.col("row_mean"), 4) / F.nullif(m2 * m2, F.lit(0.0)) - 3.0, F.lit(0.0))})
    return out.drop("_a", "_m2")


def feat_age_pct(df: DataFrame, ages: Sequence[str]) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.col(c) for c in ages])
    base = F.when(total == 0, F.lit(1)).otherwise(total)
    return df.withColumns({f"{c}_pct": F.col(c) * 100.0 / base for c in ages})


# Places with known capture trouble or heavy manual labour, humid months.
HIGH_RISK_STATES = ("Jharkhand", "Bihar", "Chhattisgarh", "Madhya Pradesh", "Odisha")
RURAL_LABOR_STATES = ("Bihar", "Jharkhand", "Chhattisgarh", "Odisha", "Madhya Pradesh", "Uttar Pradesh", "Rajasthan", "West Bengal")
MONSOON_MONTHS = (6, 7, 8, 9)


def feat_risk_derived(df: DataFrame, date: str | None, as_of: str,
                      high_risk: Sequence[str] = HIGH_RISK_STATES, rural: Sequence[str] = RURAL_LABOR_STATES) -> DataFrame:
    """Risk inputs from joined facts: age mix, update ratios, quality, season, place.

    Days since the update are real days to ``as_of`` (365 without a date);
    percentages never enter the head-counts.
    """
    days = F.coalesce(F.datediff(F.to_date(F.lit(as_of)), F.col(date)), F.lit(365)) if date else F.lit(365)
    month = F.coalesce(F.month(date), F.lit(1)) if date else F.lit(1)
    out = df.withColumns({
        "days_since_update": days, "capture_month": month,
        "child_count": F.expr("enrol_age_0_5+enrol_age_5_17+demo_age_5_17+bio_age_5_17"),
        "adult_count": F.expr("enrol_age_18_greater+demo_age_17_+bio_age_17_"),
        "total_population": F.expr("coalesce(nullif(enrol_total+bio_total,0),1)")})
    t, a = F.col("total_population"), F.col("adult_count")
    out = out.withColumns({"ratio_0_17": F.col("child_count") / t, "ratio_18_34": a * 0.35 / t, "ratio_35_49": a * 0.30 / t,
                           "ratio_50_64": a * 0.20 / t, "ratio_65_plus": a * 0.15 / t})
    both = F.expr("coalesce(nullif(bio_total+demo_total,0),1)")
    out = out.withColumns({
        "age_bucket_risk_score": (F.col("ratio_0_17") * 0.5 + F.col("ratio_18_34") * 0.7 + F.col("ratio_35_49") * 1.0
                                  + F.col("ratio_50_64") * 1.5 + F.col("ratio_65_plus") * 2.5),
        "elderly_ratio": F.col("ratio_50_64") + F.col("ratio_65_plus"), "adult_ratio": 1.0 - F.col("ratio_0_17"),
        "age_65_plus_ratio": F.col("ratio_65_plus"),
        "biometric_update_ratio": F.col("bio_total") / both, "demographic_update_ratio": F.col("demo_total") / both})
    penalty = 1.0 - clip(F.col("days_since_update"), 0, 730) / 730.0 * 0.3
    return out.withColumns({
        "centre_quality_score": clip(clip(F.col("biometric_update_ratio"), 0, 1) * 0.7 + penalty * 0.3, 0, 1),
        "is_monsoon": F.col("capture_month").isin(*MONSOON_MONTHS).cast("int"),
        "seasonal_factor": 1.0 - F.col("capture_month").isin(*MONSOON_MONTHS).cast("int") * 0.15,
        "is_high_risk_state": F.col("state").isin(*high_risk).cast("int"),
        "is_rural_labor": F.col("state").isin(*rural).cast("int")})


def feat_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Size, mean column variance, share of zeros, complexity, kinds of columns."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(c).alias(f"_v_{c}") for c in columns],
                 *[F.count_if(F.col(c) == 0).alias(f"_z_{c}") for c in columns])
    k = len(columns)
    add = lambda p: reduce(lambda a, b: a + b, [F.col(f"_{p}_{c}") for c in columns])
    names = " ".join(df.columns).lower()
    size = F.col("n") * k
    return one.select("n", F.lit(k).alias("k"), (add("v") / float(k)).alias("variance"), (add("z") / size).alias("sparsity"),
                      ladder(size, [("<", 1e4, "low"), ("<", 1e6, "medium")], "high").alias("complexity"),
                      F.lit(any(w in names for w in ("date", "month", "day", "time"))).alias("has_temporal"),
                      F.lit(any(w in names for w in ("state", "district", "pincode"))).alias("has_geo"))


# ---------------------------------------------------------------- per-id behaviour

def gap_between_updates(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Days since the id's previous event."""
    p = spread.previous_in_key(df.select(key, ts, tie), key, ts, tie, [ts])
    secs = F.unix_micros(ts) - F.unix_micros(f"prev_{ts}")
    return p.withColumn("gap_days", secs / 86400e6)


def update_velocity(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Change of the gap from one event to the next."""
    g = gap_between_updates(df, key, ts, tie).drop(f"prev_{ts}")
    p = spread.previous_in_key(g, key, ts, tie, ["gap_days"])
    return p.withColumn("gap_change", F.col("gap_days") - F.col("prev_gap_days")).drop("prev_gap_days")


def daily_average(df: DataFrame, key: str, date: str, prefix: str) -> DataFrame:
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("events"), F.countDistinct(date).alias("active_days"))
    return g.withColumn(f"{prefix}_daily_avg", F.col("events") / F.col("active_days"))


def center_operator_ratio(df: DataFrame, center: str, operator: str) -> DataFrame:
    g = df.groupBy(center).agg(F.countDistinct(operator).alias("operators"), F.count(F.lit(1)).alias("events"))
    return g.withColumn("ratio", F.col("operators") / F.col("events"))


def location_hop_count(df: DataFrame, key: str, ts: str, tie: str, place: str) -> DataFrame:
    p = spread.previous_in_key(df.select(key, ts, tie, place), key, ts, tie, [place])
    return p.groupBy(key).agg(F.count_if(F.col(place) != F.col(f"prev_{place}")).alias("hops"))


def update_type_entropy(df: DataFrame, key: str, kind: str) -> DataFrame:
    """Entropy (nats) of the event types of an id; two-level aggregation."""
    c = df.groupBy(key, kind).agg(F.count(F.lit(1)).cast("double").alias("c"))
    g = c.groupBy(key).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"))
    return g.select(key, (F.log("n") - F.col("s") / F.col("n")).alias("type_entropy"))


def activity_acceleration(df: DataFrame, key: str, ts: str) -> DataFrame:
    """First and second difference of an id's daily counts (one row per active day)."""
    daily = df.groupBy(key, F.col(ts).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(key).orderBy("day")
    d = daily.withColumn("velocity", F.col("n") - F.lag("n").over(w))
    return d.withColumn("acceleration", F.col("velocity") - F.lag("velocity").over(w))


def weekend_night_ratio(df: DataFrame, key: str, ts: str) -> DataFrame:
    we, h = F.weekday(ts) >= 5, F.hour(ts)
    night = (h >= 22) | (h <= 5)
    g = df.groupBy(key).agg(F.count_if(we).alias("weekend"), F.count_if(~we).alias("weekday"),
                            F.count_if(night).alias("night"), F.count_if(~night).alias("daytime"))
    return g.withColumn("weekend_ratio", F.col("weekend") / F.nullif("weekday", F.lit(0))).withColumn(
        "night_ratio", F.col("night") / F.nullif("daytime", F.lit(0)))
