"""Explanations: which features make a record stand out, and how to say it.

Records stay one row each: the per-feature facts are arrays of structs built
from one-row statistics, so no record is exploded or shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import spread
from rollcall.functions.scalar import ladder

# Words used for a feature in sentences.
FEATURE_WORDS = {
    "month": "time of year", "is_weekend": "weekend activity", "is_month_end": "month-end timing",
    "center_event_count": "center activity level", "operator_event_count": "operator activity level",
    "state_event_count": "state activity level", "total_demo_updates": "demographic update count",
    "demo_age_5_17": "demographic updates (5-17 years)", "demo_age_17_": "demographic updates (17+ years)",
    "total_enrolments": "total enrolment count", "age_0_5": "infant enrolments (0-5 years)",
    "age_5_17": "child/teen enrolments (5-17 years)", "age_18_greater": "adult enrolments (18+ years)",
}

# Opening line per score, above the bound.
SCORE_PREFIX = ((0.9, "CRITICAL: Multiple strong anomaly indicators detected"),
                (0.7, "HIGH RISK: Significant deviations from normal patterns"),
                (0.5, "MEDIUM RISK: Notable anomalies requiring review"))

# Pattern names.
PATTERNS = {
    "geo": "Geo-Inconsistent Activity: Updates from multiple unusual locations within short timeframe",
    "operator": "Operator/Center Fraud: Unusually high update frequency from same operator or center",
    "volume": "Volume Spike Fraud: Abnormally high transaction volume detected",
    "temporal": "Temporal Anomaly: Activity occurring at unusual times (off-hours/weekends)",
    "bio_z": "Biometric Update Fraud: Excessive biometric update requests",
    "bio": "Biometric Update Anomaly: Unusual biometric update patterns",
    "demo_z": "Demographic Update Fraud: Excessive demographic update requests",
    "demo": "Demographic Update Anomaly: Suspicious demographic changes",
    "age_ratio": "Demographic Distribution Fraud: Unusual age distribution in enrolments",
    "age": "Enrolment Volume Fraud: Abnormal enrolment patterns detected",
    "other": "General Statistical Anomaly: Multiple deviations from normal patterns",
}

# Pattern names of single detectors.
MODEL_PATTERNS = {
    "hdbscan": "Behavioral Outlier: Record does not match any known normal behavior cluster",
    "autoencoder": "Complex Pattern Fraud: Multi-feature anomaly pattern detected",
}


def feature_stats(df: DataFrame, features: Sequence[str], sample: bool = False) -> DataFrame:
    """One row: mean, std, min, max per feature."""
    sd = F.stddev_samp if sample else F.stddev_pop
    kinds = (("m", F.avg), ("s", sd), ("lo", F.min), ("hi", F.max))
    return df.agg(*[f(F.col(c).cast("double")).alias(f"_{n}_{c}") for c in features for n, f in kinds])


def baselines(df: DataFrame, features: Sequence[str], dims: Sequence[str]) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """The statistics of the whole table (population, then sample std) and of every value of each dimension, in one pass.

    One aggregation over grouping sets, written once; its rows are as many as the
    dimensions have values, and a part is broadcast only after its size is checked.
    """
    keys = [F.col(d).alias(f"_k_{d}") for d in dims]
    values = [F.col(c).cast("double").alias(f"_v_{c}") for c in features]
    kinds = (("m", F.avg), ("sp", F.stddev_pop), ("ss", F.stddev_samp), ("lo", F.min), ("hi", F.max))
    names = [f"_k_{d}" for d in dims]
    table = (df.select(*keys, *values).groupingSets([[], *[[n] for n in names]], *names)
               .agg(F.grouping_id().alias("_set"), *[f(f"_v_{c}").alias(f"_{n}_{c}") for c in features for n, f in kinds]))
    table = spread.pin(table)

    def part(left_out: int, kept: Sequence[str], std: str) -> DataFrame:
        named = [F.col(f"_{std if n == 's' else n}_{c}").alias(f"_{n}_{c}") for c in features for n in ("m", "s", "lo", "hi")]
        return table.filter(F.col("_set") == left_out).select(*kept, *named)

    every = (1 << len(names)) - 1  # one bit per dimension, the last one lowest, set where it is left out
    by_dim = {d: part(every ^ (1 << (len(names) - 1 - i)), [f"_k_{d}"], "ss").drop(*[f"_{n}_{c}" for c in features for n in ("lo", "hi")])
              for i, d in enumerate(dims)}
    return part(every, [], "sp"), part(every, [], "ss"), by_dim


def _drop_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.drop(*[f"_{n}_{c}" for c in features for n in ("m", "s", "lo", "hi")])


def _z(c: str) -> Column:
    """z of a feature against the attached statistics, 0 where the feature is constant."""
    return F.coalesce((F.col(c).cast("double") - F.col(f"_m_{c}")) / F.nullif(f"_s_{c}", F.lit(0.0)), F.lit(0.0))


def _top(cells: Sequence[Column], k: int) -> Column:
    """The first k cells; every cell starts with its sort key (-|z|), then the feature name.

    ``sort_array`` on structs runs in generated code, unlike a comparator lambda.
    """
    return F.slice(F.sort_array(F.array(*cells)), 1, k)


def _sort_key(z: Column) -> Column:
    return -F.round(F.abs(z), 9)


def _sentence(feature: str, value: Column, mean: Column, z: Column) -> Column:
    """What to say about a feature; NULL when the value is the mean."""
    low = feature.lower()
    tail = (" (possible volume spike)" if "spike" in low or "count" in low else " (unusual distribution)" if "ratio" in low
            else " (statistical outlier)" if "zscore" in low else "")
    how = ladder(F.abs(z), [(">", 3, "extremely"), (">", 2, "significantly"), (">", 1, "moderately")], "slightly")
    head = F.lit(f"The {FEATURE_WORDS.get(feature, feature.replace('_', ' '))} is ")
    return F.when(value != mean, F.concat(head, how, F.when(value > mean, " higher").otherwise(" lower"), F.lit(f" than expected{tail}")))


def _tags(feature: str, z: Column) -> Column:
    """The pattern rules a feature name takes part in, as one piece of text."""
    low = feature.lower()
    has = lambda *words: any(w in low for w in words)
    found = [t for t, hit in (("geo", has("state", "district", "pincode", "geo")), ("operator", has("operator", "center")),
                              ("temporal", has("weekend", "month_end", "month_start", "day_of_week")), ("bio_z", has("bio") and has("zscore")), ("bio", has("bio")),
                              ("demo_z", has("demo") and has("zscore")), ("demo", has("demo")), ("age_ratio", has("enrolment", "age") and has("ratio")),
                              ("age", has("enrolment", "age"))) if hit]
    text = "".join(f"<{t}>" for t in found)
    return F.when(z > 2, F.lit(f"<volume>{text}")).otherwise(F.lit(text)) if has("count", "total") else F.lit(text)


def attribution(df: DataFrame, features: Sequence[str], k: int = 5, stats: DataFrame | None = None) -> DataFrame:
    """Share of |z| per feature, the k largest with direction, in ``contributors``."""
    out = spread.with_global(df, stats if stats is not None else feature_stats(df, features))
    out = out.withColumns({f"_z_{c}": _z(c) for c in features})
    total = reduce(lambda a, b: a + b, [F.abs(F.col(f"_z_{c}")) for c in features])
    out = out.withColumn("_total", F.nullif(total, F.lit(0.0)))
    cells = []
    for c in features:
        v, m, z = F.col(c).cast("double"), F.col(f"_m_{c}"), F.col(f"_z_{c}")
        side = F.when(v > m, "above").when(v < m, "below").otherwise("at")
        cells.append(F.struct(_sort_key(z).alias("key"), F.lit(c).alias("feature"), (F.abs(z) / F.col("_total")).alias("share"), v.alias("value"),
                              m.alias("mean"), z.alias("z"), side.alias("direction"), _sentence(c, v, m, z).alias("sentence"), _tags(c, z).alias("tags")))
    out = out.withColumn("contributors", _top(cells, k))
    return _drop_stats(out, features).drop("_total", *[f"_z_{c}" for c in features])


def compare_to_normal(df: DataFrame, key: Sequence[str], features: Sequence[str], anomalous: Column) -> DataFrame:
    """Anomalous values against the normal rows: z, percentile among normal values, outside p5..p95.

    One output row per anomalous record and feature.  Percentiles come from
    running counts over (feature, value) pairs.
    """
    tagged = df.withColumn("_anom", anomalous)
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]))
    long = tagged.select(*key, "_anom", pair.alias("p")).select(*key, "_anom", "p.*")
    counts = long.groupBy("feature", "value").agg(F.count_if(~F.col("_anom")).alias("_c"))
    cum = spread.running(counts, ["feature"], ["value"], {"n": "_c"})
    cum = cum.select("feature", "value", ((F.col("n_before") + F.col("_c")) * 100.0 / F.nullif("n_all", F.lit(0))).alias("percentile"))
    normal = tagged.filter(~F.col("_anom"))
    q = spread.quantiles(normal, features, [0.05, 0.95])
    base = normal.agg(*[f(F.col(c).cast("double")).alias(f"_{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))]).crossJoin(F.broadcast(q))
    rows = F.array(*[F.struct(F.lit(c).alias("_f"), F.col(f"_m_{c}").alias("normal_mean"), F.col(f"_s_{c}").alias("normal_std"),
                              F.col(f"{c}_q0").alias("_p5"), F.col(f"{c}_q1").alias("_p95")) for c in features])
    base = spread.small(base.select(F.explode(rows).alias("e")).select("e.*"))
    out = spread.join_stats(long.filter("_anom"), cum, ["feature", "value"]).join(base, F.col("feature") == F.col("_f"))
    return (out.withColumn("z", F.coalesce((F.col("value") - F.col("normal_mean")) / F.nullif("normal_std", F.lit(0.0)), F.lit(0.0)))
               .withColumn("is_outlier", (F.col("value") < F.col("_p5")) | (F.col("value") > F.col("_p95"))).drop("_f", "_p5", "_p95", "_anom"))


def baseline_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per feature: mean, std, quantiles, range."""
    m = df.agg(*[f(F.col(c).cast("double")).alias(f"_{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_samp), ("lo", F.min), ("hi", F.max))])
    q = spread.quantiles(df, features, [0.25, 0.5, 0.75, 0.95, 0.99])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_m_{c}").alias("mean"), F.col(f"_s_{c}").alias("std"), F.col(f"{c}_q1").alias("median"),
                              F.col(f"{c}_q0").alias("q25"), F.col(f"{c}_q2").alias("q75"), F.col(f"{c}_q3").alias("q95"), F.col(f"{c}_q4").alias("q99"),
                              F.col(f"_lo_{c}").alias("min"), F.col(f"_hi_{c}").alias("max"), (F.col(f"{c}_q2") - F.col(f"{c}_q0")).alias("iqr")) for c in features])
    return m.crossJoin(F.broadcast(q)).select(F.explode(rows).alias("e")).select("e.*")


def baseline_by_dim(df: DataFrame, dims: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Mean, std and count per dimension value and feature, as one long table."""
    parts = []
    for dim in dims:
        g = df.groupBy(F.col(dim).cast("string").alias("key")).agg(
            F.count(F.lit(1)).alias("n"), *[f(F.col(c).cast("double")).alias(f"_{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_samp))])
        rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_m_{c}").alias("mean"), F.col(f"_s_{c}").alias("std")) for c in features])
        parts.append(g.select(F.lit(dim).alias("dim"), "key", "n", F.explode(rows).alias("e")).select("dim", "key", "n", "e.*"))
    return reduce(DataFrame.unionByName, parts)


# Kind of deviation by words in the feature name, first match wins; what a sentence adds for it.
DEVIATION_WORDS = (("geographic", ("state", "district", "pincode", "geo")), ("temporal", ("month", "day", "weekend", "quarter", "time")),
                   ("behavioral", ("operator", "center", "update", "enrolment")))
DEVIATION_CONTEXT = {"geographic": " (unusual for this location)", "temporal": " (unusual for this time period)",
                     "behavioral": " (deviates from typical behavior)", "statistical": ""}
INTENSITY = {"critical": "extremely", "high": "significantly", "medium": "moderately", "low": "slightly"}


def deviation_type(feature: str) -> str:
    return next((kind for kind, words in DEVIATION_WORDS if any(w in feature.lower() for w in words)), "statistical")


def deviation_severity(z: Column, pct: Column) -> Column:
    a = F.abs(z)
    return (F.when((a > 4) | (pct > 99.5) | (pct < 0.5), "critical").when((a > 3) | (pct > 99) | (pct < 1), "high")
             .when((a > 2) | (pct > 95) | (pct < 5), "medium").otherwise("low"))


def deviations(df: DataFrame, features: Sequence[str], k: int = 10, stats: DataFrame | None = None) -> DataFrame:
    """The k largest deviations of a record in ``deviations``: z, percentile, type, severity, sentence."""
    out = spread.with_global(df, stats if stats is not None else feature_stats(df, features, sample=True))
    pct = {}
    for c in features:
        v, m, lo, hi = F.col(c).cast("double"), F.col(f"_m_{c}"), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        pct[f"_p_{c}"] = (F.when(v <= lo, 0.0).when(v >= hi, 100.0).when(v < m, (v - lo) * 50.0 / F.nullif(m - lo, F.lit(0.0)))
                           .otherwise((v - m) * 50.0 / F.nullif(hi - m, F.lit(0.0)) + 50.0))
    out = out.withColumns({**pct, **{f"_z_{c}": F.abs(_z(c)) for c in features}})
    out = out.withColumns({f"_v_{c}": deviation_severity(F.col(f"_z_{c}"), F.col(f"_p_{c}")) for c in features})
    cells = []
    for c in features:
        v, m, z, sev = F.col(c).cast("double"), F.col(f"_m_{c}"), F.col(f"_z_{c}"), F.col(f"_v_{c}")
        kind = deviation_type(c)
        how = F.when(sev == "critical", INTENSITY["critical"]).when(sev == "high", INTENSITY["high"]).when(sev == "medium", INTENSITY["medium"]).otherwise(INTENSITY["low"])
        text = F.concat(F.lit(f"{c.replace('_', ' ').title()} is "), how, F.when(v > m, " higher").otherwise(" lower"), F.lit(f" than expected{DEVIATION_CONTEXT[kind]}"))
        cells.append(F.struct(_sort_key(z).alias("key"), F.lit(c).alias("feature"), v.alias("value"), m.alias("expected"), (v - m).alias("deviation"), z.alias("z"),
                              F.col(f"_p_{c}").alias("percentile"), F.lit(kind).alias("type"), sev.alias("severity"), text.alias("explanation")))
    out = out.withColumn("deviations", _top(cells, k))
    return _drop_stats(out, features).drop(*[f"_{n}_{c}" for c in features for n in "pzv"])


def _dim_flags(df: DataFrame, dim: str, features: Sequence[str], label: str, base: DataFrame | None = None) -> DataFrame:
    """Array of (type, feature, severity) where |z| > 2 against the baseline of the dimension value.

    ``base`` holds that baseline (from ``baselines``); without it the rows themselves give it.
    """
    if base is None:
        g = df.groupBy(dim).agg(*[f(F.col(c).cast("double")).alias(f"_{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_samp))])
        out = spread.join_stats(df, g, [dim])
    else:
        out = df.join(spread.small(base, pinned=True), df[dim].eqNullSafe(F.col(f"_k_{dim}")), "left").drop(f"_k_{dim}")
    items = []
    for c in features:
        z = F.abs((F.col(c) - F.col(f"_m_{c}")) / F.nullif(f"_s_{c}", F.lit(0.0)))
        items.append(F.when(z > 2, F.struct(F.lit(label).alias("type"), F.lit(c).alias("feature"), F.when(z > 3, "high").otherwise("medium").alias("severity"))))
    return out.withColumn(f"_{dim}_flags", F.array_compact(F.array(*items))).drop(*[f"_{n}_{c}" for c in features for n in "ms"])


def temporal_deviations(df: DataFrame, features: Sequence[str], base: DataFrame | None = None) -> DataFrame:
    """Weekend and month-edge flags, and values far from the month's baseline, in ``temporal_flags``."""
    flag = lambda c, t, s: F.when(F.col(c) == 1, F.struct(F.lit(t).alias("type"), F.lit("").alias("feature"), F.lit(s).alias("severity")))
    out = _dim_flags(df, "month", features, "monthly_deviation", base)
    fixed = F.array_compact(F.array(flag("is_weekend", "weekend_activity", "medium"), flag("is_month_end", "month_end_activity", "low"),
                                    flag("is_month_start", "month_start_activity", "low")))
    return out.withColumn("temporal_flags", F.concat(fixed, "_month_flags")).drop("_month_flags")


def geo_deviations(df: DataFrame, features: Sequence[str], dims: Sequence[str] = ("state", "district"), bases: Mapping[str, DataFrame] | None = None) -> DataFrame:
    out = df
    for dim in dims:
        out = _dim_flags(out, dim, features, f"{dim}_deviation", (bases or {}).get(dim))
    return out.withColumn("geo_flags", F.concat(*[f"_{d}_flags" for d in dims])).drop(*[f"_{d}_flags" for d in dims])


def reasons(contributors: Column, score: Column) -> Column:
    """The sentences of the contributors, the score line first."""
    head = ladder(score, [(">", b, t) for b, t in SCORE_PREFIX], "")
    lines = F.array_compact(contributors["sentence"])
    lines = F.when(head != "", F.concat(F.array(head), lines)).otherwise(lines)
    return F.when(F.size(lines) == 0, F.array(F.lit("No specific anomaly patterns identified"))).otherwise(lines)


def fraud_pattern(contributors: Column, models: Mapping[str, Column] | None = None) -> Column:
    """First matching rule on the names of the contributors, then on the detectors' scores.

    ``models`` names detectors in the order they are asked; a score above 0.7 of one
    that has a pattern of its own (``MODEL_PATTERNS``) decides, a null score does not.
    """
    tags = F.concat_ws("", contributors["tags"])
    out = F.when(tags.rlike("<geo>.*<geo>"), PATTERNS["geo"])
    for name in ("operator", "volume", "temporal", "bio_z", "bio", "demo_z", "demo", "age_ratio", "age"):
        out = out.when(tags.contains(f"<{name}>"), PATTERNS[name])
    for name, score in (models or {}).items():
        if name in MODEL_PATTERNS:
            out = out.when(score > 0.7, MODEL_PATTERNS[name])
    return out.otherwise(PATTERNS["other"])


def confidence(score: Column, model_scores: Column, n_deviations: Column, n_flags: Column) -> Column:
    """Score, share of models above .6, deviations and context flags, weighted .4/.3/.2/.1."""
    present = F.array_compact(model_scores)
    agree = F.coalesce(F.size(F.filter(present, lambda s: s > 0.6)) / F.nullif(F.size(present), F.lit(0)), F.lit(0.0))
    return F.least(F.lit(1.0), score * 0.4 + agree * 0.3 + F.least(n_deviations / 5.0, F.lit(1.0)) * 0.2 + F.least(n_flags / 3.0, F.lit(1.0)) * 0.1)


def severity(score: Column, conf: Column, devs: Column) -> Column:
    crit = F.size(F.filter(devs, lambda s: s["severity"] == "critical"))
    high = F.size(F.filter(devs, lambda s: s["severity"] == "high"))
    return (F.when((score > 0.9) | ((conf > 0.8) & (crit >= 2)), "CRITICAL").when((score > 0.7) | ((conf > 0.6) & ((crit >= 1) | (high >= 2))), "HIGH")
             .when((score > 0.5) | (conf > 0.4), "MEDIUM").otherwise("LOW"))


def explain_batch(df: DataFrame, features: Sequence[str], score: str, model_scores: Sequence[str], geo_dims: Sequence[str],
                  cut: float = 0.5, k: int = 10, models: Mapping[str, Column] | None = None) -> DataFrame:
    """Every record with score >= cut: contributors, deviations, flags, pattern, confidence, severity, reasons.

    Baselines come from all records and are counted in one pass over them; explanations
    are made only for the records above the cut.  ``models`` (name to score column) adds
    the patterns that rest on a detector's own verdict.
    """
    picked = df.filter(F.col(score) >= cut)
    whole, sample, by_dim = baselines(df, features, ["month", *geo_dims])
    out = attribution(picked, features, 5, whole)
    out = deviations(out, features, k, sample)
    out = geo_deviations(temporal_deviations(out, features, by_dim["month"]), features, geo_dims, by_dim)
    noteworthy = F.size(F.filter("deviations", lambda s: s["severity"] != "low"))
    out = out.withColumn("n_deviations", noteworthy).withColumn("n_flags", F.size("temporal_flags") + F.size("geo_flags"))
    out = out.withColumn("pattern", fraud_pattern(F.col("contributors"), models))
    out = out.withColumn("confidence", confidence(F.col(score), F.array(*model_scores), F.col("n_deviations"), F.col("n_flags")))
    out = out.withColumn("severity", severity(F.col(score), F.col("confidence"), F.col("deviations")))
    return out.withColumn("reasons", reasons(F.col("contributors"), F.col(score)))


def explain_summary(explained: DataFrame, score: str) -> DataFrame:
    """Counts by severity and pattern, mean score and confidence, mentions per feature; (section, item, n, value)."""
    row = lambda g, sec: g.select(F.lit(sec).alias("section"), F.col("item"), F.col("n"), F.col("value"))
    parts = [row(explained.groupBy(F.col(c).alias("item")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("value")), c) for c in ("severity", "pattern")]
    parts.append(row(explained.agg(F.lit("all").alias("item"), F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("value")), "confidence"))
    m = explained.select(F.explode_outer(F.transform(F.slice("contributors", 1, 3), lambda c: c["feature"])).alias("item"), F.col(score).alias("_s"))
    parts.append(row(m.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.avg("_s").alias("value")), "feature"))
    return reduce(DataFrame.unionByName, parts)
