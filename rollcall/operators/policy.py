"""Policies, monitoring requests, strategies, unified risk, report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import spread, tables
from rollcall.functions.scalar import ladder
from rollcall.operators import aggregate, scoring

# Authority, action priority and recommended action per disposition and indicator.
AUTHORITY = {"ESCALATE": "Deputy Director / Regional Head", "FLAG": "Senior Investigation Officer", "REVIEW": "Field Verification Team"}
PRIORITY = {"ESCALATE|Critical": 1, "ESCALATE|High": 1, "FLAG|Critical": 1, "FLAG|High": 2, "FLAG|Medium": 2,
            "REVIEW|High": 3, "REVIEW|Medium": 3, "REVIEW|Low": 4, "CLEAR|Low": 5}
ACTIONS = {
    "ESCALATE|Critical": "Suspend processing. Escalate to Deputy Director. Initiate field verification.",
    "ESCALATE|High": "Hold for senior officer review. Request additional documentation.",
    "FLAG|High": "Flag for investigation team. Cross-reference with other flagged records.",
    "FLAG|Medium": "Queue for manual verification. Verify operator credentials.",
    "REVIEW|Medium": "Schedule routine review. No immediate action required.",
    "REVIEW|Low": "Add to review batch. Standard verification sufficient.",
    "CLEAR|Low": "Proceed with normal processing.",
}
DEFAULT_ACTION = "Follow standard operating procedure for this record type."
POLICY_WORDS = {"total_enrolments": "enrollment volume", "total_demo_updates": "demographic update frequency",
                "total_bio_updates": "biometric update frequency", "state_event_count": "regional activity level",
                "district_event_count": "local area activity", "operator_activity": "operator workload",
                "is_weekend": "weekend processing", "month": "seasonal pattern"}


def disposition(score: Column, tolerance: str = "balanced") -> Column:
    review, flag, escalate = tables.POLICY_CUTS[tolerance]
    return ladder(score, [(">=", escalate, "ESCALATE"), (">=", flag, "FLAG"), (">=", review, "REVIEW")], "CLEAR")


def policy_records(df: DataFrame, score: str, policy: str = "STANDARD", volume: str | None = None, contributors: str | None = None) -> DataFrame:
    """Disposition and everything that follows from it, per record."""
    s = F.col(score)
    out = df.withColumn("disposition", disposition(s, tables.POLICY_PRESETS.get(policy, "balanced")))
    out = out.withColumn("indicator", ladder(s, [(">=", 0.8, "Critical"), (">=", 0.6, "High"), (">=", 0.4, "Medium")], "Low"))
    pair = F.concat_ws("|", "disposition", "indicator")
    flags = [F.when(s >= 0.9, "CRITICAL_DEVIATION").when(s >= 0.7, "SIGNIFICANT_DEVIATION")]
    if "is_weekend" in df.columns:
        flags.append(F.when(F.col("is_weekend") == 1, "WEEKEND_ACTIVITY"))
    if volume:
        flags.append(F.when(F.col(volume) > 200, "HIGH_VOLUME"))
    out = out.withColumns({
        "confidence_level": ladder(s, [(">=", 0.7, "Very High"), (">=", 0.4, "High")], "Standard"),
        "requires_action": F.col("disposition").isin("FLAG", "ESCALATE"), "action_priority": F.coalesce(tables.lookup(PRIORITY, pair), F.lit(4)),
        "review_by": tables.lookup(AUTHORITY, F.col("disposition")), "action": F.coalesce(tables.lookup(ACTIONS, pair), F.lit(DEFAULT_ACTION)),
        "flags": F.array_compact(F.array(*flags))})
    if contributors is None:
        return out
    word = F.coalesce(tables.lookup(POLICY_WORDS, F.get(contributors, F.lit(0))["feature"]), F.lit("operational metric"))
    d = F.col("disposition")
    reason = (F.when(d == "CLEAR", "Record aligns with expected operational patterns.")
               .when(d == "ESCALATE", F.concat(F.lit("Critical deviation detected in "), word, F.lit(". Immediate review required.")))
               .when(d == "FLAG", F.concat(F.lit("Significant deviation in "), word, F.lit(" warrants investigation.")))
               .otherwise(F.concat(F.lit("Minor deviation in "), word, F.lit(" recommended for review."))))
    return out.withColumn("reason", reason)


def policy_summary(records: DataFrame) -> DataFrame:
    """Counts per disposition, overall assessment, next steps; one row."""
    g = records.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("disposition") == n).alias(n.lower()) for n in ("ESCALATE", "FLAG", "REVIEW", "CLEAR")])
    rate = (F.col("escalate") + F.col("flag")) / F.nullif("total", F.lit(0))
    word = (F.when(F.col("total") == 0, "NO_DATA").when(rate > 0.2, "HIGH - Immediate attention required").when(rate > 0.1, "ELEVATED - Enhanced monitoring recommended")
             .when(rate > 0.05, "MODERATE - Standard monitoring sufficient").otherwise("LOW - Normal operations"))
    n = lambda c: F.col(c).cast("string")
    steps = F.array_compact(F.array(
        F.when(F.col("escalate") > 0, F.concat(F.lit("URGENT: "), n("escalate"), F.lit(" records require immediate escalation to senior authority"))),
        F.when(F.col("flag") > 0, F.concat(F.lit("Assign "), n("flag"), F.lit(" flagged records to investigation team"))),
        F.when(F.col("review") > 0, F.concat(F.lit("Schedule review batch for "), n("review"), F.lit(" records"))),
        F.when(F.col("clear") > 0, F.concat(n("clear"), F.lit(" records cleared for standard processing"))),
        F.lit("Generate compliance report for audit trail")))
    return g.withColumn("critical_rate", rate).withColumn("assessment", word).withColumn("next_steps", steps)


def audit_rows(records: DataFrame, policy: str, user: str, at: str) -> DataFrame:
    """One audit row per policy run."""
    return records.agg(F.count(F.lit(1)).alias("records_processed"), F.count_if(F.col("disposition").isin("FLAG", "ESCALATE")).alias("flags_raised")).select(
        F.lit(policy).alias("policy_id"), F.lit(user).alias("user_id"), F.lit(at).alias("at"), "records_processed", "flags_raised")


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


# ---------------------------------------------------------------- requests and strategies

def resolve_signals(requests: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Signals of a request's intent, weighted by context (never above 1).

    ``requests`` has intent, vigilance, has_location, is_today.
    """
    sig = F.coalesce(tables.lookup(tables.INTENT_SIGNALS, F.col("intent")), F.array().cast("array<string>"))
    out = requests.withColumn("signal", F.explode_outer(sig)).filter("signal is not null").withColumn("_w", tables.lookup(tables.SIGNAL_WEIGHTS, F.col("signal")))
    cap = lambda c: F.least(F.lit(1.0), c)
    out = out.withColumn("_w", F.when(F.col("has_location") & (F.col("signal") == "geographic_distribution"), cap(F.col("_w") * 1.2)).otherwise(F.col("_w")))
    out = out.withColumn("_w", F.when(F.col("is_today") & (F.col("signal") == "temporal_patterns"), cap(F.col("_w") * 1.1)).otherwise(F.col("_w")))
    out = out.withColumn("weight", F.when(F.col("vigilance") == "maximum", cap(F.col("_w") * 1.15)).otherwise(F.col("_w")))
    return out.select(*keep, "signal", "weight")


def recommend_strategies(requests: DataFrame, keep: Sequence[str], k: int = 3) -> DataFrame:
    """Strategies by matching signals, the k best per request, ties in the order in which the signals reach them.

    Scored inside the row: no request is exploded before its list is cut to k.
    """
    sig = F.coalesce(tables.lookup(tables.INTENT_SIGNALS, F.col("intent")), F.array().cast("array<string>"))
    bonus = F.when(F.col("vigilance").isin("enhanced", "maximum"), 0.5).otherwise(0.0)
    entries = []
    for i, s in enumerate(tables.STRATEGIES):
        match = [g for g, names in tables.SIGNAL_STRATEGIES.items() if s in names]
        score = F.size(F.array_intersect("_sig", F.array(*[F.lit(m) for m in match]))).cast("double")
        if s in ("pattern_consistency", "cross_reference"):
            score = score + bonus
        # place of the first signal that reaches it, then its place in that signal's list; by vigilance alone: last
        reached = [F.when(F.array_contains("_sig", F.lit(g)), F.array_position("_sig", F.lit(g)) * 100 + tables.SIGNAL_STRATEGIES[g].index(s)) for g in match]
        first = F.coalesce(F.array_min(F.array_compact(F.array(*reached))) if reached else F.lit(None).cast("bigint"), F.lit(1_000_000 + i).cast("bigint"))
        entries.append(F.struct((-score).alias("neg"), first.alias("o"), F.lit(s).alias("strategy")))
    out = requests.withColumn("_sig", sig)
    scored = F.array_sort(F.filter(F.array(*entries), lambda e: e["neg"] < 0))
    fallback = F.array(F.struct(F.lit(0.0).alias("neg"), F.lit(0).cast("bigint").alias("o"), F.lit("behavioral_baseline").alias("strategy")))
    out = out.withColumn("_top", F.slice(F.when(F.size(scored) == 0, fallback).otherwise(scored), 1, k))
    out = out.select(*keep, F.posexplode_outer("_top").alias("_p", "e"))
    return out.select(*keep, (F.col("_p") + 1).alias("rank"), "e.strategy", (-F.col("e.neg")).alias("score"),
                      F.when(F.col("e.neg") <= -2, "High").otherwise("Standard").alias("confidence"))


def strategy_techniques(strategy: str) -> list[str]:
    return list(tables.STRATEGY_METHODS[strategy][2])


def run_strategy(df: DataFrame, strategy: str, features: Sequence[str], vigilance: str = "standard",
                 scorers: Mapping[str, Column] | None = None) -> DataFrame:
    """Score, combine and count flagged / review / cleared records of one strategy.

    ``scorers`` gives the score column of the techniques that were run; every
    other technique of the strategy falls back to the z-score baseline, and the
    technique really used is reported.
    """
    method, min_conf, names = tables.STRATEGY_METHODS[strategy]
    scorers = dict(scorers or {})
    base = scoring.zscore_score(df, features, "_base")
    used = [n if n in scorers else "zscore" for n in names]
    out = base.withColumns({f"_s{i}": scorers[n] if n in scorers else F.col("_base") for i, n in enumerate(names)})
    out = scoring.ensemble_vote(out, [f"_s{i}" for i in range(len(names))], method, "_c")
    cut, low = 0.5 * tables.VIGILANCE_CUT[vigilance], 0.3 * tables.VIGILANCE_CUT[vigilance]
    return out.agg(F.count(F.lit(1)).alias("records_analyzed"), F.count_if(F.col("_c") >= cut).alias("flagged"),
                   F.count_if((F.col("_c") >= low) & (F.col("_c") < cut)).alias("review"), F.count_if(F.col("_c") < low).alias("cleared"),
                   F.avg("_c").alias("raw_score")).select(
        F.lit(strategy).alias("strategy"), F.lit("|".join(used)).alias("techniques"), F.lit(vigilance).alias("vigilance"),
        F.lit("High" if min_conf >= 0.7 else "Standard").alias("confidence"), "records_analyzed", "flagged", "review", "cleared", "raw_score")


def unified_risk(outputs: DataFrame, key: Sequence[str], vigilance: str = "standard") -> DataFrame:
    """Weighted strategy scores to one index 0..100, a level and a confidence.

    ``outputs`` has strategy, raw_score, confidence, records_analyzed.
    """
    w = F.coalesce(tables.lookup(tables.STRATEGY_WEIGHTS, F.col("strategy")), F.lit(0.15))
    g = outputs.groupBy(*key).agg((F.sum(F.col("raw_score") * w) / F.sum(w)).alias("_s"), F.avg("confidence").alias("_c"),
                                  F.count(F.lit(1)).alias("strategies"), F.sum("records_analyzed").alias("records"))
    index = F.bround(F.least(F.lit(1.0), F.col("_s") * tables.VIGILANCE_RISK[vigilance]) * 100.0).cast("bigint")
    bonus = F.least(F.lit(0.15), F.col("strategies") * 0.03)
    penalty = F.when(F.col("records") < 100, 0.1).when(F.col("records") < 500, 0.05).otherwise(0.0)
    g = g.withColumn("risk_index", index).withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_c") + bonus - penalty)))
    g = g.withColumn("risk_level", ladder(F.col("risk_index"), [("<=", 30, "Low"), ("<=", 60, "Medium"), ("<=", 85, "High")], "Critical"))
    return g.withColumn("confidence_level", ladder(F.col("confidence"), [("<", 0.4, "Low"), ("<", 0.6, "Moderate"), ("<", 0.8, "High")], "Very High")).drop("_s", "_c")


# Finding kind to (kind of observation, title, opening of the text).
OBSERVATIONS = {
    "behavioral_baseline": ("observation", "Unusual Activity Level Detected", "Operations in {loc} showed {pct}% deviation from expected activity levels."),
    "volume_surge": ("observation", "Unusual Activity Level Detected", "Operations in {loc} showed {pct}% deviation from expected activity levels."),
    "operator_profiling": ("concern", "Operator Performance Deviation", "Operator work patterns in {loc} showed {pct}% deviation from established baselines."),
    "regional_deviation": ("observation", "Regional Pattern Variation - {loc}", "Operations in {loc} differ {pct}% from comparable regions."),
    "pattern_consistency": ("observation", "Inconsistent Pattern Detected", "Operations showed {pct}% inconsistency with historical patterns."),
    "temporal_trend": ("observation", "Temporal Anomaly Identified", "Time-based analysis revealed {pct}% deviation from expected trends."),
    "cross_reference": ("concern", "Cross-Operation Correlation Found", "Multiple operation types show {pct}% correlated anomalies."),
}
OTHER_OBSERVATION = ("observation", "Finding in {loc}", "Item identified for review with {pct}% concern level.")


def observations(findings: DataFrame, kind: str, score: str, location: str) -> DataFrame:
    """Findings (kind, score, location) to title, text and severity."""
    pct = F.floor(F.col(score) * 100).cast("string")
    pick = lambda i: F.coalesce(tables.lookup({k: v[i] for k, v in OBSERVATIONS.items()}, F.col(kind)), F.lit(OTHER_OBSERVATION[i]))
    fill = lambda t: F.replace(F.replace(t, F.lit("{loc}"), F.col(location)), F.lit("{pct}"), pct)
    return findings.withColumns({"observation": pick(0), "title": fill(pick(1)), "description": fill(pick(2)),
                                 "severity": ladder(F.col(score), [(">", 0.7, "Significant"), (">", 0.4, "Moderate")], "Minor")})


# ---------------------------------------------------------------- reports

def system_confidence(df: DataFrame, score: str, flag_columns: Sequence[Column] = (), expected: Sequence[str] = ("state", "district", "month", "year")) -> DataFrame:
    """Agreement of detectors, completeness, column coverage and score spread in one number."""
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    one = df.agg(F.count(F.lit(1)).alias("_n"), nulls.alias("_nulls"), F.stddev_pop(score).alias("_sd"),
                 *[F.count_if(c).cast("double").alias(f"_f{i}") for i, c in enumerate(flag_columns)])
    if len(flag_columns) > 1:
        cols = [F.col(f"_f{i}") for i in range(len(flag_columns))]
        mean = reduce(lambda a, b: a + b, cols) / float(len(cols))
        var = reduce(lambda a, b: a + b, [(c - mean) * (c - mean) for c in cols]) / float(len(cols))
        agree = F.greatest(F.lit(0.5), 1.0 - var / (mean + 1.0))
    else:
        agree = F.lit(0.85)
    quality = 1.0 - F.col("_nulls") / (F.col("_n") * len(df.columns))
    covered = sum(c in df.columns for c in expected) / len(expected)
    one = one.withColumn("model_agreement", agree).withColumn("data_quality", quality).withColumn("coverage", F.lit(covered))
    overall = F.col("model_agreement") * 0.4 + F.col("data_quality") * 0.3 + F.col("coverage") * 0.2 + (1.0 - F.col("_sd")) * 0.1
    return one.select(overall.alias("overall_confidence"), "model_agreement", "data_quality", "coverage")


def policy_impact(stats: DataFrame, value_per_record: int = 50_000, people_per_record: float = 2.5) -> DataFrame:
    """Value at stake, people affected and urgency from the anomaly statistics."""
    v = F.col("high_risk") * value_per_record
    people = F.floor(F.col("anomaly_count") * people_per_record)
    text = (F.when(v >= 10_000_000, F.format_string("₹%.1f Crore", v / 1e7)).when(v >= 100_000, F.format_string("₹%.1f Lakh", v / 1e5))
             .otherwise(F.format_string("₹%,d", v)))
    crowd = F.when(people >= 100_000, F.format_string("~%.1f Lakh individuals", people / 1e5)).otherwise(F.format_string("~%,d individuals", people))
    h, p = F.col("high_risk"), F.col("anomaly_pct")
    urgency = (F.when((h > 100) | (p > 10), "CRITICAL").when((h > 50) | (p > 5), "HIGH").when((h > 20) | (p > 2), "MEDIUM").otherwise("LOW"))
    return stats.select("high_risk", "anomaly_count", v.alias("value"), text.alias("value_text"), people.alias("people"), crowd.alias("people_text"), urgency.alias("urgency"))


def fraud_report(df: DataFrame, name: str) -> DataFrame:
    """One row: statistics, impact, regions, spikes as nested columns, and a text built from them."""
    stats = spread.pin(aggregate.anomaly_statistics(df))
    impact = policy_impact(stats).select(F.struct("value_text", "people_text", "urgency").alias("impact"))
    regions = aggregate.suspicious_regions(df, 3).agg(F.array_sort(F.collect_list(F.struct((-F.col("risk")).alias("o"), "state", "risk_level"))).alias("_r"))
    regions = regions.select(F.transform("_r", lambda r: F.struct(r["state"].alias("state"), r["risk_level"].alias("risk_level"))).alias("regions"))
    spikes = aggregate.temporal_trends(df).agg(F.array_sort(F.collect_list(F.when(F.col("spike"), F.col("month")))).alias("spike_months"))
    out = stats.crossJoin(F.broadcast(impact)).crossJoin(F.broadcast(regions)).crossJoin(F.broadcast(spikes))
    text = F.concat_ws("\n", F.lit(name), F.format_string("%.1f%% of records flagged as potentially fraudulent", "anomaly_pct"),
                       F.format_string("Detected %,d potentially fraudulent records out of %,d", "anomaly_count", "total_records"),
                       F.concat(F.lit("Highest risk regions: "), F.array_join(F.transform("regions", lambda r: r["state"]), ", ")),
                       F.concat(F.lit("Temporal spikes detected in: "), F.when(F.size("spike_months") == 0, "No significant spikes").otherwise(
                           F.array_join(F.transform("spike_months", lambda m: F.concat(F.lit("Month "), m.cast("string"))), ", "))),
                       F.concat(F.lit("Value at stake: "), "impact.value_text"), F.concat(F.lit("Urgency: "), "impact.urgency"))
    return out.withColumn("report_text", text)


def sanity_checklist(df: DataFrame, ratio: str, key: str = "district") -> DataFrame:
    """Data checks as (item, status, message) rows."""
    gender = {"male", "female"} <= set(df.columns)
    one = df.agg(F.countDistinct(key).alias("_d"), reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns]).alias("_m"),
                 F.count_if((F.col(ratio) < 0) | (F.col(ratio) > 1)).alias("_bad"))
    row = lambda item, status, msg: F.struct(F.lit(item).alias("item"), status.alias("status"), msg.alias("message"))
    n = lambda c: F.col(c).cast("string")
    rows = F.array(
        row("Gender columns", F.lit("ok" if gender else "warning"), F.lit("Male and female enrollment data available" if gender else "Male/female enrollment columns were estimated from age distribution")),
        row("District data", F.lit("ok"), F.concat(n("_d"), F.lit(" unique districts found"))),
        row("Missing values", F.when(F.col("_m") > 0, "info").otherwise("ok"), F.when(F.col("_m") > 0, F.concat(n("_m"), F.lit(" missing values imputed using median strategy"))).otherwise("No missing values detected")),
        row("Coverage ratio", F.when(F.col("_bad") > 0, "error").otherwise("ok"), F.when(F.col("_bad") > 0, F.concat(n("_bad"), F.lit(" records have invalid coverage ratio (<0 or >1)"))).otherwise("All coverage ratios within valid range [0, 1]")))
    return one.select(F.explode(rows).alias("e")).select("e.*")
