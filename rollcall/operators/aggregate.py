"""Roll-ups and report aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rollcall.functions import spread
from rollcall.functions.scalar import inclusion_risk_level, ladder
from rollcall.operators.joins import sum_by

AGES = ("age_0_5", "age_5_17", "age_18_greater")


def total_enrolled() -> Column:
    return F.col("age_0_5") + F.col("age_5_17") + F.col("age_18_greater")


def agg_geography(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum the head-counts, then recompute the ratios."""
    g = sum_by(df.select(*keys, *AGES), keys).withColumn("total", total_enrolled())
    return g.withColumns({f"{c}_ratio": F.col(c) / F.nullif("total", F.lit(0)) for c in AGES})


def enrolment_by_state(df: DataFrame, top: int = 10, growth: float = 0.05) -> DataFrame:
    g = df.groupBy("state").agg(F.sum(total_enrolled()).alias("total"), F.count(F.lit(1)).alias("records"),
                                F.countDistinct("district").alias("districts"))
    return (g.withColumn("projected_6m", F.round(F.col("total") * (1.0 + growth)).cast("bigint"))
             .orderBy(F.desc("total"), "state").limit(top))


def lowest_states(df: DataFrame, k: int = 10) -> DataFrame:
    return df.groupBy("state").agg(F.sum("age_18_greater").alias("adults")).orderBy("adults", "state").limit(k)


def penetration(df: DataFrame, population: DataFrame) -> DataFrame:
    """Penetration in percent and monthly velocity (rounded half up) per state."""
    g = df.groupBy("state").agg(F.sum(total_enrolled()).alias("total"),
                                F.countDistinct(F.trunc("date", "month")).alias("months"))
    g = g.join(population.select("state", "population"), "state", "left")
    return (g.withColumn("penetration_pct", F.col("total") * 100.0 / F.nullif("population", F.lit(0)))
             .withColumn("monthly_velocity", F.expr("(2 * total + months) div (2 * months)")))


def penetration_summary(p: DataFrame) -> DataFrame:
    return p.agg(F.count(F.lit(1)).alias("states"), F.sum("total").alias("total"), F.sum("population").alias("population"),
                 F.count("penetration_pct").alias("with_data"), F.avg("penetration_pct").alias("mean_penetration"))


def enrolment_efficiency(p: DataFrame) -> DataFrame:
    """Actual over expected, expected = population at the overall rate of states with a population."""
    known = F.col("population").isNotNull()
    out = spread.with_totals(p, F.sum(F.when(known, F.col("total"))).alias("_t"), F.sum("population").alias("_p"))
    expected = F.col("population") * (F.col("_t") / F.col("_p"))
    return (out.withColumn("expected", F.round(expected)).withColumn("eei", F.col("total") / F.nullif(expected, F.lit(0.0)))
               .drop("_t", "_p"))


def state_growth_features(p: DataFrame, high: int = 10_000) -> DataFrame:
    v = F.col("monthly_velocity")
    return (p.withColumn("growth_pct", v * 100.0 / F.nullif(F.col("total") - v, F.lit(0)))
             .withColumn("seasonality", F.when(F.col("months") > 2, 1.0 - 1.0 / F.col("months")))
             .withColumn("high_velocity", (v > high).cast("int")))


# ---------------------------------------------------------------- gender and groups

# Male share in thousandths by state, and the national default.
MALE_MILLI = {
    "Haryana": 535, "Punjab": 530, "Jammu And Kashmir": 530, "Rajasthan": 528, "Uttar Pradesh": 525, "Bihar": 524,
    "Gujarat": 522, "Madhya Pradesh": 520, "Maharashtra": 518, "Delhi": 530, "Kerala": 485, "Tamil Nadu": 498,
    "Andhra Pradesh": 502, "Karnataka": 510, "West Bengal": 512, "Odisha": 508,
}
DEFAULT_MALE_MILLI = 515


def male_milli(state: Column) -> Column:
    """Share by containment either way, first entry wins."""
    s = F.lower(state)
    out = F.lit(None).cast("int")
    for name, milli in reversed(MALE_MILLI.items()):
        n = F.lit(name.lower())
        out = F.when(s.contains(n) | n.contains(s), F.lit(milli)).otherwise(out)
    return F.coalesce(out, F.lit(DEFAULT_MALE_MILLI))


def gender_ratios(g: DataFrame) -> DataFrame:
    """Shares of the total enrolment (of male and female where no ``total`` is given); 0 where there is none."""
    whole = F.nullif(F.col("total") if "total" in g.columns else F.col("male") + F.col("female"), F.lit(0))
    share = lambda x, of: F.coalesce(x / of, F.lit(0.0))
    return (g.withColumn("male_ratio", share(F.col("male"), whole)).withColumn("female_ratio", share(F.col("female"), whole))
             .withColumn("gender_gap", share(F.col("male") - F.col("female"), whole))
             .withColumn("female_per_male", share(F.col("female"), F.nullif("male", F.lit(0)))))


def gender_coverage(df: DataFrame, ratios: DataFrame | None = None, by: Sequence[str] = ("state", "district")) -> DataFrame:
    """Male and female counts estimated per record (rounded), then summed.

    ``ratios`` maps state to ``male_milli``; Catalyst broadcasts it while it is
    under the broadcast threshold.
    """
    t = df.withColumn("total", total_enrolled())
    if ratios is None:
        t = t.withColumn("male_milli", male_milli(F.col("state")))
    else:
        t = t.join(ratios.select("state", "male_milli"), "state", "left").fillna(DEFAULT_MALE_MILLI, ["male_milli"])
    half_up = lambda milli: F.floor((F.col("total") * milli + 500) / 1000)
    t = t.withColumn("male", half_up(F.col("male_milli"))).withColumn("female", half_up(1000 - F.col("male_milli")))
    g = t.groupBy(*by).agg(F.sum("total").alias("total"), F.sum("male").alias("male"), F.sum("female").alias("female"),
                           F.countDistinct("district").alias("districts"), F.count(F.lit(1)).alias("records"))
    return gender_ratios(g)


def gender_national(states: DataFrame, districts: DataFrame) -> DataFrame:
    """One row over the state and district tables of ``gender_coverage``: records, states, districts, counts and the mean gap of the states."""
    s = states.agg(F.sum("records").alias("records"), F.count(F.lit(1)).alias("states"), F.sum("male").alias("male"), F.sum("female").alias("female"),
                   F.avg("gender_gap").alias("avg_gender_gap"))
    return spread.with_global(s, districts.agg(F.count(F.lit(1)).alias("districts")))


def gender_features(df: DataFrame) -> DataFrame:
    """Estimate male/female from the age sum where they are missing; 0 totals give NULL ratios."""
    t = total_enrolled()
    out = (df.withColumn("male", F.coalesce(F.col("male").cast("double"), t * 0.515))
             .withColumn("female", F.coalesce(F.col("female").cast("double"), t * 0.485)))
    both = F.nullif(F.col("male") + F.col("female"), F.lit(0.0))
    return (out.withColumn("male_ratio", F.col("male") / both).withColumn("female_ratio", F.col("female") / both)
               .withColumn("gender_gap", (F.col("male") - F.col("female")) / both))


# Expected population shares.
EXPECTED_SHARE = {"children": 0.12, "youth": 0.25, "adults": 0.63, "elderly": 0.10, "disabled": 0.022}


def group_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    total = total_enrolled()
    return df.groupBy(*keys).agg(
        F.sum("age_0_5").alias("children"), F.sum("age_5_17").alias("youth"), F.sum("age_18_greater").alias("adults"),
        F.sum(F.floor((F.col("age_18_greater") * 15 + 50) / 100)).alias("elderly"),
        F.sum(F.floor((total * 22 + 500) / 1000)).alias("disabled"), F.sum(total).alias("total"))


def vulnerable_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and group: coverage score against the expected share, status, overall score."""
    g = group_counts(df, keys)
    base = F.when(F.col("total") == 0, F.lit(1)).otherwise(F.col("total"))
    score = lambda name, share: F.least(F.lit(100), F.round((F.col(name) / base) / share * 100).cast("bigint"))
    scores = {f"_{n}": score(n, s) for n, s in EXPECTED_SHARE.items()}
    g = g.withColumns(scores)
    overall = F.round(sum((F.col(f"_{n}") for n in EXPECTED_SHARE), F.lit(0)) / 5.0).cast("bigint")
    g = g.withColumn("overall", overall)
    rows = F.array(*[F.struct(F.lit(n).alias("grp"), F.col(n).alias("enrolled"), F.col(f"_{n}").alias("coverage_score"),
                              (F.lit(s) - F.col(n) / base).alias("gap")) for n, s in EXPECTED_SHARE.items()])
    return (g.select(*keys, "total", "overall", inclusion_risk_level(F.col("overall")).alias("risk_level"), F.explode(rows).alias("e"))
             .select(*keys, "total", "overall", "risk_level", "e.*")
             .withColumn("status", ladder(F.col("coverage_score"), [(">=", 80, "GOOD"), (">=", 50, "MODERATE")], "LOW")))


def vulnerable_national(states: DataFrame, districts: DataFrame) -> DataFrame:
    """One row over ``vulnerable_groups`` per state and per district: people per group, states, districts, mean overall score of the states."""
    own = states.groupBy("state").agg(F.max("overall").alias("overall"), *[F.max(F.when(F.col("grp") == n, F.col("enrolled"))).alias(n) for n in EXPECTED_SHARE])
    s = own.agg(F.count(F.lit(1)).alias("states"), F.avg("overall").alias("avg_inclusion_score"), *[F.sum(n).alias(n) for n in EXPECTED_SHARE])
    return spread.with_global(s, districts.agg(F.countDistinct("state", "district").alias("districts")))


def vulnerable_high_risk(v: DataFrame, keys: Sequence[str], below: int = 40, k: int = 10,
                         groups: Sequence[str] = ("children", "elderly", "disabled")) -> DataFrame:
    w = W.partitionBy("grp").orderBy("overall", *keys)
    return (v.filter(F.col("grp").isin(*groups) & (F.col("coverage_score") < below))
             .withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k))


def coverage_stats(df: DataFrame, ratio: str, label: str, worst: int = 10) -> DataFrame:
    """One row: distribution of the ratio, share of high-risk rows, the worst districts."""
    base = df.agg(F.count(F.lit(1)).alias("n"), F.avg(ratio).alias("mean_ratio"), F.min(ratio).alias("min_ratio"),
                  F.max(ratio).alias("max_ratio"), F.stddev_samp(ratio).alias("std_ratio"),
                  F.avg(label).alias("high_risk_share"), F.countDistinct("state").alias("states"),
                  F.countDistinct("district").alias("districts"))
    med = spread.quantiles(df, [ratio], [0.5]).withColumnRenamed(f"{ratio}_q0", "median_ratio")
    low = (df.orderBy(ratio, "district").limit(worst)
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ratio, "district"))), lambda s: s["district"]), "|").alias("worst")))
    return base.crossJoin(F.broadcast(med)).crossJoin(F.broadcast(low))


# ---------------------------------------------------------------- score reports

def score_groups(df: DataFrame, keys: Sequence[str], score: str = "score", cut: float = 0.5) -> DataFrame:
    g = df.groupBy(*keys).agg(F.avg(score).alias("mean_score"), F.max(score).alias("max_score"),
                              F.count(F.lit(1)).alias("total"), F.count_if(F.col(score) >= cut).alias("anomaly_count"))
    return g.withColumn("anomaly_rate", F.col("anomaly_count") / F.col("total"))


def anomaly_statistics(df: DataFrame, score: str = "score", flagged: Column | None = None,
                       high: float = 0.8, medium: float = 0.5) -> DataFrame:
    s = F.col(score)
    flag = flagged if flagged is not None else s >= medium
    base = df.agg(F.count(F.lit(1)).alias("total_records"), F.count_if(flag).alias("anomaly_count"),
                  F.count_if(s >= high).alias("high_risk"), F.count_if((s >= medium) & (s < high)).alias("medium_risk"),
                  F.avg(s).alias("mean_score"), F.max(s).alias("max_score"), F.stddev_pop(s).alias("std_score"))
    med = spread.quantiles(df, [score], [0.5]).withColumnRenamed(f"{score}_q0", "median_score")
    return (base.crossJoin(F.broadcast(med))
            .withColumn("anomaly_pct", F.col("anomaly_count") * 100.0 / F.col("total_records"))
            .withColumn("low_risk", F.greatest(F.lit(0), F.col("anomaly_count") - F.col("high_risk") - F.col("medium_risk"))))


def entity_level(mean: Column) -> Column:
    return ladder(mean, [(">=", 0.7, "HIGH"), (">=", 0.4, "MEDIUM")], "LOW")


def _patterns(*pairs: tuple[Column, str], default: str) -> Column:
    found = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in pairs]))
    return F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found)


def suspicious_regions(df: DataFrame, k: int = 10) -> DataFrame:
    g = score_groups(df, ["state"])
    g = g.withColumn("risk", F.col("mean_score") * 0.6 + F.col("anomaly_rate") * 0.4).orderBy(F.desc("risk"), "state").limit(k)
    return (g.withColumn("risk_level", entity_level(F.col("mean_score")))
             .withColumn("patterns", _patterns((F.col("anomaly_rate") > 0.1, "High anomaly concentration"),
                                               (F.col("max_score") > 0.9, "Contains extreme outliers"),
                                               (F.col("mean_score") > 0.6, "Elevated average risk"),
                                               default="Standard deviation pattern")))


def suspicious_centers(df: DataFrame, key: str = "center_id", k: int = 10, min_rows: int = 5) -> DataFrame:
    """High volume is judged against p90 of the k listed centres."""
    g = score_groups(df, [key]).filter(F.col("total") >= min_rows).orderBy(F.desc("mean_score"), key).limit(k)
    g = spread.with_totals(g, F.percentile("total", 0.9).alias("_p90"))
    return (g.withColumn("risk_level", entity_level(F.col("mean_score")))
             .withColumn("patterns", _patterns((F.col("anomaly_rate") > 0.15, "Unusually high fraud rate"),
                                               (F.col("total") > F.col("_p90"), "High volume center"),
                                               default="Elevated risk indicators")).drop("_p90"))


def suspicious_operators(df: DataFrame, key: str = "operator_id", k: int = 10, min_rows: int = 3) -> DataFrame:
    g = score_groups(df, [key]).filter(F.col("total") >= min_rows).orderBy(F.desc("mean_score"), key).limit(k)
    return (g.withColumn("risk_level", entity_level(F.col("mean_score")))
             .withColumn("patterns", _patterns((F.col("anomaly_rate") > 0.2, "Suspicious activity pattern"),
                                               (F.col("mean_score") > 0.7, "Consistently high-risk operations"),
                                               default="Requires investigation")))


def temporal_trends(df: DataFrame, month: str = "month") -> DataFrame:
    g = score_groups(df, [month])
    ends = g.agg(F.avg("anomaly_rate").alias("_mean"), F.min_by("mean_score", month).alias("_first"),
                 F.max_by("mean_score", month).alias("_last"), F.count(F.lit(1)).alias("_n"))
    g = spread.with_global(g, ends)
    direction = (F.when(F.col("_n") < 3, "stable").when(F.col("_last") > F.col("_first") * 1.1, "increasing")
                  .when(F.col("_last") < F.col("_first") * 0.9, "decreasing").otherwise("stable"))
    spike = F.col("anomaly_rate") > F.col("_mean") * 1.5
    return (g.withColumn("trend_direction", direction).withColumn("spike", spike)
             .withColumn("spike_magnitude", F.when(spike, F.col("anomaly_rate") / F.col("_mean")))
             .drop("_mean", "_first", "_last", "_n"))


def weekend_split(df: DataFrame) -> DataFrame:
    g = score_groups(df, ["is_weekend"])
    return g.withColumn("spike", (F.col("is_weekend") == 1) & (F.col("anomaly_rate") > 0.1))


def monthly_score_trend(df: DataFrame, month: str = "month") -> DataFrame:
    g = df.groupBy(month).agg(F.count_if(F.col("score") >= 0.5).alias("flagged"), F.avg("score").alias("mean_score"))
    g = spread.with_totals(g, F.avg("flagged").alias("_m"))
    return g.withColumn("spike_magnitude", F.col("flagged") / F.greatest(F.lit(1.0), F.col("_m"))).drop("_m")


def score_histogram(df: DataFrame, score: str = "score", bins: int = 49) -> DataFrame:
    """Equal bins on [0, 1], last bin closed, empty bins kept."""
    b = F.greatest(F.lit(1), F.least(F.floor(F.col(score) * bins) + 1, F.lit(bins)))
    counts = df.filter(F.col(score).between(0, 1)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin")
    return (spine.join(counts, "bin", "left").fillna(0, ["n"])
                 .withColumn("lower", (F.col("bin") - 1) / float(bins)).withColumn("upper", F.col("bin") / float(bins)))


def risk_bands(df: DataFrame, score: str, cuts: Sequence[tuple[str, float]], closed: bool = True) -> DataFrame:
    """Row counts per band; ``cuts`` runs from the highest band down, the last is the floor."""
    s = F.col(score)
    hit = (lambda c: s >= c) if closed else (lambda c: s > c)
    aggs, above = [], F.lit(False)
    for name, cut in cuts:
        here = hit(cut) & ~above
        aggs.append(F.count_if(here).alias(name))
        above = above | hit(cut)
    return df.agg(*aggs)


def threshold_sensitivity(df: DataFrame, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Flagged rows per threshold in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(score) >= t).alias(f"_{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_{i}").alias("flagged")) for i, t in enumerate(thresholds)])
    out = one.select("total", F.explode(rows).alias("e")).select("e.*", "total")
    pct = F.col("flagged") * 100.0 / F.col("total")
    return out.withColumn("pct", pct).withColumn("action", ladder(pct, [(">", 20, "High"), (">", 10, "Medium")], "Low"))


def normal_vs_anomalous(df: DataFrame, features: Sequence[str], flag: Column, k: int = 10) -> DataFrame:
    one = df.agg(*[F.avg(F.when(cond, F.col(c))).alias(f"{n}_{c}") for c in features
                   for n, cond in (("a", flag), ("n", ~flag))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("normal_mean"), F.col(f"a_{c}").alias("anomalous_mean"))
                     for c in features])
    out = one.select(F.explode(rows).alias("e")).select("e.*")
    return out.withColumn("difference", F.col("anomalous_mean") - F.col("normal_mean")).orderBy(F.desc(F.abs("difference")), "feature").limit(k)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlations of all given columns, in one aggregate."""
    cols = list(columns)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"_{i}").alias("r")))
    return one.select(F.explode(F.array(*cells)).alias("e")).select("e.*")


def choropleth_table(df: DataFrame, geo: str, value: str) -> DataFrame:
    g = df.groupBy(geo).agg(F.avg(value).alias("value"), F.sum("male").alias("male"), F.sum("female").alias("female"))
    return spread.with_totals(g, F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value"))


def gender_by_state(df: DataFrame, k: int = 15) -> DataFrame:
    g = df.groupBy("state").agg(F.sum("male").alias("male"), F.sum("female").alias("female"))
    return g.withColumn("total", F.col("male") + F.col("female")).orderBy(F.desc("total"), "state").limit(k)


def risk_summary(df: DataFrame) -> DataFrame:
    """Counts and shares per category, mean, five worst states, high-risk-state ratio."""
    base = df.agg(F.count(F.lit(1)).alias("n"), F.avg("risk_score").alias("mean_risk"),
                  F.avg(F.when(F.col("is_high_risk_state") == 1, F.col("risk_score"))).alias("_hi"),
                  F.avg(F.when(F.col("is_high_risk_state") == 0, F.col("risk_score"))).alias("_lo"))
    top = df.orderBy(F.desc("risk_score"), "state").limit(5).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("risk_score")).alias("s"), "state"))), lambda s: s["state"]), "|").alias("top_states"))
    cats = df.groupBy("category").agg(F.count(F.lit(1)).alias("rows"))
    out = cats.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(top))
    return (out.withColumn("pct", F.col("rows") * 100.0 / F.col("n"))
               .withColumn("high_state_ratio", F.col("_hi") / (F.col("_lo") + 0.01)).drop("_hi", "_lo"))


def region_score_heat(df: DataFrame, geo: str, k: int) -> DataFrame:
    g = df.groupBy(geo).agg(F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("mean_score"), geo).limit(k)


def auditor_summary(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Bands, states above .5 (five), the five widest features, months above 1.5 times the mean; as (section, item, value)."""
    bands = risk_bands(df, "score", [("high", 0.8), ("medium", 0.5), ("low", 0.0)], closed=False)
    part = lambda x, sec: x.select(F.lit(sec).alias("section"), F.col("item"), F.col("value").cast("double").alias("value"))
    b = bands.select(F.explode(F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).alias("value")) for n in ("high", "medium", "low")])).alias("e")).select("e.*")
    states = (df.groupBy("state").agg(F.avg("score").alias("value")).filter("value > 0.5")
                .orderBy(F.desc("value"), "state").limit(5).withColumnRenamed("state", "item"))
    diff = normal_vs_anomalous(df, features, F.col("score") > 0.5, 5).select(F.col("feature").alias("item"), F.col("difference").alias("value"))
    spikes = (monthly_score_trend(df).filter("spike_magnitude > 1.5")
              .select(F.col("month").cast("string").alias("item"), F.col("spike_magnitude").alias("value")))
    return part(b, "band").unionByName(part(states, "state")).unionByName(part(diff, "pattern")).unionByName(part(spikes, "spike"))


def centre_performance(df: DataFrame, key: str = "state", k: int = 20) -> DataFrame:
    g = df.groupBy(key).agg(F.avg("centre_quality_score").alias("quality"), F.avg("biometric_update_ratio").alias("bio_ratio"),
                            F.avg("risk_score").alias("risk"), F.count_if(F.col("risk_score") >= 0.6).alias("high_risk"),
                            F.sum("total_population").alias("captures"))
    g = g.withColumn("failure_proxy", F.greatest(F.lit(0.0), 1.0 - F.col("quality")) * F.col("risk"))
    s = F.col("quality") * 0.6 + (1.0 - F.col("failure_proxy")) * 0.4
    grade = ladder(s, [(">=", 0.8, "A - Excellent"), (">=", 0.6, "B - Good"), (">=", 0.4, "C - Needs Improvement")],
                   "D - Critical Attention Required")
    return g.withColumn("grade", grade).orderBy(F.desc("failure_proxy"), key).limit(k)


# Age buckets, ratio column, risk multiplier.
AGE_BUCKETS = (("0-17", "ratio_0_17", 0.5), ("18-34", "ratio_18_34", 0.7), ("35-49", "ratio_35_49", 1.0),
               ("50-64", "ratio_50_64", 1.5), ("65+", "ratio_65_plus", 2.5))


def age_bucket_analysis(df: DataFrame) -> DataFrame:
    one = df.agg(F.avg("risk_score").alias("_r"), *[F.avg(c).alias(c) for _, c, _ in AGE_BUCKETS])
    risk = {b: F.least(F.lit(1.0), F.col("_r") * m / 1.5) for b, _, m in AGE_BUCKETS}
    rows = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(c).alias("share"), risk[b].alias("estimated_risk")) for b, c, _ in AGE_BUCKETS])
    worst = F.element_at(F.array_sort(F.transform(rows, lambda s: F.struct((-s["estimated_risk"]).alias("n"), s["bucket"].alias("b")))), 1)["b"]
    return (one.withColumn("elderly_ratio", risk["65+"] / F.greatest(risk["18-34"], F.lit(0.01))).withColumn("worst_bucket", worst)
               .select("elderly_ratio", "worst_bucket", F.explode(rows).alias("e")).select("e.*", "elderly_ratio", "worst_bucket"))


def cluster_summary(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(f"mean_{c}") for c in features])
    return spread.with_totals(g, F.sum("size").alias("_n")).withColumn("pct", F.col("size") * 100.0 / F.col("_n")).drop("_n")


def geo_hhi(df: DataFrame, keys: Sequence[str] = ("state", "district")) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return g.agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("_q"), F.sum("c").alias("_n")).select(
        (F.col("_q") / (F.col("_n").cast("double") * F.col("_n"))).alias("hhi"))


def compliance_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("policy_id").agg(F.count(F.lit(1)).alias("audit_entries"), F.sum("records_processed").alias("records_processed"),
                                          F.sum("flags_raised").alias("flags_raised"))
