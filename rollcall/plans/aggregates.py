"""Roll-ups and report aggregates."""

from pyspark.sql import functions as F

from rollcall.functions.scalar import risk_category
from rollcall.operators import aggregate as agg
from rollcall.plans import views
from rollcall.plans.registry import query, rounded
from rollcall.sources.domain import Domain

AGES = agg.AGES
S = lambda e, a: f"CAST(sum({e}) AS BIGINT) AS {a}"
T = "age_0_5+age_5_17+age_18_greater"


def _geo(name: str, keys: list[str]) -> None:
    k = ", ".join(keys)
    sql = (f"SELECT {k}, {', '.join(AGES)}, total, " + ", ".join(f"round({c}/total::DOUBLE,6) AS {c}_ratio" for c in AGES)
           + f" FROM (SELECT {k}, {', '.join(S(c, c) for c in AGES)}, {S(T, 'total')} FROM enrol GROUP BY {k})")
    query(name, sql)(lambda d: rounded(agg.agg_geography(d.enrolment(), keys)))


_geo("agg_state", ["state"])
_geo("agg_district", ["state", "district"])
_geo("agg_pincode", ["state", "district", "pincode"])


@query("enrolment_by_state", f"""SELECT state, {S(T, 'total')}, count(*) AS records, count(DISTINCT district) AS districts,
 CAST(round(sum({T})::DOUBLE*1.05e0) AS BIGINT) AS projected_6m FROM enrol GROUP BY 1 ORDER BY total DESC, state LIMIT 10""")
def enrolment_by_state(d: Domain):
    return agg.enrolment_by_state(d.enrolment())


@query("lowest_states", f"SELECT state, {S('age_18_greater', 'adults')} FROM enrol GROUP BY 1 ORDER BY adults, state LIMIT 10")
def lowest_states(d: Domain):
    return agg.lowest_states(d.enrolment())


_PEN = f"""SELECT e.state, total, months, population, total*100e0/population AS penetration_pct, (2*total+months)//(2*months) AS monthly_velocity FROM
 (SELECT state, {S(T, 'total')}, count(DISTINCT date_trunc('month', date)) AS months FROM enrol GROUP BY 1) e
 LEFT JOIN regions r ON e.state=r.state"""


def _pen(d: Domain):
    return agg.penetration(d.enrolment(), d.regions())


@query("penetration", f"SELECT * REPLACE (round(penetration_pct,9) AS penetration_pct) FROM ({_PEN})")
def penetration(d: Domain):
    return rounded(_pen(d), 9)


@query("penetration_summary", f"""SELECT count(*) AS states, {S('total', 'total')}, {S('population', 'population')}, count(penetration_pct) AS with_data,
 round(avg(penetration_pct),6) AS mean_penetration FROM ({_PEN})""")
def penetration_summary(d: Domain):
    return rounded(agg.penetration_summary(_pen(d)))


@query("enrolment_efficiency", f"""SELECT state, total, round(population*(t/p)) AS expected, round(total/(population*(t/p)),6) AS eei FROM ({_PEN}) x,
 (SELECT sum(CASE WHEN population IS NOT NULL THEN total END)::DOUBLE t, sum(population)::DOUBLE p FROM ({_PEN})) g""")
def enrolment_efficiency(d: Domain):
    return rounded(agg.enrolment_efficiency(_pen(d)).select("state", "total", "expected", "eei"))


@query("state_growth_features", f"""SELECT state, monthly_velocity, round(monthly_velocity*100e0/nullif(total-monthly_velocity,0),6) AS growth_pct,
 round(CASE WHEN months>2 THEN 1e0-1e0/months END,6) AS seasonality, CAST(monthly_velocity>2000 AS BIGINT) AS high_velocity FROM ({_PEN})""")
def state_growth_features(d: Domain):
    return rounded(agg.state_growth_features(_pen(d), 2000).select("state", "monthly_velocity", "growth_pct", "seasonality", "high_velocity"))


_COV = "round(male_ratio,6) AS male_ratio, round(female_ratio,6) AS female_ratio, round(gender_gap,6)+0e0 AS gender_gap, round(female_per_male,6) AS female_per_male"


@query("gender_coverage", f"""SELECT 'district' AS level, state, district, total, male, female, districts, records, {_COV} FROM coverage
 UNION ALL SELECT 'state', state, NULL, total, male, female, districts, records, {_COV} FROM (SELECT *, coalesce(male/nullif(total,0)::DOUBLE,0) AS male_ratio,
 coalesce(female/nullif(total,0)::DOUBLE,0) AS female_ratio, coalesce((male-female)/nullif(total,0)::DOUBLE,0) AS gender_gap, coalesce(female/nullif(male,0)::DOUBLE,0) AS female_per_male FROM
 (SELECT state, {S('total', 'total')}, {S('male', 'male')}, {S('female', 'female')}, count(*) AS districts, {S('records', 'records')} FROM coverage GROUP BY 1))""")
def gender_coverage(d: Domain):
    dist = agg.gender_coverage(d.enrolment(), views.ratios(d)).withColumn("level", F.lit("district"))
    st = agg.gender_coverage(d.enrolment(), views.ratios(d), ["state"]).withColumn("level", F.lit("state"))
    return rounded(dist.unionByName(st, allowMissingColumns=True))


@query("gender_national", f"""SELECT records, states, districts, male, female, round(avg_gender_gap,9)+0e0 AS avg_gender_gap FROM (SELECT {S('records', 'records')}, count(*) AS states, {S('male', 'male')}, {S('female', 'female')},
 avg(coalesce((male-female)/nullif(total,0)::DOUBLE,0)) AS avg_gender_gap FROM (SELECT state, {S('total', 'total')}, {S('male', 'male')}, {S('female', 'female')}, {S('records', 'records')} FROM coverage GROUP BY 1)), (SELECT count(*) AS districts FROM coverage)""")
def gender_national(d: Domain):
    """National summary of the gender coverage."""
    dist, st = (agg.gender_coverage(d.enrolment(), views.ratios(d), by) for by in (["state", "district"], ["state"]))
    return rounded(agg.gender_national(st, dist), 9)


@query("gender_features", f"""SELECT record_id, round(male,4) AS male, round(female,4) AS female, round(male/nullif(male+female,0),6) AS male_ratio,
 round((male-female)/nullif(male+female,0),6)+0e0 AS gender_gap FROM (SELECT record_id, CASE WHEN record_id%3=0 THEN t*0.515e0 ELSE record_id%50 END::DOUBLE AS male,
 CASE WHEN record_id%3=0 THEN t*0.485e0 ELSE record_id%41 END::DOUBLE AS female FROM (SELECT record_id, {T} AS t FROM enrol))""")
def gender_features(d: Domain):
    k = F.col("record_id")
    e = d.enrolment().withColumn("male", F.when(k % 3 != 0, k % 50)).withColumn("female", F.when(k % 3 != 0, k % 41))
    return rounded(agg.gender_features(e), male=4, female=4).select("record_id", "male", "female", "male_ratio", "gender_gap")


_GRP = {"children": "age_0_5", "youth": "age_5_17", "adults": "age_18_greater", "elderly": "(age_18_greater*15+50)//100", "disabled": f"(({T})*22+500)//1000"}


def _vuln_sql(keys: str) -> str:
    base = f"SELECT {keys}, {S(T, 'total')}, {', '.join(S(e, n) for n, e in _GRP.items())} FROM enrol GROUP BY {keys}"
    sc = ", ".join(f"least(100, CAST(round(({n}/total::DOUBLE)/{s}e0*100) AS BIGINT)) AS s_{n}" for n, s in agg.EXPECTED_SHARE.items())
    mid = f"SELECT *, CAST(round(({'+'.join('s_' + n for n in _GRP)})/5e0) AS BIGINT) AS overall FROM (SELECT *, {sc} FROM ({base}))"
    rows = " UNION ALL ".join(f"SELECT {keys}, total, overall, '{n}' AS grp, {n} AS enrolled, s_{n} AS coverage_score, {s}e0-{n}/total::DOUBLE AS gap FROM ({mid})"
                              for n, s in agg.EXPECTED_SHARE.items())
    return f"""SELECT *, CASE WHEN overall<40 THEN 'CRITICAL' WHEN overall<60 THEN 'HIGH' WHEN overall<80 THEN 'MODERATE' ELSE 'LOW' END AS risk_level,
 CASE WHEN coverage_score>=80 THEN 'GOOD' WHEN coverage_score>=50 THEN 'MODERATE' ELSE 'LOW' END AS status FROM ({rows})"""


@query("vulnerable_groups", f"SELECT * REPLACE (round(gap,6)+0e0 AS gap) FROM ({_vuln_sql('state, district')})")
def vulnerable_groups(d: Domain):
    return rounded(agg.vulnerable_groups(d.enrolment(), ["state", "district"]))


_GROUPS = ", ".join(f"CAST(sum(CASE WHEN grp='{n}' THEN enrolled END) AS BIGINT) AS {n}" for n in _GRP)


@query("vulnerable_national", f"""SELECT count(DISTINCT state) AS states, (SELECT count(*) FROM (SELECT DISTINCT state, district FROM enrol)) AS districts, round(avg(overall),9) AS avg_inclusion_score, {_GROUPS} FROM ({_vuln_sql('state')})""")
def vulnerable_national(d: Domain):
    """National summary of the vulnerable groups."""
    by = lambda *keys: agg.vulnerable_groups(d.enrolment(), list(keys))
    return rounded(agg.vulnerable_national(by("state"), by("state", "district")), 9)


@query("vulnerable_high_risk", f"""SELECT grp, rn, state, district, overall, coverage_score FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY overall, state, district) AS rn
 FROM ({_vuln_sql('state, district')}) WHERE grp IN ('children','elderly','disabled') AND coverage_score<97) WHERE rn<=10""")
def vulnerable_high_risk(d: Domain):
    v = agg.vulnerable_groups(d.enrolment(), ["state", "district"])
    return agg.vulnerable_high_risk(v, ["state", "district"], below=97).select("grp", "rn", "state", "district", "overall", "coverage_score")


@query("coverage_stats", """SELECT count(*) AS n, round(avg(female_ratio),6) AS mean_ratio, round(min(female_ratio),6) AS min_ratio, round(max(female_ratio),6) AS max_ratio,
 round(stddev_samp(female_ratio),6) AS std_ratio, round(avg(CAST(female_ratio<0.46e0 AS INT)),6) AS high_risk_share, count(DISTINCT state) AS states, count(DISTINCT district) AS districts,
 round(quantile_cont(female_ratio,0.5),6) AS median_ratio, (SELECT string_agg(district,'|' ORDER BY female_ratio, district) FROM (SELECT * FROM coverage ORDER BY female_ratio, district LIMIT 10)) AS worst FROM coverage""")
def coverage_stats(d: Domain):
    c = views.coverage(d).withColumn("high_risk", (F.col("female_ratio") < 0.46).cast("int"))
    return rounded(agg.coverage_stats(c, "female_ratio", "high_risk"))


# ---------------------------------------------------------------- score reports

@query("anomaly_statistics", """SELECT count(*) AS total_records, count_if(score>=0.5e0) AS anomaly_count, count_if(score>=0.8e0) AS high_risk,
 count_if(score>=0.5e0 AND score<0.8e0) AS medium_risk, round(avg(score),6) AS mean_score, round(max(score),6) AS max_score, round(stddev_pop(score),6) AS std_score,
 round(quantile_cont(score,0.5),6) AS median_score, round(count_if(score>=0.5e0)*100e0/count(*),6) AS anomaly_pct, CAST(0 AS BIGINT) AS low_risk FROM scored""")
def anomaly_statistics(d: Domain):
    return rounded(agg.anomaly_statistics(views.scored(d)))


def _groups(keys: str) -> str:
    return (f"SELECT *, anomaly_count/total::DOUBLE AS anomaly_rate FROM (SELECT {keys}, avg(score) AS mean_score, max(score) AS max_score, count(*) AS total, "
            f"count_if(score>=0.5e0) AS anomaly_count FROM scored GROUP BY {keys})")


_LEVEL = "CASE WHEN mean_score>=0.7e0 THEN 'HIGH' WHEN mean_score>=0.4e0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level"


def _pat(default: str, *pairs: tuple[str, str]) -> str:
    parts = ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in pairs)
    return f"coalesce(nullif(concat_ws('|', {parts}), ''), '{default}') AS patterns"


def _entity(df):
    return rounded(df.withColumn("patterns", F.array_join("patterns", "|")))


_ENT = "total, anomaly_count, round(anomaly_rate,6) AS anomaly_rate, round(mean_score,6) AS mean_score, round(max_score,6) AS max_score, risk_level, patterns"


@query("suspicious_regions", f"SELECT state, round(risk,6) AS risk, {_ENT} FROM (SELECT *, {_LEVEL}, " + _pat(
    "Standard deviation pattern", ("anomaly_rate>0.1e0", "High anomaly concentration"), ("max_score>0.9e0", "Contains extreme outliers"),
    ("mean_score>0.6e0", "Elevated average risk")) + f" FROM (SELECT *, mean_score*0.6e0+anomaly_rate*0.4e0 AS risk FROM ({_groups('state')}) ORDER BY risk DESC, state LIMIT 10))")
def suspicious_regions(d: Domain):
    return _entity(agg.suspicious_regions(views.scored(d)))


@query("suspicious_centers", f"SELECT center_id, {_ENT} FROM (SELECT *, {_LEVEL}, " + _pat(
    "Elevated risk indicators", ("anomaly_rate>0.15e0", "Unusually high fraud rate"), ("total>p90", "High volume center"))
    + f" FROM (SELECT *, quantile_cont(total,0.9) OVER () AS p90 FROM (SELECT * FROM ({_groups('center_id')}) WHERE total>=5 ORDER BY mean_score DESC, center_id LIMIT 10)))")
def suspicious_centers(d: Domain):
    return _entity(agg.suspicious_centers(views.scored(d)))


@query("suspicious_operators", f"SELECT operator_id, {_ENT} FROM (SELECT *, {_LEVEL}, " + _pat(
    "Requires investigation", ("anomaly_rate>0.2e0", "Suspicious activity pattern"), ("mean_score>0.7e0", "Consistently high-risk operations"))
    + f" FROM ({_groups('operator_id')}) WHERE total>=3 ORDER BY mean_score DESC, operator_id LIMIT 10)")
def suspicious_operators(d: Domain):
    return _entity(agg.suspicious_operators(views.scored(d)))


@query("temporal_trends", f"""SELECT month, total, anomaly_count, round(anomaly_rate,6) AS anomaly_rate, round(mean_score,6) AS mean_score, round(max_score,6) AS max_score,
 CASE WHEN n<3 THEN 'stable' WHEN l>f*1.1e0 THEN 'increasing' WHEN l<f*0.9e0 THEN 'decreasing' ELSE 'stable' END AS trend_direction,
 anomaly_rate>m*1.5e0 AS spike, round(CASE WHEN anomaly_rate>m*1.5e0 THEN anomaly_rate/m END,6) AS spike_magnitude FROM ({_groups('month')}),
 (SELECT avg(anomaly_rate) m, arg_min(mean_score,month) f, arg_max(mean_score,month) l, count(*) n FROM ({_groups('month')}))""")
def temporal_trends(d: Domain):
    return rounded(agg.temporal_trends(views.scored(d)))


@query("weekend_split", f"""SELECT is_weekend, total, anomaly_count, round(anomaly_rate,6) AS anomaly_rate, round(mean_score,6) AS mean_score, round(max_score,6) AS max_score,
 is_weekend=1 AND anomaly_rate>0.1e0 AS spike FROM ({_groups('is_weekend')})""")
def weekend_split(d: Domain):
    return rounded(agg.weekend_split(views.scored(d)))


_MST = """SELECT month, flagged, mean_score, flagged/greatest(1e0, avg(flagged) OVER ()) AS spike_magnitude FROM
 (SELECT month, count_if(score>=0.5e0) AS flagged, avg(score) AS mean_score FROM scored GROUP BY 1)"""


@query("monthly_score_trend", f"SELECT month, flagged, round(mean_score,6) AS mean_score, round(spike_magnitude,6) AS spike_magnitude FROM ({_MST})")
def monthly_score_trend(d: Domain):
    return rounded(agg.monthly_score_trend(views.scored(d)))


@query("score_histogram", """SELECT bin, coalesce(n,0) AS n, round((bin-1)/49e0,6) AS lower, round(bin/49e0,6) AS upper FROM (SELECT unnest(range(1,50)) AS bin) LEFT JOIN
 (SELECT CAST(greatest(1,least(floor(score*49)+1,49)) AS BIGINT) AS bin, count(*) AS n FROM scored WHERE score BETWEEN 0 AND 1 GROUP BY 1) USING (bin)""")
def score_histogram(d: Domain):
    return rounded(agg.score_histogram(views.scored(d)))


@query("risk_bands", """SELECT 'closed' AS edge, count_if(score>=0.8e0) AS high, count_if(score>=0.5e0 AND score<0.8e0) AS medium, count_if(score<0.5e0 AND score>=0) AS low FROM scored
 UNION ALL SELECT 'open', count_if(score>0.8e0), count_if(score>0.5e0 AND score<=0.8e0), count_if(score<=0.5e0 AND score>0) FROM scored""")
def risk_bands(d: Domain):
    s, cuts = views.scored(d), [("high", 0.8), ("medium", 0.5), ("low", 0.0)]
    return (agg.risk_bands(s, "score", cuts, True).withColumn("edge", F.lit("closed"))
            .unionByName(agg.risk_bands(s, "score", cuts, False).withColumn("edge", F.lit("open"))))


@query("threshold_sensitivity", """SELECT threshold, flagged, total, round(flagged*100e0/total,6) AS pct, CASE WHEN flagged*100e0/total>20 THEN 'High' WHEN flagged*100e0/total>10 THEN 'Medium' ELSE 'Low' END AS action
 FROM (SELECT t::DOUBLE AS threshold, count_if(score>=t) AS flagged, count(*) AS total FROM scored, (SELECT unnest([0.3e0,0.4e0,0.5e0,0.6e0,0.7e0,0.8e0,0.9e0]) AS t) GROUP BY t)""")
def threshold_sensitivity(d: Domain):
    return rounded(agg.threshold_sensitivity(views.scored(d), "score", [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))


_FEATS = ["demo_age_5_17", "demo_age_17_", "is_weekend", "month", "line_no"]
_NVA = " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CASE WHEN score<0.5e0 THEN {c} END) AS normal_mean, avg(CASE WHEN score>=0.5e0 THEN {c} END) AS anomalous_mean FROM scored" for c in _FEATS)


@query("normal_vs_anomalous", f"""SELECT feature, round(normal_mean,6) AS normal_mean, round(anomalous_mean,6) AS anomalous_mean, round(anomalous_mean-normal_mean,6) AS difference
 FROM ({_NVA}) ORDER BY abs(anomalous_mean-normal_mean) DESC, feature LIMIT 3""")
def normal_vs_anomalous(d: Domain):
    return rounded(agg.normal_vs_anomalous(views.scored(d), _FEATS, F.col("score") >= 0.5, 3))


_CC = ["demo_age_5_17", "demo_age_17_", "score", "month"]


@query("correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a},{b}),6)+0e0 AS r FROM scored" for a in _CC for b in _CC))
def correlation_matrix(d: Domain):
    return rounded(agg.correlation_matrix(views.scored(d), _CC))


@query("choropleth_table", f"""SELECT *, round(min(value) OVER (),6) AS min_value, round(max(value) OVER (),6) AS max_value, round(avg(value) OVER (),6) AS mean_value FROM
 (SELECT state, round(avg(female_ratio),6) AS value, {S('male', 'male')}, {S('female', 'female')} FROM coverage GROUP BY 1)""")
def choropleth_table(d: Domain):
    c = agg.choropleth_table(views.coverage(d).withColumn("female_ratio", F.col("female_ratio")), "state", "female_ratio")
    return rounded(c)


@query("gender_by_state", f"""SELECT state, {S('male', 'male')}, {S('female', 'female')}, {S('male+female', 'total')} FROM coverage GROUP BY 1 ORDER BY total DESC, state LIMIT 15""")
def gender_by_state(d: Domain):
    return agg.gender_by_state(views.coverage(d))


_CAT = "CASE WHEN risk_score<=0 OR risk_score>1 THEN NULL WHEN risk_score<=0.3e0 THEN 'Low' WHEN risk_score<=0.6e0 THEN 'Medium' WHEN risk_score<=0.8e0 THEN 'High' ELSE 'Critical' END"


@query("risk_summary", f"""SELECT category, rows, n, round(mean_risk,6) AS mean_risk, top_states, round(rows*100e0/n,6) AS pct, round(hi/(lo+0.01e0),6) AS high_state_ratio FROM
 (SELECT {_CAT} AS category, count(*) AS rows FROM risk GROUP BY 1), (SELECT count(*) n, avg(risk_score) mean_risk, avg(CASE WHEN is_high_risk_state=1 THEN risk_score END) hi,
 avg(CASE WHEN is_high_risk_state=0 THEN risk_score END) lo FROM risk), (SELECT string_agg(state,'|' ORDER BY risk_score DESC, state) AS top_states FROM (SELECT * FROM risk ORDER BY risk_score DESC, state LIMIT 5))""")
def risk_summary(d: Domain):
    return rounded(agg.risk_summary(views.risk(d).withColumn("category", risk_category(F.col("risk_score")))))


@query("auditor_summary", f"""SELECT section, item, round(value,6)+0e0 AS value FROM (
 SELECT 'band' AS section, 'high' AS item, count_if(score>0.8e0)::DOUBLE AS value FROM scored UNION ALL SELECT 'band','medium', count_if(score>0.5e0 AND score<=0.8e0) FROM scored
 UNION ALL SELECT 'band','low', count_if(score<=0.5e0 AND score>0) FROM scored
 UNION ALL SELECT * FROM (SELECT 'state', state, avg(score) AS v FROM scored GROUP BY 2 HAVING avg(score)>0.5e0 ORDER BY v DESC, state LIMIT 5)
 UNION ALL SELECT * FROM (SELECT 'pattern', feature, anomalous_mean-normal_mean FROM ({_NVA.replace('score<0.5e0', 'score<=0.5e0').replace('score>=0.5e0', 'score>0.5e0')}) ORDER BY abs(anomalous_mean-normal_mean) DESC, feature LIMIT 5)
 UNION ALL SELECT 'spike', CAST(month AS VARCHAR), spike_magnitude FROM ({_MST}) WHERE spike_magnitude>1.5e0)""")
def auditor_summary(d: Domain):
    return rounded(agg.auditor_summary(views.scored(d), _FEATS))


@query("region_score_heat", """SELECT * FROM (SELECT 'state' AS level, state AS place, round(avg(score),6) AS mean_score, round(max(score),6) AS max_score, count(*) AS n FROM scored GROUP BY 2)
 UNION ALL SELECT * FROM (SELECT 'center', center_id, round(avg(score),6), round(max(score),6), count(*) FROM scored GROUP BY 2 ORDER BY avg(score) DESC, center_id LIMIT 20)""")
def region_score_heat(d: Domain):
    s = views.scored(d)
    st = agg.region_score_heat(s, "state", 1000).select(F.lit("state").alias("level"), F.col("state").alias("place"), "mean_score", "max_score", "n")
    ce = agg.region_score_heat(s, "center_id", 20).select(F.lit("center").alias("level"), F.col("center_id").alias("place"), "mean_score", "max_score", "n")
    return rounded(st.unionByName(ce))


@query("centre_performance", """SELECT state, round(quality,6) AS quality, round(bio_ratio,6) AS bio_ratio, round(risk,6) AS risk, high_risk, captures, round(fp,6) AS failure_proxy,
 CASE WHEN quality*0.6e0+(1e0-fp)*0.4e0>=0.8e0 THEN 'A - Excellent' WHEN quality*0.6e0+(1e0-fp)*0.4e0>=0.6e0 THEN 'B - Good' WHEN quality*0.6e0+(1e0-fp)*0.4e0>=0.4e0 THEN 'C - Needs Improvement'
 ELSE 'D - Critical Attention Required' END AS grade FROM (SELECT state, centre_quality_score AS quality, biometric_update_ratio AS bio_ratio, risk_score AS risk, CAST(risk_score>=0.6e0 AS BIGINT) AS high_risk,
 total_population AS captures, greatest(0e0,1e0-centre_quality_score)*risk_score AS fp FROM risk) ORDER BY fp DESC, state LIMIT 20""")
def centre_performance(d: Domain):
    return rounded(agg.centre_performance(views.risk(d)))


_AB = " UNION ALL ".join(f"SELECT '{b}' AS bucket, avg({c}) AS share, least(1e0, avg(risk_score)*{m}e0/1.5e0) AS r FROM risk" for b, c, m in agg.AGE_BUCKETS)


@query("age_bucket_analysis", f"""SELECT bucket, round(share,6) AS share, round(r,6) AS estimated_risk, (SELECT round(arg_max(r,bucket='65+')/greatest(arg_max(r,bucket='18-34'),0.01e0),6) FROM ({_AB})) AS elderly_ratio,
 (SELECT bucket FROM ({_AB}) ORDER BY r DESC, bucket LIMIT 1) AS worst_bucket FROM ({_AB})""")
def age_bucket_analysis(d: Domain):
    return rounded(agg.age_bucket_analysis(views.risk(d)))


@query("cluster_summary", """SELECT cluster, count(*) AS size, round(avg(age_0_5),4) AS mean_age_0_5, round(avg(age_5_17),4) AS mean_age_5_17, round(count(*)*100e0/sum(count(*)) OVER (),6) AS pct
 FROM (SELECT *, record_id%5 AS cluster FROM enrol) GROUP BY 1""")
def cluster_summary(d: Domain):
    e = d.enrolment().withColumn("cluster", F.col("record_id") % 5)
    return rounded(agg.cluster_summary(e, "cluster", ["age_0_5", "age_5_17"]), mean_age_0_5=4, mean_age_5_17=4)


@query("geo_hhi", "SELECT round(sum(c::DOUBLE*c)/(sum(c)::DOUBLE*sum(c)),9) AS hhi FROM (SELECT count(*) c FROM enrol GROUP BY state, district)")
def geo_hhi(d: Domain):
    return rounded(agg.geo_hhi(d.enrolment()), 9)
