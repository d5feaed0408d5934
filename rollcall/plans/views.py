"""Derived inputs several queries share: scored records, risk table, gender coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.operators import aggregate, features, joins, scoring
from rollcall.plans.registry import rounded
from rollcall.sources.domain import VIEW_SQL, Domain

AS_OF = "2002-01-01"
HIGH_RISK = ("NATION_3", "NATION_7", "NATION_11", "NATION_19")
RURAL = ("NATION_1", "NATION_3", "NATION_5")
TOTAL = "age_0_5+age_5_17+age_18_greater"


def scored(d: Domain) -> DataFrame:
    """Demographic updates with their z-score based anomaly score."""
    s = scoring.zscore_score(d.demographic(), ["demo_age_5_17", "demo_age_17_"])
    return s.withColumns({"score": F.round("score", 9) + 0.0, "month": F.month("date").cast("bigint"),
                          "is_weekend": (F.weekday("date") >= 5).cast("bigint")})


VIEW_SQL["scored"] = """SELECT * EXCLUDE (c, lo, hi), round((c-lo)/(hi-lo+1e-10),9)+0e0 AS score, month(date) AS month,
 CAST(isodow(date)>=6 AS BIGINT) AS is_weekend FROM (SELECT *, min(c) OVER () lo, max(c) OVER () hi FROM (
 SELECT demo.*, (abs((demo_age_5_17-ma)/sa)+abs((demo_age_17_-mb)/sb))/2e0 AS c FROM demo,
 (SELECT avg(demo_age_5_17) ma, stddev_pop(demo_age_5_17) sa, avg(demo_age_17_) mb, stddev_pop(demo_age_17_) sb FROM demo) s))"""


def ratios(d: Domain) -> DataFrame:
    return d.table("nation").select(F.col("n_name").alias("state"), (480 + (F.col("n_nationkey") * 13) % 80).alias("male_milli"))


VIEW_SQL["ratios"] = "SELECT n_name AS state, 480+(n_nationkey*13)%80 AS male_milli FROM nation"


def coverage(d: Domain) -> DataFrame:
    return aggregate.gender_coverage(d.enrolment(), ratios(d))


VIEW_SQL["coverage"] = """SELECT state, district, total, male, female, districts, records,
 coalesce(male/nullif(total,0)::DOUBLE,0) AS male_ratio, coalesce(female/nullif(total,0)::DOUBLE,0) AS female_ratio,
 coalesce((male-female)/nullif(total,0)::DOUBLE,0) AS gender_gap, coalesce(female/nullif(male,0)::DOUBLE,0) AS female_per_male FROM (
 SELECT state, district, CAST(sum(t) AS BIGINT) AS total, CAST(sum((t*m+500)//1000) AS BIGINT) AS male,
 CAST(sum((t*(1000-m)+500)//1000) AS BIGINT) AS female, CAST(1 AS BIGINT) AS districts, count(*) AS records FROM (
 SELECT e.state, district, age_0_5+age_5_17+age_18_greater AS t, male_milli AS m FROM enrol e JOIN ratios r ON e.state=r.state)
 GROUP BY 1,2)"""


def risk(d: Domain, keys=("state",)) -> DataFrame:
    """Risk table per state: joined facts, derived features, score."""
    facts = joins.join_three_facts(
        d.enrolment().select("state", "age_0_5", "age_5_17", "age_18_greater"),
        d.demographic().select("state", "demo_age_5_17", "demo_age_17_"),
        d.biometric().select("state", "bio_age_5_17", "bio_age_17_"), keys)
    last = d.biometric().groupBy(*keys).agg(F.max("date").alias("last_update"))
    f = features.feat_risk_derived(facts.join(last, list(keys), "left"), "last_update", AS_OF, HIGH_RISK, RURAL)
    s = scoring.biometric_risk_score(f, F.col("days_since_update"), F.col("capture_month"))
    return rounded(s, 9)


VIEW_SQL["facts3"] = """SELECT coalesce(e.state, dm.state, b.state) AS state, coalesce(enrol_age_0_5,0) AS enrol_age_0_5,
 coalesce(enrol_age_5_17,0) AS enrol_age_5_17, coalesce(enrol_age_18_greater,0) AS enrol_age_18_greater,
 coalesce(enrol_total,0) AS enrol_total, coalesce(demo_age_5_17,0) AS demo_age_5_17, coalesce(demo_age_17_,0) AS demo_age_17_,
 coalesce(demo_total,0) AS demo_total, coalesce(bio_age_5_17,0) AS bio_age_5_17, coalesce(bio_age_17_,0) AS bio_age_17_,
 coalesce(bio_total,0) AS bio_total, last_update FROM
 (SELECT state, CAST(sum(age_0_5) AS BIGINT) enrol_age_0_5, CAST(sum(age_5_17) AS BIGINT) enrol_age_5_17,
  CAST(sum(age_18_greater) AS BIGINT) enrol_age_18_greater, CAST(sum(age_0_5+age_5_17+age_18_greater) AS BIGINT) enrol_total FROM enrol GROUP BY 1) e
 FULL JOIN (SELECT state, CAST(sum(demo_age_5_17) AS BIGINT) demo_age_5_17, CAST(sum(demo_age_17_) AS BIGINT) demo_age_17_,
  CAST(sum(demo_age_5_17+demo_age_17_) AS BIGINT) demo_total FROM demo GROUP BY 1) dm ON e.state=dm.state
 FULL JOIN (SELECT state, CAST(sum(bio_age_5_17) AS BIGINT) bio_age_5_17, CAST(sum(bio_age_17_) AS BIGINT) bio_age_17_,
  CAST(sum(bio_age_5_17+bio_age_17_) AS BIGINT) bio_total, max(date) last_update FROM bio GROUP BY 1) b ON coalesce(e.state,dm.state)=b.state"""

_IN = lambda names: ",".join(f"'{n}'" for n in names)

VIEW_SQL["derived"] = f"""SELECT *, ratio_0_17*0.5e0+ratio_18_34*0.7e0+ratio_35_49+ratio_50_64*1.5e0+ratio_65_plus*2.5e0 AS age_bucket_risk_score,
 ratio_50_64+ratio_65_plus AS elderly_ratio, 1e0-ratio_0_17 AS adult_ratio, ratio_65_plus AS age_65_plus_ratio,
 greatest(least(least(greatest(biometric_update_ratio,0e0),1e0)*0.7e0+(1e0-least(days_since_update,730)/730e0*0.3e0)*0.3e0,1e0),0e0) AS centre_quality_score,
 CAST(capture_month IN (6,7,8,9) AS BIGINT) AS is_monsoon, 1e0-CASE WHEN capture_month IN (6,7,8,9) THEN 0.15e0 ELSE 0e0 END AS seasonal_factor,
 CAST(state IN ({_IN(HIGH_RISK)}) AS BIGINT) AS is_high_risk_state, CAST(state IN ({_IN(RURAL)}) AS BIGINT) AS is_rural_labor
 FROM (SELECT *, child_count/total_population::DOUBLE AS ratio_0_17, adult_count*0.35e0/total_population AS ratio_18_34,
  adult_count*0.30e0/total_population AS ratio_35_49, adult_count*0.20e0/total_population AS ratio_50_64,
  adult_count*0.15e0/total_population AS ratio_65_plus,
  bio_total/coalesce(nullif(bio_total+demo_total,0),1)::DOUBLE AS biometric_update_ratio,
  demo_total/coalesce(nullif(bio_total+demo_total,0),1)::DOUBLE AS demographic_update_ratio
  FROM (SELECT *, coalesce(date_diff('day', last_update, DATE '{AS_OF}'),365) AS days_since_update, coalesce(month(last_update),1) AS capture_month,
   enrol_age_0_5+enrol_age_5_17+demo_age_5_17+bio_age_5_17 AS child_count, enrol_age_18_greater+demo_age_17_+bio_age_17_ AS adult_count,
   coalesce(nullif(enrol_total+bio_total,0),1) AS total_population FROM facts3))"""

VIEW_SQL["risk"] = """SELECT * REPLACE (round(risk_score,9) AS risk_score) FROM (SELECT *, greatest(least(0.3e0+least(days_since_update/730e0,1e0)*0.25e0
 +(1e0-least(biometric_update_ratio,1e0))*0.2e0+least(elderly_ratio,1e0)*0.2e0+least(age_65_plus_ratio,1e0)*0.05e0+is_high_risk_state*0.1e0
 +(1e0-least(demographic_update_ratio,1e0))*0.1e0+(1e0-centre_quality_score)*0.1e0+is_monsoon*0.05e0,1e0),0e0) AS risk_score FROM derived)"""
