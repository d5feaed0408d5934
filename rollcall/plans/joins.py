"""Joins."""

from pyspark.sql import functions as F

from rollcall.operators import joins
from rollcall.plans.registry import query, rounded
from rollcall.plans.views import TOTAL
from rollcall.sources.domain import Domain


@query("join_three_facts", "SELECT * EXCLUDE (last_update) FROM facts3")
def join_three_facts(d: Domain):
    return joins.join_three_facts(d.enrolment().select("state", "age_0_5", "age_5_17", "age_18_greater"),
                                  d.demographic().select("state", "demo_age_5_17", "demo_age_17_"),
                                  d.biometric().select("state", "bio_age_5_17", "bio_age_17_"))


_M = lambda v, c: (f"SELECT state, year(date) AS year, month(date) AS month, "
                   + ", ".join(f"CAST(sum({x}) AS BIGINT) AS {x}" for x in c) + f" FROM {v} GROUP BY 1,2,3")


@query("join_common_keys", f"""SELECT * FROM ({_M('enrol', ['age_0_5', 'age_18_greater'])})
 FULL JOIN ({_M('demo', ['demo_age_5_17', 'demo_age_17_'])}) USING (state, year, month)
 FULL JOIN ({_M('bio', ['bio_age_5_17', 'bio_age_17_'])}) USING (state, year, month)""")
def join_common_keys(d: Domain):
    cal = lambda df, *c: df.select("state", F.year("date").alias("year"), F.month("date").alias("month"), *c)
    return joins.join_common_keys({"enrol": cal(d.enrolment(), "age_0_5", "age_18_greater"),
                                   "demo": cal(d.demographic(), "demo_age_5_17", "demo_age_17_"),
                                   "bio": cal(d.biometric(), "bio_age_5_17", "bio_age_17_")})


@query("join_boundaries", """SELECT r.state AS name, lat, lon, total FROM regions r LEFT JOIN
 (SELECT state, CAST(sum(age_0_5+age_5_17+age_18_greater) AS BIGINT) AS total FROM enrol GROUP BY 1) e ON r.state=e.state""")
def join_boundaries(d: Domain):
    data = d.enrolment().groupBy(F.concat(F.lit(" "), F.lower("state")).alias("label")).agg(F.sum(F.expr(TOTAL)).alias("total"))
    return joins.join_boundaries(d.regions().select(F.col("state").alias("name"), "lat", "lon"), data, "name", "label")


@query("join_population", """SELECT district, d.state, enrolments, r.population, round(enrolments*100e0/r.population,9) AS penetration_pct
 FROM districts d LEFT JOIN regions r ON d.state=r.state""")
def join_population(d: Domain):
    return rounded(joins.join_population(d.districts().select("district", "state", "enrolments"), d.regions(), ["state"], "enrolments"), 9)


@query("enrich_group_stat", """SELECT record_id, district, count(*) OVER (PARTITION BY district) AS district_rows,
 round(avg(age_0_5) OVER (PARTITION BY district), 6) AS district_mean FROM enrol""")
def enrich_group_stat(d: Domain):
    out = joins.enrich_group_stat(d.enrolment().select("record_id", "district", "age_0_5"), "district",
                                  F.count(F.lit(1)).alias("district_rows"), F.avg("age_0_5").alias("district_mean"))
    return rounded(out.drop("age_0_5"))


@query("scenario_cross", """SELECT district, scenario, quantity*500 AS reach FROM districts,
 (VALUES ('small', 5::BIGINT), ('medium', 20), ('large', 80)) s(scenario, quantity)""")
def scenario_cross(d: Domain):
    s = joins.scenario_cross(d.districts().select("district"), [{"scenario": n, "quantity": q} for n, q in (("small", 5), ("medium", 20), ("large", 80))])
    return s.select("district", "scenario", (F.col("quantity") * 500).alias("reach"))
