"""Windows, ranking, sorting, top-k, set operations."""

from pyspark.sql import functions as F

from rollcall.functions import tables
from rollcall.operators import ordering
from rollcall.plans import views
from rollcall.plans.registry import query, rounded
from rollcall.plans.views import TOTAL
from rollcall.sources.domain import VIEW_SQL, Domain


@query("rank_states", "SELECT state, n, round(rank() OVER (ORDER BY n DESC)+(count(*) OVER (PARTITION BY n)-1)/2e0,6) AS rank FROM (SELECT state, count(*) AS n FROM enrol GROUP BY 1)")
def rank_states(d: Domain):
    return rounded(ordering.rank_groups(d.enrolment(), "state"))


@query("rank_smooth", "SELECT district, current, round(avg(current) OVER (ORDER BY current, district ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING),6) AS smoothed FROM districts")
def rank_smooth(d: Domain):
    return rounded(ordering.rank_smooth(d.districts(), "district", "current"))


@query("sma_trailing", """SELECT state, month, value, round(CASE WHEN rn<3 THEN coalesce(max(CASE WHEN rn=3 THEN m END) OVER (PARTITION BY state), value) ELSE m END,6) AS sma FROM (
 SELECT *, avg(value) OVER (PARTITION BY state ORDER BY month ROWS 2 PRECEDING) AS m, row_number() OVER (PARTITION BY state ORDER BY month) AS rn FROM months)""")
def sma_trailing(d: Domain):
    return rounded(ordering.sma_trailing(d.months(), "state", "month", "value"))


@query("sma_centered", "SELECT state, month, value, round(avg(value) OVER (PARTITION BY state ORDER BY month ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING),6) AS sma FROM months")
def sma_centered(d: Domain):
    return rounded(ordering.sma_centered(d.months(), "state", "month", "value"))


_VEL = """SELECT state, coalesce(avg(v),0e0) AS velocity, coalesce(max(CASE WHEN rn=1 THEN v END),0e0) AS current_velocity,
 coalesce(max(CASE WHEN rn=1 THEN v END)-max(CASE WHEN rn=2 THEN v END),0e0) AS acceleration, count(*) AS points FROM (
 SELECT state, (value-lag(value) OVER w)/(date_diff('day', lag(month) OVER w, month)/30e0) AS v, row_number() OVER (PARTITION BY state ORDER BY month DESC) AS rn
 FROM months WINDOW w AS (PARTITION BY state ORDER BY month)) GROUP BY 1"""


@query("velocity", f"""SELECT state, round(velocity,4)+0e0 AS velocity, round(current_velocity,4)+0e0 AS current_velocity, round(acceleration,4)+0e0 AS acceleration, points,
 CASE WHEN points<2 THEN 'insufficient_data' WHEN velocity>0 AND acceleration>0 THEN 'accelerating_growth' WHEN velocity>0 AND acceleration<0 THEN 'decelerating_growth'
 WHEN velocity<0 AND acceleration<0 THEN 'accelerating_decline' WHEN velocity<0 AND acceleration>0 THEN 'decelerating_decline' ELSE 'stable' END AS trend FROM ({_VEL})""")
def velocity(d: Domain):
    return rounded(ordering.velocity(d.months(), "state", "month", "value"), 4)


VIEW_SQL["halves"] = """SELECT state, avg(value) AS mean_recent, max(month) AS last_date, count(*) AS points,
 CASE WHEN count(*)>=2 THEN (avg(CASE WHEN rn<=n-n//2 THEN value END)-avg(CASE WHEN rn>n-n//2 THEN value END))/max(n//2) ELSE 0e0 END AS trend FROM (
 SELECT *, count(*) OVER (PARTITION BY state) AS n FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY month DESC) AS rn FROM months) WHERE rn<=12) GROUP BY 1"""


@query("halves_trend", "SELECT * REPLACE (round(mean_recent,4) AS mean_recent, round(trend,4)+0e0 AS trend) FROM halves")
def halves_trend(d: Domain):
    return rounded(ordering.halves_trend(d.months(), "state", "month", "value"), 4)


@query("top_k", f"SELECT record_id, district, {TOTAL} AS total FROM enrol ORDER BY total DESC, record_id LIMIT 25")
def top_k(d: Domain):
    e = d.enrolment().select("record_id", "district", F.expr(TOTAL).alias("total"))
    return ordering.top_k(e, [F.desc("total"), F.asc("record_id")], 25)


@query("top_k_per_group", f"""SELECT state, record_id, total, rn FROM (SELECT state, record_id, total, row_number() OVER (PARTITION BY state ORDER BY total DESC, record_id) AS rn
 FROM (SELECT *, {TOTAL} AS total FROM enrol)) WHERE rn<=5""")
def top_k_per_group(d: Domain):
    e = d.enrolment().select("state", "record_id", F.expr(TOTAL).alias("total"))
    return ordering.top_k_per_group(e, ["state"], [F.desc("total"), F.asc("record_id")], 5)


@query("multi_key_order", """SELECT center_id, severity, mean_score FROM (SELECT center_id, round(avg(score),6) AS mean_score,
 CASE WHEN avg(score)>0.36e0 THEN 'critical' WHEN avg(score)>0.33e0 THEN 'high' ELSE 'medium' END AS severity FROM scored GROUP BY 1)
 ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, mean_score DESC, center_id""")
def multi_key_order(d: Domain):
    g = views.scored(d).groupBy("center_id").agg(F.avg("score").alias("m"))
    g = g.select("center_id", F.round("m", 6).alias("mean_score"),
                 F.when(F.col("m") > 0.36, "critical").when(F.col("m") > 0.33, "high").otherwise("medium").alias("severity"))
    return ordering.severity_order(g, "severity", F.desc("mean_score"), F.asc("center_id"))


@query("distinct_values", "SELECT state, district, count(DISTINCT date_trunc('month',date)) AS points FROM enrol GROUP BY 1,2 HAVING points>=6")
def distinct_values(d: Domain):
    e = d.enrolment().withColumn("m", F.trunc("date", "month"))
    return ordering.distinct_values(e, ["state", "district"], 6, "m")


# Fixed values of the request fixture: event type to intent.
EVENT_INTENT = {"signup": "check_enrollments", "click": "review_updates", "view": "verify_biometrics", "purchase": "comprehensive_check"}
VIGILANCE = ("routine", "standard", "enhanced", "maximum")


def requests(d: Domain):
    """Monitoring requests read off the events: intent by type, context by user and hour."""
    e = d.events()
    intent = tables.lookup(EVENT_INTENT, F.col("event_type"))
    return e.select("event_id", "user_id", intent.alias("intent"),
                    F.element_at(F.array(*[F.lit(v) for v in VIGILANCE]), (F.col("user_id") % 4 + 1).cast("int")).alias("vigilance"),
                    (F.col("user_id") % 3 == 0).alias("has_location"), (F.hour("ts") < 12).alias("is_today"))


VIEW_SQL["requests"] = ("SELECT event_id, user_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_INTENT.items())
                        + " END AS intent, ['routine','standard','enhanced','maximum'][user_id%4+1] AS vigilance, user_id%3=0 AS has_location, hour(ts)<12 AS is_today FROM events")


@query("set_union_scopes", f"""SELECT DISTINCT event_id, coalesce(source, 'enrolment') AS source FROM requests LEFT JOIN (
 SELECT i.k AS intent, m.v AS source FROM {tables.values_sql(tables.INTENT_SIGNALS)} i(k,v) JOIN {tables.values_sql(tables.SIGNAL_SOURCES)} m(k,v) ON i.v=m.k
 UNION SELECT i.k, m.v FROM {tables.values_sql(tables.INTENT_SCOPES)} i(k,v) JOIN {tables.values_sql(tables.SCOPE_SOURCES)} m(k,v) ON i.v=m.k) USING (intent)""")
def set_union_scopes(d: Domain):
    nothing = F.array().cast("array<string>")
    r = requests(d).withColumn("signals", F.coalesce(tables.lookup(tables.INTENT_SIGNALS, F.col("intent")), nothing))
    r = r.withColumn("scopes", F.coalesce(tables.lookup(tables.INTENT_SCOPES, F.col("intent")), nothing))
    return ordering.source_union(r, "event_id", "signals", "scopes")
