"""Row and group features."""

from pyspark.sql import functions as F

from rollcall.operators import features as ft
from rollcall.operators import joins
from rollcall.plans import views
from rollcall.plans.registry import query, rounded
from rollcall.plans.views import TOTAL
from rollcall.sources.domain import Domain

AGES = ["age_0_5", "age_5_17", "age_18_greater"]
B = lambda c, a: f"CAST({c} AS BIGINT) AS {a}"


@query("feat_temporal", f"""SELECT event_id, hour(ts) AS hour, isodow(ts)-1 AS day_of_week, day(ts) AS day, month(ts) AS month, quarter(ts) AS quarter, year(ts) AS year,
 {B('isodow(ts)>=6', 'is_weekend')}, {B('hour(ts) BETWEEN 9 AND 18', 'is_business_hours')}, {B('hour(ts)>=22 OR hour(ts)<=5', 'is_night')}, {B('day(ts)>=25', 'is_month_end')},
 {B('day(ts)<=5', 'is_month_start')}, date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS days_since_epoch FROM events""")
def feat_temporal(d: Domain):
    return ft.feat_temporal(d.events().select("event_id", "ts"), "ts").drop("ts")


@query("feat_calendar", f"""SELECT record_id, {B('date=last_day(date)', 'is_month_end')}, {B('day(date)=1', 'is_month_start')},
 date_diff('day', (SELECT min(date) FROM enrol), date) AS days_since_start FROM enrol""")
def feat_calendar(d: Domain):
    return ft.feat_calendar(d.enrolment().select("record_id", "date"), "date").drop("date")


def _activity_sql(key: str, prefix: str, distinct: str) -> str:
    return f"""SELECT order_id, line_no, {key}, c AS {prefix}_count, u AS {prefix}_{distinct}s, round((c-m)/s,6)+0e0 AS {prefix}_z FROM demo JOIN (
 SELECT {key} AS k, count(*) AS c, count(DISTINCT {distinct}) AS u FROM demo GROUP BY 1) ON {key}=k,
 (SELECT avg(c) m, stddev_samp(c) s FROM (SELECT count(*) c FROM demo GROUP BY {key}))"""


@query("feat_operator", _activity_sql("operator_id", "operator", "center_id"))
def feat_operator(d: Domain):
    return rounded(ft.group_activity(d.demographic().select("order_id", "line_no", "operator_id", "center_id"), "operator_id", "operator", "center_id").drop("center_id"))


@query("feat_center", _activity_sql("center_id", "center", "operator_id"))
def feat_center(d: Domain):
    return rounded(ft.group_activity(d.demographic().select("order_id", "line_no", "operator_id", "center_id"), "center_id", "center", "operator_id").drop("operator_id"))


@query("feat_id_updates", """SELECT event_id, user_id, c AS id_updates, CAST(c>q AS BIGINT) AS is_frequent FROM events JOIN (SELECT user_id AS u, count(*) AS c FROM events GROUP BY 1) ON user_id=u,
 (SELECT quantile_cont(c::DOUBLE,0.95) q FROM (SELECT count(*) c FROM events GROUP BY user_id))""")
def feat_id_updates(d: Domain):
    return ft.feat_id_updates(d.events().select("event_id", "user_id"), "user_id")


@query("feat_geo_counts", "SELECT record_id, " + ", ".join(f"{k}_n AS {k}_count, round({k}_n*100e0/n,6) AS {k}_pct, round(({k}_n-{k}_m)/{k}_s,6)+0e0 AS {k}_z" for k in ("state", "district", "pincode"))
       + " FROM (SELECT record_id, count(*) OVER () AS n, " + ", ".join(f"count(*) OVER (PARTITION BY {k}) AS {k}_n" for k in ("state", "district", "pincode"))
       + " FROM enrol), " + ", ".join(f"(SELECT avg(c) {k}_m, stddev_samp(c) {k}_s FROM (SELECT count(*) c FROM enrol GROUP BY {k}))" for k in ("state", "district", "pincode")))
def feat_geo_counts(d: Domain):
    return rounded(ft.feat_geo_counts(d.enrolment().select("record_id", "state", "district", "pincode")).drop("state", "district", "pincode"))


@query("feat_pincode_region", "SELECT record_id, substr(pincode,1,2) AS pincode_region FROM enrol")
def feat_pincode_region(d: Domain):
    return ft.feat_pincode_region(d.enrolment()).select("record_id", "pincode_region")


@query("feat_age", "SELECT record_id, total, " + ", ".join(f"round(r{i},6) AS {c}_ratio" for i, c in enumerate(AGES)) + ", round(" + "".join(f"-r{i}*ln(r{i}+1e-10)" for i in range(3))
       + f",6)+0e0 AS age_entropy FROM (SELECT record_id, {TOTAL} AS total, " + ", ".join(f"{c}/({TOTAL}+1)::DOUBLE AS r{i}" for i, c in enumerate(AGES)) + " FROM enrol)")
def feat_age(d: Domain):
    return rounded(ft.feat_age(d.enrolment().select("record_id", *AGES), AGES).drop(*AGES))


@query("feat_enrolment", f"SELECT record_id, {TOTAL} AS total_enrolments, " + ", ".join(f"round(coalesce({c}/nullif({TOTAL},0)::DOUBLE,0),6) AS {c}_ratio" for c in AGES)
       + f", {B('age_0_5+age_5_17>age_18_greater', 'child_heavy')} FROM enrol")
def feat_enrolment(d: Domain):
    return rounded(ft.feat_enrolment(d.enrolment().select("record_id", *AGES)).drop(*AGES))


@query("feat_update_mix", """SELECT state, demo_total, bio_total, round(demo_total/(demo_total+bio_total+1)::DOUBLE,6) AS demo_share, round(bio_total/(demo_total+bio_total+1)::DOUBLE,6) AS bio_share,
 round(bio_total/(demo_total+1)::DOUBLE,6) AS bio_demo, round((demo_total-dm)/ds,6)+0e0 AS demo_total_z, round((bio_total-bm)/bs,6)+0e0 AS bio_total_z FROM facts3,
 (SELECT avg(demo_total) dm, stddev_samp(demo_total) ds, avg(bio_total) bm, stddev_samp(bio_total) bs FROM facts3)""")
def feat_update_mix(d: Domain):
    f = joins.join_three_facts(d.enrolment().select("state", *AGES), d.demographic().select("state", "demo_age_5_17", "demo_age_17_"),
                               d.biometric().select("state", "bio_age_5_17", "bio_age_17_"))
    out = ft.feat_update_mix(f.select("state", "demo_age_5_17", "demo_age_17_", "bio_age_5_17", "bio_age_17_"), ["demo_age_5_17", "demo_age_17_"], ["bio_age_5_17", "bio_age_17_"])
    return rounded(out.drop("demo_age_5_17", "demo_age_17_", "bio_age_5_17", "bio_age_17_"))


def _row_stats_sql(ddof: int) -> str:
    return f"""SELECT record_id, round(m,4) AS row_mean, round(m*3,4) AS row_sum, round(sqrt(m2*3/{3 - ddof}e0),4) AS row_std, greatest(a,b,c) AS row_max, least(a,b,c) AS row_min, greatest(a,b,c)-least(a,b,c) AS row_range,
 round(coalesce(((a-m)**3+(b-m)**3+(c-m)**3)/3e0/nullif(m2**1.5e0,0),0),6)+0e0 AS row_skew, round(coalesce(((a-m)**4+(b-m)**4+(c-m)**4)/3e0/nullif(m2*m2,0)-3e0,0),6)+0e0 AS row_kurtosis FROM (
 SELECT *, ((a-m)**2+(b-m)**2+(c-m)**2)/3e0 AS m2 FROM (SELECT *, (a+b+c)/3e0 AS m FROM (SELECT record_id, age_0_5::DOUBLE a, age_5_17::DOUBLE b, age_18_greater::DOUBLE c FROM enrol)))"""


@query("feat_row_stats", _row_stats_sql(0))
def feat_row_stats(d: Domain):
    return rounded(ft.feat_row_stats(d.enrolment().select("record_id", *AGES), AGES).drop(*AGES), row_mean=4, row_sum=4, row_std=4)


@query("feat_row_stats_samp", _row_stats_sql(1))
def feat_row_stats_samp(d: Domain):
    return rounded(ft.feat_row_stats(d.enrolment().select("record_id", *AGES), AGES, ddof=1).drop(*AGES), row_mean=4, row_sum=4, row_std=4)


@query("feat_age_pct", "SELECT record_id, " + ", ".join(f"round({c}*100e0/coalesce(nullif({TOTAL},0),1),6) AS {c}_pct" for c in AGES) + " FROM enrol")
def feat_age_pct(d: Domain):
    return rounded(ft.feat_age_pct(d.enrolment().select("record_id", *AGES), AGES).drop(*AGES))


_DER = ["ratio_0_17", "ratio_18_34", "ratio_35_49", "ratio_50_64", "ratio_65_plus", "age_bucket_risk_score", "elderly_ratio", "adult_ratio", "biometric_update_ratio",
        "demographic_update_ratio", "centre_quality_score", "seasonal_factor"]
_DERI = ["state", "days_since_update", "capture_month", "child_count", "adult_count", "total_population", "is_monsoon", "is_high_risk_state", "is_rural_labor"]


@query("feat_risk_derived", f"SELECT {', '.join(_DERI)}, " + ", ".join(f"round({c},6)+0e0 AS {c}" for c in _DER) + " FROM derived")
def feat_risk_derived(d: Domain):
    return rounded(views.risk(d).select(*_DERI, *_DER))


@query("feat_profile", f"""SELECT count(*) AS n, CAST(3 AS BIGINT) AS k, round((var_pop(age_0_5)+var_pop(age_5_17)+var_pop(age_18_greater))/3e0,3) AS variance,
 round((count_if(age_0_5=0)+count_if(age_5_17=0)+count_if(age_18_greater=0))/(count(*)*3)::DOUBLE,6) AS sparsity,
 CASE WHEN count(*)*3<10000 THEN 'low' WHEN count(*)*3<1000000 THEN 'medium' ELSE 'high' END AS complexity, true AS has_temporal, true AS has_geo FROM enrol""")
def feat_profile(d: Domain):
    return rounded(ft.feat_profile(d.enrolment(), AGES), variance=3)


_GAP = "SELECT event_id, user_id, ts, (epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))/86400e6 AS gap FROM events"


@query("gap_between_updates", f"SELECT event_id, user_id, round(gap,6) AS gap_days FROM ({_GAP})")
def gap_between_updates(d: Domain):
    return rounded(ft.gap_between_updates(d.events(), "user_id", "ts", "event_id").select("event_id", "user_id", "gap_days"))


@query("update_velocity", f"SELECT event_id, user_id, round(gap-lag(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id),6)+0e0 AS gap_change FROM ({_GAP})")
def update_velocity(d: Domain):
    return rounded(ft.update_velocity(d.events(), "user_id", "ts", "event_id").select("event_id", "user_id", "gap_change"))


for _n, _k in (("operator", "operator_id"), ("center", "center_id")):
    def _daily(d: Domain, k=_k, n=_n):
        return rounded(ft.daily_average(d.demographic(), k, "date", n))
    query(f"{_n}_daily_avg", f"SELECT {_k}, count(*) AS events, count(DISTINCT date) AS active_days, round(count(*)/count(DISTINCT date)::DOUBLE,6) AS {_n}_daily_avg FROM demo GROUP BY 1")(_daily)


@query("center_operator_ratio", "SELECT center_id, count(DISTINCT operator_id) AS operators, count(*) AS events, round(count(DISTINCT operator_id)/count(*)::DOUBLE,6) AS ratio FROM demo GROUP BY 1")
def center_operator_ratio(d: Domain):
    return rounded(ft.center_operator_ratio(d.demographic(), "center_id", "operator_id"))


@query("location_hop_count", """SELECT user_id, count_if(p<>q) AS hops FROM (SELECT user_id, event_type AS p, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS q FROM events) GROUP BY 1""")
def location_hop_count(d: Domain):
    return ft.location_hop_count(d.events(), "user_id", "ts", "event_id", "event_type")


@query("update_type_entropy", "SELECT user_id, round(ln(sum(c))-sum(c*ln(c))/sum(c),6)+0e0 AS type_entropy FROM (SELECT user_id, event_type, count(*)::DOUBLE AS c FROM events GROUP BY 1,2) GROUP BY 1")
def update_type_entropy(d: Domain):
    return rounded(ft.update_type_entropy(d.events(), "user_id", "event_type"))


@query("activity_acceleration", """SELECT *, velocity-lag(velocity) OVER (PARTITION BY user_id ORDER BY day) AS acceleration FROM (SELECT *, n-lag(n) OVER (PARTITION BY user_id ORDER BY day) AS velocity FROM
 (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1,2))""")
def activity_acceleration(d: Domain):
    return ft.activity_acceleration(d.events(), "user_id", "ts")


@query("weekend_night_ratio", """SELECT *, round(weekend/nullif(weekday,0)::DOUBLE,6) AS weekend_ratio, round(night/nullif(daytime,0)::DOUBLE,6) AS night_ratio FROM (SELECT user_id, count_if(isodow(ts)>=6) AS weekend,
 count_if(isodow(ts)<6) AS weekday, count_if(hour(ts)>=22 OR hour(ts)<=5) AS night, count_if(hour(ts)<22 AND hour(ts)>5) AS daytime FROM events GROUP BY 1)""")
def weekend_night_ratio(d: Domain):
    return rounded(ft.weekend_night_ratio(d.events(), "user_id", "ts"))
