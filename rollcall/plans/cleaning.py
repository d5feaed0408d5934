"""Projection, cleaning, filters; missing values, outliers, scaling, encoding."""

from pyspark.sql import functions as F

from rollcall.functions import scalar, spread
from rollcall.operators import clean
from rollcall.plans.registry import query, rounded
from rollcall.sources.domain import Domain

AGES = ["age_0_5", "age_5_17", "age_18_greater"]
TOTAL = "age_0_5+age_5_17+age_18_greater"


@query("normalize_columns", """SELECT state, district, date, CAST(sum(age_0_5) AS BIGINT) AS age_0_5,
 CAST(sum(age_18_greater) AS BIGINT) AS age_18_plus FROM enrol GROUP BY ALL""")
def normalize_columns(d: Domain):
    raw = d.enrolment().select(F.col("state").alias("State_Name"), F.col("district").alias(" DISTRICT "),
                               F.col("date").alias("Report_Date"), F.col("age_0_5").alias("Infant"),
                               F.col("age_18_greater").alias("Adult"))
    n = clean.normalize_columns(raw)
    return n.groupBy("state", "district", "date").agg(F.sum("age_0_5").alias("age_0_5"), F.sum("age_18_plus").alias("age_18_plus"))


@query("normalize_state", "SELECT replace(replace(state,'NATION','Nation'),'_',' ') AS state_clean, count(*) AS n FROM enrol GROUP BY 1")
def normalize_state(d: Domain):
    k = F.col("record_id") % 4
    raw = d.enrolment().withColumn(
        "raw", F.when(k == 0, F.lower("state")).when(k == 1, F.concat(F.lit("  "), "state", F.lit(" ")))
        .when(k == 2, F.replace("state", F.lit("_"), F.lit(" "))).otherwise(F.replace("state", F.lit("_"), F.lit("--"))))
    return clean.normalize_state(raw, "raw").groupBy("state_clean").agg(F.count(F.lit(1)).alias("n"))


@query("coerce_numeric", f"SELECT record_id, CASE WHEN record_id%7=0 THEN 0 ELSE {TOTAL} END AS total FROM enrol")
def coerce_numeric(d: Domain):
    raw = d.enrolment().select("record_id", F.when(F.col("record_id") % 7 == 0, F.lit("n/a"))
                               .otherwise(F.expr(TOTAL).cast("string")).alias("total"))
    return clean.coerce_numeric(raw, ["total"])


@query("parse_dates", """SELECT record_id, CASE WHEN record_id%9=0 THEN NULL WHEN record_id%3=1 THEN
 CAST(date_trunc('month', date) AS DATE) ELSE date END AS day_date, CAST(NULL AS DATE) AS note_date FROM enrol""")
def parse_dates(d: Domain):
    k = F.col("record_id")
    text = (F.when(k % 9 == 0, F.lit("bad")).when(k % 3 == 0, F.date_format("date", "dd-MM-yyyy"))
             .when(k % 3 == 1, F.date_format("date", "yyyy-MM")).otherwise(F.date_format("date", "yyyy-MM-dd")))
    note = F.when(k % 4 == 0, F.date_format("date", "yyyy-MM-dd")).otherwise(F.col("district"))
    raw = d.enrolment().select("record_id", text.alias("day"), note.alias("note"))
    out = clean.parse_dates(raw, ["day", "note"], ["dd-MM-yyyy", "yyyy-MM-dd", "yyyy-MM"])
    return out.select("record_id", "day_date", "note_date")


@query("filter_time_range", """SELECT 'last_7_days' AS period, record_id FROM enrol WHERE date BETWEEN DATE '2000-06-08' AND DATE '2000-06-15'
 UNION ALL SELECT 'this_month', record_id FROM enrol WHERE date BETWEEN DATE '2000-06-01' AND DATE '2000-06-15'
 UNION ALL SELECT 'default', record_id FROM enrol WHERE date BETWEEN DATE '2000-05-16' AND DATE '2000-06-15'""")
def filter_time_range(d: Domain):
    e = d.enrolment()
    one = lambda p: clean.filter_time_range(e, "date", p, "2000-06-15").select(F.lit(p).alias("period"), "record_id")
    return one("last_7_days").unionByName(one("this_month")).unionByName(one("default"))


@query("filter_geo", """SELECT record_id, state, district FROM enrol WHERE lower(district) LIKE '%build%' AND lower(state) LIKE '%nation_1%' ESCAPE '!'""")
def filter_geo(d: Domain):
    return clean.filter_geo(d.enrolment(), "Build, Nation_1").select("record_id", "state", "district")


@query("lookup_region", """SELECT state, zone, CAST(CASE WHEN lower(zone)='nation_1' THEN 1 WHEN lower(state)='nation_1' THEN 2 ELSE 3 END AS BIGINT) AS match_rank
 FROM regions WHERE lower(state) LIKE '%nation_1%' OR lower(zone)='nation_1' ORDER BY match_rank, zone, state LIMIT 1""")
def lookup_region(d: Domain):
    r = d.regions().select("state", "zone").withColumn("code", F.concat_ws("|", "zone", "state"))
    return clean.lookup_region(r, "nation_1", "code", "state").drop("code")


_AGE_RATIO = """SELECT state, district, s*0.35e0/t AS elderly_ratio, s/t::DOUBLE AS adult_ratio FROM
 (SELECT state, district, sum(age_18_greater)::DOUBLE s, sum(age_0_5+age_5_17+age_18_greater)::DOUBLE t FROM enrol GROUP BY 1,2)"""


@query("filter_age_range", f"""SELECT 'elderly' AS which, state, district FROM ({_AGE_RATIO}) WHERE elderly_ratio>0.26e0
 UNION ALL SELECT 'adult', state, district FROM ({_AGE_RATIO}) WHERE adult_ratio>0.5e0""")
def filter_age_range(d: Domain):
    g = d.enrolment().groupBy("state", "district").agg(F.sum("age_18_greater").cast("double").alias("s"), F.sum(F.expr(TOTAL)).cast("double").alias("t"))
    g = g.withColumn("adult_ratio", F.col("s") / F.col("t"))
    e = g.withColumn("elderly_ratio", F.col("s") * 0.35 / F.col("t") - 0.11)
    pick = lambda df, w: clean.filter_age_range(df, w).select(F.lit(w).alias("which"), "state", "district")
    return pick(e, "elderly").unionByName(pick(g, "adult"))


@query("drop_null_keys", "SELECT record_id, district FROM gaps WHERE trim(district) <> ''")
def drop_null_keys(d: Domain):
    return clean.drop_null_keys(d.gaps(), "district").select("record_id", "district")


@query("select_export_cols", "SELECT state, district, date FROM enrol")
def select_export_cols(d: Domain):
    return clean.select_export_cols(d.enrolment())


@query("mask_id", """SELECT record_id, upper(substr(sha256(concat_ws('_', state, district, pincode)),1,12)) AS export_id,
 substr(sha256(pincode),1,12) AS anonymous_id FROM enrol""")
def mask_id(d: Domain):
    return d.enrolment().select("record_id", clean.mask_id("state", "district", "pincode").alias("export_id"),
                                clean.mask_id("pincode", upper=False).alias("anonymous_id"))


def _noisy(column: str, i: int) -> str:
    u = f"((('0x'||substr(md5(state||'|'||district||'|42|{i}'),1,13))::BIGINT::DOUBLE+0.5e0)/4503599627370496e0-0.5e0)"
    return f"CAST(greatest(round({column}-2e0*sign({u})*ln(1e0-2e0*abs({u}))),0e0) AS BIGINT) AS {column}"


@query("privacy_noise", f"""SELECT state, district, {', '.join(_noisy(c, i) for i, c in enumerate(AGES))}, round(age_0_5/(age_0_5+age_5_17+age_18_greater)::DOUBLE,2) AS child_ratio FROM (
 SELECT state, district, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in AGES)} FROM enrol GROUP BY 1,2)""")
def privacy_noise(d: Domain):
    g = d.enrolment().groupBy("state", "district").agg(*[F.sum(c).alias(c) for c in AGES])
    g = g.withColumn("child_ratio", F.col("age_0_5") / F.expr(TOTAL))
    return clean.privacy_noise(g, ["state", "district"], AGES, ["child_ratio"], epsilon=0.5)


# ---------------------------------------------------------------- missing values

@query("null_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*)-count({c}) AS missing FROM gaps"
    for c in ("record_id", "date", "state", "district", "pincode", *AGES)))
def null_counts(d: Domain):
    return clean.null_counts(d.gaps())


@query("impute_global", """SELECT record_id, coalesce(age_0_5, m0)::DOUBLE AS age_0_5, coalesce(age_5_17, m1)::DOUBLE AS age_5_17 FROM gaps,
 (SELECT quantile_cont(age_0_5::DOUBLE, 0.5) m0, quantile_cont(age_5_17::DOUBLE, 0.5) m1 FROM gaps)""")
def impute_global(d: Domain):
    return clean.impute_global(d.gaps(), AGES[:2]).select("record_id", *AGES[:2])


@query("impute_group_median", """SELECT g.record_id, g.state, coalesce(age_0_5, m, gm)::DOUBLE AS age_0_5 FROM gaps g
 JOIN (SELECT state, quantile_cont(age_0_5::DOUBLE, 0.5) m FROM gaps GROUP BY 1) s ON g.state=s.state,
 (SELECT quantile_cont(age_0_5::DOUBLE, 0.5) gm FROM gaps) x""")
def impute_group_median(d: Domain):
    return clean.impute_group_median(d.gaps(), "state", ["age_0_5"]).select("record_id", "state", "age_0_5")


@query("impute_mode", """SELECT record_id, coalesce(district, m) AS district FROM gaps,
 (SELECT district AS m FROM gaps WHERE district IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, district LIMIT 1)""")
def impute_mode(d: Domain):
    return clean.impute_mode(d.gaps(), "district").select("record_id", "district")


@query("impute_ffill", """SELECT event_id, user_id, coalesce(
 last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v_filled
 FROM (SELECT *, CASE WHEN event_id%3<>0 THEN value END v FROM events)""")
def impute_ffill(d: Domain):
    e = d.events().select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    return clean.impute_ffill(e, "user_id", "ts", "event_id", "v").select("event_id", "user_id", "v_filled")


@query("missing_indicators", """SELECT record_id, CAST(age_0_5 IS NULL AS BIGINT) AS age_0_5_missing,
 CAST(age_5_17 IS NULL AS BIGINT) AS age_5_17_missing FROM gaps""")
def missing_indicators(d: Domain):
    return clean.missing_indicators(d.gaps(), AGES[:2]).select("record_id", "age_0_5_missing", "age_5_17_missing")


# ---------------------------------------------------------------- outliers

_T = f"(SELECT record_id, ({TOTAL})::DOUBLE AS total FROM enrol)"


def _total(d: Domain):
    return d.enrolment().select("record_id", F.expr(TOTAL).cast("double").alias("total"))


@query("outlier_iqr", f"""SELECT record_id, total, total < a-(b-a)*1.5e0 OR total > b+(b-a)*1.5e0 AS is_outlier FROM (
 SELECT record_id, age_0_5::DOUBLE AS total FROM enrol), (SELECT quantile_cont(age_0_5::DOUBLE,0.25) a, quantile_cont(age_0_5::DOUBLE,0.75) b FROM enrol)""")
def outlier_iqr(d: Domain):
    return clean.outlier_iqr(d.enrolment().select("record_id", F.col("age_0_5").cast("double").alias("total")), "total")


@query("outlier_z3", f"""SELECT record_id, round(z,6)+0e0 AS z, abs(z)>3e0 AS is_outlier FROM (
 SELECT record_id, (age_0_5-m)/s AS z FROM enrol, (SELECT avg(age_0_5) m, stddev_samp(age_0_5) s FROM enrol))""")
def outlier_z3(d: Domain):
    return rounded(clean.outlier_z3(d.enrolment().select("record_id", "age_0_5"), "age_0_5").select("record_id", "z", "is_outlier"))


@query("winsorize", f"""SELECT record_id, round(greatest(least(total,b),a),6) AS total_w FROM {_T},
 (SELECT quantile_cont(total,0.05) a, quantile_cont(total,0.95) b FROM {_T})""")
def winsorize(d: Domain):
    return rounded(clean.winsorize(_total(d), ["total"]).select("record_id", "total_w"))


@query("clip_or_drop_p01_p99", f"""SELECT record_id, round(greatest(least(total,b),a),6) AS total, 'clip' AS method FROM {_T},
 (SELECT quantile_cont(total,0.01) a, quantile_cont(total,0.99) b FROM {_T})
 UNION ALL SELECT record_id, round(total,6), 'drop' FROM {_T},
 (SELECT quantile_cont(total,0.01) a, quantile_cont(total,0.99) b FROM {_T}) WHERE total BETWEEN a AND b""")
def clip_or_drop_p01_p99(d: Domain):
    t = _total(d)
    return rounded(clean.clip_or_drop(t, ["total"], "clip").withColumn("method", F.lit("clip"))
                   .unionByName(clean.clip_or_drop(t, ["total"], "drop").withColumn("method", F.lit("drop"))))


@query("extreme_flags", f"""SELECT record_id, CAST(total<a OR total>b AS BIGINT) AS total_is_extreme FROM {_T},
 (SELECT quantile_cont(total,0.01) a, quantile_cont(total,0.99) b FROM {_T})""")
def extreme_flags(d: Domain):
    return clean.extreme_flags(_total(d), ["total"]).select("record_id", "total_is_extreme")


# ---------------------------------------------------------------- encoding, scaling

@query("label_encode", """SELECT record_id, pincode, code AS pincode_code FROM enrol JOIN
 (SELECT p, row_number() OVER (ORDER BY p)-1 AS code FROM (SELECT DISTINCT pincode AS p FROM enrol)) ON pincode=p""")
def label_encode(d: Domain):
    return clean.label_encode(d.enrolment().select("record_id", "pincode"), "pincode")


@query("scale_robust", f"""SELECT record_id, round((total-m)/(b-a),6)+0e0 AS total_scaled FROM {_T},
 (SELECT quantile_cont(total,0.25) a, quantile_cont(total,0.5) m, quantile_cont(total,0.75) b FROM {_T})""")
def scale_robust(d: Domain):
    return rounded(clean.scale_robust(_total(d), ["total"]).select("record_id", "total_scaled"))


@query("scale_standard", f"""SELECT record_id, round((total-m)/s,6)+0e0 AS total_scaled FROM {_T},
 (SELECT avg(total) m, stddev_pop(total) s FROM {_T})""")
def scale_standard(d: Domain):
    return rounded(clean.scale_standard(_total(d), ["total"]).select("record_id", "total_scaled"))


@query("scale_minmax", f"""SELECT record_id, round((total-a)/(b-a),6)+0e0 AS total_scaled FROM {_T},
 (SELECT min(total) a, max(total) b FROM {_T})""")
def scale_minmax(d: Domain):
    return rounded(clean.scale_minmax(_total(d), ["total"]).select("record_id", "total_scaled"))


@query("log_intensity", f"""SELECT state, district, round(sign(x)*ln(1+1000*abs(x)),6)+0e0 AS log_intensity FROM (
 SELECT state, district, (current-previous)::DOUBLE/population AS x FROM districts)""")
def log_intensity(d: Domain):
    x = (F.col("current") - F.col("previous")).cast("double") / F.col("population")
    return rounded(d.districts().select("state", "district", scalar.log_scale(x).alias("log_intensity")))


_Q5 = ", ".join(f"quantile_cont({c}::DOUBLE,{p}) {c}_q{i}" for c in AGES[:2] for i, p in enumerate((.01, .25, .5, .75, .99)))


@query("fit_transform", "SELECT record_id, " + ", ".join(
    f"round((greatest(least(coalesce({c}::DOUBLE,{c}_q2),{c}_q4),{c}_q0)-{c}_q2)/({c}_q3-{c}_q1),6)+0e0 AS {c}_scaled" for c in AGES[:2])
    + f" FROM gaps, (SELECT {_Q5} FROM gaps WHERE year(date)<1999)")
def fit_transform(d: Domain):
    """Statistics fitted on the rows before 1999, kept, and applied to every row."""
    g = d.gaps()
    stats = spread.pin(clean.fit_stats(g.filter(F.year("date") < 1999), AGES[:2]))
    return rounded(clean.transform_with(g, stats, AGES[:2]).select("record_id", *[f"{c}_scaled" for c in AGES[:2]]))


@query("feature_schema", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, '{t}' AS data_type, {'true' if t == 'bigint' else 'false'} AS is_numeric, "
    f"'{c.replace('_', ' ') if c != 'age_0_5' else 'infant enrolments (0-5 years)'}' AS explanation, "
    f"round(count({c})/count(*)::DOUBLE, 6) AS filled_share FROM gaps"
    for c, t in (("record_id", "bigint"), ("date", "date"), ("state", "string"), ("district", "string"),
                 ("pincode", "string"), ("age_0_5", "bigint"), ("age_5_17", "bigint"), ("age_18_greater", "bigint"))))
def feature_schema(d: Domain):
    return rounded(clean.feature_schema(d.gaps(), {"age_0_5": "infant enrolments (0-5 years)"}))
