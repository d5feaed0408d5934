"""Explanations of scored records."""

from pyspark.sql import functions as F

from rollcall.functions import spread
from rollcall.operators import explain as ex
from rollcall.plans import views
from rollcall.plans.registry import query, rounded
from rollcall.sources.domain import VIEW_SQL, Domain

FEATS = ["total_demo_updates", "demo_age_5_17", "demo_age_17_", "center_event_count", "month", "is_weekend"]
KEY = ["order_id", "line_no"]

# Line numbers repeat inside an order, so the check SQL numbers the rows over all their columns.
VIEW_SQL["feats"] = """SELECT *, CASE WHEN order_id%5<>0 THEN (demo_age_5_17%11)/10e0 END AS s2, CASE WHEN order_id%7<>0 THEN (demo_age_17_%9)/8e0 END AS s3,
 row_number() OVER (ORDER BY order_id, line_no, date, center_id, operator_id, demo_age_5_17, demo_age_17_) AS rid FROM (SELECT s.*, demo_age_5_17+demo_age_17_ AS total_demo_updates, c AS center_event_count, CAST(day(date)>=25 AS BIGINT) AS is_month_end, CAST(day(date)<=5 AS BIGINT) AS is_month_start
 FROM scored s JOIN (SELECT center_id AS cid, count(*) AS c FROM demo GROUP BY 1) ON center_id=cid)"""


def feats(d: Domain):
    """Scored records with their features, computed once: explanations read them several times."""
    s = views.scored(d)
    s = spread.join_stats(s, s.groupBy("center_id").agg(F.count(F.lit(1)).alias("center_event_count")), ["center_id"])
    return spread.pin(s.withColumns({
        "total_demo_updates": F.col("demo_age_5_17") + F.col("demo_age_17_"),
        "is_month_end": (F.dayofmonth("date") >= 25).cast("bigint"), "is_month_start": (F.dayofmonth("date") <= 5).cast("bigint")}))


def with_models(f):
    """Two further score columns, null for some records."""
    return f.withColumns({"s2": F.when(F.col("order_id") % 5 != 0, F.col("demo_age_5_17") % 11 / 10.0),
                          "s3": F.when(F.col("order_id") % 7 != 0, F.col("demo_age_17_") % 9 / 8.0)})


_NAMES = "[" + ",".join(f"'{f}'" for f in FEATS) + "]"
_VALS = "[" + ",".join(f"{f}::DOUBLE" for f in FEATS) + "]"
VIEW_SQL["flong"] = f"SELECT rid, order_id, line_no, score, unnest({_NAMES}) AS feature, unnest({_VALS}) AS value FROM feats"
VIEW_SQL["fstat"] = "SELECT feature AS sf, avg(value) AS m, stddev_pop(value) AS sp, stddev_samp(value) AS ss, min(value) AS lo, max(value) AS hi FROM flong GROUP BY 1"
VIEW_SQL["attr"] = """SELECT *, row_number() OVER (PARTITION BY rid ORDER BY round(abs(z),9) DESC, feature) AS rn, abs(z)/nullif(sum(abs(z)) OVER (PARTITION BY rid),0) AS share,
 CASE WHEN value>m THEN 'above' WHEN value<m THEN 'below' ELSE 'at' END AS direction FROM (SELECT flong.*, m, coalesce((value-m)/nullif(sp,0),0) AS z FROM flong JOIN fstat ON feature=sf)"""
VIEW_SQL["devs"] = """SELECT *, CASE WHEN z>4 OR pct>99.5e0 OR pct<0.5e0 THEN 'critical' WHEN z>3 OR pct>99 OR pct<1 THEN 'high' WHEN z>2 OR pct>95 OR pct<5 THEN 'medium' ELSE 'low' END AS severity FROM (
 SELECT *, row_number() OVER (PARTITION BY rid ORDER BY round(z,9) DESC, feature) AS rn, CASE WHEN value<=lo THEN 0e0 WHEN value>=hi THEN 100e0 WHEN value<m THEN (value-lo)*50e0/(m-lo) ELSE (value-m)*50e0/(hi-m)+50e0 END AS pct,
 CASE WHEN regexp_matches(feature,'state|district|pincode|geo') THEN 'geographic' WHEN regexp_matches(feature,'month|day|weekend|quarter|time') THEN 'temporal' WHEN regexp_matches(feature,'operator|center|update|enrolment') THEN 'behavioral' ELSE 'statistical' END AS type
 FROM (SELECT flong.*, m, lo, hi, coalesce(abs((value-m)/nullif(ss,0)),0) AS z FROM flong JOIN fstat ON feature=sf))"""


@query("attribution", """SELECT order_id, line_no, feature, round(share,6) AS share, round(z,6)+0e0 AS z, direction, rn AS rank FROM attr WHERE rn<=3""")
def attribution(d: Domain):
    a = ex.attribution(feats(d), FEATS, 3)
    out = a.select(*KEY, F.posexplode_outer("contributors").alias("p", "c")).select(*KEY, "c.feature", "c.share", "c.z", "c.direction", (F.col("p") + 1).alias("rank"))
    return rounded(out)


@query("compare_to_normal", """SELECT order_id, line_no, feature, value, round(nm,6) AS normal_mean, round(ns,6) AS normal_std, round((value-nm)/ns,6)+0e0 AS z, round(pc,6) AS percentile, value<p5 OR value>p95 AS is_outlier FROM flong
 JOIN (SELECT feature AS nf, avg(value) nm, stddev_pop(value) ns, quantile_cont(value,0.05) p5, quantile_cont(value,0.95) p95 FROM flong WHERE score<0.6e0 GROUP BY 1) ON feature=nf
 JOIN (SELECT feature AS pf, value AS pv, sum(c) OVER (PARTITION BY feature ORDER BY value)*100e0/sum(c) OVER (PARTITION BY feature) AS pc FROM (SELECT feature, value, count(*) FILTER (WHERE score<0.6e0) AS c FROM flong GROUP BY 1,2)) ON feature=pf AND value=pv
 WHERE score>=0.6e0""")
def compare_to_normal(d: Domain):
    c = ex.compare_to_normal(feats(d).select(*KEY, "score", *FEATS), KEY, FEATS, F.col("score") >= 0.6)
    return rounded(c)


@query("baseline_stats", """SELECT feature, round(avg(value),6) AS mean, round(stddev_samp(value),6) AS std, round(quantile_cont(value,0.5),6) AS median, round(quantile_cont(value,0.25),6) AS q25, round(quantile_cont(value,0.75),6) AS q75,
 round(quantile_cont(value,0.95),6) AS q95, round(quantile_cont(value,0.99),6) AS q99, min(value) AS min, max(value) AS max, round(quantile_cont(value,0.75)-quantile_cont(value,0.25),6) AS iqr FROM flong GROUP BY 1""")
def baseline_stats(d: Domain):
    return rounded(ex.baseline_stats(feats(d), FEATS))


_BF = ["demo_age_5_17", "total_demo_updates"]


@query("baseline_by_dim", " UNION ALL ".join(f"SELECT '{dim}' AS dim, CAST({dim} AS VARCHAR) AS key, count(*) AS n, '{f}' AS feature, round(avg({f}),6) AS mean, round(stddev_samp({f}),6) AS std FROM feats GROUP BY 2"
                                          for dim in ("month", "is_weekend", "state", "center_id") for f in _BF))
def baseline_by_dim(d: Domain):
    return rounded(ex.baseline_by_dim(feats(d), ["month", "is_weekend", "state", "center_id"], _BF))


_CTX = "CASE type WHEN 'geographic' THEN ' (unusual for this location)' WHEN 'temporal' THEN ' (unusual for this time period)' WHEN 'behavioral' THEN ' (deviates from typical behavior)' ELSE '' END"
_TITLE = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{f.replace('_', ' ').title().rstrip() + (' ' if f.endswith('_') else '')}'" for f in FEATS) + " END"


@query("deviations", f"""SELECT order_id, line_no, feature, value, round(value-m,6)+0e0 AS deviation, round(z,6) AS z, round(pct,6) AS percentile, type, severity, concat({_TITLE}, ' is ',
 CASE severity WHEN 'critical' THEN 'extremely' WHEN 'high' THEN 'significantly' WHEN 'medium' THEN 'moderately' ELSE 'slightly' END, ' ', CASE WHEN value>m THEN 'higher' ELSE 'lower' END, ' than expected', {_CTX}) AS explanation FROM devs WHERE rn<=2""")
def deviations(d: Domain):
    out = ex.deviations(feats(d), FEATS, 2).select(*KEY, F.explode_outer("deviations").alias("c"))
    return rounded(out.select(*KEY, "c.feature", "c.value", "c.deviation", "c.z", "c.percentile", "c.type", "c.severity", "c.explanation"))


def _dim_sql(dim: str, label: str) -> str:
    return " UNION ALL ".join(f"""SELECT rid, order_id, line_no, '{label}' AS type, '{f}' AS feature, CASE WHEN z>3 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT rid, order_id, line_no,
 abs(({f}-avg({f}) OVER (PARTITION BY {dim}))/nullif(stddev_samp({f}) OVER (PARTITION BY {dim}),0)) AS z FROM feats) WHERE z>2""" for f in FEATS)


VIEW_SQL["tdev"] = _dim_sql("month", "monthly_deviation") + "".join(f" UNION ALL SELECT rid, order_id, line_no, '{t}', '', '{s}' FROM feats WHERE {c}=1" for c, t, s in (
    ("is_weekend", "weekend_activity", "medium"), ("is_month_end", "month_end_activity", "low"), ("is_month_start", "month_start_activity", "low")))
VIEW_SQL["gdev"] = _dim_sql("state", "state_deviation") + " UNION ALL " + _dim_sql("center_id", "center_id_deviation")


@query("temporal_deviations", "SELECT order_id, line_no, type, feature, severity FROM tdev")
def temporal_deviations(d: Domain):
    return ex.temporal_deviations(feats(d), FEATS).select(*KEY, F.explode_outer("temporal_flags").alias("c")).filter("c is not null").select(*KEY, "c.*")


@query("geo_deviations", "SELECT order_id, line_no, type, feature, severity FROM gdev")
def geo_deviations(d: Domain):
    return ex.geo_deviations(feats(d), FEATS, ["state", "center_id"]).select(*KEY, F.explode_outer("geo_flags").alias("c")).filter("c is not null").select(*KEY, "c.*")


_WORD = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{ex.FEATURE_WORDS.get(f, f.replace('_', ' '))}'" for f in FEATS) + " END"
_SENT = (f"concat('The ', {_WORD}, ' is ', CASE WHEN abs(z)>3 THEN 'extremely' WHEN abs(z)>2 THEN 'significantly' WHEN abs(z)>1 THEN 'moderately' ELSE 'slightly' END, ' ', "
         "CASE WHEN direction='above' THEN 'higher' ELSE 'lower' END, ' than expected', CASE WHEN regexp_matches(feature,'spike|count') THEN ' (possible volume spike)' WHEN feature LIKE '%ratio%' THEN ' (unusual distribution)' ELSE '' END)")
VIEW_SQL["rsn"] = f"""SELECT rid, order_id, line_no, score, concat(CASE WHEN score>0.9e0 THEN '{ex.SCORE_PREFIX[0][1]}|' WHEN score>0.7e0 THEN '{ex.SCORE_PREFIX[1][1]}|' WHEN score>0.5e0 THEN '{ex.SCORE_PREFIX[2][1]}|' ELSE '' END,
 string_agg({_SENT}, '|' ORDER BY rn) FILTER (WHERE direction<>'at')) AS reasons FROM attr WHERE rn<=5 GROUP BY 1,2,3,4"""
_HAS = lambda p: f"bool_or(regexp_matches(feature,'{p}'))"
VIEW_SQL["pat"] = f"""SELECT rid, order_id, line_no, score, CASE WHEN count(*) FILTER (WHERE regexp_matches(feature,'state|district|pincode|geo'))>=2 THEN '{ex.PATTERNS['geo']}' WHEN {_HAS('operator|center')} THEN '{ex.PATTERNS['operator']}'
 WHEN bool_or(regexp_matches(feature,'count|total') AND z>2) THEN '{ex.PATTERNS['volume']}' WHEN {_HAS('weekend|month_end|month_start|day_of_week')} THEN '{ex.PATTERNS['temporal']}' WHEN {_HAS('bio')} THEN '{ex.PATTERNS['bio']}'
 WHEN {_HAS('demo')} THEN '{ex.PATTERNS['demo']}' WHEN {_HAS('enrolment|age')} THEN '{ex.PATTERNS['age']}' ELSE '{ex.PATTERNS['other']}' END AS pattern FROM attr WHERE rn<={{k}} GROUP BY 1,2,3,4"""
VIEW_SQL["pat"] = VIEW_SQL["pat"].replace("{k}", "5")


@query("reasons", "SELECT order_id, line_no, reasons FROM rsn")
def reasons(d: Domain):
    a = ex.attribution(feats(d), FEATS, 5)
    return a.select(*KEY, F.array_join(ex.reasons(F.col("contributors"), F.col("score")), "|").alias("reasons"))


@query("fraud_pattern", "SELECT order_id, line_no, pattern FROM pat")
def fraud_pattern(d: Domain):
    a = ex.attribution(feats(d), FEATS, 5)
    return a.select(*KEY, ex.fraud_pattern(F.col("contributors")).alias("pattern"))


_PLAIN = ["month", "line_no", "is_weekend"]
_PABS = {c: f"coalesce(abs(({c}-avg({c}) OVER ())/nullif(stddev_pop({c}) OVER (),0)),0)" for c in _PLAIN}


@query("fraud_pattern_models", f"""SELECT order_id, line_no, CASE WHEN weekend_rank<=1 THEN '{ex.PATTERNS['temporal']}' WHEN s2>0.7e0 THEN '{ex.MODEL_PATTERNS['hdbscan']}'
 WHEN s3>0.7e0 THEN '{ex.MODEL_PATTERNS['autoencoder']}' ELSE '{ex.PATTERNS['other']}' END AS pattern FROM (SELECT *,
 1+CASE WHEN round(zl,9)>round(zw,9) THEN 1 ELSE 0 END+CASE WHEN round(zm,9)>round(zw,9) THEN 1 ELSE 0 END AS weekend_rank
 FROM (SELECT *, {_PABS['month']} AS zm, {_PABS['line_no']} AS zl, {_PABS['is_weekend']} AS zw FROM feats))""")
def fraud_pattern_models(d: Domain):
    """Patterns of records whose first contributor names none: the detectors' own scores decide."""
    a = ex.attribution(with_models(feats(d)), _PLAIN, 1)
    return a.select(*KEY, ex.fraud_pattern(F.col("contributors"), {"hdbscan": F.col("s2"), "autoencoder": F.col("s3")}).alias("pattern"))


VIEW_SQL["expl"] = """SELECT *, CASE WHEN score>0.9e0 OR (confidence>0.8e0 AND crit>=2) THEN 'CRITICAL' WHEN score>0.7e0 OR (confidence>0.6e0 AND (crit>=1 OR high>=2)) THEN 'HIGH' WHEN score>0.5e0 OR confidence>0.4e0 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM (
 SELECT *, least(1e0, score*0.4e0+agree*0.3e0+least(nd/5e0,1e0)*0.2e0+least(nf/3e0,1e0)*0.1e0) AS confidence FROM (
 SELECT p.order_id, p.line_no, p.score, pattern, reasons, nd, crit, high, coalesce(t.c,0)+coalesce(g.c,0) AS nf,
 (CASE WHEN s1>0.6e0 THEN 1 ELSE 0 END+CASE WHEN s2>0.6e0 THEN 1 ELSE 0 END+CASE WHEN s3>0.6e0 THEN 1 ELSE 0 END)/(1+CASE WHEN s2 IS NULL THEN 0 ELSE 1 END+CASE WHEN s3 IS NULL THEN 0 ELSE 1 END)::DOUBLE AS agree
 FROM pat p JOIN rsn r USING (rid) JOIN (SELECT rid, score AS s1, s2, s3 FROM feats) USING (rid)
 JOIN (SELECT rid, count(*) FILTER (WHERE severity<>'low') AS nd, count(*) FILTER (WHERE severity='critical') AS crit, count(*) FILTER (WHERE severity='high') AS high FROM devs WHERE rn<=10 GROUP BY 1) v USING (rid)
 LEFT JOIN (SELECT rid, count(*) AS c FROM tdev GROUP BY 1) t USING (rid) LEFT JOIN (SELECT rid, count(*) AS c FROM gdev GROUP BY 1) g USING (rid)) WHERE score>=0.5e0)"""


def explained(d: Domain):
    return ex.explain_batch(with_models(feats(d)), FEATS, "score", ["score", "s2", "s3"], ["state", "center_id"], 0.5)


@query("confidence", "SELECT order_id, line_no, round(confidence,6) AS confidence FROM expl")
def confidence(d: Domain):
    return rounded(explained(d).select(*KEY, "confidence"))


@query("severity", "SELECT order_id, line_no, severity FROM expl")
def severity(d: Domain):
    return explained(d).select(*KEY, "severity")


@query("explain_batch", "SELECT order_id, line_no, pattern, reasons, nd AS n_deviations, nf AS n_flags, round(confidence,6) AS confidence, severity FROM expl")
def explain_batch(d: Domain):
    e = explained(d)
    return rounded(e.select(*KEY, "pattern", F.array_join("reasons", "|").alias("reasons"), "n_deviations", "n_flags", "confidence", "severity"))


@query("explain_summary", """SELECT section, item, n, round(value,6) AS value FROM (SELECT 'severity' AS section, severity AS item, count(*) AS n, avg(score) AS value FROM expl GROUP BY 2
 UNION ALL SELECT 'pattern', pattern, count(*), avg(score) FROM expl GROUP BY 2 UNION ALL SELECT 'confidence', 'all', count(*), avg(confidence) FROM expl
 UNION ALL SELECT 'feature', feature, count(*), avg(score) FROM attr WHERE rn<=3 AND score>=0.5e0 GROUP BY 2)""")
def explain_summary(d: Domain):
    return rounded(ex.explain_summary(explained(d), "score"))
