"""Risk and anomaly scores, labels, recommendations, projections, model bookkeeping."""

from pyspark.sql import functions as F

from rollcall.functions import scalar
from rollcall.operators import aggregate, features, planning, scoring
from rollcall.plans import views
from rollcall.plans.aggregates import _vuln_sql
from rollcall.plans.registry import query, rounded
from rollcall.plans.views import TOTAL
from rollcall.sources.domain import VIEW_SQL, Domain


@query("biometric_risk_score", "SELECT state, days_since_update, round(risk_score,6) AS risk_score FROM risk")
def biometric_risk_score(d: Domain):
    return rounded(views.risk(d).select("state", "days_since_update", "risk_score"))


@query("proxy_risk", "SELECT state, round(is_high_risk_state*0.3e0+(1e0-biometric_update_ratio)*0.4e0+adult_ratio*0.3e0,6) AS proxy_risk FROM derived")
def proxy_risk(d: Domain):
    return rounded(scoring.proxy_risk(views.risk(d)).select("state", "proxy_risk"))


_FACT = """concat_ws('|', CASE WHEN biometric_update_ratio<0.3e0 THEN 'Low biometric update rate' END, CASE WHEN elderly_ratio>0.2e0 THEN 'High elderly population' END,
 CASE WHEN is_high_risk_state=1 THEN 'Known high-risk state' END, CASE WHEN demographic_update_ratio<0.3e0 THEN 'Low demographic update rate' END)"""


@query("high_risk_regions", f"""SELECT state, round(risk_score,6) AS risk_score, CASE WHEN risk_score>=0.75e0 THEN 'Critical' WHEN risk_score>=0.6e0 THEN 'High' ELSE 'Moderate' END AS risk_level, {_FACT} AS factors FROM risk WHERE risk_score>=0.6e0""")
def high_risk_regions(d: Domain):
    r = scoring.high_risk_regions(views.risk(d), 0.6)
    return rounded(r.select("state", "risk_score", "risk_level", F.array_join("factors", "|").alias("factors")))


_GLEVEL = "CASE WHEN female_ratio<0.40e0 THEN 'CRITICAL' WHEN female_ratio<0.44e0 THEN 'HIGH' WHEN female_ratio<0.46e0 THEN 'MODERATE' ELSE 'LOW' END"


@query("gender_risk", f"""SELECT state, district, female, round(female_ratio,6) AS female_ratio, CAST(round(greatest(0e0,(0.5e0-female_ratio)*100e0)*0.4e0+greatest(0e0,gender_gap*100e0)*0.3e0+least(10e0,10e0-log10(female+1))*0.2e0+0.5e0) AS BIGINT) AS risk_score,
 {_GLEVEL} AS risk_level, CASE {_GLEVEL} WHEN 'CRITICAL' THEN 1::BIGINT WHEN 'HIGH' THEN 2 WHEN 'MODERATE' THEN 3 ELSE 4 END AS priority FROM coverage WHERE female_ratio<0.46e0""")
def gender_risk(d: Domain):
    """Flagship: districts with the lowest female coverage and their risk level."""
    g = scoring.gender_risk(views.coverage(d))
    return rounded(g.select("state", "district", "female", "female_ratio", "risk_score", "risk_level", "priority"))


@query("gender_label", """SELECT district, CAST(female_per_male<0.85e0 AS BIGINT) AS fixed_label, CAST(female_per_male<(SELECT quantile_cont(female_per_male,0.15) FROM coverage) AS BIGINT) AS percentile_label FROM coverage""")
def gender_label(d: Domain):
    c = views.coverage(d)
    a = scoring.gender_label(c, "female_per_male").withColumnRenamed("label", "fixed_label")
    return scoring.gender_label(a, "female_per_male", threshold=None).select("district", "fixed_label", F.col("label").alias("percentile_label"))


@query("risk_label", """SELECT order_id, line_no, CAST(score>=0.6e0 AS BIGINT) AS label, CAST(score>=m AS BIGINT) AS fallback_label FROM scored, (SELECT quantile_cont(score,0.5) m FROM scored)""")
def risk_label(d: Domain):
    s = views.scored(d).select("order_id", "line_no", "score")
    a = scoring.risk_label(s, "score", 0.6)
    return scoring.risk_label(a.withColumnRenamed("label", "first"), "score", 2.0).select("order_id", "line_no", F.col("first").alias("label"), F.col("label").alias("fallback_label"))


@query("target_shortfall", "SELECT district, round(CASE WHEN female_ratio<0.5e0 THEN female*(0.5e0-female_ratio)/female_ratio ELSE 0e0 END,4) AS shortfall FROM coverage")
def target_shortfall(d: Domain):
    return rounded(scoring.target_shortfall(views.coverage(d), "female_ratio", "female", 0.5).select("district", "shortfall"), 4)


_CAMP = f"{_GLEVEL} IN ('CRITICAL','HIGH')"


@query("recommend_actions", f"""SELECT 'gender' AS topic, district AS place, concat_ws('|', CASE WHEN {_CAMP} THEN 'WOMEN_ONLY_CAMP' END, CASE WHEN total<10000 OR {_GLEVEL}<>'LOW' THEN 'MOBILE_VAN' END, 'AWARENESS',
 CASE WHEN {_GLEVEL}<>'LOW' THEN 'SHG_PARTNERSHIP' END, 'LANGUAGE_SUPPORT') AS actions FROM coverage
 UNION ALL SELECT 'groups', district, concat_ws('|', CASE WHEN bool_or(grp='children') THEN 'ANGANWADI_PARTNERSHIP' END, CASE WHEN bool_or(grp='elderly') THEN 'DOORSTEP_SERVICE|PENSION_LINKAGE' END,
 CASE WHEN bool_or(grp='disabled') THEN 'ACCESSIBILITY|SPECIAL_CAMP' END) FROM ({_vuln_sql('state, district')}) WHERE status='GOOD' AND grp IN ('children','elderly','disabled') GROUP BY district
 UNION ALL SELECT 'driver', district, CASE WHEN gender_gap>0.1e0 THEN 'women-only-registration-camp' ELSE 'mobile-outreach' END FROM coverage
 UNION ALL SELECT 'programme', title, concat(n, ':', (names)) FROM (SELECT title, count(*) AS n, array_to_string(list_slice(list(state ORDER BY risk_score DESC, state),1,5),'|') AS names FROM (
  SELECT state, risk_score, 'Deploy Emergency Re-enrollment Camps' AS title FROM risk WHERE risk_score>=0.75e0 UNION ALL SELECT state, risk_score, 'Senior Citizen Outreach Program' FROM risk WHERE risk_score>=0.6e0 AND elderly_ratio>0.2e0
  UNION ALL SELECT state, risk_score, 'Increase Update Center Capacity' FROM risk WHERE risk_score>=0.6e0 AND biometric_update_ratio<0.3e0) GROUP BY 1)""")
def recommend_actions(d: Domain):
    c = views.coverage(d)
    a = planning.gender_actions(c).select(F.lit("gender").alias("topic"), F.col("district").alias("place"), F.array_join("actions", "|").alias("actions"))
    v = planning.group_actions(aggregate.vulnerable_groups(d.enrolment(), ["state", "district"]), ["district"], status="GOOD")
    b = v.select(F.lit("groups").alias("topic"), F.col("district").alias("place"), F.array_join("actions", "|").alias("actions"))
    e = c.select(F.lit("driver").alias("topic"), F.col("district").alias("place"), planning.driver_action(F.array(F.lit("age_0_5")), F.col("gender_gap")).alias("actions"))
    p = planning.programme_actions(scoring.high_risk_regions(views.risk(d), 0.6))
    p = p.select(F.lit("programme").alias("topic"), F.col("title").alias("place"), F.concat(F.col("regions").cast("string"), F.lit(":"), "names").alias("actions"))
    return a.unionByName(b).unionByName(e).unionByName(p)


SCENARIOS = [{"name": "camps", "kind": "CAMP", "quantity": 10, "days": 1, "target": "WOMEN"}, {"name": "vans", "kind": "MOBILE_VAN", "quantity": 5, "days": 10, "target": "ELDERLY"},
             {"name": "doorstep", "kind": "DOORSTEP", "quantity": 100, "days": 1, "target": "CHILDREN"}, {"name": "awareness", "kind": "AWARENESS_CAMPAIGN", "quantity": 3, "days": 1, "target": "ALL"}]


@query("intervention_projection", """SELECT district, scenario, reach, n AS new_enrolments, cost, v AS annual_value, round(CASE WHEN target='WOMEN' THEN (female+n)/(female+n+male)::DOUBLE-female/(female+male)::DOUBLE END,6) AS ratio_change,
 round((v-cost)*100e0/cost,6) AS roi_pct, CAST(ceil(cost/(v/12e0)) AS BIGINT) AS break_even_months, CASE WHEN (v-cost)*100e0/cost>100 THEN 'HIGHLY RECOMMENDED' WHEN (v-cost)*100e0/cost>50 THEN 'RECOMMENDED' ELSE 'CONSIDER ALTERNATIVES' END AS advice FROM (
 SELECT *, CASE target WHEN 'WOMEN' THEN w WHEN 'ELDERLY' THEN e WHEN 'CHILDREN' THEN c ELSE w+e+c END AS v FROM (SELECT *, (n*70+50)//100*6000+(n*90+50)//100*10000+(n*75+50)//100*14400 AS w, (n*80+50)//100*12000 AS e, (n*60+50)//100*2000 AS c FROM (
 SELECT *, CAST(round(reach*rate) AS BIGINT) AS n FROM coverage, (VALUES ('camps','WOMEN',5000::BIGINT,250000::BIGINT,0.85e0),('vans','ELDERLY',5000,750000,0.9e0),('doorstep','CHILDREN',500,50000,0.95e0),('awareness','ALL',15000,150000,0.15e0)) s(scenario,target,reach,cost,rate))))""")
def intervention_projection(d: Domain):
    p = planning.intervention_projection(views.coverage(d).select("district", "male", "female"), SCENARIOS)
    return rounded(p.drop("male", "female", "target"))


@query("budget_plan", """SELECT district, budget, mix, camps, van_days, cost, projected, projected>=1000 AS meets_target, arg_min(mix, o) OVER (PARTITION BY district) AS best FROM (
 SELECT *, row_number() OVER (PARTITION BY district ORDER BY projected DESC, ord) AS o FROM (SELECT *, camps*25000+van_days*15000 AS cost, camps*425+van_days*90 AS projected FROM (
 SELECT district, budget, 'Camps Only' AS mix, 0 AS ord, budget//25000 AS camps, 0::BIGINT AS van_days FROM (SELECT district, population//10 AS budget FROM districts)
 UNION ALL SELECT district, budget, 'Mobile Vans Only', 1, 0, budget//75000*5 FROM (SELECT district, population//10 AS budget FROM districts)
 UNION ALL SELECT district, budget, 'Mixed Strategy', 2, budget*6//250000, budget*4//750000*5 FROM (SELECT district, population//10 AS budget FROM districts))))""")
def budget_plan(d: Domain):
    return planning.budget_plan(d.districts().select("district", F.expr("population div 10").alias("budget")), "budget", 1000)


# ---------------------------------------------------------------- anomaly scores

@query("zscore_score", "SELECT order_id, line_no, round(score,6) AS score FROM scored")
def zscore_score(d: Domain):
    return rounded(views.scored(d).select("order_id", "line_no", "score"))


VIEW_SQL["multi"] = """SELECT order_id, line_no, score AS s1, CASE WHEN order_id%5<>0 THEN (demo_age_5_17%11)/10e0 END AS s2, CASE WHEN order_id%7<>0 THEN (demo_age_17_%9)/8e0 END AS s3 FROM scored"""


def multi(d: Domain):
    """Three detector scores per record, some absent."""
    s = views.scored(d)
    return s.select("order_id", "line_no", F.col("score").alias("s1"), F.when(F.col("order_id") % 5 != 0, F.col("demo_age_5_17") % 11 / 10.0).alias("s2"),
                    F.when(F.col("order_id") % 7 != 0, F.col("demo_age_17_") % 9 / 8.0).alias("s3"))


_ENS = "(coalesce(s1*0.35e0,0e0)+coalesce(s2*0.25e0,0e0)+coalesce(s3*0.3e0,0e0))/(0.35e0+CASE WHEN s2 IS NULL THEN 0e0 ELSE 0.25e0 END+CASE WHEN s3 IS NULL THEN 0e0 ELSE 0.3e0 END)"
WEIGHTS = {"s1": 0.35, "s2": 0.25, "s3": 0.30}


@query("ensemble_score", f"SELECT order_id, line_no, round({_ENS},6) AS ensemble FROM multi")
def ensemble_score(d: Domain):
    return rounded(scoring.ensemble_score(multi(d), WEIGHTS).select("order_id", "line_no", "ensemble"))


@query("ensemble_vote", """SELECT order_id, line_no, round((CASE WHEN s1>=0.5e0 THEN 1e0 ELSE 0e0 END+CASE WHEN s2>=0.5e0 THEN 1e0 ELSE 0e0 END+CASE WHEN s3>=0.5e0 THEN 1e0 ELSE 0e0 END)/3e0,6) AS voting,
 round(greatest(s1,s2,s3),6) AS stacking, round((s1+s2+s3)/3e0,6) AS averaging FROM (SELECT order_id, line_no, s1, coalesce(s2,0e0) AS s2, coalesce(s3,0e0) AS s3 FROM multi)""")
def ensemble_vote(d: Domain):
    m = multi(d).fillna(0.0)
    for method in ("voting", "stacking", "averaging"):
        m = scoring.ensemble_vote(m, ["s1", "s2", "s3"], method, method)
    return rounded(m.select("order_id", "line_no", "voting", "stacking", "averaging"))


@query("anomaly_label", f"SELECT order_id, line_no, CASE WHEN e<0.3e0 THEN 'Normal' WHEN e<0.7e0 THEN 'Suspicious' ELSE 'Highly Suspicious' END AS label FROM (SELECT order_id, line_no, {_ENS} AS e FROM multi)")
def anomaly_label(d: Domain):
    e = scoring.ensemble_score(multi(d), WEIGHTS)
    return e.select("order_id", "line_no", scalar.anomaly_label(F.col("ensemble")).alias("label"))


@query("model_selection", "SELECT count(*) AS n, CASE WHEN count(*)*3<10000 THEN 'low' WHEN count(*)*3<1000000 THEN 'medium' ELSE 'high' END AS complexity, 'isolation_forest|autoencoder|hdbscan' AS models FROM enrol")
def model_selection(d: Domain):
    m = scoring.model_selection(features.feat_profile(d.enrolment(), list(aggregate.AGES)))
    return m.select("n", "complexity", F.array_join("models", "|").alias("models"))


VIEW_SQL["lab"] = "SELECT l.doc_id, quality, n_chars, CAST(n_chars>600 AS BIGINT) AS prediction FROM labels l JOIN documents d ON l.doc_id=d.doc_id"


def lab(d: Domain):
    j = d.table("labels").join(d.table("documents").select("doc_id", "n_chars"), "doc_id")
    return j.select("doc_id", "quality", "n_chars", (F.col("n_chars") > 600).cast("bigint").alias("prediction"))


@query("balance_classes", "SELECT doc_id, quality::BIGINT AS quality, round(n/(k*c)::DOUBLE,6) AS weight FROM (SELECT doc_id, quality, count(*) OVER () AS n, count(*) OVER (PARTITION BY quality) AS c FROM lab), (SELECT count(DISTINCT quality) k FROM lab)")
def balance_classes(d: Domain):
    return rounded(scoring.balance_classes(lab(d).select("doc_id", "quality"), "quality"))


@query("confusion_metrics", """SELECT *, round((tp+tn)/(tp+fp+tn+fn)::DOUBLE,6) AS accuracy, round(tp/(tp+fp)::DOUBLE,6) AS precision, round(tp/(tp+fn)::DOUBLE,6) AS recall, round(2e0*tp/(2*tp+fp+fn),6) AS f1 FROM (
 SELECT count_if(quality=1 AND prediction=1) AS tp, count_if(quality<>1 AND prediction=1) AS fp, count_if(quality<>1 AND prediction=0) AS tn, count_if(quality=1 AND prediction=0) AS fn FROM lab)""")
def confusion_metrics(d: Domain):
    return rounded(scoring.confusion_metrics(lab(d), "quality", "prediction"))


VIEW_SQL["roc"] = """SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS pa, sum(q) OVER () AS na FROM (SELECT n_chars, count(*) FILTER (WHERE quality=1) AS p, count(*) FILTER (WHERE quality<>1) AS q FROM lab GROUP BY 1) WINDOW w AS (ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING)"""


@query("roc_pr_points", "SELECT n_chars AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp/pa::DOUBLE,6) AS tpr, round(fp/na::DOUBLE,6) AS fpr, round(tp/(tp+fp)::DOUBLE,6) AS precision FROM roc")
def roc_pr_points(d: Domain):
    return rounded(scoring.roc_pr_points(lab(d), "quality", "n_chars").select("threshold", "tp", "fp", "tpr", "fpr", "precision"))


@query("roc_pr_auc", "SELECT round(sum(q*(tp-p+p/2e0))/max(pa::DOUBLE*na),6) AS roc_auc, round(sum(p*tp/(tp+fp)::DOUBLE)/max(pa),6) AS pr_auc, count(*) AS points FROM roc")
def roc_pr_auc(d: Domain):
    return rounded(scoring.roc_pr_auc(scoring.roc_pr_points(lab(d), "quality", "n_chars")))


_IMPF = ["demo_age_5_17", "demo_age_17_", "line_no", "month"]
_IMP = " UNION ALL ".join(f"SELECT is_weekend AS model, '{c}' AS feature, abs(corr({c},score)) AS importance FROM scored GROUP BY 1" for c in _IMPF)


@query("importance_merge", f"SELECT feature, round(avg(importance/m),6) AS importance, count(*) AS models FROM (SELECT *, max(importance) OVER (PARTITION BY model) AS m FROM ({_IMP})) GROUP BY 1")
def importance_merge(d: Domain):
    """Importances of two models (weekday and weekend records), merged."""
    g = views.scored(d).groupBy(F.col("is_weekend").alias("model")).agg(*[F.abs(F.corr(F.col(c).cast("double"), "score")).alias(c) for c in _IMPF])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in _IMPF])
    return rounded(scoring.importance_merge(g.select("model", F.explode(rows).alias("e")).select("model", "e.*")))


COEFS = {"age_0_5": 0.013, "age_5_17": -0.007, "age_18_greater": 0.003}
_LC = ", ".join(f"({c}-avg({c}) OVER ())*({w}e0) AS c{i}" for i, (c, w) in enumerate(COEFS.items()))


@query("linear_contribution", f"""SELECT record_id, round(t,4)+0e0 AS total_contribution, string_agg(f, '|' ORDER BY abs(v) DESC, f) AS drivers FROM (
 SELECT record_id, c0+c1+c2 AS t, unnest(['age_0_5','age_5_17','age_18_greater']) AS f, unnest([c0,c1,c2]) AS v FROM (SELECT record_id, {_LC} FROM enrol)) GROUP BY record_id, t""")
def linear_contribution(d: Domain):
    out = scoring.linear_contribution(d.enrolment().select("record_id", *COEFS), COEFS)
    return rounded(out.select("record_id", "total_contribution", F.array_join(F.transform("drivers", lambda s: s["feature"]), "|").alias("drivers")), 4)


@query("global_contribution", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(abs(({c}-m)*({w}e0))),6) AS mean_abs FROM enrol, (SELECT avg({c}) m FROM enrol)" for c, w in COEFS.items()))
def global_contribution(d: Domain):
    return rounded(scoring.global_contribution(d.enrolment(), COEFS))
