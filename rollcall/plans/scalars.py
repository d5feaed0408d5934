"""Scalar expressions and ladders, run over the records."""

from pyspark.sql import functions as F

from rollcall.functions import scalar, spread, tables
from rollcall.operators import policy_text
from rollcall.plans import views
from rollcall.plans.registry import query, rounded
from rollcall.plans.views import TOTAL
from rollcall.sources.domain import VIEW_SQL, Domain

VIEW_SQL["zs"] = f"SELECT record_id, round((t-avg(t) OVER ())/stddev_pop(t) OVER ()*1.5e0,6)+0e0 AS z FROM (SELECT record_id, ({TOTAL})::DOUBLE AS t FROM enrol)"


def zs(d: Domain):
    t = d.enrolment().select("record_id", F.expr(TOTAL).cast("double").alias("t"))
    s = t.agg(F.avg("t").alias("m"), F.stddev_pop("t").alias("s"))
    return t.crossJoin(F.broadcast(s)).select("record_id", (F.round((F.col("t") - F.col("m")) / F.col("s") * 1.5, 6) + 0.0).alias("z"))


def cdf_sql(x: str) -> str:
    t = f"(1e0/(1e0+0.3275911e0*(abs({x})/sqrt(2e0))))"
    poly = f"(((((1.061405429e0*{t}+-1.453152027e0)*{t}+1.421413741e0)*{t}+-0.284496736e0)*{t}+0.254829592e0)*{t})"
    return f"(0.5e0*(1e0+CASE WHEN {x}<0 THEN -1e0 ELSE 1e0 END*(1e0-{poly}*exp(-(abs({x})/sqrt(2e0))*(abs({x})/sqrt(2e0))))))"


def p_sql(z: str) -> str:
    return f"(2e0*(1e0-{cdf_sql(f'abs({z})')}))"


LADDER = {
    "a": "CASE WHEN {z}>3 THEN 'Anomaly' WHEN {z}>1.96e0 THEN 'Hot Spot' WHEN {z}<-1.96e0 THEN 'Cold Spot' ELSE 'In-Sync' END",
    "b": "CASE WHEN {z}>2.58e0 THEN 'Significant Hotspot' WHEN {z}>1.96e0 THEN 'Hot Spot' WHEN {z}>1.65e0 THEN 'Emerging Trend' WHEN {z}>-1.65e0 THEN 'In-Sync' "
         "WHEN {z}>-1.96e0 THEN 'Declining' WHEN {z}>-2.58e0 THEN 'Cold Spot' ELSE 'High Exclusion Zone' END",
    "c": "CASE WHEN {z}>2.58e0 THEN 'Significant Hotspot' WHEN {z}>1.96e0 THEN 'Emerging Trend' WHEN {z}<-2.58e0 THEN 'Cold Spot' WHEN {z}<-1.96e0 THEN 'Declining' ELSE 'In-Sync' END",
    "d": "CASE WHEN {z}>2.576e0 THEN 'hotspot_99' WHEN {z}<-2.576e0 THEN 'coldspot_99' WHEN {z}>1.96e0 THEN 'hotspot_95' WHEN {z}<-1.96e0 THEN 'coldspot_95' "
         "WHEN {z}>1.645e0 THEN 'hotspot_90' WHEN {z}<-1.645e0 THEN 'coldspot_90' ELSE 'not_significant' END",
    "e": "CASE WHEN {z} IS NULL THEN NULL WHEN {p}<=0.05e0 AND abs({z})>=1.65e0 THEN concat(CASE WHEN {z}>0 THEN 'hotspot_' ELSE 'coldspot_' END, "
         "CASE WHEN abs({z})>=2.58e0 THEN '99' WHEN abs({z})>=1.96e0 THEN '95' ELSE '90' END) ELSE 'not_significant' END",
}


def ladder_sql(scheme: str, z: str = "z", p: str | None = None) -> str:
    return LADDER[scheme].format(z=z, p=p or p_sql(z))


@query("normal_cdf", f"SELECT record_id, z, round({cdf_sql('z')},9) AS cdf FROM zs")
def normal_cdf(d: Domain):
    return rounded(zs(d).withColumn("cdf", scalar.normal_cdf(F.col("z"))), 9)


for _s in "abcde":
    _extra = (", CASE WHEN z>2.58e0 THEN '99%' WHEN z>1.96e0 THEN '95%' WHEN z>1.65e0 THEN '90%' WHEN z>-1.65e0 THEN 'N/A' WHEN z>-1.96e0 THEN '90%' WHEN z>-2.58e0 THEN '95%' ELSE '99%' END AS confidence"
              if _s == "b" else "")

    def _ladder(d: Domain, s=_s):
        out = zs(d).withColumn("classification", scalar.classify_z(F.col("z"), s))
        return out.withColumn("confidence", scalar.confidence_b(F.col("z"))) if s == "b" else out

    query(f"classify_z_{_s}", f"SELECT record_id, z, {ladder_sql(_s)} AS classification{_extra} FROM zs")(_ladder)


@query("color_scale", """SELECT record_id, CASE WHEN z>2.58e0 THEN '#DC143C' WHEN z>1.96e0 THEN '#FF8C00' WHEN z>1.65e0 THEN '#FFD700' WHEN z>-1.65e0 THEN '#FFFACD' WHEN z>-1.96e0 THEN '#87CEEB'
 WHEN z>-2.58e0 THEN '#4169E1' ELSE '#00008B' END AS z_color, concat('#', printf('%02x', CASE WHEN n<0.5e0 THEN 255 ELSE CAST(floor(255e0*(2e0-n*2e0)) AS INT) END),
 printf('%02x', CASE WHEN n<0.5e0 THEN CAST(floor(255e0*(n*2e0)) AS INT) ELSE 255 END), '00') AS value_color FROM (SELECT *, (z-lo)/(hi-lo) AS n FROM (SELECT record_id, z FROM zs), (SELECT min(z) AS lo, max(z) AS hi FROM zs))""")
def color_scale(d: Domain):
    z = spread.with_totals(zs(d), F.min("z").alias("_lo"), F.max("z").alias("_hi"))
    return z.select("record_id", scalar.z_color(F.col("z")).alias("z_color"), scalar.value_color(F.col("z"), F.col("_lo"), F.col("_hi")).alias("value_color"))


@query("risk_level", "SELECT order_id, line_no, CASE WHEN score>=0.75e0 THEN 'Critical' WHEN score>=0.6e0 THEN 'High' ELSE 'Moderate' END AS level FROM scored")
def risk_level(d: Domain):
    return views.scored(d).select("order_id", "line_no", scalar.risk_level(F.col("score")).alias("level"))


@query("risk_category", """SELECT order_id, line_no, CASE WHEN score<=0 OR score>1 THEN NULL WHEN score<=0.3e0 THEN 'Low' WHEN score<=0.6e0 THEN 'Medium' WHEN score<=0.8e0 THEN 'High' ELSE 'Critical' END AS category FROM scored""")
def risk_category(d: Domain):
    return views.scored(d).select("order_id", "line_no", scalar.risk_category(F.col("score")).alias("category"))


@query("gender_risk_level", """SELECT district, CASE WHEN female_ratio<0.40e0 THEN 'CRITICAL' WHEN female_ratio<0.44e0 THEN 'HIGH' WHEN female_ratio<0.46e0 THEN 'MODERATE' ELSE 'LOW' END AS level FROM coverage""")
def gender_risk_level(d: Domain):
    return views.coverage(d).select("district", scalar.gender_risk_level(F.col("female_ratio")).alias("level"))


@query("inclusion_risk_level", """SELECT record_id, CASE WHEN s<40 THEN 'CRITICAL' WHEN s<60 THEN 'HIGH' WHEN s<80 THEN 'MODERATE' ELSE 'LOW' END AS level FROM (SELECT record_id, age_18_greater*100//greatest(age_0_5+age_5_17+age_18_greater,1) AS s FROM enrol)""")
def inclusion_risk_level(d: Domain):
    return d.enrolment().select("record_id", scalar.inclusion_risk_level(F.expr(f"age_18_greater*100 div greatest({TOTAL},1)")).alias("level"))


@query("format_amount", """SELECT record_id, CASE WHEN x>=10000000 THEN printf('%d.%02d Cr', (x*100+5000000)//1000000000, (x*100+5000000)//10000000%100) WHEN x>=100000 THEN printf('%d.%02d L', (x*100+50000)//10000000, (x*100+50000)//100000%100)
 WHEN x>=1000 THEN printf('%d.%d K', (x*10+500)//10000, (x*10+500)//1000%10) ELSE printf('%d', x) END AS rupees,
 CASE WHEN x>=1000000 THEN printf('%d.%02dM', (x*100+500000)//100000000, (x*100+500000)//1000000%100) WHEN x>=1000 THEN printf('%d.%02dK', (x*100+500)//100000, (x*100+500)//1000%100) ELSE printf('%d.00', x) END AS short FROM (
 SELECT record_id, ((age_0_5+age_5_17+age_18_greater)*(1+record_id%9973))*2+1 AS x FROM enrol)""")
def format_amount(d: Domain):
    x = d.enrolment().select("record_id", F.expr(f"({TOTAL})*(1+record_id%9973)*2+1").alias("i")).withColumn("x", F.col("i").cast("double"))
    return x.select("record_id", scalar.format_rupees(F.col("x")).alias("rupees"), scalar.format_short(F.col("x")).alias("short"))


@query("flatten_struct", "SELECT record_id, state AS place_state, district AS place_district, age_0_5 AS counts_young_age_0_5, age_18_greater AS counts_adult FROM enrol")
def flatten_struct(d: Domain):
    nested = d.enrolment().select("record_id", F.struct("state", "district").alias("place"),
                                  F.struct(F.struct("age_0_5").alias("young"), F.col("age_18_greater").alias("adult")).alias("counts"))
    return scalar.flatten_struct(nested)


@query("percentile_of", f"""SELECT x, round(count_if(t<=x)*100e0/count(*),6) AS pct FROM (SELECT {TOTAL} AS t FROM enrol), (SELECT unnest([500,1000,2000,3000]) AS x) GROUP BY x""".replace("SELECT x,", "SELECT CAST(x AS DOUBLE) AS x,"))
def percentile_of(d: Domain):
    t = d.enrolment().select(F.expr(TOTAL).alias("t"))
    xs = [500.0, 1000.0, 2000.0, 3000.0]
    one = t.agg(*[(F.avg((F.col("t") <= x).cast("int")) * 100.0).alias(f"p{i}") for i, x in enumerate(xs)])
    rows = F.array(*[F.struct(F.lit(x).alias("x"), F.col(f"p{i}").alias("pct")) for i, x in enumerate(xs)])
    return rounded(one.select(F.explode(rows).alias("e")).select("e.*"))


def _terms_sql(col: str) -> str:
    for a, b in tables.TERMS.items():
        col = f"replace(replace({col},'{a}','{b}'),'{policy_text.title(a)}','{policy_text.title(b)}')"
    return col


@query("term_translate", f"SELECT doc_id, length(t) AS n_after, sha256(t) AS digest FROM (SELECT doc_id, {_terms_sql('text')} AS t FROM documents)")
def term_translate(d: Domain):
    """Plain words over the whole document texts."""
    t = d.table("documents").select("doc_id", policy_text.translate_terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").alias("n_after"), F.sha2("t", 256).alias("digest"))
