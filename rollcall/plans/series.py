"""Time series and forecasting on the state by month series."""

from pyspark.sql import functions as F

from rollcall.operators import series as se
from rollcall.operators import spatial
from rollcall.plans import views
from rollcall.plans.registry import query, rounded
from rollcall.plans.views import TOTAL
from rollcall.sources import readers
from rollcall.sources.domain import VIEW_SQL, Domain

G = ("state", "month", "value")
ZIN = {"mi": "SELECT *, row_number() OVER (PARTITION BY state ORDER BY month)-1 AS idx, count(*) OVER (PARTITION BY state) AS n FROM months"}
VIEW_SQL.update(ZIN)


@query("series_by_group", f"""SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY district) AS points FROM (SELECT district, CAST(date_trunc('month',date) AS DATE) AS month, CAST(sum({TOTAL}) AS BIGINT) AS value
 FROM enrol GROUP BY 1,2)) WHERE points>=10""")
def series_by_group(d: Domain):
    e = d.enrolment().select("district", F.trunc("date", "month").alias("month"), F.expr(TOTAL).alias("v"))
    return se.series_by_group(e, "district", "month", "v")


@query("decompose_seasonal", """SELECT state, month, value, idx, round(trend,4) AS trend, round(seasonal,4)+0e0 AS seasonal, round(residual,4)+0e0 AS residual,
 n>=24 AND stddev_pop(seasonal) OVER (PARTITION BY state)>stddev_pop(residual) OVER (PARTITION BY state)*0.5e0 AS has_seasonality FROM (SELECT *, value-trend-seasonal AS residual FROM (
 SELECT a.*, CASE WHEN a.n>=24 THEN s.a-m ELSE 0e0 END AS seasonal FROM (SELECT *, CASE WHEN n>=24 THEN avg(value) OVER (PARTITION BY state ORDER BY month ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) ELSE value::DOUBLE END AS trend FROM mi) a
 JOIN dslots s ON a.state=s.state AND a.idx%12=s.slot JOIN (SELECT state, avg(a) AS m FROM dslots GROUP BY 1) q ON a.state=q.state))""",
       views={"mi": ZIN["mi"], "dslots": """SELECT state, idx%12 AS slot, avg(value-trend) AS a FROM (SELECT *, avg(value) OVER (PARTITION BY state ORDER BY month ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) AS trend FROM mi) GROUP BY 1,2"""})
def decompose_seasonal(d: Domain):
    return rounded(se.decompose_seasonal(d.months(), *G), 4)


@query("series_anomalies", """SELECT state, month, value, round(z,6) AS z, CASE WHEN abs(z)>=3 THEN 'critical' WHEN abs(z)>=2.5e0 THEN 'high' ELSE 'medium' END AS severity,
 CASE WHEN z>0 THEN 'above_expected' ELSE 'below_expected' END AS direction, round(value-m,4) AS deviation, round((value-m)*100e0/m,4) AS pct_deviation FROM (
 SELECT *, (value-m)/s AS z FROM (SELECT *, avg(value) OVER (PARTITION BY state) AS m, stddev_pop(value) OVER (PARTITION BY state) AS s FROM mi WHERE n>=5)) WHERE abs(z)>=2""")
def series_anomalies(d: Domain):
    return rounded(se.series_anomalies(d.months(), *G), 4, z=6)


VIEW_SQL["trend"] = """SELECT *, CASE WHEN slope>0.01e0 THEN 'increasing' WHEN slope<-0.01e0 THEN 'decreasing' ELSE 'stable' END AS direction FROM (SELECT state, regr_slope(value,idx) AS slope, regr_intercept(value,idx) AS intercept,
 CASE WHEN var_pop(value)=0 THEN 0e0 ELSE regr_r2(value,idx) END AS r2, count(*) AS points, max(month) AS last_date, arg_max(value,month) AS current_value FROM mi GROUP BY 1) WHERE points>=3"""


@query("linear_trend", """SELECT state, round(slope,4)+0e0 AS slope, round(intercept,4) AS intercept, round(r2,6) AS r2, direction, p AS period, CAST(last_date+to_months(CAST(p AS INT)) AS DATE) AS date,
 round(slope*(points+p-1)+intercept,4) AS predicted FROM trend, (SELECT unnest(range(1,7)) AS p)""")
def linear_trend(d: Domain):
    t = se.project_trend(se.linear_trend(d.months(), *G), 6)
    return rounded(t.select("state", "slope", "intercept", "r2", "direction", "period", "date", "predicted"), 4, r2=6)


@query("regional_trends", """SELECT state, round(slope,4)+0e0 AS slope, direction, current_value, round(r2,6) AS r2, points, round(slope*(points+2)+intercept,4) AS projected_3m, count_if(direction='increasing') OVER () AS n_increasing,
 count_if(direction='stable') OVER () AS n_stable, count_if(direction='decreasing') OVER () AS n_decreasing FROM trend""")
def regional_trends(d: Domain):
    t = se.regional_trends(d.months(), *G)
    return rounded(t.select("state", "slope", "direction", "current_value", "r2", "points", "projected_3m", "n_increasing", "n_stable", "n_decreasing"), 4, r2=6)


@query("ma_trend_forecast", """SELECT state, p AS period, CAST(last_date+to_months(CAST(p AS INT)) AS DATE) AS date, round(greatest(0e0,f),4) AS predicted, round(greatest(0e0,f-f*0.15e0*sqrt(p)),4) AS lower,
 round(greatest(0e0,f+f*0.15e0*sqrt(p)),4) AS upper FROM (SELECT *, mean_recent+trend*p AS f FROM halves, (SELECT unnest(range(1,7)) AS p) WHERE points>=3)""")
def ma_trend_forecast(d: Domain):
    return rounded(se.ma_trend_forecast(d.months(), *G), 4)


_CURVE = """SELECT state, strftime(DATE '2001-08-01'+CAST((i+1)*30 AS INT),'%Y-%m') AS month, {v}*(1e0+0.008e0*(i+1))*(1e0+sin(2e0*pi()*month(DATE '2001-08-01'+CAST((i+1)*30 AS INT))/12e0)*{s}){z} AS p, i
 FROM ({src}), (SELECT unnest(range(0,6)) AS i)"""
_TOP8 = f"SELECT state, sum({TOTAL})/1000e0 AS v FROM enrol GROUP BY 1 ORDER BY sum({TOTAL}) DESC, state LIMIT 8"


@query("curve_forecast", f"""SELECT 'state' AS level, state AS place, month, round(p,4) AS predicted, round(p-p*0.03e0*(1e0+i*0.15e0),4) AS lower, round(p+p*0.03e0*(1e0+i*0.15e0),4) AS upper FROM ({_CURVE.format(v='v', s='0.02e0', z='', src=_TOP8)})
 UNION ALL SELECT 'district', state, month, round(p,4), round(p-p*0.04e0*(1e0+i*0.1e0),4), round(p+p*0.04e0*(1e0+i*0.1e0),4) FROM ({_CURVE.format(v='v', s='0.015e0', z='*(1e0+z*0.002e0)', src='SELECT district AS state, current AS v, z FROM dz')})""")
def curve_forecast(d: Domain):
    g = d.enrolment().groupBy("state").agg(F.sum(F.expr(TOTAL)).alias("t")).orderBy(F.desc("t"), "state").limit(8).select(F.col("state").alias("place"), (F.col("t") / 1000.0).alias("v"))
    a = se.curve_forecast(g, "place", "v", "2001-08-01").withColumn("level", F.lit("state"))
    z = spatial.with_z(spatial.intensity(d.districts()), "intensity").withColumn("place", F.col("district"))
    b = se.curve_forecast(z, "place", "current", "2001-08-01", season=0.015, ci=0.04, ci_step=0.1, z="z").withColumn("level", F.lit("district"))
    return rounded(a.unionByName(b), 4)


VIEW_SQL["adf"] = """SELECT state, n, r*sqrt((n-2)/(1e0-r*r)) AS t_stat FROM (SELECT state, corr(v-p,p) AS r, count(*) AS n FROM (SELECT state, value::DOUBLE AS v, lag(value::DOUBLE) OVER (PARTITION BY state ORDER BY month) AS p FROM months) WHERE p IS NOT NULL GROUP BY 1)"""


@query("adf_stationarity", "SELECT state, n, round(t_stat,6) AS t_stat, t_stat<-2.86e0 AS is_stationary, CASE WHEN t_stat<-2.86e0 THEN 0::BIGINT ELSE 1::BIGINT END AS d FROM adf")
def adf_stationarity(d: Domain):
    return rounded(se.adf_stationarity(d.months(), *G))


@query("arima_forecast")
def arima_forecast(d: Domain):
    e = d.finished_months().select("district", F.trunc("date", "month").alias("month"), F.expr(TOTAL).alias("v"))
    return rounded(se.arima_forecast(e, "district", "month", "v"), 4)


@query("sarima_forecast")
def sarima_forecast(d: Domain):
    return rounded(se.sarima_forecast(d.months(), *G), 4)


@query("holt_winters", """WITH RECURSIVE base AS (SELECT state, max(month) AS last_date, list(value::DOUBLE ORDER BY idx) AS ys, sum(CASE WHEN idx<12 THEN value END)/12e0 AS l0,
 (sum(CASE WHEN idx BETWEEN 12 AND 23 THEN value END)/12e0-sum(CASE WHEN idx<12 THEN value END)/12e0)/12e0 AS b0 FROM mi GROUP BY 1 HAVING count(*)>=24),
 hw AS (SELECT state, last_date, ys, 12 AS i, l0 AS l, b0 AS b, list_transform(ys[1:12], lambda x: x-l0) AS s FROM base
 UNION ALL SELECT state, last_date, ys, i+1, lev, (lev-l)*0.05e0+b*0.95e0, list_append(s[2:12], (y-lev)*0.1e0+old*0.9e0) FROM (SELECT *, ys[i+1] AS y, s[1] AS old, (ys[i+1]-s[1])*0.3e0+(l+b)*0.7e0 AS lev FROM hw WHERE i<len(ys)))
 SELECT state, p AS period, CAST(last_date+to_months(CAST(p AS INT)) AS DATE) AS date, round(greatest(0e0, l+b*p+s[(p-1)%12+1]),4) AS predicted FROM hw, (SELECT unnest(range(1,7)) AS p) WHERE i=len(ys)""")
def holt_winters(d: Domain):
    return rounded(se.holt_winters(d.months(), *G), 4)


@query("exp_smooth", "SELECT state, round(sum(value*CASE WHEN idx=0 THEN 0.7e0**(n-1) ELSE 0.3e0*0.7e0**(n-1-idx) END),4) AS level, count(*) AS points FROM mi GROUP BY 1")
def exp_smooth(d: Domain):
    return rounded(se.exp_smooth(d.months(), *G), 4)


VIEW_SQL["tfit"] = """SELECT state, month, actual, fitted, actual-fitted AS residual, fitted-1.96e0*sd AS lower, fitted+1.96e0*sd AS upper FROM (SELECT *, stddev_samp(actual-fitted) OVER (PARTITION BY state) AS sd FROM (
 SELECT m.state, month, value::DOUBLE AS actual, slope*idx+intercept AS fitted FROM mi m JOIN trend t ON m.state=t.state))"""
VIEW_SQL["metrics"] = """SELECT state, sqrt(avg(residual*residual)) AS rmse, avg(abs(residual)) AS mae, avg(CASE WHEN actual<>0 THEN abs(residual/actual) END)*100e0 AS mape,
 avg(CASE WHEN actual BETWEEN lower AND upper THEN 1e0 ELSE 0e0 END)*100e0 AS ci_coverage, count(*) AS points FROM tfit GROUP BY 1"""
VIEW_SQL["rstats"] = """SELECT state, avg(residual) AS mean, stddev_samp(residual) AS std, avg((residual-m)**3)/pow(avg((residual-m)**2),1.5e0) AS skew, kurtosis_pop(residual) AS kurtosis, count(*) AS n FROM (
 SELECT *, avg(residual) OVER (PARTITION BY state) AS m FROM tfit) GROUP BY 1"""
VIEW_SQL["racf"] = """SELECT state, lag, n, c/den AS acf, 1.96e0/sqrt(n) AS band FROM (SELECT a.state, k AS lag, sum(a.z*b.z) AS c FROM zser a, (SELECT unnest(range(1,21)) AS k), zser b WHERE b.state=a.state AND b.i=a.i-k GROUP BY 1,2) x
 JOIN (SELECT state AS st, count(*) AS n, sum(z*z) AS den FROM zser GROUP BY 1) ON state=st WHERE lag<=n//2-1"""
VIEW_SQL["zser"] = "SELECT state, row_number() OVER (PARTITION BY state ORDER BY month) AS i, residual-avg(residual) OVER (PARTITION BY state) AS z FROM tfit"
VIEW_SQL["lbq"] = "SELECT state, max(n*(n+2e0))*sum(acf*acf/(n-lag)) AS q FROM racf WHERE lag<=10 GROUP BY 1"


def _fit(d: Domain):
    return se.trend_fit(d.months(), *G)


_M = "round(rmse,4) AS rmse, round(mae,4) AS mae, round(mape,4) AS mape, round(ci_coverage,4) AS ci_coverage, points"


@query("fit_metrics", f"SELECT state, {_M} FROM metrics")
def fit_metrics(d: Domain):
    return rounded(se.fit_metrics(_fit(d), "state"), 4)


@query("residual_stats", "SELECT state, round(mean,4)+0e0 AS mean, round(std,4) AS std, round(skew,4)+0e0 AS skew, round(kurtosis,4)+0e0 AS kurtosis, n FROM rstats")
def residual_stats(d: Domain):
    return rounded(se.residual_stats(_fit(d), "state"), 4)


@query("acf", "SELECT state, lag, round(acf,6)+0e0 AS acf, round(band,6) AS band, n FROM racf")
def acf(d: Domain):
    return rounded(se.acf(_fit(d), "state", "month", "residual"))


@query("pacf")
def pacf(d: Domain):
    return rounded(se.pacf(_fit(d), "state", "month", "residual"))


@query("ljung_box", "SELECT state, round(q,4) AS q, q<18.307e0 AS no_autocorrelation FROM lbq")
def ljung_box(d: Domain):
    return rounded(se.ljung_box(_fit(d), "state", "month", "residual"), 4)


_JB = "n/6e0*(skew*skew+kurtosis*kurtosis/4e0)"


@query("normality_check", f"SELECT state, round({_JB},4) AS jarque_bera, {_JB}<5.991e0 AS is_normal FROM rstats")
def normality_check(d: Domain):
    return rounded(se.normality_check(se.residual_stats(_fit(d), "state")).select("state", "jarque_bera", "is_normal"), 4)


@query("diagnostics_table", f"""SELECT state, {_M}, round({_JB},4) AS jarque_bera, {_JB}<5.991e0 AS is_normal, round(q,4) AS q, q<18.307e0 AS no_autocorrelation, round(t_stat,4) AS t_stat FROM metrics
 JOIN rstats USING (state) JOIN lbq USING (state) JOIN (SELECT state, t_stat FROM adf) USING (state)""")
def diagnostics_table(d: Domain):
    t = se.diagnostics_table(d.months(), *G)
    return rounded(t.select("state", "rmse", "mae", "mape", "ci_coverage", "points", "jarque_bera", "is_normal", "q", "no_autocorrelation", "t_stat"), 4)


@query("forecast_export", """SELECT state, p AS period, round(greatest(0e0,mean_recent+trend*p),2) AS predicted FROM halves, (SELECT unnest(range(1,25)) AS p)""")
def forecast_export(d: Domain):
    """24 periods per region as CSV, written and read back."""
    f = rounded(se.ma_trend_forecast(d.months(), *G, periods=24).select("state", "period", "predicted"), 2)
    path = readers.work_folder(d.spark, "forecast")
    readers.write_csv(f, path)
    return readers.read_typed_csv(d.spark, path, f.schema)


@query("survival_curve", """SELECT curve, round(rate,9) AS rate, CAST(floor(ln(2e0)/rate) AS BIGINT) AS median_days, least(CAST(floor(ln(2e0)/rate) AS BIGINT),730) AS update_interval, round(exp(-rate*365),6) AS year_1,
 round(exp(-rate*1095),6) AS year_3, round(exp(-rate*1825),6) AS year_5, day, round(exp(-rate*day),6) AS survival FROM (SELECT 'overall' AS curve, 0.001e0*(1e0+avg(risk_score)*2e0) AS rate FROM risk
 UNION ALL SELECT 'low_risk', 0.0005e0 FROM risk HAVING count_if(risk_score<0.4e0)>0 UNION ALL SELECT 'high_risk', 0.003e0 FROM risk HAVING count_if(risk_score>=0.6e0)>0), (SELECT unnest(range(0,1825,30)) AS day)""")
def survival_curve(d: Domain):
    return rounded(se.survival_curve(views.risk(d)), 6, rate=9)
