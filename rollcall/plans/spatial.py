"""Neighbours, spatial statistics, grids."""

from pyspark.sql import functions as F

from rollcall.functions import shuffle, spread
from rollcall.operators import spatial as sp
from rollcall.plans import views
from rollcall.plans.registry import query, rounded
from rollcall.plans.scalars import ladder_sql, p_sql
from rollcall.sources.domain import VIEW_SQL, Domain

VIEW_SQL["places"] = """SELECT c_custkey AS id, 8e0+((c_custkey*7919)%2900)/100e0 AS lat, 69e0+((c_custkey*104729)%2800)/100e0 AS lon, c_acctbal AS balance FROM customer"""
VIEW_SQL["pknn"] = """SELECT i, j, rn AS rank, d, 1e0/count(*) OVER (PARTITION BY i) AS w FROM (SELECT a.id AS i, b.id AS j, sqrt((a.lat-b.lat)*(a.lat-b.lat)+(a.lon-b.lon)*(a.lon-b.lon)) AS d,
 row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.lat-b.lat)*(a.lat-b.lat)+(a.lon-b.lon)*(a.lon-b.lon)), b.id) AS rn FROM places a JOIN places b ON a.id<>b.id) WHERE rn<=5"""
VIEW_SQL["dknn"] = VIEW_SQL["pknn"].replace("places", "districts").replace(".id", ".district")
VIEW_SQL["dinten"] = "SELECT *, (current-previous)/greatest(population,1)::DOUBLE AS intensity FROM districts"


def places(d: Domain):
    k = F.col("c_custkey")
    return d.table("customer").select(k.alias("id"), (F.lit(8.0) + (k * 7919) % 2900 / 100.0).alias("lat"),
                                      (F.lit(69.0) + (k * 104729) % 2800 / 100.0).alias("lon"), F.col("c_acctbal").alias("balance"))


def inten(d: Domain):
    return spread.pin(sp.intensity(d.districts()))


def dknn(regions):
    return spread.pin(sp.knn_neighbors(regions, "district", "lat", "lon", 5))


@query("knn_neighbors", "SELECT i, j, rank, round(d,9) AS d, round(w,6) AS w FROM pknn")
def knn_neighbors(d: Domain):
    return rounded(sp.knn_neighbors(places(d), "id", "lat", "lon", 5), 9, w=6)


_D = "sqrt((a.lat-b.lat)*(a.lat-b.lat)+(a.lon-b.lon)*(a.lon-b.lon))"


@query("distance_band_neighbors", f"""SELECT i, j, round(d,9) AS d, round(1e0/count(*) OVER (PARTITION BY i),6) AS w FROM (SELECT a.district AS i, b.district AS j, {_D} AS d FROM districts a JOIN districts b ON a.district<>b.district),
 (SELECT quantile_cont(sqrt((lat-y)*(lat-y)+(lon-x)*(lon-x)),0.5) AS threshold FROM districts, (SELECT lat AS y, lon AS x FROM districts ORDER BY district LIMIT 1)) WHERE d<threshold""")
def distance_band_neighbors(d: Domain):
    """Districts closer than the band's own threshold."""
    return rounded(sp.distance_band_neighbors(spread.pin(d.districts()), "district", "lat", "lon"), 9, w=6)


@query("band_threshold", """SELECT round(quantile_cont(sqrt((lat-y)*(lat-y)+(lon-x)*(lon-x)),0.5),6) AS threshold FROM districts, (SELECT lat AS y, lon AS x FROM districts ORDER BY district LIMIT 1)""")
def band_threshold(d: Domain):
    """The distance band's default: median distance to the first point."""
    return rounded(sp.first_point_threshold(d.districts(), "district", "lat", "lon"))


VIEW_SQL["queen"] = """SELECT i, j, 1e0/count(*) OVER (PARTITION BY i) AS w FROM (SELECT a.district AS i, b.district AS j FROM districts a JOIN districts b ON a.district<>b.district
 AND abs(a.lat-b.lat)<=1e0 AND abs(a.lon-b.lon)<=1e0)"""


@query("queen_neighbors", "SELECT i, j, round(w,6) AS w FROM queen")
def queen_neighbors(d: Domain):
    return rounded(sp.queen_neighbors(d.districts(), "district", "lat", "lon", 0.5))


@query("same_group_neighbors", """SELECT district, n-1 AS neighbors, round(1e0/nullif(n-1,0),6) AS weight, round((s-enrolments)/nullif(n-1,0)::DOUBLE,6) AS neighbor_mean FROM (
 SELECT *, count(*) OVER (PARTITION BY state) AS n, sum(enrolments) OVER (PARTITION BY state)::DOUBLE AS s FROM districts)""")
def same_group_neighbors(d: Domain):
    out = sp.same_group_neighbors(d.districts(), "state", "enrolments")
    return rounded(out.select("district", "neighbors", "weight", "neighbor_mean"))


_GRID = "(SELECT cell, 6.5e0+floor(cell/15)*2e0 AS lat, 68e0+(cell%15)*2e0 AS lon FROM (SELECT unnest(range(0,225)) AS cell))"


@query("grid_cross_points", f"""SELECT cell, count(*) AS n_points, round(min(d),6) AS nearest FROM (SELECT a.cell, {_D} AS d FROM {_GRID} a JOIN places b ON {_D}<5e0) GROUP BY 1""")
def grid_cross_points(d: Domain):
    p = places(d)
    pairs = sp.grid_cross_points(sp.lat_lon_grid(p), p, 5.0, "balance")
    return rounded(pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("n_points"), F.min("d").alias("nearest")))


@query("impute_knn", """SELECT p.id, round(coalesce(b, m, g),6) AS balance FROM (SELECT id, CASE WHEN id%11<>0 THEN balance END AS b FROM places) p
 LEFT JOIN (SELECT i, avg(balance) AS m FROM (SELECT a.id AS i, b.balance, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.lat-b.lat)*(a.lat-b.lat)+(a.lon-b.lon)*(a.lon-b.lon)), b.id) AS rn
  FROM places a JOIN places b ON b.id%11<>0 WHERE a.id%11=0) WHERE rn<=5 GROUP BY 1) n ON p.id=n.i, (SELECT avg(balance) g FROM places WHERE id%11<>0)""")
def impute_knn(d: Domain):
    p = places(d).withColumn("balance", F.when(F.col("id") % 11 != 0, F.col("balance")))
    return rounded(sp.impute_knn(p, "id", "lat", "lon", "balance", 5).select("id", "balance"))


# ---------------------------------------------------------------- intensity, z

@query("intensity", "SELECT district, round(intensity,9)+0e0 AS intensity, round(intensity*100000,6)+0e0 AS intensity_per_100k FROM dinten")
def intensity(d: Domain):
    return rounded(sp.intensity(d.districts()).select("district", "intensity", "intensity_per_100k"), 6, intensity=9)


VIEW_SQL["smoothed"] = "SELECT district, intensity, avg(intensity) OVER (ORDER BY intensity, district ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smoothed FROM dinten"


@query("intensity_scaled", """SELECT district, round(smoothed,9)+0e0 AS smoothed, round(l,6)+0e0 AS logged, round((l-min(l) OVER ())/(max(l) OVER ()-min(l) OVER ()),6)+0e0 AS scaled_intensity FROM (
 SELECT district, smoothed, sign(c)*ln(1+1000*abs(c)) AS l FROM (SELECT *, CASE WHEN o THEN greatest(least(smoothed,p95),p05) ELSE smoothed END AS c FROM smoothed,
 (SELECT p05, p95, (SELECT bool_or(smoothed<a-(b-a)*1.5e0 OR smoothed>b+(b-a)*1.5e0) FROM smoothed) AS o FROM (SELECT quantile_cont(smoothed,0.25) a, quantile_cont(smoothed,0.75) b,
 quantile_cont(smoothed,0.05) p05, quantile_cont(smoothed,0.95) p95 FROM smoothed))))""")
def intensity_scaled(d: Domain):
    return rounded(sp.intensity_scaled(d.districts(), "district").drop("intensity"), 6, smoothed=9)


VIEW_SQL["dz"] = "SELECT *, (intensity-avg(intensity) OVER ())/stddev_pop(intensity) OVER () AS z FROM dinten"


@query("zscore_regions", f"""SELECT district, round(z,6)+0e0 AS z, round({p_sql('z')},6) AS p_value, {ladder_sql('c')} AS classification, CASE WHEN z>2.58e0 THEN '#DC143C' WHEN z>1.96e0 THEN '#FF8C00' WHEN z>1.65e0 THEN '#FFD700'
 WHEN z>-1.65e0 THEN '#FFFACD' WHEN z>-1.96e0 THEN '#87CEEB' WHEN z>-2.58e0 THEN '#4169E1' ELSE '#00008B' END AS color FROM dz""")
def zscore_regions(d: Domain):
    return rounded(sp.zscore_regions(sp.intensity(d.districts()), "intensity").select("district", "z", "p_value", "classification", "color"))


@query("anomaly_regions", "SELECT district, round(z,6)+0e0 AS z, abs(z)>1.2e0 AS is_anomaly, CASE WHEN z>1.2e0 THEN 'high' WHEN z<-1.2e0 THEN 'low' ELSE 'normal' END AS anomaly_type FROM dz")
def anomaly_regions(d: Domain):
    return rounded(sp.anomaly_regions(sp.intensity(d.districts()), "intensity", 1.2).select("district", "z", "is_anomaly", "anomaly_type"))


# ---------------------------------------------------------------- autocorrelation

def _moran_sql(edges: str, x: str = "intensity", fixed: bool = False) -> str:
    var = "0.1e0" if fixed else "((n*n*s1-n*s2+3e0*sw*sw)/((n*n-1e0)*sw*sw)-e*e)"
    return f"""SELECT n::BIGINT AS n, i AS morans_i, e AS expected, v AS variance, (i-e)/sqrt(v) AS z FROM (SELECT *, {var} AS v FROM (SELECT *, n/sw*num/den AS i, -1e0/(n-1e0) AS e FROM
 (SELECT count(*)::DOUBLE n, sum(zx*zx) den FROM (SELECT {x}-avg({x}) OVER () AS zx FROM dinten)),
 (SELECT sum(w*a.zx*b.zx) num, sum(w) sw FROM ({edges}) e JOIN (SELECT district, {x}-avg({x}) OVER () AS zx FROM dinten) a ON e.i=a.district JOIN (SELECT district, {x}-avg({x}) OVER () AS zx FROM dinten) b ON e.j=b.district),
 (SELECT sum(w*w)/2e0 s1 FROM (SELECT i, j, sum(w) w FROM (SELECT i, j, w FROM ({edges}) UNION ALL SELECT j, i, w FROM ({edges})) GROUP BY 1,2)),
 (SELECT sum(w*w) s2 FROM (SELECT i, sum(w) w FROM (SELECT i, j, w FROM ({edges}) UNION ALL SELECT j, i, w FROM ({edges})) GROUP BY 1))))"""


_GROUP_EDGES = "SELECT a.district AS i, b.district AS j, 1e0/count(*) OVER (PARTITION BY a.district) AS w FROM districts a JOIN districts b ON a.state=b.state AND a.district<>b.district"
_MOR = ("round(morans_i,6)+0e0 AS morans_i, round(expected,6) AS expected, round(variance,6) AS variance, round(z,6)+0e0 AS z, round(" + p_sql("z") + ",6) AS p_value, CASE WHEN " + p_sql("z")
        + ">0.05e0 THEN 'random' WHEN morans_i>expected THEN 'clustered' ELSE 'dispersed' END AS interpretation")


@query("moran_i", f"""SELECT 'knn' AS weights, n, {_MOR} FROM ({_moran_sql('SELECT i,j,w FROM dknn')}) UNION ALL SELECT 'group', n, {_MOR} FROM ({_moran_sql(_GROUP_EDGES)})
 UNION ALL SELECT 'group_fixed', n, {_MOR} FROM ({_moran_sql(_GROUP_EDGES, fixed=True)})""")
def moran_i(d: Domain):
    v = inten(d)
    knn = sp.moran_i(v, "district", "intensity", dknn(v)).withColumn("weights", F.lit("knn"))
    grp = sp.moran_i_groups(v, "state", "intensity").withColumn("weights", F.lit("group"))
    fix = sp.moran_i_groups(v, "state", "intensity", "fixed").withColumn("weights", F.lit("group_fixed"))
    return rounded(knn.unionByName(grp).unionByName(fix))


def _round_sql(state: str, i: int) -> str:
    """One Feistel round of the shuffle over (p, k, n, a, b, l, r)."""
    half, other, size = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
    moved = f"({half}+('0x'||substr(md5('42|'||p||'|{i}|'||{other}),1,8))::BIGINT)%{size} AS {half}"
    return f"SELECT p, k, n, a, b, {other}, {moved} FROM ({state})"


def _rounds_sql(state: str) -> str:
    for i in range(shuffle.ROUNDS):
        state = _round_sql(state, i)
    return f"SELECT p, k, n, a, b, l*b+r AS x FROM ({state})"


_SEATS = """SELECT k, s, v, n, b, greatest(1, (n+b-1)//b) AS a FROM (SELECT district AS k, row_number() OVER (ORDER BY district)-1 AS s, intensity AS v, count(*) OVER () AS n,
 (CASE WHEN count(*) OVER ()>1 THEN floor(sqrt((count(*) OVER ()-1)::DOUBLE))::BIGINT+1 ELSE 1 END) AS b FROM dinten)"""
VIEW_SQL["mseat"] = _SEATS
VIEW_SQL["mdeal"] = f"""SELECT p, w.k, m.v AS x FROM (WITH RECURSIVE walk AS ({_rounds_sql('SELECT p, k, n, a, b, s//b AS l, s%b AS r FROM mseat, range(1,1000) t(p)')}
 UNION ALL {_rounds_sql('SELECT p, k, n, a, b, x//b AS l, x%b AS r FROM walk WHERE x>=n')}) SELECT p, k, x FROM walk WHERE x<n) w JOIN mseat m ON w.x=m.s
 UNION ALL SELECT 0, district, intensity FROM dinten"""


@query("moran_permutation", """SELECT round(i,6)+0e0 AS morans_i, count(*) AS permutations, round((least(count_if(s>=i), count(*)-count_if(s>=i))+1)/(count(*)+1)::DOUBLE,6) AS p_sim,
 round((i-avg(s))/stddev_pop(s),6)+0e0 AS z_sim FROM (SELECT p, s, max(CASE WHEN p=0 THEN s END) OVER () AS i FROM (SELECT a.p, n/sum(w)*sum(w*(a.x-m)*(b.x-m))/den AS s FROM dknn e
 JOIN mdeal a ON e.i=a.k JOIN mdeal b ON e.j=b.k AND a.p=b.p, (SELECT count(*)::DOUBLE AS n, avg(intensity) AS m, var_pop(intensity)*count(*) AS den FROM dinten) GROUP BY a.p, n, den)) WHERE p>0 GROUP BY i""")
def moran_permutation(d: Domain):
    v = inten(d)
    return rounded(sp.moran_permutation(v, "district", "intensity", dknn(v), 999))


def _gi_sql(edges: str) -> str:
    return f"""SELECT i AS district, (wx-m*w1)/(s*sqrt((n*w2-w1*w1)/(n-1e0))) AS gi_z FROM (SELECT i, sum(w*x) AS wx, sum(w) AS w1, sum(w*w) AS w2 FROM (SELECT i, j, w FROM ({edges}) UNION ALL
 SELECT district, district, 1e0 FROM districts) e JOIN (SELECT district, intensity AS x FROM dinten) v ON e.j=v.district GROUP BY 1),
 (SELECT count(*)::DOUBLE n, avg(intensity) m, stddev_pop(intensity) s FROM dinten)"""


VIEW_SQL["gik"] = _gi_sql("SELECT i,j,w FROM dknn")
_GI = f"round(gi_z,6)+0e0 AS gi_z, round({p_sql('gi_z')},6) AS p_value, {ladder_sql('e', 'gi_z')} AS classification"


@query("gi_star", f"SELECT 'knn' AS weights, district, {_GI} FROM gik UNION ALL SELECT 'group', district, {_GI} FROM ({_gi_sql(_GROUP_EDGES)})")
def gi_star(d: Domain):
    v = inten(d)
    knn = sp.gi_star(v, "district", "intensity", dknn(v)).withColumn("weights", F.lit("knn"))
    grp = sp.gi_star_groups(v, "district", "state", "intensity").withColumn("weights", F.lit("group"))
    cols = ["weights", "district", "gi_z", "p_value", "classification"]
    return rounded(knn.select(*cols).unionByName(grp.select(*cols)))


@query("gi_star_permutation", """SELECT i AS district, round(gi,6)+0e0 AS gi, round((least(count_if(s>=gi), count(*)-count_if(s>=gi))+1)/(count(*)+1)::DOUBLE,6) AS p_sim,
 round((gi-avg(s))/nullif(stddev_pop(s),0),6)+0e0 AS z_sim FROM (SELECT i, p, s, max(CASE WHEN p=0 THEN s END) OVER (PARTITION BY i) AS gi FROM (SELECT e.i, p, sum(w*x) AS s FROM (
 SELECT i, j, 1e0/count(*) OVER (PARTITION BY i) AS w FROM (SELECT i, j FROM dknn UNION ALL SELECT district, district FROM dinten)) e JOIN mdeal d ON e.j=d.k GROUP BY 1,2)) WHERE p>0 GROUP BY i, gi""")
def gi_star_permutation(d: Domain):
    v = inten(d)
    return rounded(sp.gi_star_permutation(v, "district", "intensity", dknn(v), 999))


@query("hotspots", "SELECT district, round(gi_z,6) AS gi_z FROM gik WHERE gi_z>1.2e0")
def hotspots(d: Domain):
    v = inten(d)
    return rounded(sp.hotspots(sp.gi_star(v, "district", "intensity", dknn(v)), 1.2).select("district", "gi_z"))


@query("coldspots", "SELECT district, round(gi_z,6) AS gi_z FROM gik WHERE gi_z<-1.2e0")
def coldspots(d: Domain):
    v = inten(d)
    return rounded(sp.hotspots(sp.gi_star(v, "district", "intensity", dknn(v)), 1.2, cold=True).select("district", "gi_z"))


@query("spatial_summary", f"""SELECT round(mean_z,6)+0e0 AS mean_z, round(std_z,6) AS std_z, total_regions, hotspots, coldspots, anomalies, in_sync, round(morans_i,6) AS morans_i, round({p_sql('mz')},6) AS p_value,
 CASE WHEN morans_i>0.3e0 THEN 'Strong Clustering' WHEN morans_i>0.1e0 THEN 'Moderate Clustering' WHEN abs(morans_i)<0.1e0 THEN 'Random' ELSE 'Dispersed' END AS autocorrelation FROM (
 SELECT avg(z) AS mean_z, stddev_pop(z) AS std_z, count(*) AS total_regions, count_if(c='Hot Spot') AS hotspots, count_if(c='Cold Spot') AS coldspots, count_if(c='Anomaly') AS anomalies, count_if(c='In-Sync') AS in_sync
 FROM (SELECT z, {ladder_sql('a')} AS c FROM dz)), (SELECT morans_i, z AS mz FROM ({_moran_sql('SELECT i,j,w FROM dknn')}))""")
def spatial_summary(d: Domain):
    v = inten(d)
    return rounded(sp.spatial_summary(sp.with_z(v, "intensity"), sp.moran_i(v, "district", "intensity", dknn(v))))


# ---------------------------------------------------------------- smoothing, grids

@query("gauss_smooth", f"""SELECT i AS district, round(sum(exp(-d*d/2e0)*x)/sum(exp(-d*d/2e0)),9)+0e0 AS smoothed FROM (SELECT a.district AS i, b.intensity AS x, {_D} AS d FROM dinten a CROSS JOIN dinten b) GROUP BY 1""")
def gauss_smooth(d: Domain):
    return rounded(sp.gauss_smooth(sp.intensity(d.districts()), "district", "intensity"), 9)


def _idw_sql(cells: str, src: str, val: str) -> str:
    return f"""SELECT cell, lat, lon, coalesce(n,0) AS n_points, coalesce(hit, num/den, g) AS value FROM {cells} c LEFT JOIN (SELECT a.cell AS c2, count(*) AS n, min(CASE WHEN d=0 THEN v END) AS hit,
 sum(v/nullif(d*d,0)) AS num, sum(1e0/nullif(d*d,0)) AS den FROM (SELECT a.cell, b.{val} AS v, {_D} AS d FROM {cells} a JOIN {src} b ON {_D}<5e0) a GROUP BY 1) p ON c.cell=p.c2, (SELECT avg({val}) g FROM {src})"""


@query("idw_points", f"SELECT cell, lat, lon, n_points, round(value,4)+0e0 AS value FROM ({_idw_sql(_GRID, 'places', 'balance')})")
def idw_points(d: Domain):
    p = places(d)
    return rounded(sp.idw_points(sp.lat_lon_grid(p), p, "balance"), 4)


@query("idw_grid", f"""SELECT cell, lat, lon, n_points, round(value,9)+0e0 AS value, round(z,6)+0e0 AS z, {ladder_sql('c')} AS classification FROM (
 SELECT *, (value-avg(value) OVER ())/(stddev_pop(value) OVER ()+1e-10) AS z FROM ({_idw_sql(_GRID, 'dinten', 'intensity')}))""")
def idw_grid(d: Domain):
    return rounded(sp.idw_grid(sp.intensity(d.districts()), "intensity"), 9, z=6)


@query("hex_bin", """SELECT hex_q, hex_r, round((hex_q+hex_r/2e0)*(sqrt(3e0)*1.5e0),6)+0e0 AS hex_lon, round(hex_r*(1.5e0*1.5e0),6)+0e0 AS hex_lat, count(*) AS n, round(avg(balance),4)+0e0 AS mean_balance FROM (
 SELECT balance, CAST(CASE WHEN dq>dr AND dq>ds THEN -rr-rs ELSE rq END AS BIGINT) AS hex_q, CAST(CASE WHEN dq>dr AND dq>ds THEN rr WHEN dr>ds THEN -rq-rs ELSE rr END AS BIGINT) AS hex_r FROM (
 SELECT *, abs(rq-q) AS dq, abs(rr-r) AS dr, abs(rs-s) AS ds FROM (SELECT *, round_even(q,0) AS rq, round_even(r,0) AS rr, round_even(s,0) AS rs FROM (SELECT *, -q-r AS s FROM (
 SELECT balance, (lon/1.5e0)*(sqrt(3e0)/3e0)-(lat/1.5e0)/3e0 AS q, (lat/1.5e0)*(2e0/3e0) AS r FROM places))))) GROUP BY ALL""")
def hex_bin(d: Domain):
    h = sp.hex_bin(places(d), "lat", "lon", 1.5)
    return rounded(h.groupBy("hex_q", "hex_r", "hex_lon", "hex_lat").agg(F.count(F.lit(1)).alias("n"), F.avg("balance").alias("mean_balance")), 6, mean_balance=4)


def _ring(df, name: str):
    return rounded(df.select("id", F.posexplode("ring").alias("pos", "xy")).select("id", "pos", F.col("xy")[0].alias("lon"), F.col("xy")[1].alias("lat")))


@query("box_polygon", "SELECT id, pos, round(lon+dx*0.5e0,6) AS lon, round(lat+dy*0.5e0,6) AS lat FROM places, (VALUES (0::BIGINT,-1,-1),(1,1,-1),(2,1,1),(3,-1,1),(4,-1,-1)) v(pos,dx,dy)")
def box_polygon(d: Domain):
    return _ring(places(d).withColumn("ring", sp.box_polygon(F.col("lat"), F.col("lon"), 0.5)), "box")


@query("hex_polygon", "SELECT id, pos, round(lon+cos(radians(60*(pos%6)))*0.5e0,6) AS lon, round(lat+sin(radians(60*(pos%6)))*0.5e0,6) AS lat FROM places, (SELECT unnest(range(0,7)) AS pos)")
def hex_polygon(d: Domain):
    return _ring(places(d).withColumn("ring", sp.hex_polygon(F.col("lat"), F.col("lon"), 0.5)), "hex")


# ---------------------------------------------------------------- planning

@query("intervention_priority", """SELECT district, round(coverage,6) AS coverage, is_coldspot, round(p,6) AS priority_score, CASE WHEN p>=30 THEN 'high' WHEN p>=20 THEN 'medium' ELSE 'low' END AS urgency FROM (
 SELECT district, coverage, coalesce(gi_z<-1.96e0,false) AS is_coldspot, (100e0-coverage)+CASE WHEN gi_z<-1.96e0 THEN abs(gi_z)*10e0 ELSE 0e0 END AS p FROM (SELECT district, least(enrolments*100e0/population,100e0) AS coverage FROM districts)
 JOIN gik USING (district)) WHERE coverage<85 OR is_coldspot""")
def intervention_priority(d: Domain):
    v = inten(d)
    gi = sp.gi_star(v, "district", "intensity", dknn(v))
    c = v.select("district", F.least(F.col("enrolments") * 100.0 / F.col("population"), F.lit(100.0)).alias("coverage")).join(gi.select("district", "gi_z"), "district")
    return rounded(sp.intervention_priority(c, "district").select("district", "coverage", "is_coldspot", "priority_score", "urgency"))


@query("scenario_coverage", """SELECT t AS target_regions, e AS current_enrolments, round(c,6) AS current_coverage, CAST(2 AS BIGINT) AS mobile_units, CAST(24000 AS BIGINT) AS additional_enrolments,
 round((e+24000)*100e0/p,6) AS projected_coverage, round((e+24000)*100e0/p-c,6)+0e0 AS coverage_increase FROM (SELECT count(*) AS t, CAST(sum(enrolments) AS BIGINT) AS e, avg(enrolments/population::DOUBLE)*100e0 AS c, sum(population)::DOUBLE AS p FROM dz WHERE z<-1e0)""")
def scenario_coverage(d: Domain):
    return rounded(sp.scenario_coverage(sp.with_z(sp.intensity(d.districts()), "intensity"), 20, -1.0))


@query("region_details", f"""SELECT district, current-previous AS raw_change, round((current-previous)*100000e0/population,6)+0e0 AS per_100k, round(current*100e0/population,6) AS coverage_pct, greatest(0,population-current) AS remaining,
 round(z,6)+0e0 AS z, {ladder_sql('c')} AS classification, CASE WHEN abs(z)>2.58e0 THEN '99%' WHEN abs(z)>1.96e0 THEN '95%' ELSE 'N/A' END AS confidence,
 CASE {ladder_sql('c')} WHEN 'Cold Spot' THEN 'CRITICAL' WHEN 'Declining' THEN 'HIGH' WHEN 'Significant Hotspot' THEN 'MONITOR' ELSE 'NORMAL' END AS priority,
 CASE {ladder_sql('c')} WHEN 'Cold Spot' THEN 'Deploy Mobile Enrollment Units immediately' WHEN 'Declining' THEN 'Increase awareness campaigns and CSC support' WHEN 'Significant Hotspot' THEN 'Study success factors for replication' ELSE 'Continue current operations' END AS action,
 round(current*(1.048e0*(1e0+sin(2e0*pi()*month(DATE '2001-08-01'+180)/12e0)*0.015e0)*(1e0+z*0.002e0)),3) AS projected FROM dz""")
def region_details(d: Domain):
    out = sp.region_details(sp.intensity(d.districts()), "intensity", "2001-08-01")
    return rounded(out.select("district", "raw_change", "per_100k", "coverage_pct", "remaining", "z", "classification", "confidence", "priority", "action", "projected"), 6, projected=3)


VIEW_SQL["fc"] = "SELECT district, p AS period, enrolments*(1e0+0.01e0*p) AS f FROM districts, (SELECT unnest(range(1,7)) AS p)"


@query("neighbor_lag_adjust", """SELECT a.district, a.period, round(a.f+0.3e0*(m-a.f),4) AS adjusted FROM fc a JOIN (SELECT i, period, avg(f) AS m FROM dknn JOIN fc ON j=district GROUP BY 1,2) n ON a.district=n.i AND a.period=n.period""")
def neighbor_lag_adjust(d: Domain):
    v = d.districts()
    f = v.select("district", "enrolments", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("period")).withColumn("f", F.col("enrolments") * (1.0 + F.col("period") * 0.01))
    return rounded(sp.neighbor_lag_adjust(f, dknn(v), "district", "period", "f").select("district", "period", "adjusted"), 4)


@query("spatial_lag_rho", """SELECT round(regr_slope(intensity,lag),6) AS rho, round(regr_intercept(intensity,lag),9) AS intercept, round(regr_r2(intensity,lag),6) AS r2, count(*) AS n FROM dinten JOIN
 (SELECT i, sum(w*intensity)/sum(w) AS lag FROM dknn JOIN dinten ON j=district GROUP BY 1) ON i=district""")
def spatial_lag_rho(d: Domain):
    v = inten(d)
    return rounded(sp.spatial_lag_rho(v, "district", "intensity", dknn(v)), 6, intercept=9)
