"""Learned detectors, clusters and classifiers."""

from functools import reduce

from pyspark.sql import functions as F

from rollcall.functions import spread, tables
from rollcall.operators import density, detectors, neighbors
from rollcall.operators import models as mo
from rollcall.plans import views
from rollcall.plans.registry import query, rounded
from rollcall.sources.domain import VIEW_SQL, Domain

FEATURES = ["n_chars", "n_words", "digit_share"]


def emb(d: Domain):
    return d.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


def docs(d: Domain):
    """Text features over the whole documents, with the quality label where one exists."""
    t = F.col("text")
    f = d.table("documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split(t, " ")).cast("double").alias("n_words"),
                                    (F.length(F.regexp_replace(t, "[^0-9]", "")) / F.greatest(F.length(t), F.lit(1))).alias("digit_share"))
    return f.join(d.table("labels").select("doc_id", "quality"), "doc_id", "left")


DOCS_SQL = """SELECT d.doc_id, d.n_chars::DOUBLE AS n_chars, len(string_split(text,' '))::DOUBLE AS n_words, quality FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id"""


@query("isolation_forest")
def isolation_forest(d: Domain):
    out = mo.isolation_forest(emb(d), "vec_id", "x")
    return rounded(out.select("vec_id", "iforest", "is_anomaly"))


@query("pca_recon_score")
def pca_recon_score(d: Domain):
    return rounded(mo.pca_recon_score(emb(d), "x", 8).select("vec_id", "recon_error", "recon_score", "is_anomaly"))


@query("pca_project")
def pca_project(d: Domain):
    p = mo.pca_project(emb(d), "x", 2)
    return rounded(p.select("vec_id", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2")))


@query("feature_recon_error")
def feature_recon_error(d: Domain):
    return rounded(mo.feature_recon_error(emb(d), "x", 8), 9)


VIEW_SQL["behav"] = """SELECT c_custkey AS id, c_acctbal/1000e0 AS x, coalesce(n,0)/2e0 AS y FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey=c_custkey"""


def behav(d: Domain):
    """Two behaviour columns per customer: balance and number of orders, scaled."""
    n = d.table("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = d.table("customer")
    return c.join(n, c.c_custkey == n.o_custkey, "left").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000.0).alias("x"), (F.coalesce("n", F.lit(0)) / 2.0).alias("y"))


_DD = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))"


@query("lof_score", f"""SELECT id, round(lof,6) AS lof, lof>1.5e0 AS is_outlier FROM (SELECT e.i AS id, avg(o.l)/max(me.l) AS lof FROM bknn e JOIN blrd o ON e.j=o.i JOIN blrd me ON e.i=me.i GROUP BY 1)""",
       views={**VIEW_SQL, "bknn": f"""SELECT i, j, d FROM (SELECT a.id AS i, b.id AS j, {_DD} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_DD}, b.id) AS rn FROM behav a JOIN behav b ON a.id<>b.id) WHERE rn<=20""",
              "blrd": "SELECT e.i, 1e0/(avg(greatest(d,kd))+1e-10) AS l FROM bknn e JOIN (SELECT i, max(d) AS kd FROM bknn GROUP BY 1) k ON e.j=k.i GROUP BY 1"})
def lof_score(d: Domain):
    return rounded(mo.lof_score(behav(d), "id", "x", "y", 20))


_EPS, _MIN = 0.25, 5
_B = {"nb": f"SELECT a.id AS i, b.id AS j FROM behav a JOIN behav b ON (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<={_EPS}e0*{_EPS}e0",
      "cores": f"SELECT i FROM nb GROUP BY 1 HAVING count(*)>={_MIN}",
      "ce": "SELECT nb.i, nb.j FROM nb JOIN cores a ON nb.i=a.i JOIN cores b ON nb.j=b.i"}


@query("dbscan_labels", f"""WITH RECURSIVE nb AS ({_B['nb']}), cores AS ({_B['cores']}), ce AS ({_B['ce']}), walk AS (SELECT i AS node, i AS root FROM cores UNION SELECT ce.j, walk.root FROM walk JOIN ce ON walk.node=ce.i AND walk.root<ce.j),
 clab AS (SELECT node, min(root) AS comp FROM walk GROUP BY 1), border AS (SELECT nb.i, min(l.comp) AS comp FROM nb JOIN clab l ON nb.j=l.node WHERE nb.i NOT IN (SELECT i FROM cores) GROUP BY 1)
 SELECT id, coalesce(l.comp, b.comp, -1) AS cluster, l.comp IS NOT NULL AS is_core FROM behav LEFT JOIN clab l ON id=l.node LEFT JOIN border b ON id=b.i""")
def dbscan_labels(d: Domain):
    return mo.dbscan_labels(behav(d), "id", "x", "y", _EPS, _MIN)


VIEW_SQL["evecs"] = "SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings"


@query("lof_vectors", """SELECT vec_id, round(lof,6) AS lof, lof>1.5e0 AS is_outlier FROM (SELECT e.i AS vec_id, avg(o.l)/max(me.l) AS lof FROM eknn e JOIN elrd o ON e.j=o.i JOIN elrd me ON e.i=me.i GROUP BY 1)""",
       views={**VIEW_SQL, "eknn": """SELECT i, j, d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rn FROM (
 SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS d FROM evecs a JOIN evecs b ON a.id<>b.id)) WHERE rn<=20""",
              "elrd": "SELECT e.i, 1e0/(avg(greatest(d,kd))+1e-10) AS l FROM eknn e JOIN (SELECT i, max(d) AS kd FROM eknn GROUP BY 1) k ON e.j=k.i GROUP BY 1"})
def lof_vectors(d: Domain):
    """Local outlier factor over all 64 columns of the embeddings."""
    return rounded(neighbors.lof(emb(d), "vec_id", "x", 20))


_VEPS = 1.2
_V = {"nb": f"SELECT a.id AS i, b.id AS j FROM evecs a JOIN evecs b ON list_distance(a.v, b.v)<={_VEPS}e0", "cores": _B["cores"], "ce": _B["ce"]}


@query("dbscan_vectors", f"""WITH RECURSIVE nb AS ({_V['nb']}), cores AS ({_V['cores']}), ce AS ({_V['ce']}), walk AS (SELECT i AS node, i AS root FROM cores UNION SELECT ce.j, walk.root FROM walk JOIN ce ON walk.node=ce.i AND walk.root<ce.j),
 clab AS (SELECT node, min(root) AS comp FROM walk GROUP BY 1), border AS (SELECT nb.i, min(l.comp) AS comp FROM nb JOIN clab l ON nb.j=l.node WHERE nb.i NOT IN (SELECT i FROM cores) GROUP BY 1)
 SELECT id AS vec_id, coalesce(l.comp, b.comp, -1) AS cluster, l.comp IS NOT NULL AS is_core FROM evecs LEFT JOIN clab l ON id=l.node LEFT JOIN border b ON id=b.i""")
def dbscan_vectors(d: Domain):
    """DBSCAN over all 64 columns of the embeddings."""
    return density.dbscan(emb(d), "vec_id", "x", _VEPS, _MIN)


VIEW_SQL["trade"] = """SELECT c_custkey AS id, c_acctbal/1000e0 AS x, coalesce(n,0)/2e0 AS y, coalesce(s,0)/500000e0 AS z FROM customer
 LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(floor(o_totalprice)::BIGINT) AS s FROM orders GROUP BY 1) ON o_custkey=c_custkey"""


def trade(d: Domain):
    """Three behaviour columns per customer: balance, number of orders, spending."""
    o = d.table("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("o_totalprice").cast("bigint")).alias("s"))
    c = d.table("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return spread.pin(c.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000.0).alias("x"), (F.coalesce("n", F.lit(0)) / 2.0).alias("y"),
                               (F.coalesce("s", F.lit(0)) / 500000.0).alias("z")))


_TEPS = 0.3
_DETECT = {**VIEW_SQL,
           "tpair": "SELECT a.id AS i, b.id AS j, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d FROM trade a JOIN trade b ON true",
           "tnear": f"SELECT i, j FROM tpair WHERE d<={_TEPS}e0",
           "tknn": "SELECT i, j, d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rn FROM tpair WHERE i<>j) WHERE rn<=20",
           "tlrd": "SELECT e.i, 1e0/(avg(greatest(d,kd))+1e-10) AS l FROM tknn e JOIN (SELECT i, max(d) AS kd FROM tknn GROUP BY 1) k ON e.j=k.i GROUP BY 1",
           "tlof": "SELECT e.i AS id, avg(o.l)/max(me.l) AS lof FROM tknn e JOIN tlrd o ON e.j=o.i JOIN tlrd me ON e.i=me.i GROUP BY 1",
           "tcore": f"SELECT i FROM tnear GROUP BY 1 HAVING count(*)>={_MIN}",
           "tscore": """SELECT id, (c-min(c) OVER ())/(max(c) OVER ()-min(c) OVER ()+1e-10) AS s_z, (lof-min(lof) OVER ())/(max(lof) OVER ()-min(lof) OVER ()+1e-10) AS s_lof,
 CASE WHEN lof>(SELECT quantile_cont(lof, 0.9) FROM tlof) THEN 1e0 ELSE 0e0 END AS s_cut, CASE WHEN near IS NULL THEN 1e0 ELSE 0e0 END AS s_noise FROM (
 SELECT id, (abs((x-avg(x) OVER ())/stddev_pop(x) OVER ())+abs((y-avg(y) OVER ())/stddev_pop(y) OVER ())+abs((z-avg(z) OVER ())/stddev_pop(z) OVER ()))/3e0 AS c FROM trade)
 JOIN tlof USING (id) LEFT JOIN (SELECT DISTINCT n.i AS near FROM tnear n JOIN tcore c ON n.j=c.i) ON id=near"""}


@query("ensemble_detectors", """SELECT id, round(s_z,6) AS score_zscore, round(s_lof,6) AS score_lof_share, s_noise AS score_dbscan, round((s_z*0.35e0+s_lof*0.25e0+s_noise*0.3e0)/0.9e0,6) AS ensemble FROM tscore""", views=_DETECT)
def ensemble_detectors(d: Domain):
    """Three detectors run on the customers' behaviour, and their weighted mean."""
    s = detectors.ensemble_detectors(trade(d), "id", ["x", "y", "z"], {"zscore": 0.35, "lof_share": 0.25, "dbscan": 0.3}, eps=_TEPS, min_samples=_MIN)
    return rounded(s.select("id", "score_zscore", "score_lof_share", "score_dbscan", "ensemble"))


_REAL_RUNS = [("regional_deviation", "standard"), ("regional_deviation", "maximum"), ("volume_surge", "enhanced")]


def _strategy_sql(strategy: str, vigilance: str) -> str:
    method, conf, names = tables.STRATEGY_METHODS[strategy]
    used = [n if n in detectors.REAL else "zscore" for n in names]
    c = "(" + "+".join(f"CASE WHEN {'s_cut' if n == 'lof' else 's_z'}>=0.5e0 THEN 1e0 ELSE 0e0 END" for n in used) + f")/{len(used)}e0"
    m = tables.VIGILANCE_CUT[vigilance]
    return (f"SELECT '{strategy}' AS strategy, '{'|'.join(used)}' AS techniques, '{vigilance}' AS vigilance, '{'High' if conf >= 0.7 else 'Standard'}' AS confidence, count(*) AS records_analyzed, "
            f"count(*) FILTER (WHERE c>={m * 0.5!r}::DOUBLE) AS flagged, count(*) FILTER (WHERE c>={m * 0.3!r}::DOUBLE AND c<{m * 0.5!r}::DOUBLE) AS review, count(*) FILTER (WHERE c<{m * 0.3!r}::DOUBLE) AS cleared, "
            f"round(avg(c),6) AS raw_score FROM (SELECT {c} AS c FROM tscore)")


@query("run_strategy_detectors", " UNION ALL ".join(_strategy_sql(s, v) for s, v in _REAL_RUNS), views=_DETECT)
def run_strategy_detectors(d: Domain):
    """Strategies whose techniques are run on the customers' behaviour."""
    rows = trade(d)
    return rounded(reduce(lambda a, b: a.unionByName(b), [detectors.run_strategy(rows, "id", s, ["x", "y", "z"], v) for s, v in _REAL_RUNS]))


@query("kmeans_clusters")
def kmeans_clusters(d: Domain):
    """Best silhouette of 2..10 on the behaviour columns, with a risk word per cluster."""
    c = mo.kmeans_clusters(behav(d), ["x", "y"], max_k=10)
    return rounded(mo.cluster_risk(c, "cluster", ["x", "y"]))


@query("calinski_harabasz", """SELECT round(b,6) AS between, round(w,6) AS within, k, n, round((b/(k-1))/(w/(n-k)),6) AS calinski_harabasz FROM (SELECT sum(c*(m-g)**2) AS b, sum(c*s) AS w, count(DISTINCT label) AS k FROM (
 SELECT label, pos, count(*) AS c, avg(v) AS m, var_pop(v) AS s FROM evec GROUP BY 1,2) JOIN (SELECT pos, avg(v) AS g FROM evec GROUP BY 1) USING (pos)), (SELECT count(*) AS n FROM embeddings)""",
       views={"evec": "SELECT label, unnest(range(1,65)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings"})
def calinski_harabasz(d: Domain):
    return rounded(mo.calinski_harabasz(emb(d), "x", "label").select("between", "within", "k", "n", "calinski_harabasz"))


@query("train_classifier")
def train_classifier(d: Domain):
    return rounded(mo.train_classifier(docs(d).filter("quality is not null"), "doc_id", FEATURES, "quality"))


@query("tune_classifier")
def tune_classifier(d: Domain):
    return rounded(mo.tune_classifier(docs(d).filter("quality is not null"), "doc_id", FEATURES, "quality"))


@query("cv_compare")
def cv_compare(d: Domain):
    return rounded(mo.cv_compare(docs(d).filter("quality is not null"), "doc_id", FEATURES, "quality"))


@query("batch_predict")
def batch_predict(d: Domain):
    """Trained on the labelled documents, applied to all of them."""
    x = spread.pin(docs(d))
    return rounded(mo.batch_predict(x.filter("quality is not null"), x, "doc_id", FEATURES, "quality"))


def _smote_sql(rows: str, out: str) -> str:
    """Rows (id, c, v) levelled by class: the given ones and ``out`` of the new ones (v and o the two ends, u the place)."""
    u = "((('0x'||substr(md5(id||'|'||copy||'|42|{}'),1,13))::BIGINT::DOUBLE+0.5e0)/4503599627370496e0)"
    return f"""WITH r AS ({rows}), n AS (SELECT c, count(*) AS n, max(count(*)) OVER () - count(*) AS need FROM r GROUP BY c), f AS (SELECT id, c, v, n, need, row_number() OVER (PARTITION BY c ORDER BY id)-1 AS p FROM r JOIN n USING (c) WHERE need>0),
 e AS (SELECT i, list(j ORDER BY rn) AS js FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rn FROM (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS d FROM f a JOIN f b ON a.c=b.c AND a.id<>b.id)) WHERE rn<=5 GROUP BY i),
 t AS (SELECT *, unnest(range(0, CASE WHEN p<need THEN (need-p-1)//n+1 ELSE 0 END)) AS copy FROM f),
 s AS (SELECT t.*, coalesce(js, [t.id]) AS js, {u.format('row')} AS pick, {u.format('place')} AS u FROM t LEFT JOIN e ON id=i),
 m AS (SELECT s.*, o.v AS o, o.id AS other FROM s JOIN f o ON o.id=s.js[CAST(floor(pick*len(js)) AS BIGINT)+1])
 {out}"""


@query("smote_oversample", _smote_sql(
    f"SELECT doc_id AS id, quality AS c, [n_chars/1000, n_words/200] AS v FROM ({DOCS_SQL}) WHERE quality IS NOT NULL",
    """SELECT round(v[1],6) AS x, round(v[2],6) AS y, c::BIGINT AS quality, false AS is_synthetic FROM r UNION ALL
 SELECT round(v[1]+u*(o[1]-v[1]),6), round(v[2]+u*(o[2]-v[2]),6), c::BIGINT, true FROM m"""))
def smote_oversample(d: Domain):
    x = docs(d).filter("quality is not null").select("doc_id", (F.col("n_chars") / 1000).alias("x"), (F.col("n_words") / 200).alias("y"), "quality")
    return rounded(mo.smote_oversample(x, "doc_id", "x", "y", "quality"))


@query("smote_vectors", _smote_sql(
    "SELECT id, label AS c, v FROM evecs",
    """SELECT id AS vec_id, -1::BIGINT AS copy, NULL::BIGINT AS other, NULL::DOUBLE AS u, c::BIGINT AS label, false AS is_synthetic, round(v[1],6) AS first, round(list_sum(v),6) AS total FROM r UNION ALL
 SELECT id, copy, other, round(u,6), c::BIGINT, true, round(v[1]+u*(o[1]-v[1]),6), round(list_sum(v)+u*(list_sum(o)-list_sum(v)),6) FROM m"""))
def smote_vectors(d: Domain):
    """Classes of the embeddings levelled over all 64 columns."""
    s = neighbors.smote(emb(d), "vec_id", "x", "label")
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    return rounded(s.select("vec_id", "copy", "other", "u", "label", "is_synthetic", F.col("x")[0].alias("first"), total.alias("total")))


_COLS = ["bal", "n", "spent"]
VIEW_SQL["holed"] = """SELECT c_custkey AS id, CASE WHEN c_custkey%7<>0 THEN (bal-mb)/sb END AS bal, CASE WHEN c_custkey%11<>0 THEN (n-mn)/sn END AS n,
 CASE WHEN c_custkey%13>1 AND c_custkey%77<>0 THEN (spent-ms)/ss END AS spent FROM (SELECT *, avg(bal) OVER () AS mb, stddev_pop(bal) OVER () AS sb, avg(n) OVER () AS mn, stddev_pop(n) OVER () AS sn,
 avg(spent) OVER () AS ms, stddev_pop(spent) OVER () AS ss FROM (SELECT c_custkey, c_acctbal::DOUBLE AS bal, coalesce(n,0)::DOUBLE AS n, coalesce(s,0)::DOUBLE AS spent FROM customer
 LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(floor(o_totalprice)::BIGINT) AS s FROM orders GROUP BY 1) ON o_custkey=c_custkey))"""


def holed(d: Domain):
    """Standardised balance, orders and spending per customer, with cells missing at fixed positions."""
    o = d.table("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("o_totalprice").cast("bigint")).alias("spent"))
    c = d.table("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    c = c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("bal"), *[F.coalesce(x, F.lit(0)).cast("double").alias(x) for x in ("n", "spent")])
    c = spread.with_totals(c, *[f(x).alias(f"{p}{x}") for x in _COLS for p, f in (("m_", F.avg), ("s_", F.stddev_pop))])
    there = {"bal": F.col("id") % 7 != 0, "n": F.col("id") % 11 != 0, "spent": (F.col("id") % 13 > 1) & (F.col("id") % 77 != 0)}
    return c.select("id", *[F.when(there[x], (F.col(x) - F.col(f"m_{x}")) / F.col(f"s_{x}")).alias(x) for x in _COLS])


def _common(value: str) -> str:
    return "+".join(f"CASE WHEN a.{c} IS NOT NULL AND b.{c} IS NOT NULL THEN {value.format(c=c)} ELSE 0e0 END" for c in _COLS)


_NAN = f"sqrt(3e0/nullif({_common('1e0')},0e0))*sqrt({_common('(a.{c}-b.{c})*(a.{c}-b.{c})')})"
_FILL = " ".join(f"""LEFT JOIN (SELECT i, avg(x) AS x FROM (SELECT a.id AS i, b.{c} AS x, row_number() OVER (PARTITION BY a.id ORDER BY {_NAN}, b.id) AS rn FROM holed a JOIN holed b
 ON a.{c} IS NULL AND b.{c} IS NOT NULL WHERE {_NAN} IS NOT NULL) WHERE rn<=5 GROUP BY 1) k{c} ON h.id=k{c}.i""" for c in _COLS)


@query("impute_knn_columns", f"""SELECT h.id, {', '.join(f'round(coalesce(h.{c}, k{c}.x, g.{c}),6)+0e0 AS {c}' for c in _COLS)} FROM holed h {_FILL}, (SELECT {', '.join(f'avg({c}) AS {c}' for c in _COLS)} FROM holed) g""")
def impute_knn_columns(d: Domain):
    """All missing cells of three columns from the five nearest customers that have the column."""
    return rounded(neighbors.impute_columns(holed(d), "id", _COLS, 5))


@query("permutation_importance")
def permutation_importance(d: Domain):
    """Importance of two features for the isolation forest score of the enrolment records."""
    e = d.enrolment().select("record_id", "age_0_5", "age_5_17", "age_18_greater")
    cols = ["age_0_5", "age_5_17", "age_18_greater"]
    arr = F.array(*[F.col(c).cast("double") for c in cols])
    forest = spread.pin(mo.fit_isolation_forest(e.select("record_id", arr.alias("x")), "record_id", "x"))
    score = lambda t: mo.score_isolation_forest(t.withColumn("_x", arr), forest, "_x", "score").drop("_x")
    return rounded(mo.permutation_importance(e, "record_id", cols, score))
