"""Learned detectors, clusters and classifiers, fitted and applied on the cluster."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from rollcall.functions import shuffle, spread
from rollcall.operators import neighbors, scoring


def hashed_unit(*cols: Column | str) -> Column:
    """Uniform [0, 1) from a keyed hash: the same on every retry."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") / float(1 << 52)


# ---------------------------------------------------------------- isolation forest

def average_path(n: float) -> float:
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict[str, list]:
    """One tree as parallel lists; leaves carry the expected path length."""
    feat, cut, left, right, depth = [], [], [], [], []

    def node(rows: np.ndarray, level: int) -> int:
        me = len(feat)
        feat.append(-1), cut.append(0.0), left.append(-1), right.append(-1), depth.append(level + average_path(len(rows)))
        if level < limit and len(rows) > 1:
            lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
            usable = np.flatnonzero(hi > lo)
            if len(usable):
                f = int(rng.choice(usable))
                c = float(rng.uniform(lo[f], hi[f]))
                go = x[rows, f] < c
                if go.any() and not go.all():
                    feat[me], cut[me] = f, c
                    left[me], right[me] = node(rows[go], level + 1), node(rows[~go], level + 1)
        return me

    node(np.arange(len(x)), 0)
    return {"feat": feat, "cut": cut, "left": left, "right": right, "depth": depth}


TREE_SCHEMA = "tree int, feat array<int>, cut array<double>, `left` array<int>, `right` array<int>, depth array<double>, n int"


def fit_isolation_forest(df: DataFrame, key: str, features: str, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """One row per tree. Each tree sees an expected ``sample`` rows chosen by keyed hash."""
    n = df.agg(F.count(F.lit(1))).first()[0]
    rate = min(1.0, sample / max(1, n))
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: hashed_unit(F.col(key), t, F.lit(seed)) < rate)
    rows = df.select(F.explode(chosen).alias("tree"), F.col(features).alias("x"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = np.array(sorted(map(tuple, pdf["x"])), dtype=float)
        t = _grow(x, np.random.default_rng(seed * 100_003 + tree), max(1, math.ceil(math.log2(max(2, len(x))))))
        return pd.DataFrame([{"tree": tree, **t, "n": len(x)}])

    return rows.groupBy("tree").applyInPandas(grow, TREE_SCHEMA)


class Forest:
    """All trees in one set of arrays: right children follow left ones; leaves lead to themselves."""

    def __init__(self, rows: Sequence):
        feat, cut, left, depth, roots, self.levels = [], [], [], [], [], 0
        for r in rows:
            roots.append(len(feat))
            todo = [0]  # nodes of the tree in their new order
            for col in (feat, cut, left, depth):
                col.append(None)
            level = {0: 0}
            for at, old in enumerate(todo):
                here = roots[-1] + at
                feat[here], cut[here], left[here], depth[here] = r["feat"][old], r["cut"][old], here, r["depth"][old]
                if r["feat"][old] >= 0:
                    left[here] = len(feat)
                    for child in (r["left"][old], r["right"][old]):
                        level[child] = level[old] + 1
                        self.levels = max(self.levels, level[child])
                        todo.append(child)
                        for col in (feat, cut, left, depth):
                            col.append(None)
        self.feat, self.left, self.roots = (np.asarray(c, dtype=np.int64) for c in (feat, left, roots))
        self.cut, self.depth = (np.asarray(c, dtype=float) for c in (cut, depth))

    def paths(self, x: np.ndarray, step: int = 256) -> np.ndarray:
        """Sum of the path lengths per row; all trees go down one level at a time, for ``step`` rows."""
        total = np.zeros(len(x))
        feat = np.where(self.feat < 0, x.shape[1], self.feat)  # a leaf asks a column of -inf and stays
        for a in range(0, len(x), step):
            part = x[a:a + step]
            m = len(part)
            flat = np.concatenate([part.T.ravel(), np.full(m, -np.inf)])
            start, seat = feat * m, np.arange(m)
            at = np.repeat(self.roots[:, None], m, axis=1)
            for _ in range(self.levels):
                right = ~(flat.take(start.take(at) + seat) < self.cut.take(at))
                at = self.left.take(at)
                at += right
            for t in range(len(at)):
                total[a:a + step] += self.depth.take(at[t])
        return total


def score_isolation_forest(df: DataFrame, forest: DataFrame, features: str, out: str = "iforest") -> DataFrame:
    """2^(-mean path / c(n)) per row, in Arrow batches; the forest is bounded (trees x sample nodes)."""
    rows = forest.collect()
    c_n = average_path(float(np.mean([r["n"] for r in rows])))
    held = df.sparkSession.sparkContext.broadcast(Forest(rows))

    @F.pandas_udf(T.DoubleType())
    def score(col: pd.Series) -> pd.Series:
        x = np.stack(col.to_numpy()).astype(float, copy=False) if len(col) else np.zeros((0, 1))
        return pd.Series(np.power(2.0, -(held.value.paths(x) / len(held.value.roots)) / max(c_n, 1e-9)))

    return df.withColumn(out, score(F.col(features)))


def isolation_forest(df: DataFrame, key: str, features: str, trees: int = 100, sample: int = 256, contamination: float = 0.1,
                     seed: int = 42) -> DataFrame:
    """Score 0..1 (min-max, high = odd) and a label for the top ``contamination`` share."""
    forest = fit_isolation_forest(df, key, features, trees, sample, seed)
    s = spread.pin(score_isolation_forest(df, forest, features, "_raw"))
    s = spread.with_totals(s, F.min("_raw").alias("_lo"), F.max("_raw").alias("_hi"))
    s = s.withColumn("iforest", (F.col("_raw") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-10)).drop("_raw", "_lo", "_hi")
    q = spread.quantiles(s, ["iforest"], [1.0 - contamination])
    return spread.with_global(s, q).withColumn("is_anomaly", F.col("iforest") > F.col("iforest_q0")).drop("iforest_q0")


# ---------------------------------------------------------------- principal components

def _dot(a: Column, b: Sequence[float]) -> Column:
    return F.aggregate(F.zip_with(a, F.array(*[F.lit(float(v)) for v in b]), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def pca_project(df: DataFrame, features: str, k: int = 2, out: str = "pc") -> DataFrame:
    """Centred coordinates on the first k components; signs fixed so the largest loading is positive."""
    v = df.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    mean = v.select(Summarizer.mean(F.col("_v")).alias("m")).first()["m"].toArray()
    pc = model.pc.toArray()
    pc = pc * np.where(pc[np.abs(pc).argmax(axis=0), range(k)] < 0, -1.0, 1.0)
    centre = mean @ pc
    cols = [(_dot(F.col("_a"), pc[:, i]) - float(centre[i])) for i in range(k)]
    return v.withColumn("_a", F.col(features).cast("array<double>")).withColumn(out, F.array(*cols)).drop("_v", "_a")


def pca_recon_score(df: DataFrame, features: str, k: int = 8, threshold: float = 0.95) -> DataFrame:
    """Squared distance lost by projecting on k components, min-max scaled, flagged above p95.

    The components are orthonormal, so the loss is |x - mean|^2 - |coordinates|^2.
    """
    p = pca_project(df, features, k, "_pc")
    mean = df.select(Summarizer.mean(array_to_vector(F.col(features).cast("array<double>"))).alias("m")).first()["m"].toArray()
    dev = F.zip_with(F.col(features).cast("array<double>"), F.array(*[F.lit(float(v)) for v in mean]), lambda x, m: x - m)
    norm = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
    p = spread.pin(p.withColumn("recon_error", F.greatest(F.lit(0.0), norm(dev) - norm(F.col("_pc")))).drop("_pc"))
    p = spread.with_totals(p, F.min("recon_error").alias("_lo"), F.max("recon_error").alias("_hi"))
    p = p.withColumn("recon_score", (F.col("recon_error") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-10)).drop("_lo", "_hi")
    q = spread.quantiles(p, ["recon_error"], [threshold])
    return spread.with_global(p, q).withColumn("is_anomaly", F.col("recon_error") > F.col("recon_error_q0")).drop("recon_error_q0")


def feature_recon_error(df: DataFrame, features: str, k: int = 8) -> DataFrame:
    """Mean squared reconstruction error per feature, from variances and loadings."""
    v = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    pc = model.pc.toArray()
    s = v.select(Summarizer.metrics("variance", "count").summary(F.col("_v")).alias("s")).select("s.*").first()
    var = s["variance"].toArray() * (s["count"] - 1) / s["count"]
    lam = model.transform(v).select(Summarizer.variance(F.col("_p")).alias("l")).first()["l"].toArray() * (s["count"] - 1) / s["count"]
    mse = np.maximum(0.0, var - (pc ** 2) @ lam)
    return df.sparkSession.createDataFrame([(i, float(m), float(x)) for i, (m, x) in enumerate(zip(mse, var))], "feature int, recon_mse double, variance double")


# ---------------------------------------------------------------- density and clusters

def lof_score(df: DataFrame, key: str, x: str, y: str, k: int = 20, outlier: float = 1.5) -> DataFrame:
    """Local outlier factor over two columns; ``neighbors.lof`` takes any number."""
    return neighbors.lof(df, key, [x, y], k, outlier)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Connected components of (a, b) over the single-column table ``nodes`` (id): (id, comp = smallest id).

    Every round each node points to its smallest neighbour, pointers are
    followed once more, and the edges are rewritten to the pointed nodes; the
    graph shrinks by contraction until no edge is left.
    """
    left = spread.pin(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    lab = nodes.select("id", F.col("id").alias("comp"))
    while not left.isEmpty():
        near = left.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("p"))
        hop = near.select(F.col("a").alias("p"), F.col("p").alias("_pp"))
        to = spread.pin(near.join(hop, "p").select("a", F.col("_pp").alias("p")))
        lab = spread.pin(lab.join(to.withColumnRenamed("a", "comp"), "comp", "left").select("id", F.coalesce("p", "comp").alias("comp")))
        moved = left.join(to, "a").select(F.col("p").alias("_a"), "b").join(to.withColumnRenamed("a", "b"), "b").select(F.col("_a").alias("a"), F.col("p").alias("b"))
        left = spread.pin(moved.filter("a <> b").distinct())
    return lab


def dbscan_labels(df: DataFrame, key: str, x: str, y: str, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """DBSCAN over two columns: cluster (smallest key of its core points), noise -1, core flag.

    Cells of side eps/sqrt(2) hold only mutual neighbours, so a cell with enough
    points is all core without comparing any of them.  Only points of thin
    cells count their neighbours.  Cells, not points, are connected: first by
    comparing one point per small sub-square, and only the cell pairs still open
    compare the points of the sub-squares that could decide it.
    """
    side = eps / math.sqrt(2.0)
    p = df.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    p = spread.pin(p.withColumn("cx", F.floor(F.col("x") / side).cast("bigint")).withColumn("cy", F.floor(F.col("y") / side).cast("bigint")))
    site = p.groupBy("cx", "cy", "x", "y").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("first"))
    per_cell = site.groupBy("cx", "cy").agg(F.sum("m").alias("in_cell"))
    site = spread.pin(site.join(per_cell, ["cx", "cy"]))
    ring = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4])
    d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))

    def look(left: DataFrame, right: DataFrame, *cols: str) -> DataFrame:
        a = left.withColumn("_o", F.explode(ring)).withColumn("tx", F.col("cx") + F.col("_o.i")).withColumn("ty", F.col("cy") + F.col("_o.j")).drop("_o")
        b = right.select(F.col("cx").alias("tx"), F.col("cy").alias("ty"), F.col("x").alias("ox"), F.col("y").alias("oy"), *cols)
        return a.join(b, ["tx", "ty"])

    thin = site.filter(F.col("in_cell") < min_samples)
    counted = look(thin, site.withColumnRenamed("m", "om"), "om").filter(d2 <= eps * eps).groupBy("x", "y").agg(F.sum("om").alias("near"))
    core = site.filter(F.col("in_cell") >= min_samples).unionByName(
        thin.join(counted.filter(F.col("near") >= min_samples).drop("near"), ["x", "y"]).select(*site.columns))
    core = spread.pin(core.select("cx", "cy", "x", "y", "first"))

    small = side / 8.0
    sub = core.withColumn("sx", F.floor(F.col("x") / small).cast("bigint")).withColumn("sy", F.floor(F.col("y") / small).cast("bigint"))
    reps = sub.groupBy("cx", "cy", "sx", "sy").agg(F.min_by(F.struct("x", "y"), F.struct("x", "y")).alias("r")).select("cx", "cy", "sx", "sy", "r.x", "r.y")
    met = look(reps, reps.withColumnRenamed("sx", "osx").withColumnRenamed("sy", "osy"), "osx", "osy")
    met = met.filter((F.col("cx") < F.col("tx")) | ((F.col("cx") == F.col("tx")) & (F.col("cy") < F.col("ty"))))
    reach2 = (eps + 2.0 * small * math.sqrt(2.0)) ** 2
    met = spread.pin(met.withColumn("_d2", d2).filter(F.col("_d2") <= reach2).select("cx", "cy", "tx", "ty", "sx", "sy", "osx", "osy", "_d2"))
    pair = ["cx", "cy", "tx", "ty"]
    sure = met.filter(F.col("_d2") <= eps * eps).select(*pair).distinct()
    open_ = met.join(sure, pair, "left_anti").select(*pair, "sx", "sy", "osx", "osy")
    a = open_.join(sub.select("sx", "sy", "x", "y"), ["sx", "sy"])
    b = a.join(sub.select(F.col("sx").alias("osx"), F.col("sy").alias("osy"), F.col("x").alias("ox"), F.col("y").alias("oy")), ["osx", "osy"])
    joined = sure.unionByName(b.filter(d2 <= eps * eps).select(*pair).distinct())

    cells = spread.pin(core.groupBy("cx", "cy").agg(F.min("first").alias("id")))
    edge = joined.join(cells.select("cx", "cy", F.col("id").alias("a")), ["cx", "cy"]).join(
        cells.select(F.col("cx").alias("tx"), F.col("cy").alias("ty"), F.col("id").alias("b")), ["tx", "ty"])
    comp = components(edge.select("a", "b"), cells.select("id"))
    named = spread.pin(cells.join(comp, "id").select("cx", "cy", "comp"))
    core_lab = core.join(named, ["cx", "cy"])
    rest = site.join(core.select("x", "y").withColumn("_core", F.lit(True)), ["x", "y"], "left_anti")
    border = look(rest, core_lab, "comp").filter(d2 <= eps * eps).groupBy("x", "y").agg(F.min("comp").alias("comp"))
    lab = core_lab.select("x", "y", "comp", F.lit(True).alias("is_core")).unionByName(border.select("x", "y", "comp", F.lit(False).alias("is_core")))
    out = p.join(lab, ["x", "y"], "left")
    return out.select(F.col("id").alias(key), F.coalesce("comp", F.lit(-1)).alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core"))


def kmeans_clusters(df: DataFrame, features: Sequence[str], k: int | None = None, max_k: int = 10, seed: int = 42) -> DataFrame:
    """k-means on named columns; without k the best silhouette of 2..max_k is taken."""
    v = VectorAssembler(inputCols=list(features), outputCol="_v").transform(df)
    if k is None:
        v = spread.pin(v)
        ev = ClusteringEvaluator(featuresCol="_v", predictionCol="cluster")
        scores = {c: ev.evaluate(KMeans(k=c, seed=seed, featuresCol="_v", predictionCol="cluster").fit(v).transform(v)) for c in range(2, max_k + 1)}
        k = max(scores, key=scores.get)
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(v)
    return model.transform(v).drop("_v")


def cluster_risk(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """Quarter of the clusters with the highest mean is Critical, and so on; noise is Unknown."""
    mean = sum((F.col(c) for c in features), F.lit(0.0)) / float(len(features))
    g = df.filter(F.col(cluster) >= 0).groupBy(cluster).agg(F.avg(mean).alias("_m"), F.count(F.lit(1)).alias("size")).withColumn("_neg", -F.col("_m")).withColumn("_one", F.lit(1))
    r = spread.running(g, [], ["_neg", cluster], {"i": "_one"})
    share = F.col("i_before") / F.col("i_all")
    word = F.when(share < 0.25, "Critical").when(share < 0.5, "High").when(share < 0.75, "Medium").otherwise("Low")
    g = r.select(cluster, F.col("_m").alias("mean_level"), "size", word.alias("risk"))
    return spread.join_stats(df, g, [cluster]).withColumn("risk", F.coalesce("risk", F.lit("Unknown")))


def calinski_harabasz(df: DataFrame, features: str, label: str) -> DataFrame:
    """Between over within dispersion of labelled vectors."""
    long = df.select(label, F.posexplode(F.col(features).cast("array<double>")).alias("pos", "v"))
    cell = long.groupBy(label, "pos").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    allv = cell.groupBy("pos").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    j = cell.join(allv, "pos")
    g = j.agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), F.lit(2))).alias("between"), F.sum(F.col("n") * F.col("s")).alias("within"), F.countDistinct(label).alias("k"))
    n = df.agg(F.count(F.lit(1)).alias("n"))
    g = g.crossJoin(F.broadcast(n))
    return g.withColumn("calinski_harabasz", (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k"))))


# ---------------------------------------------------------------- classifiers

def split_rows(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test by keyed hash: reruns agree, and every class is cut by ``share`` up to chance."""
    u = hashed_unit(F.col(key), F.lit(seed))
    return df.filter(u < share), df.filter(u >= share)


def estimator(kind: str, seed: int = 42):
    """logistic, forest or boosted, with class weights in ``weight``."""
    common = {"featuresCol": "_x", "labelCol": "label", "weightCol": "weight"}
    if kind == "logistic":
        return LogisticRegression(maxIter=50, **common)
    if kind == "forest":
        return RandomForestClassifier(numTrees=20, maxDepth=6, seed=seed, **common)
    if kind == "boosted":
        return GBTClassifier(maxIter=10, maxDepth=4, seed=seed, **common)
    raise ValueError(kind)


def classifier(features: Sequence[str], kind: str = "logistic", seed: int = 42) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_raw"),
                            StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True), estimator(kind, seed)])


def prepare(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Missing features to 0, label as double, balanced class weights."""
    out = df.fillna(0, list(features)).withColumn("label", F.col(label).cast("double"))
    return scoring.balance_classes(out, "label")


def train_classifier(df: DataFrame, key: str, features: Sequence[str], label: str, kinds: Sequence[str] = ("logistic", "forest", "boosted")) -> DataFrame:
    """Fit on 80 %, measure on 20 %: one row per model kind."""
    data = spread.pin(prepare(df, features, label))
    train, test = split_rows(data, key)
    out = None
    for kind in kinds:
        pred = classifier(features, kind).fit(train).transform(test).withColumn("_score", vector_to_array("probability")[1])
        pred = spread.pin(pred.select("label", "prediction", "_score"))
        m = scoring.confusion_metrics(pred, "label", "prediction")
        auc = scoring.roc_pr_auc(scoring.roc_pr_points(pred, "label", "_score"))
        row = m.crossJoin(F.broadcast(auc)).withColumn("model", F.lit(kind))
        out = row if out is None else out.unionByName(row)
    return out


def tuning_settings() -> list[tuple[str, dict[str, float]]]:
    """Thirty settings: (kind, parameters) of logistic, forest and boosted models."""
    logistic = [{"regParam": 10.0 ** -e, "elasticNetParam": mix} for e in (4, 3, 2, 1, 0) for mix in (0.0, 0.5)]
    forest = [{"numTrees": n, "maxDepth": depth} for n in (20, 40) for depth in (3, 5, 7, 9, 11)]
    boosted = [{"maxIter": n, "maxDepth": depth, "stepSize": step} for n, step in ((10, 0.1), (20, 0.1)) for depth in (2, 3, 4, 5, 6)]
    return [*(("logistic", p) for p in logistic), *(("forest", p) for p in forest), *(("boosted", p) for p in boosted)]


def tune_classifier(df: DataFrame, key: str, features: Sequence[str], label: str, settings: Sequence[tuple[str, dict[str, float]]] | None = None,
                    folds: int = 5, rungs: Sequence[float] = (1 / 9, 1 / 3, 1.0), keep: int = 3, parallel: int = 4, seed: int = 42) -> DataFrame:
    """Successive halving over the settings: one row each with the last rung it reached and its ROC-AUC there.

    Every rung trains on a larger share of the rows, drawn by a keyed hash so that
    rungs are nested and reruns agree, and a ``keep``-th of the settings goes on.
    All rungs but the last measure on one fold; the last one trains on all rows
    and averages all folds.  The best setting of the last rung is flagged, ties
    go to the earlier setting.  Columns are standardised over all rows.
    """
    settings = list(tuning_settings() if settings is None else settings)
    data = prepare(df, features, label).withColumns({
        "_fold": F.floor(hashed_unit(F.col(key), F.lit(seed + 1)) * folds), "_draw": hashed_unit(F.col(key), F.lit(seed + 2))})
    raw = VectorAssembler(inputCols=list(features), outputCol="_raw").transform(data)
    scaled = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True).fit(raw).transform(raw)
    data = spread.pin(scaled.select("_x", "label", "weight", "_fold", "_draw"))
    measure = BinaryClassificationEvaluator(labelCol="label")

    def fold_auc(setting: int, share: float, fold: int) -> float:
        kind, params = settings[setting]
        model = estimator(kind, seed)
        model = model.copy({model.getParam(n): v for n, v in params.items()})
        train = data.filter((F.col("_fold") != fold) & (F.col("_draw") < share))
        return measure.evaluate(model.fit(train).transform(data.filter(F.col("_fold") == fold)))

    alive, reached = list(range(len(settings))), {}
    with ThreadPoolExecutor(parallel) as pool:
        for rung, share in enumerate(rungs):
            used = range(folds) if rung == len(rungs) - 1 else range(1)
            jobs = {(s, f): pool.submit(inheritable_thread_target(df.sparkSession)(fold_auc), s, share, f) for s in alive for f in used}
            auc = {s: sum(jobs[s, f].result() for f in used) / len(used) for s in alive}
            reached.update({s: (rung + 1, auc[s]) for s in alive})
            alive = sorted(alive, key=lambda s: (-auc[s], s))
            if rung < len(rungs) - 1:
                alive = alive[:-(-len(alive) // keep)]
    best = alive[0]
    rows = [(k, ", ".join(f"{n}={v:g}" for n, v in p.items()), reached[s][0], float(rungs[reached[s][0] - 1]), float(reached[s][1]), s == best)
            for s, (k, p) in enumerate(settings)]
    return df.sparkSession.createDataFrame(rows, "model string, setting string, rung int, train_share double, roc_auc double, is_best boolean")


def cv_compare(df: DataFrame, key: str, features: Sequence[str], label: str, kinds: Sequence[str] = ("logistic", "forest", "boosted"), folds: int = 5, seed: int = 42) -> DataFrame:
    """Accuracy per fold by keyed hash, averaged per model kind, best flagged."""
    data = spread.pin(prepare(df, features, label).withColumn("_fold", F.floor(hashed_unit(F.col(key), F.lit(seed + 1)) * folds)))
    ev = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    means = {}
    for kind in kinds:
        acc = [ev.evaluate(classifier(features, kind, seed).fit(data.filter(F.col("_fold") != f)).transform(data.filter(F.col("_fold") == f))) for f in range(folds)]
        means[kind] = sum(acc) / folds
    best = max(means.values())
    return df.sparkSession.createDataFrame([(k, float(v), bool(v == best)) for k, v in means.items()], "model string, accuracy double, is_best boolean")


def batch_predict(train: DataFrame, rows: DataFrame, key: str, features: Sequence[str], label: str, kind: str = "logistic") -> DataFrame:
    """Probability and label for every row, riskiest first."""
    model = classifier(features, kind).fit(prepare(train, features, label))
    p = model.transform(rows.fillna(0, list(features)).withColumn("weight", F.lit(1.0)))
    prob = vector_to_array("probability")[1]
    return p.select(key, prob.alias("probability"), F.col("prediction").cast("int").alias("predicted")).orderBy(F.desc("probability"), key)


def smote_oversample(df: DataFrame, key: str, x: str, y: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic rows of two columns until classes are level; ``neighbors.smote`` takes any number and tells where they come from."""
    return neighbors.smote(df, key, [x, y], label, k, seed).select(x, y, label, "is_synthetic")


def permutation_importance(df: DataFrame, key: str, features: Sequence[str], score: Callable[[DataFrame], DataFrame], seed: int = 42) -> DataFrame:
    """Mean |change of score| after dealing one feature's values out anew, over the largest.

    ``score`` adds a ``score`` column.  Rows are numbered once; for each feature
    a keyed bijection on the numbers says whose value a row gets, so a feature
    is shuffled by one join.
    """
    seats = shuffle.numbered(df.select(key, *features), key, "_seat")  # before scoring: range partitions read their input twice
    base = spread.pin(score(seats).select(key, F.col("score").alias("_base"), *features, "_seat"))
    rows, out = base.count(), None
    for c in features:
        given = base.select(F.col("_seat").alias("_from"), F.col(c).alias("_given"))
        place = base.withColumn("_from", shuffle.shuffled(F.col("_seat"), rows, F.lit(seed), F.lit(c)))
        moved = score(place.join(given, "_from").drop("_from", "_seat", c).withColumnRenamed("_given", c))
        one = moved.agg(F.avg(F.abs(F.col("score") - F.col("_base"))).alias("change")).withColumn("feature", F.lit(c))
        out = one if out is None else out.unionByName(one)
    out = spread.with_totals(spread.pin(out), F.max("change").alias("_m"))
    return out.select("feature", "change", (F.col("change") / F.nullif("_m", F.lit(0.0))).alias("importance"))
