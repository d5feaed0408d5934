"""Iterative and randomised operators against brute force or invariants."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from rollcall.operators import models, series, spatial


def points(n=260, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if i % 3 == 0:
            out.append((i, 1.0, 1.0))  # a third of all rows on one spot
        elif i % 3 == 1:
            out.append((i, 5 + rng.gauss(0, 0.05), 5 + rng.gauss(0, 0.05)))
        else:
            out.append((i, rng.uniform(0, 100), rng.uniform(0, 100)))
    return out


def test_knn_exact_on_clumped_points(spark):
    pts = points()
    df = spark.createDataFrame(pts, "id bigint, x double, y double")
    got: dict[int, list] = {}
    for r in spatial.knn_neighbors(df, "id", "x", "y", 4).orderBy("i", "rank").collect():
        got.setdefault(r["i"], []).append(r["j"])
    for i, x, y in pts:
        want = sorted(((math.sqrt((x - a) ** 2 + (y - b) ** 2), j) for j, a, b in pts if j != i))[:4]
        assert got[i] == [j for _, j in want]


def dbscan_brute(pts, eps, k):
    near = {i: [j for j, a, b in pts if (x - a) ** 2 + (y - b) ** 2 <= eps * eps] for i, x, y in pts}
    core = {i for i, js in near.items() if len(js) >= k}
    label: dict[int, int] = {}
    for start in sorted(core):
        if start in label:
            continue
        stack = [start]
        while stack:
            p = stack.pop()
            if p not in label:
                label[p] = start
                stack += [q for q in near[p] if q in core]
    out = {}
    for i, _, _ in pts:
        joined = [label[j] for j in near[i] if j in core]
        out[i] = label[i] if i in core else (min(joined) if joined else -1)
    return out


def test_dbscan_matches_brute_force(spark):
    rng = random.Random(11)
    pts = points(150) + [(1000 + i, 50 + i * 0.4, 50 + rng.uniform(-0.1, 0.1)) for i in range(60)]
    got = {r["id"]: r["cluster"] for r in models.dbscan_labels(spark.createDataFrame(pts, "id bigint, x double, y double"), "id", "x", "y", 0.9, 4).collect()}
    assert got == dbscan_brute(pts, 0.9, 4)


def test_components_of_a_chain(spark):
    ids = list(range(40))
    random.Random(2).shuffle(ids)
    e = spark.createDataFrame(list(zip(ids, ids[1:])), "a bigint, b bigint")
    lab = models.components(e, spark.range(42).withColumnRenamed("id", "id")).collect()
    assert {r["comp"] for r in lab if r["id"] < 40} == {0} and {r["comp"] for r in lab if r["id"] >= 40} == {40, 41}


def test_isolation_forest_ranks_planted_rows_first(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (300, 4)), rng.normal(6, 1, (15, 4))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>")
    rows = models.isolation_forest(df, "id", "x", trees=40, sample=64, contamination=0.05).collect()
    s = np.array([r["iforest"] for r in sorted(rows, key=lambda r: r["id"])])
    assert s.min() >= 0 and s.max() <= 1 and s[300:].mean() > s[:300].mean() + 0.2
    again = models.isolation_forest(df.repartition(3), "id", "x", trees=40, sample=64, contamination=0.05).collect()
    assert {r["id"]: round(r["iforest"], 9) for r in again} == {r["id"]: round(r["iforest"], 9) for r in rows}


def test_pca_reconstruction(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 5))
    base[7] += np.array([4, -4, 4, -4, 4.0])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(base)], "id bigint, x array<double>")
    top = models.pca_recon_score(df, "x", 2).orderBy(F.desc("recon_error")).first()
    assert top["id"] == 7 and top["is_anomaly"]
    total = models.pca_recon_score(df, "x", 2).agg(F.avg("recon_error")).first()[0]
    assert abs(sum(r["recon_mse"] for r in models.feature_recon_error(df, "x", 2).collect()) - total) < 1e-6


def months(spark, values, group="a"):
    rows = [(group, f"{2015 + i // 12}-{i % 12 + 1:02d}-01", float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "g string, m string, v double").withColumn("m", F.to_date("m"))


def test_holt_winters_matches_loop(spark):
    y = [100 + 2 * i + 10 * math.sin(i * math.pi / 6) for i in range(48)]
    level = sum(y[:12]) / 12
    slope = (sum(y[12:24]) / 12 - level) / 12
    season = [v - level for v in y[:12]]
    for i in range(12, 48):
        old = season[i % 12]
        new = 0.3 * (y[i] - old) + 0.7 * (level + slope)
        slope = 0.05 * (new - level) + 0.95 * slope
        season[i % 12] = 0.1 * (y[i] - new) + 0.9 * old
        level = new
    want = [level + slope * h + season[(48 + h - 1) % 12] for h in range(1, 7)]
    got = [r["predicted"] for r in series.holt_winters(months(spark, y), "g", "m", "v").orderBy("period").collect()]
    assert np.allclose(got, want)


def test_pacf_of_an_ar1(spark):
    rng = np.random.default_rng(4)
    y = [0.0]
    for _ in range(299):
        y.append(0.8 * y[-1] + rng.normal())
    got = {r["lag"]: r["pacf"] for r in series.pacf(months(spark, y), "g", "m", "v", 5).collect()}
    assert got[1] > 0.7 and all(abs(got[k]) < 0.2 for k in (2, 3, 4, 5))


def test_forecasts_follow_trend_and_season(spark):
    y = [1000 + 5 * i + 80 * math.sin(i * math.pi / 6) for i in range(72)]
    nxt = [1000 + 5 * i + 80 * math.sin(i * math.pi / 6) for i in range(72, 78)]
    got = series.sarima_forecast(months(spark, y), "g", "m", "v").orderBy("period").collect()
    assert np.allclose([r["predicted"] for r in got], nxt, rtol=0.05) and all(r["lower"] <= r["predicted"] <= r["upper"] for r in got)
    flat = series.arima_forecast(months(spark, [500 + (i % 3) for i in range(60)]), "g", "m", "v").collect()
    assert all(abs(r["predicted"] - 501) < 5 for r in flat)


def test_smote_levels_classes(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.random(), rng.random(), int(i % 5 == 0)) for i in range(100)], "id bigint, x double, y double, c int")
    counts = {r["c"]: r["count"] for r in models.smote_oversample(df, "id", "x", "y", "c").groupBy("c").count().collect()}
    assert counts == {0: 80, 1: 80}


def test_privacy_noise_repeats_and_stays_positive(spark):
    from rollcall.operators import clean
    df = spark.range(500).withColumn("n", F.lit(3).cast("bigint"))
    a = clean.privacy_noise(df, ["id"], ["n"], epsilon=0.5)
    first = {r["id"]: r["n"] for r in a.collect()}
    assert first == {r["id"]: r["n"] for r in clean.privacy_noise(df.repartition(7), ["id"], ["n"], epsilon=0.5).collect()}
    assert min(first.values()) >= 0 and len(set(first.values())) > 3


def test_moran_permutation_sees_clustering(spark):
    pts = [(i, float(i % 8), float(i // 8), 10.0 if i % 8 < 4 else 0.0) for i in range(64)]
    df = spark.createDataFrame(pts, "id bigint, x double, y double, v double")
    e = spatial.knn_neighbors(df, "id", "x", "y", 4)
    r = spatial.moran_permutation(df, "id", "v", e, 99).first()
    assert r["morans_i"] > 0.5 and r["p_sim"] <= 0.02 and r["z_sim"] > 3
    g = {x["id"]: x["z_sim"] for x in spatial.gi_star_permutation(df, "id", "v", e, 99).collect()}
    assert g[0] > 0 > g[7]


def test_halving_finds_the_model_that_can(spark):
    rows = [(i, float(i % 2) + (i % 97) / 500, float(i // 2 % 2) + (i % 89) / 500, int(i % 2 != i // 2 % 2)) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")  # neither column alone tells the classes apart
    some = [s for s in models.tuning_settings() if s[1].get("maxDepth", 3) == 3][:2] + [("logistic", {"regParam": r}) for r in (0.0, 0.01, 0.1, 1.0)]
    assert len(models.tuning_settings()) == 30
    out = models.tune_classifier(df, "id", ["a", "b"], "y", some + [("boosted", {"maxIter": 5, "maxDepth": 3, "stepSize": 0.1})] * 2, folds=3).collect()
    assert sorted(r["rung"] for r in out) == [1] * 5 + [2] * 2 + [3]
    best = [r for r in out if r["is_best"]]
    assert len(best) == 1 and best[0]["model"] != "logistic" and best[0]["roc_auc"] > 0.95 and best[0]["train_share"] == 1.0
    assert all(r["roc_auc"] < 0.7 for r in out if r["model"] == "logistic")


def test_forest_in_one_set_of_arrays_walks_like_its_trees():
    rng = np.random.default_rng(18)
    rows = [models._grow(np.round(rng.normal(size=(n, 3)), 1), np.random.default_rng(n), 7) for n in (1, 2, 60, 128)]
    x = rng.normal(size=(600, 3))
    x[0, 1], x[1, 0], x[2] = np.nan, np.inf, -np.inf

    def walk(tree, v):
        at = 0
        while tree["feat"][at] >= 0:
            at = tree["left" if v[tree["feat"][at]] < tree["cut"][at] else "right"][at]
        return tree["depth"][at]

    assert np.allclose(models.Forest(rows).paths(x), [sum(walk(t, v) for t in rows) for v in x], rtol=1e-12)


def test_permutation_importance_scores_each_row_once_per_feature(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(a, b):
        calls.add(1)
        return a * 3.0 + b

    df = spark.createDataFrame([(i, float(i), float(i % 5)) for i in range(200)], "id long, a double, b double")
    out = {r["feature"]: r["importance"] for r in models.permutation_importance(df, "id", ["a", "b"], lambda t: t.withColumn("score", seen("a", "b"))).collect()}
    assert out["a"] == 1.0 and out["b"] < 0.1 and calls.value == 600
