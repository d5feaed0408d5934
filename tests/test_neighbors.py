"""Neighbours and clusters in any number of dimensions against brute force, with one place that holds a large share of the rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.operators import density, gauss, neighbors, pivots, quadtree, spatial


def gap(a, b):
    return math.sqrt(sum((x - y) * (x - y) for x, y in zip(a, b)))


def crowd(n, d, seed):
    """A third of the rows at one place, a few pairs of equal rows, the rest spread."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 2)
    x[:n // 3] = x[0]
    x[n // 3:n // 3 + 8] = x[n // 3 + 8:n // 3 + 16]
    return x


def frame(spark, x, odd=()):
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(x)] + [(1000 + i, v, 0, "x") for i, v in enumerate(odd)]
    return spark.createDataFrame(rows, "id long, v array<double>, cell int, bid string").repartition(5)


@pytest.mark.parametrize("n,d,per", [(150, 1, 10), (150, 3, 12), (120, 40, 16)])
def test_knn_join_against_brute_force(spark, n, d, per):
    x = crowd(n, d, d)
    odd = [None, [None] * d, [float("nan")] * d, [float("inf")] * d]
    got = {}
    for r in pivots.knn_join(frame(spark, x, odd), "id", "v", 5, per_block=per).collect():
        got.setdefault(r["i"], []).append((r["rank"], r["j"], r["d"], r["w"]))
    assert sorted(got) == list(range(n))
    for i in range(n):
        want = sorted((gap(x[i], x[j]), j) for j in range(n) if j != i)[:5]
        own = sorted(got[i])
        assert [r[1] for r in own] == [j for _, j in want] and [r[0] for r in own] == [1, 2, 3, 4, 5] and {r[3] for r in own} == {0.2}
        assert np.allclose([r[2] for r in own], [g for g, _ in want])


def test_knn_join_with_donors_and_few_rows(spark):
    x, y = crowd(60, 2, 1), np.round(np.random.default_rng(2).normal(size=(4, 2)), 2)
    donors = spark.createDataFrame([(i * 10, v.tolist()) for i, v in enumerate(y)], "id long, v array<double>")
    got = {}
    for r in pivots.knn_join(frame(spark, x), "id", "v", 7, donors).collect():
        got.setdefault(r["i"], []).append((r["rank"], r["j"]))
    assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == {
        i: [j for _, j in sorted((gap(x[i], v), j * 10) for j, v in enumerate(y))] for i in range(60)}
    assert pivots.knn_join(frame(spark, x), "id", "v", 3, donors.limit(0)).count() == 0
    assert pivots.knn_join(frame(spark, x[:0]), "id", "v", 3).count() == 0
    with pytest.raises(ValueError):
        pivots.knn_join(frame(spark, x, [[1.0, 2.0, 3.0]]), "id", "v", 3)


def test_blocks_are_bounded_and_prune(spark):
    """Half of all rows in one small ball: many blocks of one cell, and far balls never meet."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(200, 3)) * 0.01, rng.normal(size=(200, 3)) * 0.01 + 50 * rng.integers(1, 9, size=(200, 1))])
    rows = pivots.points(frame(spark, x), "id", "v")
    pick = pivots.choose_pivots(rows, 400, 20)
    blocks = pivots.pack(rows, pick, 20)
    sizes = [r["n"] for r in blocks.collect()]
    assert max(sizes) <= 20 and sum(sizes) == 400
    cells = pivots.cells_of(blocks, pick, 6)
    assert pivots.meetings(blocks, blocks, cells, 6).count() < 0.75 * len(sizes) ** 2


def naive_dbscan(x, eps, least):
    n = len(x)
    near = [[j for j in range(n) if gap(x[i], x[j]) <= eps] for i in range(n)]
    core = [len(a) >= least for a in near]
    comp = [-1] * n
    for i in range(n):
        if core[i] and comp[i] < 0:
            comp[i], todo = i, [i]
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and comp[j] < 0:
                        comp[j] = i
                        todo.append(j)
    return {i: (comp[i] if core[i] else min((comp[j] for j in near[i] if core[j]), default=-1), core[i]) for i in range(n)}


@pytest.mark.parametrize("d,eps,per", [(2, 0.3, 12), (6, 1.4, 16)])
def test_dbscan_with_half_of_the_rows_in_one_ball(spark, d, eps, per):
    rng = np.random.default_rng(d)
    x = np.round(rng.normal(size=(200, d)), 2)
    x[:60] = x[0]
    x[60:110] = x[0] + rng.normal(size=(50, d)) * eps * 0.15
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in density.dbscan(frame(spark, x, [None]), "id", "v", eps, 5, per_block=per).collect()}
    assert got.pop(1000) == (-1, False)
    assert got == naive_dbscan(x.tolist(), eps, 5)


def test_a_dense_ball_becomes_few_clots(spark):
    x = np.random.default_rng(3).normal(size=(3000, 3)) * 0.01
    sites = pivots.sites_of(pivots.points(frame(spark, x), "id", "v"))
    pick = pivots.choose_pivots(sites, 3000, 50)
    members, found = density.clots(sites, pick, 50, 1.0)
    assert members.count() == 3000 and found.count() <= 150
    assert found.agg({"radius": "max"}).first()[0] <= 0.5


def test_lof_over_many_columns(spark):
    x = np.random.default_rng(6).normal(size=(80, 5))
    x[7] += 30
    got = {r["id"]: r["lof"] for r in neighbors.lof(frame(spark, x), "id", "v", 6).collect()}
    near = {i: sorted((gap(x[i], x[j]), j) for j in range(80) if j != i)[:6] for i in range(80)}
    density_ = {i: 1 / (sum(max(g, near[j][-1][0]) for g, j in near[i]) / 6 + 1e-10) for i in near}
    assert all(abs(got[i] - sum(density_[j] for _, j in near[i]) / 6 / density_[i]) < 1e-9 for i in near)
    assert max(got, key=got.get) == 7


def test_impute_columns_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = [[None if rng.random() < 0.25 else float(rng.integers(0, 6)) for _ in range(4)] for _ in range(90)]
    x[3] = [None] * 4
    df = spark.createDataFrame([(i, *v, "keep") for i, v in enumerate(x)], "id long, a double, b double, c double, d double, _m_a string").repartition(3)
    got = {r["id"]: [r[c] for c in "abcd"] for r in neighbors.impute_columns(df, "id", list("abcd"), 3).collect()}
    for i, v in enumerate(x):
        for c in range(4):
            want = v[c]
            if want is None:
                near = []
                for j, o in enumerate(x):
                    both = [k for k in range(4) if v[k] is not None and o[k] is not None]
                    if o[c] is not None and both:
                        near.append((math.sqrt(4 / len(both)) * math.sqrt(sum((v[k] - o[k]) ** 2 for k in both)), j, o[c]))
                have = [o[c] for o in x if o[c] is not None]
                want = sum(n[2] for n in sorted(near)[:3]) / 3 if near else sum(have) / len(have)
            assert abs(got[i][c] - want) < 1e-9, (i, c)


def test_smote_over_many_columns_and_classes(spark):
    rng = np.random.default_rng(9)
    label = [0] * 50 + [1] * 12 + [2] * 3 + [3] + [None] * 2
    x = rng.normal(size=(len(label), 6))
    df = spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(x, label))], "id long, v array<double>, c int")
    rows = neighbors.smote(df, "id", "v", "c", 4).collect()
    assert {c: sum(r["c"] == c for r in rows) for c in (0, 1, 2, 3, None)} == {0: 50, 1: 50, 2: 50, 3: 50, None: 2}
    for r in rows:
        if r["is_synthetic"]:
            own = [j for j, c in enumerate(label) if c == r["c"] and j != r["id"]]
            near = sorted((gap(x[r["id"]], x[j]), j) for j in own)[:4] or [(0, r["id"])]
            assert r["other"] in [j for _, j in near] and 0 < r["u"] < 1
            assert np.allclose(r["v"], x[r["id"]] + r["u"] * (x[r["other"]] - x[r["id"]]))
    again = neighbors.smote(df.repartition(7), "id", "v", "c", 4).collect()
    assert sorted((r["id"], r["copy"], r["other"] or 0) for r in rows) == sorted((r["id"], r["copy"], r["other"] or 0) for r in again)


@pytest.mark.parametrize("reach", [0.0, 0.05, 0.7, 40.0])
def test_quadtree_pairs_against_brute_force(spark, reach):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(60, 2)) * 0.02, np.zeros((40, 2)) + 0.5, rng.uniform(-9, 9, size=(60, 2)), [[300.0, -200.0]]])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(999, None, 1.0), (998, 1.0, float("nan"))], "id long, x double, y double")
    close = (F.abs(F.col("ix") - F.col("jx")) <= reach) & (F.abs(F.col("iy") - F.col("jy")) <= reach)
    got = sorted((r["i"], r["j"]) for r in quadtree.near_pairs(df, reach, close, most=8).collect())
    assert got == [(i, j) for i in range(len(x)) for j in range(len(x)) if i != j and max(abs(x[i] - x[j])) <= reach]
    assert quadtree.near_pairs(df.limit(0), reach, close).count() == 0


def test_quadtree_spreads_a_crowded_cell(spark):
    """Half of all points in one cell: leaves stay near their size and no task opens more than twice the pairs of the median one."""
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(1500, 2)) * 1e-3, np.ones((500, 2)), rng.uniform(-50, 50, size=(2000, 2))])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, x double, y double")
    tree = quadtree.leaves(df, 32)
    sizes = [len(r["rows"]) for r in tree.collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 64
    work = tree.select(F.col("leaf").alias("a"), F.size("rows").alias("n")), tree.select(F.col("leaf").alias("b"), F.size("rows").alias("m"))
    pairs = quadtree.leaf_pairs(tree, 0.5).join(work[0], "a").join(work[1], "b").repartition(16, "a", "b")
    tasks = sorted(r["w"] for r in pairs.groupBy(F.spark_partition_id()).agg(F.sum(F.col("n") * F.col("m")).alias("w")).collect())
    assert len(tasks) == 16 and tasks[-1] <= 2 * tasks[8]


@pytest.mark.parametrize("sigma", [0.3, 2.0])
def test_gaussian_sums_against_brute_force(spark, sigma):
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(size=(150, 2)) * 0.2, rng.uniform(-8, 8, size=(150, 2)), [[90.0, 90.0]]])
    q = rng.normal(size=len(x)) * 100
    df = spark.createDataFrame([(i, *map(float, v), float(w)) for i, (v, w) in enumerate(zip(x, q))] + [(998, *map(float, x[0]), 5.0), (999, None, 1.0, 2.0)],
                               "id long, lat double, lon double, v double").repartition(4)
    got = {r["id"]: r["smoothed"] for r in spatial.gauss_smooth(df, "id", "v", sigma).collect()}
    xs, qs = np.concatenate([x, x[:1]]), np.append(q, 5.0)
    w = np.exp(-((xs[:, None] - xs[None]) ** 2).sum(axis=-1) / (2 * sigma * sigma))
    want = (w @ qs) / w.sum(axis=1)
    assert got.pop(999) is None
    assert np.abs(np.array([got[i] for i in [*range(len(x)), 998]]) - want).max() < 1e-10
    assert spatial.gauss_smooth(df.limit(0), "id", "v", sigma).count() == 0


def test_gaussian_tile_holds_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(gauss, "BLOCK", 50)
    rng = np.random.default_rng(14)
    df = spark.createDataFrame([(float(a), float(b), float(a)) for a, b in rng.uniform(0.1, 0.9, size=(600, 2))], "x double, y double, q double")
    held = gauss.blocks(df, 1.0, ["q"])
    assert held.count() == 12 and max(len(r["rows"]) for r in held.collect()) <= 100


def test_blocks_travel_once_per_group_and_task(spark):
    """Every pair of blocks meets once, and a right block reaches a task once however many held blocks it meets."""
    import pandas as pd
    x = np.random.default_rng(15).normal(size=(400, 4))
    rows = pivots.points(frame(spark, x), "id", "v")
    pick = pivots.choose_pivots(rows, 400, 20)
    blocks = pivots.pack(rows, pick, 20)
    pairs = pivots.meetings(blocks, blocks, pivots.cells_of(blocks, pick, 6), 6)
    assert pairs.columns == ["bid", "sid"]  # nothing of the size of a block goes with a pair

    def work(held, met):
        for b, at in met:
            yield pd.DataFrame({"bid": [held[a]["bid"] for a in at], "sid": b["bid"], "held": min(c["bid"] for c in held.values())})

    seen = pivots.facing(pairs, blocks, blocks, work, "bid long, sid long, held long", group=8).collect()
    assert sorted((r["bid"], r["sid"]) for r in seen) == sorted(tuple(r) for r in pairs.collect())
    travels = {(r["sid"], r["held"]) for r in seen}
    assert len(travels) < len(seen) / 2 and len({r["held"] for r in seen}) > 1


def test_links_and_counts_stay_small_where_all_rows_are_near(spark):
    """A hundred thousand pairs within eps: a task writes the links of a tree, and counts end at the limit."""
    x = np.random.default_rng(16).normal(size=(320, 12)) * 0.1
    sites = pivots.sites_of(pivots.points(frame(spark, x), "id", "v"))
    pick = pivots.choose_pivots(sites, 320, 32)
    found = sites.select(F.col("id").alias("cid"), "v", F.lit(0.0).alias("radius"), F.col("m").alias("rows"), F.col("id").alias("x"))
    blocks = density.clot_blocks(found, pick, 32)
    pairs = pivots.meetings(blocks, blocks, pivots.cells_of(blocks, pick, 1), None, 5.0)
    links = [tuple(r) for r in density.sure_links(blocks, pairs, 5.0).collect()]
    whole = {i: i for i in range(320)}

    def root(i):
        while whole[i] != i:
            i = whole[i]
        return i

    for a, b in links:
        whole[root(a)] = root(b)
    assert len({root(i) for i in range(320)}) == 1 and len(links) < 320 * 40
    assert {r["known"] >= 5 for r in density.known_rows(blocks, pairs, 5.0, 5).collect()} == {True}


def test_two_columns_with_many_copies_against_brute_force(spark):
    x = np.round(np.random.default_rng(17).normal(size=(12, 2)), 1).repeat(15, axis=0)
    x[:4] = [[9.0, 9.0], [9.0, 9.1], [8.0, 9.0], [-9.0, 3.0]]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(900, None, 1.0)], "id long, x double, y double")
    got = {}
    for r in spatial.knn_neighbors(df, "id", "x", "y", 20).collect():
        got.setdefault(r["i"], []).append((r["rank"], r["j"]))
    assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == {
        i: [j for _, j in sorted((gap(x[i], x[j]), j) for j in range(len(x)) if j != i)[:20]] for i in range(len(x))}
