"""Neighbours, spatial statistics, grids.

Weights are always an edge table (i, j, w).  Point joins run on grid cells, so
only nearby points meet; nothing is joined with everything.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rollcall.functions import shuffle, spread
from rollcall.functions.scalar import classify_z, log_scale, normal_cdf, two_sided_p, z_color
from rollcall.operators import gauss, pivots, quadtree
from rollcall.operators.clean import scale_minmax
from rollcall.operators.ordering import rank_smooth


# ---------------------------------------------------------------- neighbours

def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size))).cast("bigint")


def _around(size: float, x: Column, y: Column) -> Column:
    """The 3 x 3 block of cells around a point."""
    step = [-1, 0, 1]
    return F.array(*[F.struct((_cell(x, size) + dx).alias("cx"), (_cell(y, size) + dy).alias("cy")) for dx in step for dy in step])


def near_pairs(left: DataFrame, right: DataFrame, lx: str, ly: str, rx: str, ry: str, size: float) -> DataFrame:
    """Pairs that share a 3 x 3 block of cells of ``size``; holds every pair closer than ``size``.

    Column names of the two sides must differ.
    """
    a = left.withColumn("_cell", F.explode(_around(size, F.col(lx), F.col(ly))))
    b = right.withColumn("_cell", F.struct(_cell(F.col(rx), size).alias("cx"), _cell(F.col(ry), size).alias("cy")))
    b = b.withColumnRenamed("_cell", "_rcell")
    return a.join(b, F.col("_cell") == F.col("_rcell")).drop("_cell", "_rcell")


def distance(ax: str, ay: str, bx: str, by: str) -> Column:
    dx, dy = F.col(ax) - F.col(bx), F.col(ay) - F.col(by)
    return F.sqrt(dx * dx + dy * dy)


def _as(df: DataFrame, key: str, x: str, y: str, tag: str, *more: str) -> DataFrame:
    return df.select(F.col(key).alias(tag), F.col(x).cast("double").alias(f"{tag}x"), F.col(y).cast("double").alias(f"{tag}y"),
                     *[F.col(m).alias(f"{tag}_{m}") for m in more])


def knn_neighbors(df: DataFrame, key: str, x: str, y: str, k: int = 5, donors: DataFrame | None = None) -> DataFrame:
    """Edges (i, j, rank, d, w) to the k nearest points (of ``donors`` if given), ties by key, w = 1/number of edges: ``pivots.knn_join`` of two columns."""
    return pivots.knn_join(df, key, [x, y], k, donors)


def _standardize(edges: DataFrame) -> DataFrame:
    deg = edges.groupBy("i").agg(F.count(F.lit(1)).alias("_n"))
    return edges.join(deg, "i").withColumn("w", 1.0 / F.col("_n")).drop("_n")


def first_point_threshold(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """One row: median distance of all points to the first point by key."""
    first = df.agg(F.min_by(F.struct(F.col(x).alias("x"), F.col(y).alias("y")), key).alias("_f"))
    d = spread.with_global(df, first).withColumn("d", F.sqrt(F.pow(F.col(x) - F.col("_f.x"), F.lit(2)) + F.pow(F.col(y) - F.col("_f.y"), F.lit(2))))
    return spread.quantiles(d, ["d"], [0.5]).select(F.col("d_q0").alias("threshold"))


def distance_band_neighbors(df: DataFrame, key: str, x: str, y: str, threshold: float | None = None) -> DataFrame:
    """Region pairs closer than ``threshold`` (the median distance to the first point where none is given), row-standardised."""
    if threshold is None:
        threshold = first_point_threshold(df, key, x, y).first()["threshold"] or 0.0
    pairs = quadtree.near_pairs(_points(df, key, x, y), threshold, distance("ix", "iy", "jx", "jy") < threshold)
    return _standardize(pairs.select("i", "j", distance("ix", "iy", "jx", "jy").alias("d")))


def queen_neighbors(df: DataFrame, key: str, x: str, y: str, offset: float) -> DataFrame:
    """Regions whose boxes of +-offset touch or overlap, row-standardised."""
    touch = (F.abs(F.col("ix") - F.col("jx")) <= 2 * offset) & (F.abs(F.col("iy") - F.col("jy")) <= 2 * offset)
    return _standardize(quadtree.near_pairs(_points(df, key, x, y), 2 * offset, touch).select("i", "j"))


def _points(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


def same_group_neighbors(df: DataFrame, group: str, value: str) -> DataFrame:
    """Row-standardised neighbours in the same group, given by their sums instead of pairs.

    Adds the number of neighbours, their weight 1/(n-1) and the mean of the
    others, which is all the statistics below need.
    """
    out = spread.with_group(df, [group], F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    others = F.nullif(F.col("_n") - 1, F.lit(0))
    return (out.withColumn("neighbors", F.col("_n") - 1).withColumn("weight", 1.0 / others)
               .withColumn("neighbor_mean", (F.col("_s") - F.col(value)) / others).drop("_n", "_s"))


def grid_cross_points(cells: DataFrame, points: DataFrame, max_distance: float, value: str) -> DataFrame:
    """Grid cells (cell, lat, lon) with every point closer than ``max_distance``.

    The grid is broadcast once its size is checked, so the points are never
    shuffled and a crowded area stays spread over their own partitions.
    """
    a = cells.select("cell", F.col("lat").alias("glat"), F.col("lon").alias("glon"))
    a = a.withColumn("_cell", F.explode(_around(max_distance, F.col("glat"), F.col("glon"))))
    p = points.select(F.col("lat").alias("plat"), F.col("lon").alias("plon"), F.col(value).cast("double").alias("v"))
    p = p.withColumn("_pcell", F.struct(_cell(F.col("plat"), max_distance).alias("cx"), _cell(F.col("plon"), max_distance).alias("cy")))
    pairs = p.join(spread.small(a), F.col("_pcell") == F.col("_cell")).drop("_pcell", "_cell").withColumn("d", distance("glat", "glon", "plat", "plon"))
    return pairs.filter(F.col("d") < max_distance)


# ---------------------------------------------------------------- intensity, z

def intensity(df: DataFrame) -> DataFrame:
    x = (F.col("current") - F.col("previous")) / F.greatest(F.col("population"), F.lit(1))
    return df.withColumn("intensity", x).withColumn("intensity_per_100k", x * 100000.0)


def intensity_scaled(df: DataFrame, key: str) -> DataFrame:
    """Intensity smoothed by rank, winsorised when any IQR outlier exists, logged, min-max scaled."""
    raw = spread.pin(intensity(df).select(key, "intensity"))
    s = spread.pin(rank_smooth(raw, key, "intensity"))
    q = spread.quantiles(s, ["smoothed"], [0.25, 0.75, 0.05, 0.95])
    s = spread.with_global(s, q)
    iqr = F.col("smoothed_q1") - F.col("smoothed_q0")
    out_of = (F.col("smoothed") < F.col("smoothed_q0") - iqr * 1.5) | (F.col("smoothed") > F.col("smoothed_q1") + iqr * 1.5)
    s = spread.with_totals(s, F.max(out_of).alias("_any"))
    clipped = F.when(F.col("_any"), F.greatest(F.least(F.col("smoothed"), F.col("smoothed_q3")), F.col("smoothed_q2"))).otherwise(F.col("smoothed"))
    logged = s.select(key, "intensity", "smoothed", log_scale(clipped).alias("logged"))
    return scale_minmax(logged, ["logged"], constant=0.5).withColumnRenamed("logged_scaled", "scaled_intensity")


def with_z(df: DataFrame, value: str, eps: float = 0.0) -> DataFrame:
    out = spread.with_totals(df, F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    sd = F.col("_s") + eps if eps else F.nullif("_s", F.lit(0.0))
    return out.withColumn("z", F.coalesce((F.col(value) - F.col("_m")) / sd, F.lit(0.0))).drop("_m", "_s")


def zscore_regions(df: DataFrame, value: str) -> DataFrame:
    out = with_z(df, value)
    return (out.withColumn("p_value", two_sided_p(F.col("z"))).withColumn("classification", classify_z(F.col("z"), "c"))
               .withColumn("color", z_color(F.col("z"))))


def anomaly_regions(df: DataFrame, value: str, threshold: float = 1.96) -> DataFrame:
    out = with_z(df, value).withColumn("is_anomaly", F.abs("z") > threshold)
    kind = F.when(F.col("z") > threshold, "high").when(F.col("z") < -threshold, "low").otherwise("normal")
    return out.withColumn("anomaly_type", kind).orderBy(F.desc(F.abs("z")))


# ---------------------------------------------------------------- autocorrelation

def _centered(values: DataFrame, key: str, value: str) -> DataFrame:
    v = values.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_x"))
    v = spread.with_totals(v, F.avg("_x").alias("_mean"))
    return v.select("_k", (F.col("_x") - F.col("_mean")).alias("_z"))


def _moran_result(parts: DataFrame, variance_mode: str) -> DataFrame:
    """parts: n, sw, num, den, s1, s2 -> statistics. NULL when no weight is present."""
    n, sw = F.col("n").cast("double"), F.nullif("sw", F.lit(0.0))
    i = n / sw * F.col("num") / F.nullif("den", F.lit(0.0))
    e = -1.0 / (n - 1.0)
    if variance_mode == "fixed":
        var = F.lit(0.1)
    else:
        var = (n * n * F.col("s1") - n * F.col("s2") + 3.0 * sw * sw) / ((n * n - 1.0) * sw * sw) - e * e
    out = parts.select("n", i.alias("morans_i"), e.alias("expected"), var.alias("variance"))
    out = out.withColumn("z", (F.col("morans_i") - F.col("expected")) / F.sqrt("variance")).withColumn("p_value", two_sided_p(F.col("z")))
    wording = (F.when(F.col("p_value") > 0.05, "random").when(F.col("morans_i") > F.col("expected"), "clustered").otherwise("dispersed"))
    return out.withColumn("interpretation", wording)


def moran_i(values: DataFrame, key: str, value: str, edges: DataFrame, variance_mode: str = "normal") -> DataFrame:
    """Global Moran's I from an edge table, with the analytic normality variance."""
    z = spread.pin(_centered(values, key, value))
    zi, zj = z.select(F.col("_k").alias("i"), F.col("_z").alias("zi")), z.select(F.col("_k").alias("j"), F.col("_z").alias("zj"))
    cross = edges.select("i", "j", "w").join(zi, "i").join(zj, "j")
    num = cross.agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("num"), F.sum("w").alias("sw"))
    sym = edges.select("i", "j", "w").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    s1 = sym.groupBy("i", "j").agg(F.sum("w").alias("w")).agg((F.sum(F.col("w") * F.col("w")) / 2.0).alias("s1"))
    s2 = sym.groupBy("i").agg(F.sum("w").alias("w")).agg(F.sum(F.col("w") * F.col("w")).alias("s2"))
    base = z.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_z") * F.col("_z")).alias("den"))
    parts = base
    for one in (num, s1, s2):
        parts = parts.crossJoin(F.broadcast(one))
    return _moran_result(parts, variance_mode)


def moran_i_groups(values: DataFrame, group: str, value: str, variance_mode: str = "normal") -> DataFrame:
    """Moran's I with row-standardised same-group weights, from group sums (no pairs)."""
    v = values.select(F.col(group).alias("g"), F.col(value).cast("double").alias("x"))
    v = spread.with_totals(v, F.avg("x").alias("_m")).select("g", (F.col("x") - F.col("_m")).alias("z"))
    g = v.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("q"))
    pos, m = F.col("m") > 1, F.col("m").cast("double")
    pair = F.when(pos, (F.col("s") * F.col("s") - F.col("q")) / (m - 1.0)).otherwise(0.0)
    parts = g.agg(F.sum("m").alias("n"), F.sum(F.when(pos, m).otherwise(0.0)).alias("sw"), F.sum(pair).alias("num"), F.sum("q").alias("den"),
                  F.sum(F.when(pos, 2.0 * m / (m - 1.0)).otherwise(0.0)).alias("s1"), F.sum(F.when(pos, 4.0 * m).otherwise(0.0)).alias("s2"))
    return _moran_result(parts, variance_mode)


def _gi_result(local: DataFrame, stats: DataFrame) -> DataFrame:
    out = spread.with_global(local, stats)
    n = F.col("_n").cast("double")
    den = F.col("_s") * F.sqrt((n * F.col("w2") - F.col("w1") * F.col("w1")) / (n - 1.0))
    z = (F.col("wx") - F.col("_m") * F.col("w1")) / F.nullif(den, F.lit(0.0))
    out = out.withColumn("gi_z", z).withColumn("p_value", two_sided_p(F.col("gi_z")))
    return out.withColumn("classification", classify_z(F.col("gi_z"), "e", F.col("p_value"))).drop("_n", "_m", "_s", "w1", "w2", "wx")


def _gi_stats(values: DataFrame, value: str) -> DataFrame:
    return values.agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))


def gi_star(values: DataFrame, key: str, value: str, edges: DataFrame) -> DataFrame:
    """Getis-Ord Gi* with self weight 1."""
    own = values.select(F.col(key).alias("i"), F.col(key).alias("j"), F.lit(1.0).alias("w"))
    all_edges = edges.select("i", "j", "w").unionByName(own)
    x = values.select(F.col(key).alias("j"), F.col(value).cast("double").alias("_x"))
    local = all_edges.join(x, "j").groupBy("i").agg(F.sum(F.col("w") * F.col("_x")).alias("wx"), F.sum("w").alias("w1"),
                                                    F.sum(F.col("w") * F.col("w")).alias("w2"))
    return _gi_result(local, _gi_stats(values, value)).withColumnRenamed("i", key)


def gi_star_groups(values: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """Gi* with row-standardised same-group weights plus self weight 1, from group sums."""
    near = same_group_neighbors(values.select(key, group, value), group, value)
    has = F.col("neighbors") > 0
    local = near.select(key, group, F.col(value), (F.col(value) + F.coalesce("neighbor_mean", F.lit(0.0))).alias("wx"),
                        F.when(has, 2.0).otherwise(1.0).alias("w1"), F.when(has, 1.0 + F.col("weight")).otherwise(1.0).alias("w2"))
    return _gi_result(local, _gi_stats(values, value))


def _shuffled(values: DataFrame, key: str, value: str, permutations: int, seed: int) -> DataFrame:
    """(p, key, x): the region values dealt out anew per permutation; p = 0 is the original.

    Regions are numbered once; each permutation is a keyed bijection on the
    numbers, so dealing is one join on the number.
    """
    v = spread.pin(shuffle.numbered(values.select(F.col(key).alias("k"), F.col(value).cast("double").alias("x")), "k"))
    n = v.count()
    reps = v.select("k", "seat", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("p"))
    place = reps.select("p", "k", shuffle.shuffled(F.col("seat"), n, F.lit(seed), F.col("p")).alias("seat"))
    dealt = place.join(v.select("seat", "x"), "seat").select("p", "k", "x")
    return dealt.unionByName(v.select(F.lit(0).alias("p"), "k", "x"))


def moran_permutation(values: DataFrame, key: str, value: str, edges: DataFrame, permutations: int = 999, seed: int = 42) -> DataFrame:
    """Pseudo p-value and z of Moran's I; permutes region rows only."""
    centered = _centered(values, key, value)
    deal = spread.pin(_shuffled(centered, "_k", "_z", permutations, seed))
    e = edges.select("i", "j", "w")
    lag = e.join(deal.select("p", F.col("k").alias("j"), F.col("x").alias("xj")), "j").join(
        deal.select("p", F.col("k").alias("i"), F.col("x").alias("xi")), ["p", "i"])
    sims = lag.groupBy("p").agg(F.sum(F.col("w") * F.col("xi") * F.col("xj")).alias("num"), F.sum("w").alias("sw"))
    den = centered.agg(F.sum(F.col("_z") * F.col("_z")).alias("den"), F.count(F.lit(1)).alias("n"))
    sims = spread.with_global(sims, den).select("p", (F.col("n") / F.col("sw") * F.col("num") / F.col("den")).alias("s"))
    sims = spread.pin(sims)
    real = sims.filter("p = 0").select(F.col("s").alias("morans_i"))
    both = spread.with_global(sims.filter("p > 0"), real)
    r = both.groupBy("morans_i").agg(F.count_if(F.col("s") >= F.col("morans_i")).alias("_ge"), F.avg("s").alias("_m"), F.stddev_pop("s").alias("_sd"),
                                     F.count(F.lit(1)).alias("permutations"))
    extreme = F.least(F.col("_ge"), F.col("permutations") - F.col("_ge"))
    return r.select("morans_i", "permutations", ((extreme + 1) / (F.col("permutations") + 1)).alias("p_sim"),
                    ((F.col("morans_i") - F.col("_m")) / F.col("_sd")).alias("z_sim"))


def gi_star_permutation(values: DataFrame, key: str, value: str, edges: DataFrame, permutations: int = 999, seed: int = 42) -> DataFrame:
    """Pseudo p-values of row-standardised Gi* per region."""
    own = values.select(F.col(key).alias("i"), F.col(key).alias("j"))
    full = _standardize(edges.select("i", "j").unionByName(own))
    deal = _shuffled(values, key, value, permutations, seed)
    lag = full.join(deal.select("p", F.col("k").alias("j"), "x"), "j").groupBy("p", "i").agg(F.sum(F.col("w") * F.col("x")).alias("s"))
    lag = spread.pin(lag)
    real = lag.filter("p = 0").select("i", F.col("s").alias("gi"))
    r = lag.filter("p > 0").join(real, "i").groupBy("i", "gi").agg(
        F.count_if(F.col("s") >= F.col("gi")).alias("_ge"), F.avg("s").alias("_m"), F.stddev_pop("s").alias("_sd"), F.count(F.lit(1)).alias("_p"))
    return r.select(F.col("i").alias(key), "gi", ((F.least(F.col("_ge"), F.col("_p") - F.col("_ge")) + 1) / (F.col("_p") + 1)).alias("p_sim"),
                    ((F.col("gi") - F.col("_m")) / F.nullif("_sd", F.lit(0.0))).alias("z_sim"))


def hotspots(gi: DataFrame, threshold: float = 1.96, cold: bool = False, z: str = "gi_z") -> DataFrame:
    if cold:
        return gi.filter(F.col(z) < -threshold).orderBy(z)
    return gi.filter(F.col(z) > threshold).orderBy(F.desc(z))


def spatial_summary(z: DataFrame, moran: DataFrame) -> DataFrame:
    s = z.agg(F.avg("z").alias("mean_z"), F.stddev_pop("z").alias("std_z"), F.count(F.lit(1)).alias("total_regions"),
              *[F.count_if(classify_z(F.col("z"), "a") == n).alias(a) for n, a in (("Hot Spot", "hotspots"), ("Cold Spot", "coldspots"), ("Anomaly", "anomalies"), ("In-Sync", "in_sync"))])
    out = s.crossJoin(F.broadcast(moran.select("morans_i", "p_value")))
    i = F.col("morans_i")
    word = (F.when(i > 0.3, "Strong Clustering").when(i > 0.1, "Moderate Clustering").when(F.abs(i) < 0.1, "Random").otherwise("Dispersed"))
    return out.withColumn("autocorrelation", word)


# ---------------------------------------------------------------- smoothing, grids

def gauss_smooth(df: DataFrame, key: str, value: str, sigma: float = 1.0, lat: str = "lat", lon: str = "lon", reach: float | None = None) -> DataFrame:
    """Kernel-weighted mean over all points, or over those within ``reach`` sigmas if it is given.

    Points are first folded to sites (equal positions) with their sum and
    count.  Without a ``reach`` all sites weigh, tile by tile (``gauss``), to
    1e-14 of the sum of all values; with one, only sites that near are paired.
    """
    sites = spread.pin(df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(F.col(lat).cast("double").alias("x"), F.col(lon).cast("double").alias("y")).agg(
        F.coalesce(F.sum(value), F.lit(0)).cast("double").alias("_s"), F.count(value).cast("double").alias("_c")))
    if reach is None:
        smooth = gauss.transform(sites, sigma, ["_s", "_c"]).select(F.col("x").alias("ix"), F.col("y").alias("iy"), (F.col("_s") / F.nullif("_c", F.lit(0.0))).alias("smoothed"))
    else:
        pairs = near_pairs(sites.select(F.col("x").alias("ix"), F.col("y").alias("iy")), sites.withColumnsRenamed({"x": "jx", "y": "jy"}), "ix", "iy", "jx", "jy", sigma * reach)
        pairs = pairs.withColumn("d", distance("ix", "iy", "jx", "jy")).filter(F.col("d") <= sigma * reach)
        w = F.exp(-F.col("d") * F.col("d") / (2.0 * sigma * sigma))
        smooth = pairs.groupBy("ix", "iy").agg((F.sum(w * F.col("_s")) / F.sum(w * F.col("_c"))).alias("smoothed"))
    return df.select(key, lat, lon).join(smooth, (F.col(lat) == F.col("ix")) & (F.col(lon) == F.col("iy")), "left").select(key, "smoothed")


def idw_points(cells: DataFrame, points: DataFrame, value: str, power: float = 2.0, max_distance: float = 5.0) -> DataFrame:
    """Inverse-distance value per cell: exact hit wins, no point in reach gives the global mean."""
    pairs = grid_cross_points(cells, points, max_distance, value)
    w = 1.0 / F.pow(F.nullif("d", F.lit(0.0)), F.lit(float(power)))
    g = pairs.groupBy("cell").agg(F.sum(w * F.col("v")).alias("_num"), F.sum(w).alias("_den"), F.min(F.when(F.col("d") == 0, F.col("v"))).alias("_hit"),
                                  F.count(F.lit(1)).alias("n_points"))
    out = spread.with_global(cells.join(g, "cell", "left"), points.agg(F.avg(value).alias("_mean")))
    v = F.coalesce("_hit", F.col("_num") / F.col("_den"), "_mean")
    return out.withColumn("value", v).fillna(0, ["n_points"]).drop("_num", "_den", "_hit", "_mean")


def lat_lon_grid(df_like: DataFrame, lat: tuple[float, float] = (6.5, 35.5), lon: tuple[float, float] = (68.0, 97.5), step: float = 2.0) -> DataFrame:
    """Cells (cell, lat, lon) of a regular grid."""
    ny, nx = int((lat[1] - lat[0]) // step) + 1, int((lon[1] - lon[0]) // step) + 1
    g = df_like.sparkSession.range(ny * nx).select(F.col("id").alias("cell"))
    return g.withColumn("lat", lat[0] + F.floor(F.col("cell") / nx) * step).withColumn("lon", lon[0] + F.col("cell") % nx * step)


def idw_grid(points: DataFrame, value: str, step: float = 2.0, power: float = 2.0, max_distance: float = 5.0) -> DataFrame:
    out = with_z(idw_points(lat_lon_grid(points, step=step), points, value, power, max_distance), "value", eps=1e-10)
    return out.withColumn("classification", classify_z(F.col("z"), "c"))


def hex_bin(df: DataFrame, lat: str, lon: str, size: float = 1.0) -> DataFrame:
    """Axial coordinates (q, r) of the pointy-top hexagon of a point, and its centre."""
    x, y = F.col(lon) / size, F.col(lat) / size
    q = x * (math.sqrt(3.0) / 3.0) - y / 3.0
    r = y * (2.0 / 3.0)
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    hq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    hr = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    out = df.withColumn("hex_q", hq.cast("bigint")).withColumn("hex_r", hr.cast("bigint"))
    return (out.withColumn("hex_lon", (F.col("hex_q") + F.col("hex_r") / 2.0) * (math.sqrt(3.0) * size))
               .withColumn("hex_lat", F.col("hex_r") * (1.5 * size)))


def box_polygon(lat: Column, lon: Column, offset: float) -> Column:
    """Closed ring of [lon, lat] corners."""
    corner = lambda dx, dy: F.array(lon + dx * offset, lat + dy * offset)
    return F.array(*[corner(dx, dy) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])


def hex_polygon(lat: Column, lon: Column, offset: float) -> Column:
    ring = [(math.cos(math.radians(60 * i)), math.sin(math.radians(60 * i))) for i in range(6)]
    return F.array(*[F.array(lon + c * offset, lat + s * offset) for c, s in [*ring, ring[0]]])


# ---------------------------------------------------------------- planning

def intervention_priority(df: DataFrame, key: str, coverage: float = 85.0) -> DataFrame:
    """Low coverage or coldspot first: (100 - coverage) + 10 |z| for coldspots, with urgency."""
    cold = F.coalesce(F.col("gi_z") < -1.96, F.lit(False))
    out = df.withColumn("is_coldspot", cold).filter((F.col("coverage") < coverage) | F.col("is_coldspot"))
    score = (100.0 - F.coalesce("coverage", F.lit(0.0))) + F.when(F.col("is_coldspot"), F.abs("gi_z") * 10.0).otherwise(0.0)
    out = out.withColumn("priority_score", score)
    urgency = F.when(F.col("priority_score") >= 30, "high").when(F.col("priority_score") >= 20, "medium").otherwise("low")
    return out.withColumn("urgency", urgency).orderBy(F.desc("priority_score"), key)


def scenario_coverage(df: DataFrame, increase_pct: float = 20.0, z_below: float = -1.96) -> DataFrame:
    """Coverage of the low-z regions before and after adding mobile units for six months."""
    units = int(increase_pct / 10)
    extra = units * 2000 * 6
    t = df.filter(F.col("z") < z_below).agg(
        F.count(F.lit(1)).alias("target_regions"), F.coalesce(F.sum("enrolments"), F.lit(0)).alias("current_enrolments"),
        (F.avg(F.col("enrolments") / F.col("population")) * 100.0).alias("current_coverage"), F.sum("population").alias("_p"))
    after = (F.col("current_enrolments") + extra) * 100.0 / F.col("_p")
    return (t.withColumn("mobile_units", F.lit(units).cast("bigint")).withColumn("additional_enrolments", F.lit(extra).cast("bigint"))
             .withColumn("projected_coverage", after).withColumn("coverage_increase", after - F.col("current_coverage")).drop("_p"))


# Action per five-step class.
INTERVENTIONS: Mapping[str, tuple[str, str]] = {
    "Cold Spot": ("CRITICAL", "Deploy Mobile Enrollment Units immediately"),
    "Declining": ("HIGH", "Increase awareness campaigns and CSC support"),
    "Significant Hotspot": ("MONITOR", "Study success factors for replication"),
}


def region_details(df: DataFrame, value: str, as_of: str, months: int = 6) -> DataFrame:
    """Velocity, coverage, class, intervention, and the projection at the end of the horizon."""
    z = zscore_regions(df, value)
    cur, pop = F.col("current"), F.greatest(F.col("population"), F.lit(1))
    ahead = F.date_add(F.to_date(F.lit(as_of)), 30 * months)
    growth = (1 + 0.008 * months) * (1.0 + F.sin(F.lit(2 * math.pi) * F.month(ahead) / 12.0) * 0.015) * (1.0 + F.col("z") * 0.002)
    cls = F.col("classification")
    pri = act = None
    for name, (p, a) in INTERVENTIONS.items():
        pri = F.when(cls == name, p) if pri is None else pri.when(cls == name, p)
        act = F.when(cls == name, a) if act is None else act.when(cls == name, a)
    return z.withColumns({
        "raw_change": cur - F.col("previous"), "per_100k": (cur - F.col("previous")) * 100000.0 / pop, "coverage_pct": cur * 100.0 / pop,
        "remaining": F.greatest(F.lit(0), F.col("population") - cur),
        "confidence": F.when(F.abs("z") > 2.58, "99%").when(F.abs("z") > 1.96, "95%").otherwise("N/A"),
        "priority": pri.otherwise("NORMAL"), "action": act.otherwise("Continue current operations"), "projected": cur * growth})


def neighbor_lag_adjust(forecasts: DataFrame, edges: DataFrame, key: str, period: str, value: str, pull: float = 0.3) -> DataFrame:
    """f + pull * (mean of the neighbours' f - f) per period; regions without neighbours keep f."""
    n = forecasts.select(F.col(key).alias("j"), period, F.col(value).alias("_fj"))
    mean = edges.select("i", "j").join(n, "j").groupBy(F.col("i").alias(key), period).agg(F.avg("_fj").alias("_nm"))
    out = forecasts.join(mean, [key, period], "left")
    return out.withColumn("adjusted", F.coalesce(F.col(value) + pull * (F.col("_nm") - F.col(value)), F.col(value).cast("double"))).drop("_nm")


def spatial_lag_rho(values: DataFrame, key: str, value: str, edges: DataFrame) -> DataFrame:
    """rho and R2 from regressing a region's value on the weighted mean of its neighbours."""
    x = values.select(F.col(key).alias("j"), F.col(value).cast("double").alias("_x"))
    lag = edges.join(x, "j").groupBy("i").agg((F.sum(F.col("w") * F.col("_x")) / F.sum("w")).alias("_lag"))
    own = lag.join(x.withColumnRenamed("j", "i"), "i")
    return own.agg(F.regr_slope("_x", "_lag").alias("rho"), F.regr_intercept("_x", "_lag").alias("intercept"), F.regr_r2("_x", "_lag").alias("r2"),
                   F.count(F.lit(1)).alias("n"))


def impute_knn(df: DataFrame, key: str, x: str, y: str, target: str, k: int = 5) -> DataFrame:
    """Missing ``target`` becomes the mean over the k nearest rows that have it, else the global mean."""
    donors = df.filter(F.col(target).isNotNull())
    edges = knn_neighbors(df.filter(F.col(target).isNull()), key, x, y, k, donors)
    near = edges.join(donors.select(F.col(key).alias("j"), F.col(target).alias("_t")), "j").groupBy("i").agg(F.avg("_t").alias("_near"))
    out = df.join(near, df[key] == near["i"], "left").drop("i")
    out = spread.with_global(out, df.agg(F.avg(target).alias("_mean")))
    return out.withColumn(target, F.coalesce(target, "_near", "_mean")).drop("_near", "_mean")
