"""Pairs of near points on a plane, by an adaptive quadtree whose leaves are split by counts.

A square around all points is cut into quarters of quarters until no leaf holds
more than ``most`` points; what stands at one place is dealt into several parts
of a leaf.  Leaves, not points, are paired: two leaves can hold near points only
if the larger one's cell at a level not finer than the reach is one of the few
cells the other one's box touches when widened by the reach.  The pairs of
leaves are then spread evenly and opened, so a place with half of all points is
many tasks of one size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import spread

DEPTH = 26
MOST = 64


def leaves(points: DataFrame, most: int = MOST) -> DataFrame:
    """(leaf, level, ux, uy, x0, x1, y0, y1, rows) of points (id, x, y); ``rows`` lists at most about ``most`` of them.

    ``ux`` and ``uy`` count cells of the finest level; null coordinates are left out.
    """
    points = spread.pin(points.filter("x is not null and y is not null and not isnan(x) and not isnan(y)"))
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n")).first()
    side, low = _square(box)
    at = lambda c: F.least(F.floor((F.col(c) - low[c]) / side * (1 << DEPTH)), F.lit((1 << DEPTH) - 1)).cast("bigint")
    sites = spread.pin(points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("m")).withColumns({"ux": at("x"), "uy": at("y")}))
    level = min(DEPTH, max(0, int(math.log2(max(1.0, (box["n"] or 0) / most)) / 2)))
    done, todo = None, sites
    while True:
        cell = [F.shiftright(c, DEPTH - level).alias(f"c{c}") for c in ("ux", "uy")]
        keyed = todo.select("*", *cell)
        crowded = spread.small(keyed.groupBy("cux", "cuy").agg(F.sum("m").alias("n")).filter(F.col("n") > most).select("cux", "cuy"))
        last = level >= DEPTH
        split = spread.pin(keyed.join(crowded.withColumn("_deep", F.lit(True)), ["cux", "cuy"], "left"))
        here = split.filter(F.lit(last) | F.col("_deep").isNull()).select("x", "y", "m", "cux", "cuy", F.lit(level).alias("level"))
        done = here if done is None else done.unionByName(here)
        todo = split.filter(F.lit(not last) & F.col("_deep").isNotNull()).select("x", "y", "m", "ux", "uy")
        if last or todo.isEmpty():
            break
        level = min(DEPTH, level + 2)
    key = ["level", "cux", "cuy"]
    parts = done.groupBy(*key).agg(F.ceil(F.sum("m") / most).cast("int").alias("_parts"))
    placed = points.join(done.select("x", "y", *key), ["x", "y"]).join(parts, key)
    placed = placed.withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")))
    found = placed.groupBy(*key, "_part").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
                                              F.collect_list(F.struct("id", "x", "y")).alias("rows"))
    up = lambda c: F.expr(f"shiftleft(c{c}, {DEPTH} - level)").alias(c)
    return spread.pin(found.select(F.monotonically_increasing_id().alias("leaf"), "level", up("ux"), up("uy"), "x0", "x1", "y0", "y1", "rows"))


def _square(box) -> tuple[float, dict[str, float]]:
    low = {"x": box["x0"] or 0.0, "y": box["y0"] or 0.0}
    return max((box["x1"] or 0.0) - low["x"], (box["y1"] or 0.0) - low["y"], 1e-9), low


def leaf_pairs(tree: DataFrame, reach: float) -> DataFrame:
    """(a, b): ordered pairs of leaves whose boxes are within ``reach`` along both axes, a leaf with itself included."""
    box = tree.agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.max("level").alias("level")).first()
    side, low = _square(box)
    deepest = DEPTH if reach <= 0 else max(0, min(DEPTH, math.floor(math.log2(side / reach)) if reach < side else 0))
    meta = tree.select("leaf", "level", "ux", "uy", "x0", "x1", "y0", "y1").withColumn("top", F.least("level", F.lit(deepest)))
    tops = [r["top"] for r in meta.select("top").distinct().collect()]  # at most DEPTH + 1

    def cell(value: Column, axis: str, level: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.floor((value - low[axis]) / side * (1 << level)), F.lit((1 << level) - 1))).cast("bigint")

    # a little wider than the reach, so that rounding of a cell's edge loses nothing
    wide = reach * (1 + 1e-9) + side * 1e-12

    def touched(level: int) -> Column:
        span = {c: F.sequence(cell(F.col(f"{c}0") - wide, c, level), cell(F.col(f"{c}1") + wide, c, level)) for c in ("x", "y")}
        return F.flatten(F.transform(span["x"], lambda x: F.transform(span["y"], lambda y: F.struct(F.lit(level).alias("t"), x.alias("x"), y.alias("y")))))

    each = [F.when(F.col("top") >= t, touched(t)) for t in tops]
    reaching = meta.select("*", F.explode(F.flatten(F.array_compact(F.array(*each)))).alias("at")) if tops else meta.select("*", F.lit(None).alias("at"))
    reaching = reaching.select(F.col("leaf").alias("b"), F.col("top").alias("btop"), "at", *[F.col(c).alias(f"b{c}") for c in ("x0", "x1", "y0", "y1")])
    mine = lambda c: F.expr(f"shiftright({c}, {DEPTH} - top)")
    own = meta.select(F.col("leaf").alias("a"), F.struct(F.col("top").alias("t"), mine("ux").alias("x"), mine("uy").alias("y")).alias("at"),
                      "top", "x0", "x1", "y0", "y1")
    close = [F.greatest(F.col(f"{c}0") - F.col(f"b{c}1"), F.col(f"b{c}0") - F.col(f"{c}1")) <= wide for c in ("x", "y")]
    met = spread.pin(own.join(reaching, "at").filter(close[0] & close[1]).select("a", "b", "top", "btop"))
    back = met.filter("top < btop").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return met.select("a", "b").unionByName(back)


def near_pairs(points: DataFrame, reach: float, condition: Column, most: int = MOST) -> DataFrame:
    """Ordered pairs (i, ix, iy, j, jx, jy) of different ids that meet ``condition`` and are within ``reach`` along both axes."""
    tree = leaves(points, most)
    a, b = tree.select(F.col("leaf").alias("a"), F.col("rows").alias("ra")), tree.select(F.col("leaf").alias("b"), F.col("rows").alias("rb"))
    opened = leaf_pairs(tree, reach).join(a, "a").join(b, "b").repartition("a", "b").select(F.explode("ra").alias("p"), "rb")
    both = opened.select("p", F.explode("rb").alias("q")).select(F.col("p.id").alias("i"), F.col("p.x").alias("ix"), F.col("p.y").alias("iy"),
                                                                 F.col("q.id").alias("j"), F.col("q.x").alias("jx"), F.col("q.y").alias("jy"))
    return both.filter((F.col("i") != F.col("j")) & condition)
