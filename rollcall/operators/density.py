"""DBSCAN on any number of columns, over clots of rows instead of rows.

1. Different vectors are packed into blocks by pivots (``pivots.pack``).  Inside
   a block every vector joins a leader within a quarter of eps; the leaders are
   packed and led once more, so a clot has a radius of half an eps at most and
   its members are neighbours of each other.  A dense ball of any number of rows
   shrinks by the square of the block size, to a few clots.
2. Clots, not rows, meet by blocks (``pivots.facing``), and a task keeps what it
   finds to itself: counts up to the limit, links only while they join what was
   apart, the smallest cluster.  No pair that radii decide is ever written.
   Where they cannot decide, the members are compared block by block: rows of
   thin clots to count their neighbours, core members only for two clots that
   sure links have not yet put into one cluster.
3. Clots with core members are connected; other rows take the smallest cluster
   of a core row within eps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions import spread
from rollcall.operators import pivots as pv

QUARTER = 0.2499999  # two of them stay below a half, whatever the rounding


def lead(blocks: DataFrame, radius: float, kind: T.DataType) -> DataFrame:
    """(leader, id): inside each block every vector joins the first leader within ``radius``, or leads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            leaders, ids = [], []
            for r in b.itertuples(index=False):
                x = pv.matrix(r.vec, r.n)
                near = pv.distances(x, x) <= radius
                left = np.ones(r.n, dtype=bool)
                for i in range(r.n):
                    if left[i]:
                        own = np.flatnonzero(near[i] & left)
                        left[own] = False
                        leaders += [r.ids[i]] * len(own)
                        ids += [r.ids[j] for j in own]
            yield pd.DataFrame({"leader": leaders, "id": ids})

    return blocks.select("n", "ids", "vec").mapInPandas(run, T.StructType([T.StructField("leader", kind), T.StructField("id", kind)]))


def clots(sites: DataFrame, pivots: np.ndarray, per_block: int, eps: float) -> tuple[DataFrame, DataFrame]:
    """Members (cid, id, v, m) and clots (cid, v, rows, radius)."""
    kind = sites.schema["id"].dataType
    one = spread.pin(lead(pv.pack(sites.select("id", "v"), pivots, per_block), QUARTER * eps, kind))
    leaders = sites.select("id", "v").join(one.select(F.col("leader").alias("id")).distinct(), "id")
    two = lead(pv.pack(leaders, pivots, per_block), QUARTER * eps, kind)
    to = one.join(two.select(F.col("leader").alias("cid"), F.col("id").alias("leader")), "leader").select("cid", "id")
    members = spread.pin(sites.join(to, "id").select("cid", "id", "v", "m"))
    heads = sites.select(F.col("id").alias("cid"), F.col("v").alias("lv"))
    d2 = F.aggregate(F.zip_with("v", "lv", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    found = members.join(heads, "cid").withColumn("_r", F.sqrt(d2)).groupBy("cid").agg(F.sum("m").alias("rows"), F.max("_r").alias("radius"),
                                                                                      F.count(F.lit(1)).alias("sites"))
    return members, spread.pin(found.join(heads, "cid").select("cid", F.col("lv").alias("v"), "rows", "sites", "radius"))


def judge(shifted: pv.Shifted, a: dict, b: dict, eps: float, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """(near, sure) of the clots of two blocks: their rows may lie, or surely lie, within eps of each other.

    Distances come from one product and are summed as in ``pv.distances`` only
    where that is not sharp enough; clots of one place are decided exactly.
    """
    x, y = a["x"][rows], b["x"]
    ra, rb = a["radius"][rows], b["radius"]
    with np.errstate(over="ignore", invalid="ignore"):
        p, error = shifted.products(y, rows)
        if not np.isfinite(error):
            d = pv.distances(x, y)
            both = ra[:, None] + rb[None]
            return d - both <= eps * (1 + pv.SLACK * (both > 0)), np.where(both > 0, d + both <= eps * (1 - pv.SLACK), d <= eps)
    if not ra.any() and not rb.any():
        p -= (shifted.xx[rows][:, None] - eps * eps) / 2
        error += 8 * np.finfo(float).eps * eps * eps
        sure = p > error
        i, j = np.nonzero(np.abs(p) <= error)
        sure[i, j] = pv.along(x[i], y[j]) <= eps
        return sure, sure
    d2, both = shifted.xx[rows][:, None] - 2 * p, ra[:, None] + rb[None]
    low, high = np.sqrt(np.maximum(d2 - 2 * error, 0.0)), np.sqrt(np.maximum(d2 + 2 * error, 0.0))
    wide = both > 0
    near, sure = low - both <= eps * (1 + pv.SLACK), high + both <= eps * (1 - pv.SLACK)
    i, j = np.nonzero(~wide & near & ~sure)
    near[i, j] = sure[i, j] = pv.along(x[i], y[j]) <= eps
    return near, sure


def sized(blocks: dict, *fields: str) -> dict:
    return {at: c | {f: np.array([s[f] for s in c["size"]]) for f in fields} for at, c in blocks.items()}


def clot_blocks(found: DataFrame, pivots: np.ndarray, per_block: int) -> DataFrame:
    """Blocks of clots; everything but their place is in ``size``."""
    more = [c for c in found.columns if c not in ("cid", "v")]
    return pv.pack(found.select(F.col("cid").alias("id"), "v", F.struct(*more).alias("size")), pivots, per_block, "size")


def known_rows(blocks: DataFrame, pairs: DataFrame, eps: float, least: int) -> DataFrame:
    """(cid, known): rows of the clot and of those surely near, counted until there are ``least``."""

    def count(held: dict, met: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        held = sized(held, "radius", "rows")
        shifted = {at: pv.Shifted(c["x"]) for at, c in held.items()}
        known = {at: np.zeros(c["n"], dtype=np.int64) for at, c in held.items()}
        for b, at in met:
            b = sized({0: b}, "radius", "rows")[0]
            for i in at:
                todo = np.flatnonzero(known[i] + held[i]["rows"] < least)
                if len(todo):
                    sure = judge(shifted[i], held[i], b, eps, todo)[1]
                    if b["bid"] == held[i]["bid"]:
                        sure[np.arange(len(todo)), todo] = False
                    known[i][todo] += sure @ b["rows"].astype(np.int64)
        for i, c in held.items():
            yield pd.DataFrame({"cid": list(c["ids"]), "more": known[i]})

    kind = blocks.schema["ids"].dataType.elementType
    more = pv.facing(pairs, blocks, blocks, count, T.StructType([T.StructField("cid", kind), T.StructField("more", T.LongType())]), ["size"])
    own = blocks.select(F.explode(F.arrays_zip("ids", "size")).alias("c")).select(F.col("c.ids").alias("cid"), F.col("c.size.rows").alias("rows"))
    return own.join(more.groupBy("cid").agg(F.sum("more").alias("more")), "cid", "left").select("cid", (F.col("rows") + F.coalesce("more", F.lit(0))).alias("known"))


def sure_links(blocks: DataFrame, pairs: DataFrame, eps: float) -> DataFrame:
    """(a, b) by the names ``x``: links of sure pairs that join what the task's links had not joined yet."""

    def link(held: dict, met: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        held, base, total = sized(held, "radius", "x"), {}, 0
        held = {at: c | {"name": c["x"], "x": pv.matrix(c["vec"], c["n"])} for at, c in held.items()}
        shifted = {at: pv.Shifted(c["x"]) for at, c in held.items()}
        for at, c in held.items():
            base[at], total = total, total + c["n"]
        parent = np.arange(total)

        def roots(at: np.ndarray) -> np.ndarray:
            out = parent[at]
            while (parent[out] != out).any():
                out = parent[out]
            parent[at] = out
            return out

        for b, at in met:
            b = sized({0: b}, "radius", "x")[0]
            name, b["x"] = b["x"], pv.matrix(b["vec"], b["n"])
            # a block that is held too keeps its places; else its rows are new ones behind the held
            own = [i for i in held if held[i]["bid"] == b["bid"]]
            there = base[own[0]] + np.arange(b["n"]) if own else total + np.arange(b["n"])
            parent = np.concatenate([parent[:total], total + np.arange(0 if own else b["n"])])
            out = []
            for i in at:
                mine = base[i] + np.arange(held[i]["n"])
                one, two = roots(mine), roots(there)
                if one.min() == one.max() == two.min() == two.max():
                    continue
                sure = judge(shifted[i], held[i], b, eps)[1]
                while True:
                    sure &= one[:, None] != two[None]
                    rows, columns = np.flatnonzero(sure.any(axis=1)), np.flatnonzero(sure.any(axis=0))
                    if not len(rows):
                        break
                    for r, c in [*zip(rows, sure[rows].argmax(axis=1)), *zip(sure[:, columns].argmax(axis=0), columns)]:
                        u, w = (int(roots(np.array([m]))[0]) for m in (mine[r], there[c]))
                        if u != w:
                            parent[max(u, w)] = min(u, w)
                            out.append((held[i]["name"][r], name[c]))
                    one, two = roots(mine), roots(there)
            # held rows must not hang on rows that are dropped: roots are the smaller places, and held places are smaller
            roots(np.arange(len(parent)))
            yield pd.DataFrame(out, columns=["a", "b"])

    kind = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return pv.facing(pairs.filter("bid <= sid"), blocks, blocks, link, schema, ["size"])


def open_pairs(left: DataFrame, right: DataFrame, pairs: DataFrame, eps: float) -> DataFrame:
    """(a, b) of clots that may hold rows within eps, but not surely; of clots with a cluster ``comp``, those of two clusters: (a, b, cx, cy)."""
    names = left.select(F.col("size")[0].alias("s")).select("s.*").columns
    fields = [f for f in ("radius", "comp") if f in names]

    def ask(held: dict, met: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        held = sized(held, *fields)
        shifted = {at: pv.Shifted(c["x"]) for at, c in held.items()}
        for b, at in met:
            b = sized({0: b}, *fields)[0]
            for i in at:
                a = held[i]
                if "comp" in fields and a["comp"].min() == a["comp"].max() == b["comp"].min() == b["comp"].max():
                    continue
                near, sure = judge(shifted[i], a, b, eps)
                x, y = np.nonzero(near & ~sure)
                out = pd.DataFrame({"a": [a["ids"][r] for r in x], "b": [b["ids"][c] for c in y]})
                if "comp" in fields:
                    out = out.assign(cx=a["comp"][x], cy=b["comp"][y])[a["comp"][x] != b["comp"][y]]
                yield out[out["a"] != out["b"]]

    kind = left.schema["ids"].dataType.elementType
    cols = ["a", "b", *(("cx", "cy") if "comp" in fields else ())]
    return pv.facing(pairs, left, right, ask, T.StructType([T.StructField(c, kind) for c in cols]), ["size"])


def beside(left: DataFrame, right: DataFrame, pairs: DataFrame, eps: float) -> DataFrame:
    """(a, b, comp): per clot of ``left`` the smallest cluster surely near it (b null), and open pairs that could give a smaller one."""

    def ask(held: dict, met: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        held = sized(held, "radius")
        shifted = {at: pv.Shifted(c["x"]) for at, c in held.items()}
        best = {at: np.full(c["n"], np.iinfo(np.int64).max) for at, c in held.items()}
        for b, at in met:
            b = sized({0: b}, "radius", "comp")[0]
            for i in at:
                todo = np.flatnonzero(best[i] > b["comp"].min())
                if not len(todo):
                    continue
                a, comp = held[i], b["comp"].astype(np.int64)
                near, sure = judge(shifted[i], a, b, eps, todo)
                best[i][todo] = np.minimum(best[i][todo], np.where(sure, comp[None], np.iinfo(np.int64).max).min(axis=1))
                x, y = np.nonzero(near & ~sure & (comp[None] < best[i][todo][:, None]))
                out = pd.DataFrame({"a": [a["ids"][r] for r in todo[x]], "b": pd.array([b["ids"][c] for c in y], dtype="Int64"), "comp": comp[y]})
                yield out[(out["a"] != out["b"]).to_numpy(dtype=bool)]
        for i, c in held.items():
            some = np.flatnonzero(best[i] < np.iinfo(np.int64).max)
            yield pd.DataFrame({"a": [c["ids"][r] for r in some], "b": pd.array([None] * len(some), dtype="Int64"), "comp": best[i][some]})

    kind = left.schema["ids"].dataType.elementType
    return pv.facing(pairs, left, right, ask, T.StructType([T.StructField(c, kind) for c in ("a", "b", "comp")]), ["size"])


def _gather(members: DataFrame, per_block: int, name: str) -> DataFrame:
    """Members by clot in lists of about ``per_block``: (name, <name>_l)."""
    counts = members.groupBy("cid").agg(F.floor(F.count(F.lit(1)) / per_block + 1).cast("int").alias("_s"))
    dealt = members.join(counts, "cid").withColumn("_s", F.pmod(F.xxhash64("id"), F.col("_s")))
    return dealt.groupBy("cid", "_s").agg(F.collect_list(F.struct("id", "v", "m")).alias(f"{name}_l")).drop("_s").withColumnRenamed("cid", name)


def _facing(pairs: DataFrame, left: DataFrame, right: DataFrame, per_block: int, eps: float, row: Callable, schema: T.StructType) -> DataFrame:
    """``row(left part, right part, within)`` for every two lists of members of the pairs (a, b)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                x, y = (np.array([s["v"] for s in part], dtype=float) for part in (r.a_l, r.b_l))
                out += row(r, pv.distances(x, y) <= eps)
            yield pd.DataFrame(out, columns=schema.names)

    held = pairs.join(_gather(left, per_block, "a"), "a").join(_gather(right, per_block, "b"), "b")
    return held.mapInPandas(run, schema)


def dbscan(df: DataFrame, key: str, features: str | Sequence[str], eps: float = 0.5, min_samples: int = 5, per_block: int | None = None) -> DataFrame:
    """Cluster (smallest key of its core rows) per row, noise -1, and a core flag; keys are integers.

    A row counts itself among its neighbours; a row between two clusters goes
    to the smaller one.  Rows without a complete vector are noise.
    """
    from rollcall.operators.models import components

    rows = spread.pin(pv.points(df, key, features))
    sites = pv.sites_of(rows)
    size = sites.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), F.min(F.size("v")).alias("least")).first()
    keys = df.select(F.col(key))
    if not size["n"]:
        return keys.select(key, F.lit(-1).cast("bigint").alias("cluster"), F.lit(False).alias("is_core"))
    if size["d"] != size["least"]:
        raise ValueError("vectors of different lengths")
    per_block = per_block or pv.block_rows(size["d"], 16, size["n"])
    kind = sites.schema["id"].dataType
    pivots = pv.choose_pivots(sites, size["n"], per_block)
    members, found = clots(sites, pivots, per_block, eps)
    widest = found.agg(F.max("radius")).first()[0]

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        return pv.meetings(left, right, pv.cells_of(right, pivots, 1), None, eps + 2 * widest)

    # rows within eps: all of the own clot and of sure clots, and the members of open clots that are
    blocks = clot_blocks(found.select("cid", "v", "radius", "rows"), pivots, per_block)
    known = spread.pin(known_rows(blocks, meet(blocks, blocks), eps, min_samples))
    thin = spread.pin(known.filter(F.col("known") < min_samples))
    thin_rows = members.join(thin.select("cid"), "cid", "left_semi")
    if widest and not thin.isEmpty():
        asking = clot_blocks(found.join(thin.select("cid"), "cid", "left_semi").select("cid", "v", "radius", "rows"), pivots, per_block)
        ask = spread.pin(open_pairs(asking, blocks, meet(asking, blocks), eps))
    else:
        ask = thin.select(F.col("cid").alias("a"), F.col("cid").alias("b")).limit(0)

    def count(r, within):
        m = np.array([s["m"] for s in r.b_l])
        return [(s["id"], int(n)) for s, n in zip(r.a_l, within @ m) if n]

    more = _facing(ask, thin_rows, members, per_block, eps, count, T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType())]))
    more = more.groupBy("id").agg(F.sum("n").alias("_more"))
    thin_core = thin_rows.join(thin, "cid").join(more, "id", "left").filter(F.col("known") + F.coalesce("_more", F.lit(0)) >= min_samples)
    core = spread.pin(members.join(thin.select("cid"), "cid", "left_anti").select("cid", "id", "v", "m").unionByName(thin_core.select("cid", "id", "v", "m")))

    # clots with core members, named by the smallest
    nodes = spread.pin(core.groupBy("cid").agg(F.min("id").alias("id")))
    placed = spread.pin(found.join(nodes, "cid").select("cid", "v", "radius", F.col("id").alias("x")))
    blocks = clot_blocks(placed, pivots, per_block)
    pairs = meet(blocks, blocks)
    comp = components(spread.pin(sure_links(blocks, pairs, eps)), nodes.select("id"))
    if widest and comp.select("comp").distinct().limit(2).count() > 1:
        blocks = clot_blocks(placed.join(comp, F.col("x") == F.col("id")).select("cid", "v", "radius", "comp"), pivots, per_block)
        open_ = spread.pin(open_pairs(blocks, blocks, meet(blocks, blocks).filter("bid <= sid"), eps))
        touching = _facing(open_, core, core, per_block, eps, lambda r, within: [(r.cx, r.cy)] if within.any() else [],
                           T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))
        top = components(spread.pin(touching.distinct()), comp.select(F.col("comp").alias("id")).distinct())
        comp = comp.join(top.select(F.col("id").alias("comp"), F.col("comp").alias("_top")), "comp").select("id", F.col("_top").alias("comp"))
    named = spread.pin(nodes.join(comp, "id").select("cid", "comp"))

    # rows that are not core: the own clot, sure clots, and core members of open clots within eps
    rest = spread.pin(members.join(core.select("id"), "id", "left_anti"))
    own = rest.join(named, "cid").select("id", "comp")
    seeking = clot_blocks(found.join(rest.select("cid").distinct(), "cid", "left_semi").select("cid", "v", "radius", F.lit(-1).cast(kind).alias("comp")), pivots, per_block)
    giving = clot_blocks(found.join(named, "cid").select("cid", "v", "radius", "comp"), pivots, per_block)
    around = spread.pin(beside(seeking, giving, meet(seeking, giving), eps))
    sure_comp = around.filter("b is null").groupBy(F.col("a").alias("cid")).agg(F.min("comp").alias("comp"))
    by_clot = rest.join(sure_comp, "cid").select("id", "comp")
    doubt = around.filter("b is not null")
    reached = _facing(doubt, rest, core, per_block, eps, lambda r, within: [(s["id"], r.comp) for s, w in zip(r.a_l, within.any(axis=1)) if w],
                      T.StructType([T.StructField("id", kind), T.StructField("comp", kind)]))
    border = own.unionByName(by_clot).unionByName(reached).groupBy("id").agg(F.min("comp").alias("comp"))

    label = core.join(named, "cid").select("id", "comp", F.lit(True).alias("is_core")).unionByName(border.select("id", "comp", F.lit(False).alias("is_core")))
    by_vector = sites.select("id", "v").join(label, "id").select("v", "comp", "is_core")
    out = rows.join(by_vector, "v").select(F.col("id").alias("_id"), "comp", "is_core")
    return keys.join(out, F.col(key) == F.col("_id"), "left").select(key, F.coalesce("comp", F.lit(-1)).alias("cluster"),
                                                                     F.coalesce("is_core", F.lit(False)).alias("is_core"))
