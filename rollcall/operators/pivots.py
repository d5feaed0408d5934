"""Exact neighbours and dense clusters of vectors with any number of dimensions, by pivots.

Rows are dealt to the nearest of a bounded number of pivots (keyed-hash choice)
and, ordered by their distance to it, packed into blocks of bounded bytes: a
block is a ring segment (cell, lo, hi) of a cell.  Only pairs of blocks meet,
and only those that the triangle inequality cannot rule out, so a cell that
holds half of all rows is many blocks and many tasks.  Equal vectors are one
site first.  Distances are summed dimension by dimension, as SQL sums a list.

Vectors that are null or hold null or non-finite entries take no part; vectors
of different lengths are refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions import spread

MOST_PIVOTS = 1024
BLOCK_BYTES = 1 << 19
GROUP = 64
SLACK = 1e-9


def as_vector(features: str | Sequence[str]) -> Column:
    """An array column by its name, or several numeric columns as one array."""
    if isinstance(features, str):
        return F.col(features).cast("array<double>")
    return F.array(*[F.col(c).cast("double") for c in features])


def points(df: DataFrame, key: str, features: str | Sequence[str]) -> DataFrame:
    """(id, v) of the rows whose vector is complete and finite."""
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.select(F.col(key).alias("id"), as_vector(features).alias("v")).filter(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all rows of ``b``, summed in the order of the dimensions."""
    total = np.zeros((len(a), len(b)))
    for t in range(a.shape[1]):
        diff = a[:, t, None] - b[None, :, t]
        total += diff * diff
    return np.sqrt(total)


def matrix(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(n, -1)


def choose_pivots(sites: DataFrame, n: int, per_block: int, seed: int = 42) -> np.ndarray:
    """At most ``MOST_PIVOTS`` different vectors in the order of a keyed hash."""
    most = min(MOST_PIVOTS, max(1, n // per_block))
    rows = sites.select("v").orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(most).collect()
    return np.array([r["v"] for r in rows], dtype=float)


def pack(rows: DataFrame, pivots: np.ndarray, per_block: int, extra: str | None = None) -> DataFrame:
    """Blocks (bid, cell, lo, hi, n, ids, vec, first, extra) of (id, v, extra) in the order of (cell, distance to the pivot).

    ``first`` holds the distances of the whole block to its pivot, ascending.
    """
    more = [extra] if extra else []
    kind = rows.schema["id"].dataType
    cells = T.StructType([T.StructField("id", kind), T.StructField("v", T.ArrayType(T.DoubleType())),
                          *([rows.schema[extra]] if extra else []), T.StructField("cell", T.IntegerType()), T.StructField("r", T.DoubleType())])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = distances(np.stack(b["v"].to_numpy()), pivots)
                near = d.argmin(axis=1)
                yield b.assign(cell=near.astype("int32"), r=d[np.arange(len(b)), near])

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        at, held = TaskContext.get().partitionId() << 33, None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            while len(held):
                same = held["cell"].to_numpy() == held["cell"].iloc[0]
                n = min(len(held) if same.all() else int(same.argmin()), per_block)
                if n == len(held) and n < per_block:
                    break  # the next batch may go on with this block
                yield one(held.iloc[:n], at)
                at, held = at + 1, held.iloc[n:].reset_index(drop=True)
        if held is not None and len(held):
            yield one(held, at)

    def one(b: pd.DataFrame, bid: int) -> pd.DataFrame:
        r = b["r"].to_numpy()
        row = {"bid": bid, "cell": int(b["cell"].iloc[0]), "lo": float(r[0]), "hi": float(r[-1]), "n": len(b), "ids": list(b["id"]),
               "vec": np.stack(b["v"].to_numpy()).astype("<f8").tobytes(), "first": r.tolist()}
        return pd.DataFrame([row | {m: list(b[m]) for m in more}])

    out = T.StructType([T.StructField("bid", T.LongType()), T.StructField("cell", T.IntegerType()), T.StructField("lo", T.DoubleType()),
                        T.StructField("hi", T.DoubleType()), T.StructField("n", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)),
                        T.StructField("vec", T.BinaryType()), T.StructField("first", T.ArrayType(T.DoubleType())),
                        *([T.StructField(extra, T.ArrayType(rows.schema[extra].dataType))] if extra else [])])
    dealt = rows.select("id", "v", *more).mapInPandas(assign, cells)
    return spread.pin(dealt.repartitionByRange("cell", "r", "id").sortWithinPartitions("cell", "r", "id").mapInPandas(blocks, out))


@dataclass(frozen=True)
class Cells:
    """What the driver knows of the cells: pivots, rings, and the ``near`` smallest distances to each pivot (inf where fewer)."""

    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    near: np.ndarray

    def reach(self, d: np.ndarray, k: int) -> np.ndarray:
        """An upper bound of the k-th smallest distance, from the distances ``d`` to the pivots."""
        out, few = np.full(len(d), np.inf), min(4, d.shape[1])
        close = np.argpartition(d, few - 1, axis=1)[:, :few]
        sums = (np.take_along_axis(d, close, axis=1)[:, :, None] + self.near[close]).reshape(len(d), -1)
        if sums.shape[1] >= k:
            out = np.partition(sums, k - 1, axis=1)[:, k - 1]
        open_ = np.flatnonzero(~np.isfinite(out))  # the closest cells hold too few
        for at in range(0, len(open_), 64):  # rows x pivots x k numbers at a time
            rows = open_[at:at + 64]
            sums = (d[rows, :, None] + self.near[None]).reshape(len(rows), -1)
            if sums.shape[1] >= k:
                out[rows] = np.partition(sums, k - 1, axis=1)[:, k - 1]
        return out

    def visits(self, x: np.ndarray, reach: np.ndarray, d: np.ndarray) -> Iterator[tuple[int, float, float]]:
        """(cell, lo, hi): rings in which something may be as close to a row of ``x`` as its ``reach``."""
        own = d.min(axis=1)
        between = distances(self.pivots[d.argmin(axis=1)], self.pivots)
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(between > 0, (d * d - (own * own)[:, None]) / (2 * between), 0.0)
        slack = SLACK * (1.0 + d)
        limit = reach[:, None] + slack
        need = (plane <= limit) & (d - self.high <= limit) & (self.low - d <= limit) & np.isfinite(self.low)
        for cell in np.flatnonzero(need.any(axis=0)):
            rows = need[:, cell]
            yield int(cell), float((d[rows, cell] - limit[rows, cell]).min()), float((d[rows, cell] + limit[rows, cell]).max())


def cells_of(blocks: DataFrame, pivots: np.ndarray, k: int) -> Cells:
    """Rings and nearest distances of every cell: at most ``MOST_PIVOTS`` rows of k numbers."""
    rows = blocks.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.slice(F.min_by("first", "lo"), 1, k).alias("near")).collect()
    low, high, near = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf), np.full((len(pivots), k), np.inf)
    for r in rows:
        low[r["cell"]], high[r["cell"]] = r["lo"], r["hi"]
        near[r["cell"], :len(r["near"])] = r["near"]
    return Cells(pivots, low, high, near)


def promised(left: DataFrame, right: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(bid, reach): per row of a block an upper bound of its k-th smallest distance, from the pivots and the block next to its own.

    Rows with more than k - 1 equal ones (column ``m``, if there is one) need nothing but those.
    """
    meta = right.select(F.col("bid").alias("sid"), "cell", F.col("lo").alias("slo"), F.col("hi").alias("shi"))
    gap = F.greatest(F.col("slo") - F.col("hi"), F.col("lo") - F.col("shi"), F.lit(0.0))
    middle = F.abs(F.col("slo") + F.col("shi") - F.col("lo") - F.col("hi"))
    nearest = left.select("bid", "cell", "lo", "hi").join(meta, "cell").groupBy("bid").agg(F.min_by("sid", F.struct(gap, middle, "sid")).alias("sid"))
    other = right.select(F.col("bid").alias("sid"), F.col("n").alias("sn"), F.col("vec").alias("svec"))
    copies = F.col("m") if "m" in left.columns else F.lit(None).cast("array<bigint>").alias("m")
    mine = left.select("bid", "n", "vec", copies).join(nearest, "bid", "left").join(other, "sid", "left").drop("sid")

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                x = matrix(r.vec, r.n)
                far = cells.reach(distances(x, cells.pivots), k)
                if r.svec is not None and r.sn >= k:
                    far = np.minimum(far, np.partition(distances(x, matrix(r.svec, int(r.sn))), k - 1, axis=1)[:, k - 1])
                if r.m is not None:
                    far[np.asarray(r.m) >= k] = 0.0
                yield pd.DataFrame({"bid": [r.bid], "reach": [far]})

    return spread.pin(mine.mapInPandas(bound, "bid long, reach array<double>"))


def meetings(left: DataFrame, right: DataFrame, cells: Cells, k: int | None, reach: float | DataFrame | None = None) -> DataFrame:
    """(bid, sid) of the pairs of blocks that must be compared.

    For the k nearest, ``reach`` is the table of ``promised`` (made here where it
    is missing); else it is one distance for all rows.
    """
    meta = right.select(F.col("bid").alias("sid"), "cell", F.col("lo").alias("slo"), F.col("hi").alias("shi"))
    mine = left.select("bid", "n", "vec")
    if k is not None:
        mine = mine.join(promised(left, right, cells, k) if reach is None else reach, "bid")
    one = reach if k is None else None

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                x = matrix(r.vec, r.n)
                far = np.asarray(r.reach) if one is None else np.full(len(x), one)
                out = [(r.bid, *v) for v in cells.visits(x, far, distances(x, cells.pivots))]
                yield pd.DataFrame(out, columns=["bid", "cell", "vlo", "vhi"])

    seen = mine.mapInPandas(visit, "bid long, cell int, vlo double, vhi double")
    return spread.pin(seen.join(meta, "cell").filter((F.col("slo") <= F.col("vhi")) & (F.col("shi") >= F.col("vlo"))).select("bid", "sid"))


def facing(pairs: DataFrame, left: DataFrame, right: DataFrame, work: Callable[[list, Iterator[tuple]], Iterator[pd.DataFrame]], schema,
           extra: Sequence[str] = (), group: int = GROUP) -> DataFrame:
    """``work(held, met)`` per task: ``held`` are up to ``group`` left blocks, ``met`` yields (right block, positions in ``held`` it must meet).

    Blocks next to each other are held together, so a right block travels once
    per group that needs it, not once per pair of blocks; it is dropped when the
    next one comes.  Groups with many pairs are several tasks with a part of the
    right blocks each.  Blocks have ids, vec, n and the columns ``extra``; a side
    without such a column gives None.
    """
    spark = left.sparkSession
    # blocks are numbered through in their order: their place in a partition plus the blocks of the partitions before
    place, part = F.col("bid").bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright("bid", 33).cast("int")
    counts = {r["p"]: r["n"] for r in left.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    size = -(-total // max(-(-total // group), min(total, 8))) if total else 1
    seat = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in before or [0]]), part + 1) + place
    grouped = lambda t: t.withColumn("_g", F.floor(seat / size).cast("int")).withColumn("_at", F.pmod(seat, F.lit(size)).cast("int"))
    weights = {r["_g"]: r["n"] for r in grouped(pairs).groupBy("_g").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = min(max(spread.shuffle_parts(spark), spark.sparkContext.defaultParallelism * 4), max(1, sum(weights.values()) // 16))
    plan, tasks = [], 0
    for g in sorted(weights):
        parts = max(1, round(wanted * weights[g] / sum(weights.values())))
        plan.append((g, tasks, parts))
        tasks += parts
    if not plan:
        return spark.createDataFrame([], schema)
    plan = F.broadcast(spark.createDataFrame(plan, "_g int, _first int, _parts int"))

    def side(t: DataFrame, n: int, *at: Column) -> DataFrame:
        more = [F.col(f"`{c}`") if c in t.columns else F.lit(None).cast(kinds[c]).alias(c) for c in extra]
        return t.select(*at, F.lit(n).alias("_side"), "bid", "n", "ids", "vec", *more)

    kinds = {c: (left if c in left.columns else right).schema[c].dataType for c in extra}
    mine = side(grouped(left).join(plan, "_g").withColumn("_t", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_parts") - 1))),
                0, F.col("_t"), F.array("_at").alias("_at"))
    needs = grouped(pairs).join(plan, "_g").groupBy("sid", (F.col("_first") + F.pmod(F.xxhash64("sid"), F.col("_parts"))).cast("int").alias("_t")).agg(
        F.sort_array(F.collect_list("_at")).alias("_at"))
    others = side(needs.join(right.withColumnRenamed("bid", "sid"), "sid").withColumnRenamed("sid", "bid"), 1, F.col("_t"), F.col("_at"))
    dealt = mine.unionByName(others).repartitionById(tasks, "_t").sortWithinPartitions("_t", "_side", "bid")
    names = dealt.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (dict(zip(names, r)) for b in batches for r in b.itertuples(index=False, name=None))
        for _, of_task in groupby(rows, key=lambda c: c["_t"]):
            held: dict[int, dict] = {}
            for right, blocks in groupby((c | {"x": matrix(c["vec"], c["n"])} for c in of_task), key=lambda c: c["_side"]):
                if not right:
                    held = {int(c["_at"][0]): c for c in blocks}
                    continue
                for out in work(held, ((c, [int(a) for a in c["_at"]]) for c in blocks)):
                    if len(out):
                        yield out

    return dealt.mapInPandas(run, schema)


class Shifted:
    """A block moved to its own middle, for products: ``products(y)`` is x.y - y.y/2 in one matrix product, |x - y|^2 = xx - 2 products."""

    def __init__(self, x: np.ndarray):
        self.middle = x.mean(axis=0)
        moved = x - self.middle
        self.xx = (moved * moved).sum(axis=1)
        self.side = np.hstack([moved, np.ones((len(x), 1))])

    def products(self, y: np.ndarray, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, float]:
        """The products of ``rows`` and a bound of their rounding error (not finite where numbers are too large for products)."""
        moved = y - self.middle
        yy = (moved * moved).sum(axis=1)
        error = 8 * np.finfo(float).eps * (len(self.middle) + 8) * (self.xx.max(initial=0.0) + yy.max(initial=0.0))
        return self.side[rows] @ np.hstack([moved, -0.5 * yy[:, None]]).T, float(error) + 1e-300


def along(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``x`` to the rows of ``y`` beside them, summed like ``distances``."""
    total = np.zeros(len(x))
    for t in range(x.shape[1]):
        diff = x[:, t] - y[:, t]
        total += diff * diff
    return np.sqrt(total)


class Nearest:
    """The k nearest of every row of a block among the blocks it has met: ties by id."""

    def __init__(self, block: dict, k: int):
        self.x, self.ids, self.k, self.n = block["x"], block["ids"], k, block["n"]
        self.bound = np.asarray(block["reach"], dtype=float) * (1 + SLACK) + 1e-300
        self.shifted = Shifted(self.x)
        self.held: list[tuple] = []
        self.count = 0

    def meet(self, y: np.ndarray, ids: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            p, error = self.shifted.products(y)
            least = (self.shifted.xx - self.bound * self.bound * (1 + 4 * SLACK)) / 2 - error
            if np.isfinite(error):
                i, j = np.nonzero(~(p < least[:, None]))
            else:
                i, j = np.divmod(np.arange(p.size), p.shape[1])
        for at in range(0, len(i), 1 << 16):
            a, b = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
            with np.errstate(over="ignore"):
                d = along(self.x[a], y[b])
            ok = d <= self.bound[a]
            self.held.append((a[ok], d[ok], ids[b[ok]]))
            self.count += int(ok.sum())
            if self.count > 2 * self.n * self.k + (1 << 15):
                self.fold()

    def fold(self) -> None:
        rows, d, ids = (np.concatenate([h[c] for h in self.held]) for c in range(3))
        if ids.dtype == object:
            order = np.array(sorted(range(len(rows)), key=lambda e: (rows[e], d[e], ids[e])), dtype=int)
        else:
            order = np.lexsort((ids, d, rows))
        rows, d, ids = rows[order], d[order], ids[order]
        first = np.searchsorted(rows, np.arange(self.n))
        keep = np.arange(len(rows)) - first[rows] < self.k
        rows, d, ids = rows[keep], d[keep], ids[keep]
        last = np.searchsorted(rows, np.arange(self.n), side="right")
        full = np.bincount(rows, minlength=self.n) == self.k
        self.bound[full] = np.minimum(self.bound[full], d[last[full] - 1])
        self.held, self.count = [(rows, d, ids)], len(rows)

    def found(self) -> pd.DataFrame:
        if not self.held:
            return pd.DataFrame({"i": [], "d": [], "j": []})
        self.fold()
        rows, d, ids = self.held[0]
        at = np.searchsorted(rows, np.arange(self.n + 1))
        some = np.flatnonzero(np.diff(at))
        return pd.DataFrame({"i": [self.ids[i] for i in some], "d": [d[at[i]:at[i + 1]] for i in some], "j": [ids[at[i]:at[i + 1]] for i in some]})


def sites_of(rows: DataFrame) -> DataFrame:
    """Different vectors with the smallest id, (id, v, m) with m rows each."""
    return spread.pin(rows.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m")).select("id", "v", "m"))


def block_rows(d: int, least: int, n: int) -> int:
    """At most 1024 rows and ``BLOCK_BYTES``; of few rows, blocks for a few tasks."""
    return max(least, min(1024, BLOCK_BYTES // (8 * max(1, d)), max(128, n // 64)))


def knn_join(df: DataFrame, key: str, features: str | Sequence[str], k: int = 5, donors: DataFrame | None = None,
             per_block: int | None = None) -> DataFrame:
    """Edges (i, j, rank, d, w) to the k nearest rows (of ``donors`` if given), ties by key, w = 1/number of edges.

    Each different vector searches once, among different vectors: the k + 1
    nearest of those hold the k + 1 nearest rows.  Of equal vectors, the k + 1
    with the smallest keys are candidates; no more can matter.
    """
    rows = spread.pin(points(df, key, features))
    givers = rows if donors is None else spread.pin(points(donors, key, features))
    kind = rows.schema["id"].dataType
    sites = sites_of(rows)
    given = sites if donors is None else sites_of(givers)
    size = given.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    if sites.unionByName(given).filter(F.size("v") != (size["d"] or 0)).count() and size["n"]:
        raise ValueError("vectors of different lengths")
    empty = df.sparkSession.createDataFrame([], T.StructType([
        T.StructField("i", kind), T.StructField("j", kind), T.StructField("rank", T.IntegerType()), T.StructField("d", T.DoubleType()),
        T.StructField("w", T.DoubleType())]))
    if not size["n"]:
        return empty
    per_block = per_block or block_rows(size["d"], k + 1, size["n"])
    pivots = choose_pivots(given, size["n"], per_block)
    s_blocks = pack(given.select("id", "v"), pivots, per_block)
    r_blocks = pack(sites.select("id", "v", "m"), pivots, per_block, "m") if donors is None else pack(sites.select("id", "v"), pivots, per_block)
    cells = cells_of(s_blocks, pivots, k + 1)
    reach = promised(r_blocks, s_blocks, cells, k + 1)
    pairs = meetings(r_blocks, s_blocks, cells, k + 1, reach)
    found = T.StructType([T.StructField("i", kind), T.StructField("d", T.ArrayType(T.DoubleType())), T.StructField("j", T.ArrayType(kind))])

    def compare(held: dict, met: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        own = {at: Nearest(b, k + 1) for at, b in held.items()}
        for b, at in met:
            ids = np.asarray(b["ids"])
            if ids.dtype.kind not in "iu":
                ids = np.asarray(list(b["ids"]), dtype=object)
            for a in at:
                own[a].meet(b["x"], ids)
        for o in own.values():
            yield o.found()

    near = facing(pairs, r_blocks.drop("m").join(reach, "bid"), s_blocks, compare, found, ["reach"])
    near = near.select("i", F.transform(F.arrays_zip("d", "j"), lambda s: F.struct(s["d"].alias("d"), s["j"].alias("j"))).alias("near"))
    near = near.groupBy("i").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    # of a vector that is repeated, the rows with the smallest keys: a bounded array per group, partly aggregated before the shuffle
    repeated = spread.pin(given.filter("m > 1").select(F.col("id").alias("_site"), "v"))
    if not repeated.isEmpty():
        some = givers.join(repeated, "v").groupBy("_site", F.pmod(F.xxhash64("id"), F.lit(64)).alias("_s")).agg(
            F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("l"))
        some = some.groupBy("_site").agg(F.slice(F.sort_array(F.flatten(F.collect_list("l"))), 1, k + 1).alias("l"))
        each = spread.pin(near).select("i", F.explode("near").alias("s")).join(some, F.col("s.j") == F.col("_site"), "left")
        same = F.transform(F.coalesce("l", F.array("s.j")), lambda j: F.struct(F.col("s.d").alias("d"), j.alias("j")))
        near = each.select("i", same.alias("near")).groupBy("i").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    lists = spread.pin(sites.select(F.col("id").alias("i"), "v").join(near, "i").select("v", "near"))
    mine = rows.select(F.col("id").alias("i"), "v").join(lists, "v")
    others = F.slice(F.filter("near", lambda s: s["j"] != F.col("i")), 1, k) if donors is None else F.slice("near", 1, k)
    out = mine.select("i", F.size(others).alias("_n"), F.posexplode(others).alias("_p", "_s"))
    return out.select("i", F.col("_s.j").alias("j"), (F.col("_p") + 1).alias("rank"), F.col("_s.d").alias("d"), (1.0 / F.col("_n")).alias("w"))
