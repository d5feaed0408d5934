"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search on it.

* Equal vectors are one point (its smallest vector ids stand by to be listed).
  Links and search use one measure, the inner product itself, so a point's
  links are what a query at that point asks for, whatever the lengths are.
* Start: points meet in buckets of random projections, split where they are
  large, and keep their ``k`` best.  Buckets go by direction alone.
* Descent: every point brings its neighbours and the points it is a neighbour
  of together (a join of the edge table with itself and the vectors); its own
  neighbours always come, as long vectors are neighbours of very many.  Pairs
  not seen before that beat the worst neighbour of one side become edges.  Each
  round keeps the ``k`` best per point and ends when few edges are new.
* Search: a query starts from its own neighbours, from ``entries`` fixed points
  and from the ``longest`` longest ones, and expands the best ``beam`` points not expanded yet, by joins, until
  those are all expanded.  The best are scored again in double precision on the
  original vectors.

All tables are in the shared folder between rounds; nothing is broadcast but
the projections.  Recall is measured in tests against brute force.

Defined results: vectors that are null, zero, of another length than most, or
hold a null or non-finite component take no part, nor do rows without an id; of
rows with one id the least vector takes part; ties go to the smaller id; with
fewer candidates than asked all are returned; an empty table gives an empty
result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from rollcall.llm.common import discard, hold


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` (array of double) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1)
    rows = rows.join(F.broadcast(usual.select("d")), F.size("v") == F.col("d"), "left_semi")
    # -0.0 and 0.0 are one value
    return rows.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


@F.pandas_udf(T.BinaryType())
def _packed(v: pd.Series) -> pd.Series:
    """Single-precision vector."""
    return pd.Series([np.asarray(x, "<f4").tobytes() for x in v])


def _stack(column: pa.Array) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), "<f4").reshape(len(data), -1)


def _codes(trees: int, bits: int, seed: int):
    """Bucket code of every point in every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _stack(batch.column(1))
            planes = np.random.default_rng(seed).standard_normal((x.shape[1], trees * bits)).astype("f4")
            sign = (x @ planes > 0).reshape(len(x), trees, bits)
            code = (sign << np.arange(bits)).sum(2) + (np.arange(trees) << 40)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), trees)), pa.array(code.reshape(-1)),
                 pa.array(np.repeat(np.array(batch.column(1).to_pylist(), object), trees).tolist(), pa.binary())], names=["id", "code", "x"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of lines with one value in the first column, whole, from a sorted partition."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cuts = (np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            part = batch.slice(a, b - a)
            if rest and rest[0].column(0)[0].as_py() != int(key[a]):
                yield pa.concat_batches(rest) if len(rest) > 1 else rest[0]
                rest = []
            rest.append(part)
    if rest:
        yield pa.concat_batches(rest) if len(rest) > 1 else rest[0]


def _edges(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]
    return pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.float32))],
                                      names=["a", "b", "sim"])


def _best_of(ids: np.ndarray, sims: np.ndarray, allowed: np.ndarray, most: int):
    """Per row the ``most`` best allowed columns as edges."""
    sims = np.where(allowed, sims, -np.inf)
    most = min(most, len(ids) - 1)
    top = np.argpartition(-sims, most - 1, axis=1)[:, :most]
    value = np.take_along_axis(sims, top, 1)
    keep = np.isfinite(value)
    return np.repeat(ids, most)[keep.ravel()], ids[top][keep], value[keep]


def _meet(most: int):
    """Edges between the points of a bucket (columns: bucket, id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for g in _groups(batches):
            if g.num_rows > 1:
                x, ids = _stack(g.column(2)), g.column(1).to_numpy()
                found.append(_best_of(ids, x @ x.T, ~np.eye(len(ids), dtype=bool), most))
            if len(found) >= 200:
                yield _edges(found)
                found = []
        yield _edges(found)

    return run


def _local_join(most: int):
    """Pairs among the neighbours of one point, at least one of them new (columns: point, id, x, least, fresh)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for g in _groups(batches):
            fresh = g.column(4).to_numpy(zero_copy_only=False)
            if g.num_rows > 1 and fresh.any():
                x, ids = _stack(g.column(2)), g.column(1).to_numpy()
                sims = x @ x.T
                allowed = (fresh[:, None] | fresh[None, :]) & (sims > g.column(3).to_numpy()[:, None]) & (ids[:, None] != ids[None, :])
                found.append(_best_of(ids, sims, allowed, most))
            if len(found) >= 1000:
                yield _edges(found)
                found = []
        yield _edges(found)

    return run


EDGE = "a long, b long, sim float"


def _keep_best(edges: DataFrame, k: int) -> DataFrame:
    """``a, b, sim, fresh``: the ``k`` best per point, each pair once; an edge met before is not fresh."""
    once = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return once.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def build_graph(points: DataFrame, n: int, k: int = 24, trees: int = 6, bucket: int = 160, rounds: int = 8,
                settled: float = 0.03, seed: int = 7) -> DataFrame:
    """Edges ``a, b, sim, fresh`` of the neighbour graph over ``points`` (``id, x``)."""
    bits = max(1, int(np.ceil(np.log2(max(2.0, n / bucket)))))
    coded = hold(points.mapInArrow(_codes(trees, bits, seed), "id long, code long, x binary"), "codes")
    size = coded.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / (2 * bucket)).alias("parts")).withColumnRenamed("code", "_c")
    dealt = coded.join(size, F.col("code") == F.col("_c")).select(
        F.xxhash64("code", F.pmod(F.xxhash64("id", "code"), F.col("parts"))).alias("cell"), "id", "x")
    start = dealt.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(_meet(k), EDGE)
    edges = hold(_keep_best(start.withColumn("fresh", F.lit(True)), k), "graph")
    discard(coded)
    for _ in range(rounds):
        least = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("m")).select(
            F.col("a").alias("_i"), F.when(F.col("n") >= k, F.col("m")).otherwise(F.lit(-3.4e38).cast("float")).alias("least"))
        carried = points.join(least, F.col("id") == F.col("_i"), "left").select(
            "id", "x", F.coalesce("least", F.lit(-3.4e38).cast("float")).alias("least"))
        both = edges.select("a", "b", "fresh", F.lit(True).alias("own")).unionByName(
            edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "fresh", F.lit(False).alias("own")))
        both = both.groupBy("a", "b").agg(F.max("fresh").alias("fresh"), F.max("own").alias("own"))
        order = W.partitionBy("a").orderBy(F.desc("own"), F.desc("fresh"), F.xxhash64("a", "b"))
        near = both.withColumn("_r", F.row_number().over(order)).filter(
            F.col("_r") <= 2 * k)
        met = near.join(carried, F.col("b") == F.col("id")).select("a", F.col("b").alias("i"), "x", "least", "fresh")
        found = met.repartition("a").sortWithinPartitions("a", "i").mapInArrow(_local_join(k // 2), EDGE)
        now = edges.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True)))
        now = hold(_keep_best(now, k), "graph")
        discard(edges)
        edges = now
        if edges.filter("fresh").count() <= settled * n * k:
            break
    return edges


@F.pandas_udf(T.FloatType())
def _dot(x: pd.Series, y: pd.Series) -> pd.Series:
    if not len(x):
        return pd.Series([], dtype="float32")
    a, b = (np.frombuffer(b"".join(s), "<f4").reshape(len(s), -1) for s in (x, y))
    return pd.Series(np.einsum("ij,ij->i", a, b))


@F.pandas_udf(T.DoubleType())
def _exact(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([float(np.dot(a, b)) for a, b in zip(x, y)], dtype="float64")


def search(queries: DataFrame, points: DataFrame, edges: DataFrame, beam: int = 100, entries: int = 8,
           longest: int = 32, rounds: int = 12) -> DataFrame:
    """``q, b``: the ``beam`` best points found for every query (``q, node, qx``), its own point left out."""
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "b"))
    links = edges.select("a", "b")
    first = queries.select("q", "node").join(links, F.col("node") == F.col("a")).select("q", "b")
    doors = points.orderBy(F.xxhash64("id")).limit(entries).unionByName(
        points.orderBy(F.desc(_dot("x", "x")), "id").limit(longest)).distinct()
    doors = F.broadcast(hold(doors.select(F.col("id").alias("b"), "x"), "doors"))
    # every query meets the doors, so they are scored where the query is
    pool = queries.crossJoin(doors).filter("b <> node").select("q", "b", _dot("qx", "x").alias("sim"), F.lit(False).alias("done"))
    asked = first.distinct()
    for at in range(rounds):
        scored = (asked.join(queries, "q").filter("b <> node").join(points, F.col("b") == F.col("id"))
                  .select("q", "b", _dot("qx", "x").alias("sim"), F.lit(False).alias("done")))
        every = (pool if at == 0 else pool.withColumn("done", F.lit(True))).unionByName(scored)
        every = every.groupBy("q", "b").agg(F.max("sim").alias("sim"), F.max("done").alias("done"))
        pool = hold(every.withColumn("_r", rank).filter(F.col("_r") <= beam).drop("_r"), "pool")
        fresh = pool.filter("not done")
        if not fresh.limit(1).count():
            break
        seen = pool.select(F.col("q").alias("_q"), F.col("b").alias("_b"))
        asked = fresh.select("q", F.col("b").alias("from")).join(links, F.col("from") == F.col("a")).select("q", "b").distinct()
        asked = asked.join(seen, (F.col("q") == F.col("_q")) & (F.col("b") == F.col("_b")), "left_anti")
    return pool.select("q", "b")


def nearest(vectors: DataFrame, query_every: int = 20, k: int = 20, degree: int = 24, beam: int = 100, **graph) -> DataFrame:
    """``query_id, rank, vec_id, score``: neighbours by inner product of the rows whose id ``query_every`` divides."""
    rows = hold(usable(vectors), "vectors")
    # equal vectors are one point; its id is its smallest vector id
    lowest = rows.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    lowest = hold(lowest, "points")
    points = hold(lowest.select("id", _packed("v").alias("x")), "packed")
    n = points.count()
    edges = build_graph(points, n, degree, **graph)
    member = rows.join(lowest.select(F.col("v").alias("_v"), "id", "copies"), F.col("v") == F.col("_v"))
    member = hold(member.select("vec_id", "id", "copies", "v"), "members")
    asked = member.filter(F.col("vec_id") % query_every == 0)
    # one search per point, however many of its copies are queries
    starts = asked.select("id").distinct().join(points.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i")).select(
        F.col("id").alias("q"), F.col("id").alias("node"), F.col("x").alias("qx"))
    found = hold(search(hold(starts, "queries"), points, edges, beam), "found")
    # of every point the k + 1 smallest vector ids can be listed; its own copies come with it
    listed = member.filter("copies = 1").select("id", "vec_id").unionByName(
        member.filter("copies > 1").select("id", "vec_id", F.row_number().over(W.partitionBy("id").orderBy("vec_id")).alias("_r"))
        .filter(F.col("_r") <= k + 1).select("id", "vec_id"))
    near = found.unionByName(found.select("q", F.col("q").alias("b")).distinct()).unionByName(
        asked.select(F.col("id").alias("q"), F.col("id").alias("b"))).distinct()
    vector = lowest.select(F.col("id").alias("_i"), "v")
    scored = near.join(vector, F.col("q") == F.col("_i")).select("q", "b", F.col("v").alias("qv")).join(
        vector, F.col("b") == F.col("_i")).select("q", "b", _exact("qv", "v").alias("score"))
    options = scored.join(listed.select(F.col("id").alias("_i"), "vec_id"), F.col("b") == F.col("_i")).select("q", "vec_id", "score")
    top = hold(options.withColumn("_r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(
        F.col("_r") <= k + 1).drop("_r"), "options")
    # copies of a point share its k + 1 options; each leaves itself out
    each = asked.select(F.col("id").alias("_i"), F.col("vec_id").alias("query_id")).join(top, F.col("_i") == F.col("q")).filter(
        "query_id <> vec_id")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
