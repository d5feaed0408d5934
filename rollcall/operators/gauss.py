"""Gaussian sums of all places over all places, tile by tile (a fast Gauss transform).

sum_j q_j exp(-|t - s_j|^2 / (2 sigma^2)) is worked out for every place t in
time that follows the number of places, not its square:

1. Places are cut into tiles as wide as sigma.  The places of a tile become one
   Hermite expansion around its middle, ``TERMS`` terms per axis.
2. Expansions move to the middles of the tiles within ``REACH`` tiles as Taylor
   expansions and are summed, first along x, then along y (the kernel is a
   product), so a tile receives 2 * (2 * REACH + 1) expansions.
3. Every place evaluates the Taylor expansion of its own tile.

Error: with u the distance from a middle over sigma * sqrt(2), at most
1 / (2 * sqrt(2)) on each axis, and |h_n(x)| <= 1.09 * 2^(n/2) * sqrt(n!) for the
Hermite functions, the terms left out come to less than
4 * 1.09^2 * sum_{n >= TERMS} 0.5^(n/2) * e / sqrt(n!) < 1e-14 per unit of weight;
tiles beyond the reach weigh less than exp(-REACH^2 / 2) < 2e-20 per unit.  So a
sum is off by less than 1e-14 times the sum of all |q|.

Contents of a tile are dealt into blocks, so a tile with half of all places is
many tasks; sums of expansions are taken in two steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions import spread

TERMS, REACH, BLOCK, SLICES = 24, 10, 2048, 32
FACTORIAL = np.array([float(math.factorial(n)) for n in range(TERMS)])


def hermite(x: float) -> np.ndarray:
    """h_0(x) .. h_{2 TERMS - 1}(x), the derivatives (-d/dx)^n of exp(-x^2)."""
    h = np.zeros(2 * TERMS)
    h[0] = math.exp(-x * x)
    h[1] = 2 * x * h[0]
    for n in range(1, 2 * TERMS - 1):
        h[n + 1] = 2 * x * h[n] - 2 * n * h[n - 1]
    return h


@lru_cache(maxsize=64)
def shift(tiles: int) -> np.ndarray:
    """[a, b]: what term a of an expansion ``tiles`` tiles behind adds to term b of a Taylor expansion here."""
    h = hermite(tiles / math.sqrt(2.0))
    a = np.arange(TERMS)
    return h[a[:, None] + a[None]] * ((-1.0) ** a / FACTORIAL)[None]


def powers(u: np.ndarray) -> np.ndarray:
    return u[:, None] ** np.arange(TERMS)[None]


def _load(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, TERMS, TERMS)


def _sum(tx: str, ty: str):
    """Rows of one tile become one with the sum of their expansions."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        total = sum(_load(e) for e in b["e"])
        return pd.DataFrame({tx: [b[tx].iloc[0]], ty: [b[ty].iloc[0]], "e": [total.tobytes()]})

    return run


def blocks(sites: DataFrame, sigma: float, sums: list[str]) -> DataFrame:
    """(tx, ty, part, us, vs, q): places of a tile by their offsets from its middle over sigma * sqrt(2), with their weights."""
    tile = lambda c: F.floor(F.col(c) / sigma).cast("bigint")
    off = lambda c, t: (F.col(c) / sigma - F.col(t) - 0.5) / math.sqrt(2.0)
    put = sites.withColumns({"tx": tile("x"), "ty": tile("y")})
    parts = put.groupBy("tx", "ty").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_n"))
    dealt = put.join(parts, ["tx", "ty"]).withColumn("part", F.pmod(F.xxhash64("x", "y"), F.col("_n")))
    rows = F.collect_list(F.struct("x", "y", off("x", "tx").alias("u"), off("y", "ty").alias("v"), *sums))
    return spread.pin(dealt.groupBy("tx", "ty", "part").agg(rows.alias("rows")))


def transform(sites: DataFrame, sigma: float, sums: list[str]) -> DataFrame:
    """(x, y, <sums>): for each different place (x, y) the Gaussian sums of the columns ``sums`` over all places."""
    held = blocks(sites, sigma, sums)
    count = len(sums)

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                u, v = (powers(np.array([s[c] for s in r.rows], dtype=float)) / FACTORIAL for c in ("u", "v"))
                e = np.stack([u.T @ (np.array([s[c] for s in r.rows], dtype=float)[:, None] * v) for c in sums])
                out.append((r.tx, r.ty, r.part % SLICES, e.astype("<f8").tobytes()))
            yield pd.DataFrame(out, columns=["tx", "ty", "slice", "e"])

    one = held.mapInPandas(expand, "tx long, ty long, slice int, e binary")
    first = one.groupBy("tx", "ty", "slice").applyInPandas(lambda b: _sum("tx", "ty")(b).assign(slice=b["slice"].iloc[0]), "tx long, ty long, e binary, slice int")
    source = spread.pin(first.groupBy("tx", "ty").applyInPandas(_sum("tx", "ty"), "tx long, ty long, e binary"))
    near = F.explode(F.sequence(F.lit(-REACH), F.lit(REACH)))

    def move(axis: int):
        """Sum of the expansions that reach a tile along one axis; a group has 2 * REACH + 1 rows at most."""
        def run(b: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros((count, TERMS, TERMS))
            for r in b.itertuples(index=False):
                m = shift(int(r.step))
                e = _load(r.e)
                total += np.einsum("ab,qac->qbc", m, e) if axis == 0 else np.einsum("cd,qbc->qbd", m, e)
            return pd.DataFrame({"tx": [b["tx"].iloc[0]], "ty": [b["ty"].iloc[0]], "e": [total.tobytes()]})
        return run

    # step: how many tiles the receiving middle lies ahead of the sending one
    targets = held.select("tx", "ty").distinct()
    columns = targets.select("tx").distinct()
    along = source.withColumn("step", near).withColumn("tx", F.col("tx") + F.col("step")).join(columns, "tx", "left_semi")
    rowwise = spread.pin(along.groupBy("tx", "ty").applyInPandas(move(0), "tx long, ty long, e binary"))
    asked = targets.withColumn("step", near).withColumn("_from", F.col("ty") - F.col("step"))
    got = asked.join(rowwise.select("tx", F.col("ty").alias("_from"), "e"), ["tx", "_from"]).select("tx", "ty", "step", "e")
    local = spread.pin(got.groupBy("tx", "ty").applyInPandas(move(1), "tx long, ty long, e binary"))

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                u, v = (powers(np.array([s[c] for s in r.rows], dtype=float)) for c in ("u", "v"))
                e = _load(r.e)
                yield pd.DataFrame({"x": [s["x"] for s in r.rows], "y": [s["y"] for s in r.rows],
                                    **{c: ((u @ e[i]) * v).sum(axis=1) for i, c in enumerate(sums)}})

    return held.join(local, ["tx", "ty"]).select("rows", "e").mapInPandas(evaluate, "x double, y double, " + ", ".join(f"{c} double" for c in sums))
