"""Whitening of vectors with a covariance from variances alone (polarisation).

Entries become integers x = floor(scale * c) + offset.  ``fit`` makes two
passes: exact sums per dimension, then exact sums of squares of the centred
values of every dimension and of every sum of two dimensions.  As
Var(a + b) = Var(a) + Var(b) + 2 Cov(a, b), the differences of these variances
are twice the covariances; they are assembled on the driver (dimensions squared,
whatever the number of rows) and decomposed by ``eigh``.  Everything before that
is integer arithmetic: values are centred on the whole part m of their mean, and
with r = S - n * m the square sums of n * x - S are n^2 * sum((x - m)^2) - n * r^2.
Tasks add up in 64 bits and go over to unbounded integers where values are
large; Spark adds the tasks' sums as decimals.

Defined results: vectors that are null, or hold null or non-finite entries, take
no part; nor do vectors of another length than the commonest (the longer of two
as common); rows with null or repeated ids are rows like any others.  Components
whose eigenvalue is zero (below 1e-11 of the largest) cannot be scaled to one and
are left out, so one row, equal rows and an empty table give no rows.  Entries
beyond +-2^52 / scale are set to that bound.  A deviation that does not fit a
long is null.  Only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LARGE = float(1 << 52)
SAFE = 1 << 62


def usable(df: DataFrame, vector: str, key: str | None = None) -> DataFrame:
    """``_v`` (array of doubles, finite) and the key as ``_id``."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("_v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(*([F.col(key).alias("_id")] if key else []), v.alias("_v"))
    return rows.filter(F.col("_v").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def to_ints(vectors: pd.Series, scale: float, offset: int) -> np.ndarray:
    """Rows of x as int64."""
    v = np.stack(vectors.to_numpy())
    return np.clip(np.floor(scale * v), -LARGE, LARGE).astype(np.int64) + offset


def _wide(values: np.ndarray, most: int) -> np.ndarray:
    """``values`` as they are while ``most`` (a bound of what follows) fits 64 bits, else as unbounded integers."""
    return values if most < SAFE else values.astype(object)


def _total(name: str) -> T.StructField:
    return T.StructField(name, T.DecimalType(38, 0))


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: integer rows minus ``mean``, projected on ``axes`` (columns), over the root of ``eigenvalues``."""

    scale: float
    offset: int
    n: int
    sums: list[int]
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x minus the whole part of the mean (exact), and the part that is left of the mean."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        return x - whole, np.array([(s % self.n) / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        y, rest = self.centred(x)
        return (y - rest) @ self.axes / np.sqrt(self.eigenvalues)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum over dimensions of (n * x - S)^2."""
        y, _ = self.centred(x)
        rest = np.array([s % self.n for s in self.sums])
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        z = _wide(y, most * most * len(self.sums)) * self.n - rest
        found = (z * z).sum(axis=1).tolist()
        return [d if d < 1 << 63 else None for d in found]


def dimension(rows: DataFrame) -> int:
    """The commonest length, the longer of two as common; 0 for an empty table."""
    top = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0


def moments(rows: DataFrame, d: int, scale: float, offset: int) -> tuple[int, list[int], dict[tuple[int, int], int]]:
    """n, the sums S, and Q: sum of squares of n * u - S_u over n for u each dimension (i, i) and each pair sum (i, j)."""
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), _total("total")])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, [0] * d
        for b in batches:
            if len(b):
                x = to_ints(b["_v"], scale, offset)
                n += len(x)
                total = [t + s for t, s in zip(total, _wide(x, int(np.abs(x).max()) * len(x)).sum(axis=0).tolist())]
        if n:
            yield pd.DataFrame({"i": range(-1, d), "j": 0, "total": _decimals([n, *total])})

    first = rows.mapInPandas(sums, schema).groupBy("i").agg(F.sum("total").alias("t")).collect()
    if not first:
        return 0, [], {}
    found = {r["i"]: int(r["t"]) for r in first}
    n, total = found[-1], [found[i] for i in range(d)]
    whole = np.array([s // n for s in total], dtype=np.int64)
    at = np.triu_indices(d)

    def squares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(len(at[0]), dtype=object)
        seen = False
        for b in batches:
            if not len(b):
                continue
            seen = True
            y = to_ints(b["_v"], scale, offset) - whole
            y = _wide(y, 4 * int(np.abs(y).max(initial=0)) ** 2 * len(y))
            each = []
            for i in range(d):
                pair = y[:, i:] + y[:, i:i + 1]
                pair[:, 0] = y[:, i]
                each.append((pair * pair).sum(axis=0))
            acc = acc + np.concatenate(each).astype(object)
        if seen:
            yield pd.DataFrame({"i": at[0], "j": at[1], "total": _decimals(acc.tolist())})

    got = rows.mapInPandas(squares, schema).groupBy("i", "j").agg(F.sum("total").alias("t")).collect()
    rest = [s % n for s in total]
    q = {}
    for r in got:
        i, j = r["i"], r["j"]
        left = rest[i] if i == j else rest[i] + rest[j]
        q[i, j] = n * int(r["t"]) - left * left
    return n, total, q


def _decimals(values: list[int]) -> list:
    from decimal import Decimal
    return [Decimal(int(v)) for v in values]


def fit(df: DataFrame, vector: str, scale: float = 64.0, offset: int = 1_000_000, most: int = 32) -> Whitening | None:
    """The whitening of all usable vectors with at most ``most`` components; None without any spread."""
    rows = usable(df, vector)
    d = dimension(rows)
    n, sums, q = moments(rows.filter(F.size("_v") == d), d, scale, offset) if d else (0, [], {})
    if not n:
        return None
    v = np.zeros((d, d))
    for i in range(d):
        v[i, i] = q[i, i] / (n * n)
        for j in range(i + 1, d):
            v[i, j] = v[j, i] = (q[i, j] - q[i, i] - q[j, j]) / (2 * n * n)
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > 1e-11 * max(values[order[0]], 0.0)]
    if not len(order) or values[order[0]] <= 0:
        return None
    axes = axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(len(order))] < 0, -1.0, 1.0)
    return Whitening(scale, offset, n, sums, axes, values[order], float(np.trace(v)))


def identity_error(df: DataFrame, vector: str, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, by the same polarisation."""
    rows = usable(df, vector).filter(F.size("_v") == len(model.sums))
    k = len(model.eigenvalues)
    at = np.triu_indices(k)

    def squares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc, mean = np.zeros(len(at[0])), np.zeros(k)
        for b in batches:
            if len(b):
                w = model.project(to_ints(b["_v"], model.scale, model.offset))
                mean += w.sum(axis=0)
                acc += np.concatenate([((w[:, i:] + w[:, i:i + 1] * (np.arange(i, k) > i)) ** 2).sum(axis=0) for i in range(k)])
        yield pd.DataFrame({"i": [*at[0], *range(k)], "j": [*at[1], *[-1] * k], "total": [*acc, *mean]})

    got = {(r["i"], r["j"]): r["t"] / model.n for r in rows.mapInPandas(squares, "i int, j int, total double").groupBy("i", "j").agg(
        F.sum("total").alias("t")).collect()}
    worst = 0.0
    var = {(i, j): got[i, j] - (got[i, -1] if i == j else got[i, -1] + got[j, -1]) ** 2 for i, j in zip(*map(np.ndarray.tolist, at))}
    for (i, j), s in var.items():
        worst = max(worst, abs(s - 1.0) if i == j else abs(s - var[i, i] - var[j, j]) / 2)
    return worst


def transform(df: DataFrame, key: str, vector: str, model: Whitening) -> DataFrame:
    """(key, deviation, whitened array) of every usable vector."""
    rows = usable(df, vector, key).filter(F.size("_v") == len(model.sums))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = to_ints(b["_v"], model.scale, model.offset)
                yield pd.DataFrame({key: b["_id"], "deviation": pd.array(model.deviation(x), dtype="Int64"), "whitened": list(model.project(x))})

    kind = df.schema[key].dataType
    return rows.mapInPandas(apply, T.StructType([T.StructField(key, kind), T.StructField("deviation", T.LongType()),
                                                 T.StructField("whitened", T.ArrayType(T.DoubleType()))]))


def components(df: DataFrame, key: str, vector: str, most: int = 32) -> DataFrame:
    """One row per usable vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    model = fit(df, vector, most=most)
    kind = df.schema[key].dataType
    if model is None:
        names = [(key, kind), ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()),
                 ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField(*n) for n in names]))
    error = identity_error(df, vector, model)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    wide = transform(df, key, vector, model).select(key, "deviation", F.posexplode("whitened").alias("_c", "whitened"))
    return wide.select(key, (F.col("_c") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
                       F.element_at(shares, F.col("_c") + 1).alias("explained"), F.lit(error).alias("identity_error"))
