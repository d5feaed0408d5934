"""Joins of pre-aggregated facts and of small dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions import spread


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def sum_by(df: DataFrame, keys: Sequence[str], skip: Sequence[str] = ("month", "year")) -> DataFrame:
    """Sum every numeric column that is not a key or a calendar part."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in numeric_columns(df, [*keys, *skip])])


def join_three_facts(enrolment: DataFrame, demographic: DataFrame, biometric: DataFrame,
                     keys: Sequence[str] = ("state",)) -> DataFrame:
    """Full outer join of the three facts, each summed by key first; gaps become 0."""
    keys = list(keys)
    parts = []
    for prefix, df in (("enrol", enrolment), ("demo", demographic), ("bio", biometric)):
        agg = sum_by(df, keys)
        measures = [c for c in agg.columns if c not in keys]
        parts.append(agg.withColumn("total", reduce(lambda a, b: a + b, [F.col(c) for c in measures]))
                     .withColumnsRenamed({c: c if c.startswith(f"{prefix}_") else f"{prefix}_{c}" for c in [*measures, "total"]}))
    out = reduce(lambda a, b: a.join(b, keys, "full"), parts)
    return out.fillna(0, [c for c in out.columns if c not in keys])


def join_common_keys(facts: Mapping[str, DataFrame],
                     candidates: Sequence[str] = ("state", "district", "month", "year")) -> DataFrame:
    """Outer join on the candidate keys all facts share; without any, a union.

    Facts are summed to the keys first, which keeps one row per key and side.
    """
    shared = [k for k in candidates if all(k in df.columns for df in facts.values())]
    if not shared:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts.values())
    seen: set[str] = set(shared)
    out = None
    for df in facts.values():
        keep = [c for c in numeric_columns(df, shared) if c not in seen]
        seen.update(keep)
        agg = df.groupBy(*shared).agg(*[F.sum(c).alias(c) for c in keep])
        out = agg if out is None else out.join(agg, shared, "full")
    return out


def join_boundaries(boundaries: DataFrame, data: DataFrame, boundary_key: str, data_key: str) -> DataFrame:
    """Left join on the trimmed, lower-case name."""
    right = data.withColumn("_bk", F.lower(F.trim(data_key))).drop(data_key)
    left = boundaries.withColumn("_bk", F.lower(F.trim(boundary_key)))
    return spread.join_stats(left, right, ["_bk"]).drop("_bk")


def join_population(df: DataFrame, population: DataFrame, keys: Sequence[str], enrolled: str) -> DataFrame:
    """Attach population and the penetration in percent (NULL when unknown)."""
    return (df.join(population.select(*keys, "population"), list(keys), "left")
              .withColumn("penetration_pct", F.try_divide(F.col(enrolled) * 100.0, F.nullif("population", F.lit(0)))))


def enrich_group_stat(df: DataFrame, key: str, *aggs: Column) -> DataFrame:
    return spread.with_group(df, [key], *aggs)


def scenario_cross(df: DataFrame, scenarios: Sequence[Mapping[str, object]]) -> DataFrame:
    """Every row with every scenario, as an exploded literal array (no join)."""
    items = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in s.items()]) for s in scenarios])
    return df.withColumn("_s", F.explode(items)).select(*df.columns, "_s.*")
