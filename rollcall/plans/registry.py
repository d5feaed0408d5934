"""Registry of runnable queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.session import tune
from rollcall.sources.domain import Domain, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Widen small integers and floats and drop time zones, so that result schemas are stable."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint").alias(f.name)
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double").alias(f.name)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz").alias(f.name)
        out.append(c)
    return df.select(*out)


def bigint_counts(sql: str) -> str:
    """Write ``count_if(x)`` as a filtered count, whose type is BIGINT in the check engine."""
    while (i := sql.find("count_if(")) >= 0:
        j, depth = i + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        sql = f"{sql[:i]}count(*) FILTER (WHERE {sql[i + 9:j - 1]}){sql[j:]}"
    return sql


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register ``fn(domain) -> DataFrame`` under ``name`` with its check SQL."""

    def register(fn: Callable[[Domain], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain(fn(Domain(tune(spark), folder)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(bigint_counts(sql), views)
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6, **per_column: int) -> DataFrame:
    """Round every double column (``-0.0`` becomes ``0.0``)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = (F.round(c, per_column.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
        out.append(c)
    return df.select(*out)
