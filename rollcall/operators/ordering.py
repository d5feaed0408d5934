"""Ranks, moving windows, trends of short series, top-k, set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rollcall.functions import spread, tables


def rank_groups(df: DataFrame, key: str) -> DataFrame:
    """Rank keys by row count, most rows first, ties averaged.

    Works on the (count, number of keys) pairs, so no window spans all keys.
    """
    counts = spread.pin(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    ties = counts.groupBy("n").agg(F.count(F.lit(1)).alias("_k")).withColumn("_neg", -F.col("n"))
    ranked = spread.running(ties, [], ["_neg"], {"_k": "_k"}).select(
        "n", (F.col("_k_before") + (F.col("_k") + 1) / 2.0).alias("rank"))
    return spread.join_stats(counts, ranked, ["n"])


def rank_smooth(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean of the values one rank below to one rank above the row's own rank."""
    indexed = spread.running(df.select(key, value).withColumn("_one", F.lit(1)), [], [value, key], {"i": "_one"})
    indexed = indexed.select(key, value, F.col("i_before").alias("_i"))
    near = indexed.select(F.explode(F.array(F.col("_i") - 1, F.col("_i"), F.col("_i") + 1)).alias("_i"), F.col(value).alias("_v"))
    means = near.groupBy("_i").agg(F.avg("_v").alias("smoothed"))
    return indexed.join(means, "_i").drop("_i")


def sma_trailing(df: DataFrame, group: str, order: str, value: str, window: int = 3) -> DataFrame:
    """Mean of the last ``window`` points; the head takes the first full mean."""
    w = W.partitionBy(group).orderBy(order)
    mean = F.avg(value).over(w.rowsBetween(1 - window, 0))
    out = df.withColumn("_m", mean).withColumn("_rn", F.row_number().over(w))
    first_full = F.max(F.when(F.col("_rn") == window, F.col("_m"))).over(W.partitionBy(group))
    return out.withColumn("sma", F.when(F.col("_rn") < window, F.coalesce(first_full, F.col(value).cast("double"))).otherwise(F.col("_m"))).drop("_m", "_rn")


def sma_centered(df: DataFrame, group: str, order: str, value: str, window: int = 12, out: str = "sma") -> DataFrame:
    """Mean over [i - w//2, i + ceil(w/2)), cut at the ends."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(-(window // 2), (window + 1) // 2 - 1)
    return df.withColumn(out, F.avg(value).over(w))


def velocity(df: DataFrame, group: str, date: str, value: str) -> DataFrame:
    """Change per 30 days between neighbours: mean, last, acceleration, five-way trend."""
    w = W.partitionBy(group).orderBy(date)
    months = F.datediff(F.col(date), F.lag(date).over(w)) / 30.0
    step = F.col(value) - F.lag(value).over(w)
    s = (df.withColumn("_v", F.when(months > 0, step / months).when(months.isNotNull(), F.lit(0.0)))
           .withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(F.desc(date)))))
    g = s.groupBy(group).agg(F.avg("_v").alias("velocity"), F.max(F.when(F.col("_rn") == 1, F.col("_v"))).alias("current_velocity"),
                             F.max(F.when(F.col("_rn") == 2, F.col("_v"))).alias("_v2"), F.count(F.lit(1)).alias("points"))
    acc = F.coalesce(F.col("current_velocity") - F.col("_v2"), F.lit(0.0))
    v = F.col("velocity")
    trend = (F.when(F.col("points") < 2, "insufficient_data").when((v > 0) & (acc > 0), "accelerating_growth")
              .when((v > 0) & (acc < 0), "decelerating_growth").when((v < 0) & (acc < 0), "accelerating_decline")
              .when((v < 0) & (acc > 0), "decelerating_decline").otherwise("stable"))
    return (g.withColumn("acceleration", acc).withColumn("trend", trend)
             .withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("velocity", "current_velocity")}).drop("_v2"))


def halves_trend(df: DataFrame, group: str, date: str, value: str, last: int = 12) -> DataFrame:
    """Mean of the last points and (mean of 2nd half - mean of 1st half) / length of the 1st half."""
    rn = F.row_number().over(W.partitionBy(group).orderBy(F.desc(date)))
    s = df.withColumn("_rn", rn).filter(F.col("_rn") <= last)
    s = s.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(group)))
    half = F.floor(F.col("_n") / 2)
    first = F.col("_rn") > F.col("_n") - half
    g = s.groupBy(group).agg(F.avg(value).alias("mean_recent"), F.avg(F.when(first, F.col(value))).alias("_a"),
                             F.avg(F.when(~first, F.col(value))).alias("_b"), F.max(half).alias("_h"),
                             F.max(date).alias("last_date"), F.count(F.lit(1)).alias("points"))
    trend = F.when(F.col("points") >= 2, (F.col("_b") - F.col("_a")) / F.nullif("_h", F.lit(0))).otherwise(0.0)
    return g.withColumn("trend", trend).drop("_a", "_b", "_h")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per group; Spark cuts each input partition to k rows per group before the shuffle."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def severity_order(df: DataFrame, severity: str, *then: Column) -> DataFrame:
    rank = F.when(F.col(severity) == "critical", 0).when(F.col(severity) == "high", 1).otherwise(2)
    return df.orderBy(rank, *then)


def trend_order(df: DataFrame, trend: str, change: str, key: str) -> DataFrame:
    """Decreasing first, then by change."""
    return df.orderBy(F.when(F.col(trend) == "decreasing", 0).otherwise(1), change, key)


def distinct_values(df: DataFrame, keys: Sequence[str], min_points: int = 1, point: str | None = None) -> DataFrame:
    g = df.groupBy(*keys).agg((F.countDistinct(point) if point else F.count(F.lit(1))).alias("points"))
    return g.filter(F.col("points") >= min_points).orderBy(*keys)


def source_union(df: DataFrame, key: str, signals: str, scopes: str,
                 signal_map: Mapping = tables.SIGNAL_SOURCES, scope_map: Mapping = tables.SCOPE_SOURCES) -> DataFrame:
    """Facts a key needs: union over its signals and scopes, default enrolment."""
    nothing = F.array().cast("array<string>")
    via_signal = F.flatten(F.transform(signals, lambda s: F.coalesce(tables.lookup(signal_map, s), nothing)))
    via_scope = F.flatten(F.transform(scopes, lambda s: F.coalesce(tables.lookup(scope_map, s), nothing)))
    found = F.array_union(via_signal, via_scope)
    found = F.when(F.size(found) == 0, F.array(F.lit("enrolment"))).otherwise(found)
    return df.select(key, F.explode_outer(found).alias("source")).distinct()
