"""Helpers that keep fact-sized work spread over the cluster.

Rules the operators follow:

* one-row statistics are attached with a broadcast cross join (one row by
  construction);
* per-group statistics are aggregated first (map-side combine absorbs hot
  groups) and joined back; the join is a broadcast only after the row count of
  the statistics table has been checked, otherwise a shuffled join that AQE
  splits when a key is hot;
* ordered work over a whole table (quantiles, running totals, ranks) uses
  range partitions plus per-partition offsets, never one global window;
* ordered work inside a key is cut into time slices, so that a key holding a
  large share of all rows is still many tasks.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode with none set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    target = named or tempfile.mkdtemp(prefix="rollcall-ckpt-")
    sc.setCheckpointDir(target)
    return target


def pin(df: DataFrame) -> DataFrame:
    """Compute once and keep as a table in the shared checkpoint folder.

    Reading the table back cuts the lineage and gives Catalyst its true size,
    so joins with small pinned tables become broadcasts by the usual threshold;
    the loss of an executor costs nothing but a re-read.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/pinned-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS, pinned: bool = False) -> DataFrame:
    """Broadcast-hint ``df`` when its row count is within ``max_rows`` and its files within ``BROADCAST_BYTES``.

    The table is computed once (``pin``), measured and counted; a larger table
    comes back without a hint, so the caller's join runs as a shuffled join.
    """
    held = df if pinned else pin(df)
    size = int(held._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size <= BROADCAST_BYTES and held.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(held)
    return held


def with_global(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row."""
    return df.crossJoin(F.broadcast(stats))


def with_totals(df: DataFrame, *aggs: Column) -> DataFrame:
    return with_global(df, df.agg(*aggs))


def join_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left",
               checked: bool = True) -> DataFrame:
    """Null-safe join of per-group statistics, broadcast only when proven small."""
    renamed = stats
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_jk_{k}")
    if checked:
        renamed = small(renamed)
    cond = None
    for k in keys:
        one = df[k].eqNullSafe(F.col(f"_jk_{k}"))
        cond = one if cond is None else cond & one
    return df.join(renamed, cond, how).drop(*[f"_jk_{k}" for k in keys])


def with_group(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Per-group statistic mapped back on every row without a row window."""
    return join_stats(df, df.groupBy(*keys).agg(*aggs), keys)


def running(df: DataFrame, group: Sequence[str], order: Sequence[Column | str],
            weights: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Exact running totals over an ordered table, without a global window.

    ``weights`` maps an output prefix to a numeric column; for each prefix the
    result holds ``<prefix>_before`` (total strictly before the row) and
    ``<prefix>_all`` (total of the group).  The rows are range-partitioned on
    (group, order); each partition gets the sum of the earlier partitions as its
    offset, so the only unpartitioned step handles one row per partition.
    ``order`` must be unique inside a group.
    """
    spark = df.sparkSession
    parts = partitions or shuffle_parts(spark)
    group = list(group)
    held = pin(df.repartitionByRange(parts, *group, *order)
                 .withColumn("_slice", F.spark_partition_id()))
    totals = held.groupBy(*group, "_slice").agg(
        *[F.sum(c).alias(f"_t_{p}") for p, c in weights.items()])
    over_group = W.partitionBy(*(group or [F.lit(0)]))
    prior = over_group.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *group, "_slice",
        *[F.coalesce(F.sum(f"_t_{p}").over(prior), F.lit(0)).alias(f"_o_{p}") for p in weights],
        *[F.sum(f"_t_{p}").over(over_group).alias(f"{p}_all") for p in weights])
    joined = join_stats(held, offsets, [*group, "_slice"], "inner")
    inside = W.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = joined
    for p, c in weights.items():
        out = out.withColumn(
            f"{p}_before", F.col(f"_o_{p}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("_slice", *[f"_o_{p}" for p in weights])


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
              by: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated percentiles, one output row per ``by`` group.

    Columns come out as ``<col>_q<position of the probability>``.  Values are
    reduced to (value, count) pairs first, so neither a hot value nor a hot
    group is held by one task.
    """
    by = list(by)
    pairs = F.array(*[F.struct(F.lit(c).alias("_f"), F.col(c).cast("double").alias("_v")) for c in cols])
    long = (df.select(*by, F.explode(pairs).alias("_p"))
              .select(*by, F.col("_p._f").alias("_f"), F.col("_p._v").alias("_v"))
              .filter(F.col("_v").isNotNull()))
    counted = long.groupBy(*by, "_f", "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(counted, [*by, "_f"], ["_v"], {"_n": "_c"})
    first, after = F.col("_n_before"), F.col("_n_before") + F.col("_c")

    def value_at(rank: Column, col: str) -> Column:
        return F.max(F.when((F.col("_f") == col) & (first <= rank) & (rank < after), F.col("_v")))

    aggs = []
    for c in cols:
        for i, p in enumerate(probs):
            pos = (F.col("_n_all") - 1) * F.lit(float(p))
            lo, hi = F.floor(pos), F.ceil(pos)
            frac = F.max(F.when(F.col("_f") == c, pos - lo))
            low, high = value_at(lo, c), value_at(hi, c)
            aggs.append((low + (high - low) * frac).alias(f"{c}_q{i}"))
    return ranked.groupBy(*by).agg(*aggs) if by else ranked.agg(*aggs)


def previous_in_key(df: DataFrame, key: str, order: str, tie: str, values: Sequence[str],
                    slice_by: str = "hour") -> DataFrame:
    """``lag`` inside a key, cut into time slices.

    Adds ``prev_<col>`` for every value column.  Rows are windowed per (key,
    slice); the first row of a slice takes the last row of the key's previous
    slice from a table with one row per (key, slice).
    """
    cut = df.withColumn("_slice", F.date_trunc(slice_by, F.col(order)))
    inside = W.partitionBy(key, "_slice").orderBy(order, tie)
    packed = F.struct(*[F.col(v).alias(v) for v in values])
    edges = (cut.groupBy(key, "_slice")
                .agg(F.max_by(packed, F.struct(order, tie)).alias("_last")))
    edges = edges.select(
        F.col(key).alias("_ek"), F.col("_slice").alias("_es"),
        F.lag("_last").over(W.partitionBy(key).orderBy("_slice")).alias("_edge"))
    lagged = (cut.withColumn("_in", F.lag(packed).over(inside))
                 .withColumn("_rn", F.row_number().over(inside)))
    joined = lagged.join(edges, (F.col(key) == F.col("_ek")) & (F.col("_slice") == F.col("_es")), "left")
    prev = F.when(F.col("_rn") == 1, F.col("_edge")).otherwise(F.col("_in"))
    return joined.select(*[F.col(c) for c in df.columns],
                         *[prev[v].alias(f"prev_{v}") for v in values])
