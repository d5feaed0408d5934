"""Structured Streaming jobs over the event table, and their batch twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rollcall.operators import policy
from rollcall.sources.readers import work_folder


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream of events; ``ts`` becomes a timestamp with zone for watermarks."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, stem: str) -> DataFrame:
    """Run what is available now in append mode into a Parquet folder and read it.

    Offsets and state live in the shared folder, so a restarted job goes on
    where it stopped and the file sink keeps every row once.
    """
    spark = stream.sparkSession
    base = work_folder(spark, stem)
    q = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state")
         .trigger(availableNow=True).start(f"{base}/out"))
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_batches(stream: DataFrame, stem: str, step: Callable[[DataFrame, int], None]) -> str:
    """Run what is available now through ``foreachBatch``; returns the work folder."""
    base = work_folder(stream.sparkSession, stem)
    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return base


# ---------------------------------------------------------------- windows

def stream_velocity(events: DataFrame, region: str, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Activity per region and period; a period appears once its watermark has passed."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", size), region).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return g.select(region, F.col("window.start").alias("start"), "events", "total")


def stream_moving_mean(events: DataFrame, key: str, late: str = "1 hour", size: str = "7 days", slide: str = "1 day") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), key).agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "mean_value", "n")


def stream_sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of an id: events closer than ``gap``."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("events"))
    return g.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def stream_late(events: DataFrame, key: str, late: str = "2 hours") -> DataFrame:
    """Drop repeats of ``key`` that arrive within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


# ---------------------------------------------------------------- drift

def _drift_columns(hist_mean: Column, hist_std: Column, new_mean: Column, new_std: Column, threshold: float) -> dict[str, Column]:
    mag = (F.abs(new_mean - hist_mean) + F.abs(new_std - hist_std)) / 2.0
    return {"magnitude": mag, "is_drift": mag > threshold}


def newest(df: DataFrame, key: str, order: str, tie: str, n: int, slices: int = 64) -> DataFrame:
    """The newest n rows per key (``rn`` 1 = newest): per (key, slice of a hash of the tie) first, then per key.

    A key that holds half of all rows is ``slices`` sorts; the second step sees
    ``slices`` times n rows of a key at most.
    """
    by = [F.desc(order), F.desc(tie)]
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(tie), F.lit(slices)))
    cut = cut.withColumn("_r", F.row_number().over(W.partitionBy(key, "_slice").orderBy(*by))).filter(F.col("_r") <= n)
    return cut.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(*by))).filter(F.col("rn") <= n).drop("_slice", "_r")


def compare_windows(rows: DataFrame, key: str, score: str, window: int, threshold: float) -> DataFrame:
    """The newest ``window`` scores (by ``rn``) against the ``window`` before them; a key with fewer rows is ``enough`` false and no drift."""
    new = F.col("rn") <= window
    pick = lambda cond, f, n: f(F.when(cond, F.col(score))).alias(n)
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), pick(~new, F.avg, "historical_mean"), pick(~new, F.stddev_pop, "_hs"),
                              pick(new, F.avg, "recent_mean"), pick(new, F.stddev_pop, "_rs"))
    g = g.withColumn("enough", F.col("n") == 2 * window)
    g = g.withColumns(_drift_columns(F.col("historical_mean"), F.col("_hs"), F.col("recent_mean"), F.col("_rs"), threshold))
    shown = [F.when(F.col("enough"), F.col(c)).alias(c) for c in ("historical_mean", "recent_mean", "magnitude")]
    return g.select(key, "n", "enough", *shown, (F.col("enough") & F.coalesce("is_drift", F.lit(False))).alias("is_drift"))


def batch_drift(df: DataFrame, key: str, order: str, tie: str, score: str, window: int = 1000, threshold: float = 0.1) -> DataFrame:
    """Drift of the scores per key: newest ``window`` against the ``window`` before."""
    return compare_windows(newest(df.select(key, order, tie, score), key, order, tie, 2 * window), key, score, window, threshold)


def stream_drift(events: DataFrame, key: str, tie: str, score: str, window: int = 1000, threshold: float = 0.1, stem: str = "drift") -> DataFrame:
    """Drift per key over a stream, in two levels of state.

    Every micro-batch is cut to the newest rows of each (key, slice), joined
    with the state of the batch before and cut again; the result, two windows
    per key, is written under the batch's number.  A batch that is run again
    starts from the same state and overwrites the same folder.
    """
    spark = events.sparkSession
    out = work_folder(spark, f"{stem}-state")
    rows = events.select(F.col(key).cast("string").alias("key"), F.col("ts").alias("at"), F.col(tie).cast("bigint").alias("tie"), F.col(score).cast("double").alias("score"))

    def step(batch: DataFrame, number: int) -> None:
        known = batch
        if number:
            known = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{out}/batch={number - 1}"))
        newest(known, "key", "at", "tie", 2 * window).drop("rn").write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number > 1:
            remove(spark, f"{out}/batch={number - 2}")

    run_batches(rows, stem, step)
    kept = spark.read.parquet(out)
    last = kept.agg(F.max("batch")).first()[0]
    return compare_windows(newest(kept.filter(F.col("batch") == last), "key", "at", "tie", 2 * window), "key", "score", window, threshold)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


# ---------------------------------------------------------------- scoring and snapshots

def score_on_arrival(events: DataFrame, mean: float, std: float, tolerance: str = "balanced") -> DataFrame:
    """Stateless score from fitted statistics: min(1, |z| / 3), with its disposition."""
    s = F.least(F.lit(1.0), F.abs((F.col("value") - mean) / std) / 3.0)
    return events.withColumn("score", s).withColumn("disposition", policy.disposition(F.col("score"), tolerance))


def refresh_snapshot(stream: DataFrame, key: str, stem: str = "snapshot") -> DataFrame:
    """Counts and totals per key, refreshed by every micro-batch.

    Each batch writes its own small aggregate under its batch number (a retry
    overwrites the same folder); the snapshot is the sum of the parts.
    """
    spark = stream.sparkSession
    out = work_folder(spark, f"{stem}-parts")

    def step(batch: DataFrame, number: int) -> None:
        part = batch.groupBy(key).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"), F.max("ts").alias("last_ts"))
        part.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run_batches(stream, stem, step)
    parts = spark.read.parquet(out)
    return parts.groupBy(key).agg(F.sum("events").alias("events"), F.sum("total").alias("total"), F.max("last_ts").alias("last_ts"))
