"""Session settings the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Wide projections (one expression per feature) generate methods the JVM will
# not compile; past 8000 bytes of bytecode Spark should fall back to its split
# form instead of running one huge interpreted method.
# Rows of whole documents go to Python in smaller Arrow batches, so that a
# worker's memory follows a few thousand texts, not ten thousand.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": ("65535", "8000"),
            "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000")}


def tune(spark: SparkSession) -> SparkSession:
    """Apply ``SETTINGS`` where the session still has Spark's default."""
    for key, (default, wanted) in SETTINGS.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, wanted)
    return spark
