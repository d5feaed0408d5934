"""Small helpers the operators of this package share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.spread import ensure_checkpoint_dir
from rollcall.session import tune

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


#: Spark removes the shuffle files of a query when it has ended.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def hold(df: DataFrame, label: str = "held", tidy: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, and what comes out of a
    Python stage is computed once.  The table is written with zstd to keep the
    scratch space small.  ``tidy``: shuffle files of the writing go at its end,
    not when the driver happens to collect its garbage.
    """
    spark = tune(df.sparkSession)
    path = f"{ensure_checkpoint_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, None)
    try:
        if tidy:
            spark.conf.set(TIDY, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if tidy:
            spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(docs: DataFrame) -> int:
    """Size of the input as Catalyst knows it (file sizes), or half its characters where it does not."""
    known = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if known < 1 << 50:
        return known
    return (docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0) // 2


def discard(*held: DataFrame) -> None:
    """Remove tables made by ``hold`` that no later plan reads."""
    for df in held:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` of a ``mapInArrow``; when a task ends, its worker gives the memory it has freed back to the system.

    Workers are kept for later tasks and would otherwise hold the most they ever needed beside the executor.
    """

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return task


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def crc32_of(col: Column) -> Column:
    """Unsigned crc32 of the text form of ``col``."""
    return F.crc32(col.cast("string").cast("binary"))
