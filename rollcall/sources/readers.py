"""Reading landed records and writing results."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions import spread
from rollcall.functions.spread import ensure_checkpoint_dir


def page_schema(record: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("total", T.LongType()), T.StructField("count", T.LongType()),
                         T.StructField("records", T.ArrayType(record))])


def land_pages(df: DataFrame, key: str, size: int, path: str, by: Sequence[str] = ()) -> None:
    """Write rows as pages ``{offset, total, count, records}`` of at most ``size`` rows in the order of ``key``.

    Pages of one value of the ``by`` columns lie in a folder of their own, as a
    source lands them that is asked with a filter.  Rows are placed by exact
    running counts over range partitions, so no value is gathered in one task;
    a page is the only thing that is.
    """
    by, names = list(by), df.columns
    numbered = spread.running(df.withColumn("_one", F.lit(1)), by, [key], {"_at": "_one"})
    record = F.struct(F.col("_at_before").alias("_at"), F.struct(*names).alias("r"))
    pages = (numbered.withColumn("offset", F.expr(f"_at_before div {size} * {size}"))
             .groupBy(*by, "offset").agg(F.first("_at_all").alias("total"), F.count(F.lit(1)).alias("count"),
                                         F.array_sort(F.collect_list(record)).alias("_rs")))
    pages = pages.select(*by, "offset", "total", "count", F.transform("_rs", lambda x: x["r"]).alias("records"))
    pages.write.partitionBy(*by).json(path) if by else pages.write.json(path)


def read_record_pages(spark: SparkSession, path: str, record: T.StructType, size: int | None = None,
                      filters: Mapping[str, object] | None = None, multi_line: bool | None = None) -> DataFrame:
    """Landed pages of at most ``size`` records to one row per record.

    ``filters`` are equalities on the columns the pages are filed under; they
    choose folders, other files are not listed or read.  Reading ends with the
    first page that is not full, as a pager does that asks for one page after the
    other: the page heads are read first (without the records), then only pages
    up to that one, for each folder on its own.  Without ``size`` every page is read.
    ``multi_line`` takes files that hold one page over several lines (so by default
    without ``size``); otherwise every line is a page.
    """
    read = spark.read.option("multiLine", size is None if multi_line is None else multi_line)
    whole = T.StructType([T.StructField("offset", T.LongType()), *page_schema(record).fields])
    filters = filters or {}
    filed = [f.name for f in read.schema(whole).json(path).schema.fields if f.name not in whole.names]
    if unfiled := set(filters).difference(filed):
        raise ValueError(f"pages are not filed by {sorted(unfiled)}")

    def pages(schema: T.StructType) -> DataFrame:
        found = read.schema(schema).json(path)
        for column, value in filters.items():
            found = found.filter(F.col(column) == F.lit(value))
        return found

    own = [c for c in filed if c not in record.names]
    if size is None:
        return pages(whole).select(*own, F.explode("records").alias("r")).select(*own, "r.*")
    heads = pages(T.StructType([f for f in whole.fields if f.name != "records"]))
    ends = heads.filter(F.coalesce("count", F.lit(0)) < size).groupBy(*filed).agg(F.min("offset").alias("_end"))
    if filed:
        held = spread.join_stats(pages(whole), ends, filed)
    else:
        held = spread.with_global(pages(whole), ends)
    held = held.filter(F.col("_end").isNull() | (F.col("offset") <= F.col("_end")))
    return held.select(*own, F.explode("records").alias("r")).select(*own, "r.*")


def parse_record_pages(pages: DataFrame, column: str, record: T.StructType) -> DataFrame:
    """The same for pages held in a string column."""
    parsed = pages.select(F.from_json(column, page_schema(record)).alias("p"))
    return parsed.select(F.explode("p.records").alias("r")).select("r.*")


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType,
                   zero: Sequence[str] = ()) -> DataFrame:
    """CSV with a header; blanks are NULL, except 0 in the ``zero`` columns."""
    return apply_zero_policy(spark.read.schema(schema).csv(path, header=True), zero)


def parse_typed_csv(lines: DataFrame, column: str, schema: T.StructType,
                    zero: Sequence[str] = ()) -> DataFrame:
    parsed = lines.select(F.from_csv(column, schema.simpleString()[7:-1].replace(":", " ")).alias("r"))
    return apply_zero_policy(parsed.select("r.*"), zero)


def apply_zero_policy(df: DataFrame, zero: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in zero})


def scan_filtered(df: DataFrame, filters: Mapping[str, object], key: str,
                  limit: int | None = None, offset: int = 0) -> DataFrame:
    """Equality filters (pushed to the scan) with an optional page of the ordered result."""
    for column, value in filters.items():
        df = df.filter(F.col(column) == F.lit(value))
    return df if limit is None else page_rows(df, [key], limit, offset)


def page_rows(df: DataFrame, order: Sequence[str | Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def union_sources(parts: Mapping[str, DataFrame], label: str = "source") -> DataFrame:
    """Concatenate facts that share no key; missing columns become NULL."""
    out = None
    for name, df in parts.items():
        tagged = df.withColumn(label, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def dataset_profile(df: DataFrame, key: str, samples: int = 3) -> DataFrame:
    """One row per column: type, row count, non-null count, first samples by key."""
    names = df.columns
    counts = df.agg(F.count(F.lit(1)).alias("row_count"), *[F.count(c).alias(f"n_{c}") for c in names])
    top = df.orderBy(key).limit(samples).select(F.col(key).alias("_k"), *[F.col(c).cast("string").alias(c) for c in names])
    firsts = top.agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.col(c).alias("v")))),
                                                lambda s: s["v"]), "|").alias(f"s_{c}") for c in names])
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"),
                                 F.col(f"n_{c}").alias("filled"), F.col(f"s_{c}").alias("samples"))
                        for c, t in df.dtypes])
    return (counts.crossJoin(F.broadcast(firsts)).select("row_count", F.explode(entries).alias("e"))
                  .select("e.*", "row_count"))


# Keyword groups and their weights for ranking data sets.
SUITABILITY = (
    (("male", "female", "gender", "m_", "f_", "men", "women"), 0.30),
    (("state", "district", "pincode", "location"), 0.25),
    (("date", "year", "month", "period"), 0.15),
    (("count", "total", "enrolled", "population", "age"), 0.15),
    (("literacy", "education", "income", "bank", "mobile"), 0.15),
)


def dataset_suitability(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rank data sets by the keyword groups their column names cover (cap 1)."""
    rows = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), F.lit(",".join(df.columns).lower()).alias("fields"), "row_count")
        rows = one if rows is None else rows.unionByName(one)
    score = F.lit(0.0)
    fields = F.split("fields", ",")
    for words, weight in SUITABILITY:
        pattern = "|".join(words)
        hit = F.exists(fields, lambda f: f.rlike(pattern))  # noqa: B023
        score = score + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
    return rows.withColumn("score", F.least(score, F.lit(1.0)))


def work_folder(spark: SparkSession, stem: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{stem}-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def feature(lon: Column, lat: Column, **properties: Column) -> Column:
    """A GeoJSON point feature as text."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"),
        F.struct(*[c.alias(n) for n, c in properties.items()]).alias("properties")))
