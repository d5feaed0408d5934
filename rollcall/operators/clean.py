"""Cleaning: names, dates, filters, missing values, outliers, scaling, encoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from rollcall.functions import spread
from rollcall.functions.scalar import clip

# Accepted spellings per canonical column, first match wins.
COLUMN_ALIASES = {
    "state": ["state", "state_name", "statename", "state_cd"],
    "state_code": ["state_code", "state_cd", "statecode"],
    "district": ["district", "district_name", "districtname", "dist_name"],
    "district_code": ["district_code", "district_cd", "districtcode", "dist_code"],
    "male_enrolled": ["male_enrolled", "male_count", "male", "m_enrolled", "men_enrolled", "male_aadhaar"],
    "female_enrolled": ["female_enrolled", "female_count", "female", "f_enrolled", "women_enrolled", "female_aadhaar"],
    "age_0_5": ["age_0_5", "age0_5", "0_5", "infant", "age_0to5", "age_below_5"],
    "age_5_17": ["age_5_17", "age5_17", "5_17", "child", "age_5to17", "age_5_to_17"],
    "age_18_plus": ["age_18_greater", "age_18_plus", "age18_plus", "adult", "age_above_18", "age_18_above"],
    "date": ["date", "month", "period", "month_year", "report_date"],
    "year": ["year", "yr", "financial_year", "fy"],
    "pincode": ["pincode", "pin_code", "pin", "postal_code"],
    "total_enrolled": ["total", "total_enrolled", "total_count", "all_enrolled"],
}

# Region spellings that differ from the canonical name.
STATE_ALIASES = {
    "delhi": "NCT of Delhi",
    "nct of delhi": "NCT of Delhi",
    "orissa": "Odisha",
    "west bangal": "West Bengal",
    "westbengal": "West Bengal",
    "jammu and kashmir": "Jammu & Kashmir",
    "andaman and nicobar": "Andaman And Nicobar Islands",
    "dadra and nagar haveli": "Dadra And Nagar Haveli And Daman And Diu",
    "daman and diu": "Dadra And Nagar Haveli And Daman And Diu",
    "national capital territory of delhi": "NCT of Delhi",
    "uttaranchal": "Uttarakhand",
    "pondicherry": "Puducherry",
    "chattisgarh": "Chhattisgarh",
}


def column_mapping(columns: Sequence[str], aliases: Mapping[str, Sequence[str]] = COLUMN_ALIASES) -> dict[str, str]:
    """Original name to canonical name; each canonical name is used once."""
    squash = {c.strip().lower().replace(" ", "_"): c for c in reversed(list(columns))}
    out: dict[str, str] = {}
    for canonical, names in aliases.items():
        for n in names:
            original = squash.get(n)
            if original is not None and original not in out:
                out[original] = canonical
                break
    return out


def normalize_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]] = COLUMN_ALIASES) -> DataFrame:
    return df.withColumnsRenamed(column_mapping(df.columns, aliases))


def normalize_state(df: DataFrame, column: str, aliases: Mapping[str, str] = STATE_ALIASES,
                    out: str = "state_clean") -> DataFrame:
    """Canonical region name; names without any letter become NULL."""
    key = F.trim(F.regexp_replace(F.lower(F.regexp_replace(column, "&", " and ")), "[^a-z0-9]+", " "))
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return df.withColumn(out, F.when(key.rlike("[a-z]"), F.coalesce(F.try_element_at(known, key), F.initcap(key))))


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Unparsable text becomes 0."""
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0).cast("bigint")) for c in columns})


def parse_dates(df: DataFrame, columns: Sequence[str], formats: Sequence[str],
                min_rate: float = 0.5) -> DataFrame:
    """Multi-format dates, unparsable NULL; a column is kept as text below ``min_rate``."""
    parsed = df.withColumns({f"{c}_date": F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("date")
                             for c in columns})
    rates = parsed.agg(*[(F.count(f"{c}_date") / F.count(F.lit(1))).alias(f"{c}_rate") for c in columns])
    out = spread.with_global(parsed, rates)
    return out.withColumns({f"{c}_date": F.when(F.col(f"{c}_rate") >= min_rate, F.col(f"{c}_date")) for c in columns})


def filter_time_range(df: DataFrame, date: str, period: str, as_of: str, fallback: bool = False) -> DataFrame:
    """today / last_7_days / this_month / default 30 days, relative to ``as_of``."""
    end = F.to_date(F.lit(as_of))
    start = {"today": end, "last_7_days": F.date_sub(end, 7), "this_month": F.trunc(end, "month")}.get(
        period, F.date_sub(end, 30))
    kept = df.filter(F.col(date).between(start, end))
    if not fallback:
        return kept
    any_left = df.agg(F.coalesce(F.max(F.col(date).between(start, end)), F.lit(False)).alias("_any"))
    tagged = spread.with_global(df, any_left)
    note = F.when(F.col("_any"), F.lit("filtered")).otherwise(F.lit("unfiltered"))
    return (tagged.filter(~F.col("_any") | F.col(date).between(start, end))
                  .withColumn("range_note", note).drop("_any"))


def filter_geo(df: DataFrame, place: str, state: str = "state", district: str = "district") -> DataFrame:
    """``"State"`` or ``"District, State"``, case-insensitive containment."""
    parts = [p.strip().lower() for p in place.split(",") if p.strip()]
    if len(parts) >= 2:
        return df.filter(F.lower(district).contains(parts[0]) & F.lower(state).contains(parts[1]))
    return df.filter(F.lower(state).contains(parts[0]) | F.lower(district).contains(parts[0]))


def lookup_region(df: DataFrame, text: str, code: str, name: str) -> DataFrame:
    """First hit of: exact code, exact name, name contains."""
    t = text.strip().lower()
    rank = (F.when(F.lower(code) == t, 1).when(F.lower(name) == t, 2).when(F.lower(name).contains(t), 3))
    return df.withColumn("match_rank", rank).filter("match_rank is not null").orderBy("match_rank", code).limit(1)


def filter_age_range(df: DataFrame, which: str) -> DataFrame:
    if which == "elderly":
        return df.filter(F.col("elderly_ratio") > 0.15)
    if which == "adult":
        return df.filter(F.col("adult_ratio") > 0.5)
    return df


def drop_null_keys(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.trim(F.col(key)) != "")


# Columns an export shows, in order.
EXPORT_PRIORITY = ["state", "district", "date", "male_enrolled", "female_enrolled", "total_enrolled",
                   "female_coverage_ratio", "gender_gap", "high_risk"]


def select_export_cols(df: DataFrame, priority: Sequence[str] = tuple(EXPORT_PRIORITY),
                       prediction: Sequence[str] = ("risk_probability", "predicted_high_risk")) -> DataFrame:
    return df.select(*[c for c in [*priority, *prediction] if c in df.columns])


def mask_id(*parts: Column | str, upper: bool = True) -> Column:
    digest = F.substring(F.sha2(F.concat_ws("_", *parts), 256), 1, 12)
    return F.upper(digest) if upper else digest


def privacy_noise(df: DataFrame, key: Sequence[str], counts: Sequence[str], ratios: Sequence[str] = (),
                  epsilon: float = 1.0, sensitivity: float = 1.0, seed: int = 42) -> DataFrame:
    """Laplace(0, sensitivity/epsilon) on counts, never below 0; ratios to 2 digits.

    The uniform draw is a keyed hash, so a retried task repeats the same noise.
    """
    scale = sensitivity / epsilon
    out = {}
    for i, c in enumerate(counts):
        h = F.substring(F.md5(F.concat_ws("|", *key, F.lit(seed), F.lit(i)).cast("binary")), 1, 13)
        u = (F.conv(h, 16, 10).cast("double") + 0.5) / float(1 << 52) - 0.5
        noise = -F.lit(scale) * F.signum(u) * F.log(1.0 - 2.0 * F.abs(u))
        out[c] = F.greatest(F.round(F.col(c) + noise), F.lit(0.0)).cast("bigint")
    out.update({r: F.round(r, 2) for r in ratios})
    return df.withColumns(out)


# ---------------------------------------------------------------- missing values

def null_counts(df: DataFrame) -> DataFrame:
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in df.columns])
    return one.select(F.explode(pairs).alias("e")).select("e.*")


def impute_global(df: DataFrame, columns: Sequence[str], strategy: str = "median") -> DataFrame:
    if strategy == "mean":
        stats = df.agg(*[F.avg(c).alias(f"{c}_q0") for c in columns])
    else:
        stats = spread.quantiles(df, columns, [0.5])
    out = spread.with_global(df, stats)
    return (out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}_q0")) for c in columns})
               .drop(*[f"{c}_q0" for c in columns]))


def impute_group_median(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Median of the group, else the global median."""
    local = spread.quantiles(df, columns, [0.5], by=[group]).withColumnsRenamed({f"{c}_q0": f"{c}_g" for c in columns})
    out = spread.join_stats(df, local, [group])
    out = spread.with_global(out, spread.quantiles(df, columns, [0.5]))
    return (out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}_g"), F.col(f"{c}_q0")) for c in columns})
               .drop(*[f"{c}_g" for c in columns], *[f"{c}_q0" for c in columns]))


def impute_mode(df: DataFrame, column: str, default: str = "UNKNOWN") -> DataFrame:
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).count()
    top = counts.agg(F.min_by(F.col(column), F.struct(-F.col("count"), F.col(column))).alias("_mode"))
    return (spread.with_global(df, top)
            .withColumn(column, F.coalesce(F.col(column), F.col("_mode"), F.lit(default))).drop("_mode"))


def impute_ffill(df: DataFrame, key: str, order: str, tie: str, column: str, slice_by: str = "hour") -> DataFrame:
    """Forward, then backward fill inside a key.

    Windows run per (key, time slice); values cross slices through a table with
    one row per (key, slice).
    """
    cut = df.withColumn("_slice", F.date_trunc(slice_by, F.col(order)))
    at = F.struct(order, tie)
    edge = cut.filter(F.col(column).isNotNull()).groupBy(key, "_slice").agg(
        F.max_by(column, at).alias("_l"), F.min_by(column, at).alias("_f"))
    slots = cut.groupBy(key, "_slice").agg(F.lit(1).alias("_one")).drop("_one")
    slots = slots.join(edge, [key, "_slice"], "left")
    w = W.partitionBy(key).orderBy("_slice")
    slots = slots.select(
        key, "_slice",
        F.last("_l", True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
        F.first("_f", True).over(w.rowsBetween(1, W.unboundedFollowing)).alias("_after"))
    inside = W.partitionBy(key, "_slice").orderBy(order, tie)
    filled = F.coalesce(
        F.last(column, True).over(inside.rowsBetween(W.unboundedPreceding, 0)), F.col("_before"),
        F.first(column, True).over(inside.rowsBetween(0, W.unboundedFollowing)), F.col("_after"))
    return (cut.join(slots, [key, "_slice"]).withColumn(f"{column}_filled", filled)
               .select(*df.columns, f"{column}_filled"))


def missing_indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_missing": F.isnull(c).cast("int") for c in columns})


# ---------------------------------------------------------------- outliers

def outlier_iqr(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    q = spread.quantiles(df, [column], [0.25, 0.75])
    lo, hi = F.col(f"{column}_q0"), F.col(f"{column}_q1")
    out = spread.with_global(df, q)
    return (out.withColumn("is_outlier", (F.col(column) < lo - (hi - lo) * k) | (F.col(column) > hi + (hi - lo) * k))
               .drop(f"{column}_q0", f"{column}_q1"))


def outlier_z3(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    out = spread.with_totals(df, F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    z = (F.col(column) - F.col("_m")) / F.nullif("_s", F.lit(0.0))
    return out.withColumn("z", z).withColumn("is_outlier", F.coalesce(F.abs(z) > threshold, F.lit(False))).drop("_m", "_s")


def winsorize(df: DataFrame, columns: Sequence[str], lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    out = spread.with_global(df, spread.quantiles(df, columns, [lo, hi]))
    return (out.withColumns({f"{c}_w": clip(F.col(c).cast("double"), F.col(f"{c}_q0"), F.col(f"{c}_q1")) for c in columns})
               .drop(*[f"{c}_q{i}" for c in columns for i in (0, 1)]))


def clip_or_drop(df: DataFrame, columns: Sequence[str], method: str = "clip") -> DataFrame:
    """Clip to p1..p99 or remove rows outside; constant columns are left alone."""
    out = spread.with_global(df, spread.quantiles(df, columns, [0.01, 0.99]))
    drop = [f"{c}_q{i}" for c in columns for i in (0, 1)]
    for c in columns:
        lo, hi = F.col(f"{c}_q0"), F.col(f"{c}_q1")
        if method == "clip":
            out = out.withColumn(c, F.when(lo < hi, clip(F.col(c).cast("double"), lo, hi)).otherwise(F.col(c).cast("double")))
        else:
            out = out.filter(F.col(c).isNull() | (lo == hi) | F.col(c).between(lo, hi))
    return out.drop(*drop)


def extreme_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = spread.with_global(df, spread.quantiles(df, columns, [0.01, 0.99]))
    flags = {f"{c}_is_extreme": F.when((F.col(c) < F.col(f"{c}_q0")) | (F.col(c) > F.col(f"{c}_q1")), 1).otherwise(0)
             for c in columns}
    return out.withColumns(flags).drop(*[f"{c}_q{i}" for c in columns for i in (0, 1)])


# ---------------------------------------------------------------- encoding, scaling

UNKNOWN = "UNKNOWN"


def encoding_table(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values, ``UNKNOWN`` among them, with codes 0..n-1, numbered across range partitions."""
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias(column))
    unknown = df.sparkSession.createDataFrame([(UNKNOWN,)], f"`{column}` string")
    values = values.unionByName(unknown).distinct().withColumn("_one", F.lit(1))
    return spread.running(values, [], [column], {"code": "_one"}).select(column, F.col("code_before").alias("code"))


def label_encode(df: DataFrame, column: str, table: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """Codes from ``table`` (fitted earlier) or from ``df``; NULL and unseen values get the code of ``UNKNOWN``."""
    out = out or f"{column}_code"
    codes = spread.pin(table if table is not None else encoding_table(df, column))
    n = codes.agg(F.max(F.when(F.col(column) == UNKNOWN, F.col("code"))).alias("_n"))
    joined = spread.join_stats(df, codes, [column])
    joined = spread.with_global(joined, n)
    return joined.withColumn(out, F.coalesce("code", "_n").cast("bigint")).drop("code", "_n")


def scale_robust(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = spread.with_global(df, spread.quantiles(df, columns, [0.25, 0.5, 0.75]))
    scaled = {}
    for c in columns:
        iqr = F.col(f"{c}_q2") - F.col(f"{c}_q0")
        scaled[f"{c}_scaled"] = (F.col(c) - F.col(f"{c}_q1")) / F.when(iqr == 0, F.lit(1.0)).otherwise(iqr)
    return out.withColumns(scaled).drop(*[f"{c}_q{i}" for c in columns for i in (0, 1, 2)])


def scale_standard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    aggs = [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    out = spread.with_totals(df, *aggs)
    scaled = {f"{c}_scaled": (F.col(c) - F.col(f"_m_{c}"))
              / F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}")) for c in columns}
    return out.withColumns(scaled).drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def scale_minmax(df: DataFrame, columns: Sequence[str], constant: float = 0.0, suffix: str = "_scaled") -> DataFrame:
    aggs = [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    out = spread.with_totals(df, *aggs)
    scaled = {}
    for c in columns:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        scaled[f"{c}{suffix}"] = F.when(hi == lo, F.lit(float(constant))).otherwise((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0)))
    return out.withColumns(scaled).drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


# ---------------------------------------------------------------- fit and transform

def fit_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of p1, p25, median, p75, p99 per column: everything ``transform_with`` needs."""
    return spread.quantiles(df, columns, [0.01, 0.25, 0.5, 0.75, 0.99])


def transform_with(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Impute the median, clip to p1..p99, scale by median and IQR, all from fitted statistics."""
    out = spread.with_global(df, stats)
    done = {}
    for c in columns:
        q = [F.col(f"{c}_q{i}") for i in range(5)]
        v = clip(F.coalesce(F.col(c).cast("double"), q[2]), q[0], q[4])
        iqr = q[3] - q[1]
        done[f"{c}_scaled"] = (v - q[2]) / F.when(iqr == 0, F.lit(1.0)).otherwise(iqr)
    return out.withColumns(done).drop(*[f"{c}_q{i}" for c in columns for i in range(5)])


def feature_schema(df: DataFrame, explain: Mapping[str, str]) -> DataFrame:
    """Name, type, filled share and explanation per feature."""
    stats = df.agg(*[(F.count(c) / F.count(F.lit(1))).alias(f"n_{c}") for c in df.columns])
    rows = F.array(*[F.struct(F.lit(f.name).alias("feature"), F.lit(f.dataType.simpleString()).alias("data_type"),
                              F.lit(isinstance(f.dataType, T.NumericType)).alias("is_numeric"),
                              F.lit(explain.get(f.name, f.name.replace("_", " "))).alias("explanation"),
                              F.col(f"n_{f.name}").alias("filled_share")) for f in df.schema.fields])
    return stats.select(F.explode(rows).alias("e")).select("e.*")
