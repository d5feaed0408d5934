"""Column expressions: classification ladders, distribution functions, text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Error-function polynomial (Abramowitz and Stegun 7.1.26).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Colour per step of the seven-step ladder.
Z_COLORS = ("#DC143C", "#FF8C00", "#FFD700", "#FFFACD", "#87CEEB", "#4169E1", "#00008B")


def lit_double(x: float) -> Column:
    return F.lit(float(x))


def ladder(x: Column, steps: Sequence[tuple[str, float, object]], other: object) -> Column:
    """First matching ``(operator, bound, label)`` step, else ``other``."""
    compare = {">": lambda b: x > b, ">=": lambda b: x >= b, "<": lambda b: x < b, "<=": lambda b: x <= b}
    out: Column | None = None
    for op, bound, label in steps:
        cond = compare[op](F.lit(float(bound)))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.when(x.isNotNull(), out.otherwise(F.lit(other)))


def normal_cdf(x: Column) -> Column:
    a = F.abs(x) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * a)
    poly = F.lit(ERF_A[4])
    for coef in reversed(ERF_A[:4]):
        poly = poly * t + F.lit(coef)
    y = F.lit(1.0) - poly * t * F.exp(-(a * a))
    return F.lit(0.5) * (F.lit(1.0) + F.when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * y)


def two_sided_p(z: Column) -> Column:
    return F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs(z)))


def classify_z(z: Column, scheme: str = "a", p: Column | None = None) -> Column:
    """The five z-score ladders under one name.

    ``a`` four classes, ``b`` seven steps, ``c`` five steps, ``d`` hotspot
    confidence names, ``e`` the same idea gated by ``p <= .05``.
    """
    if scheme == "a":
        return ladder(z, [(">", 3.0, "Anomaly"), (">", 1.96, "Hot Spot"), ("<", -1.96, "Cold Spot")], "In-Sync")
    if scheme == "b":
        return ladder(z, [(">", 2.58, "Significant Hotspot"), (">", 1.96, "Hot Spot"),
                          (">", 1.65, "Emerging Trend"), (">", -1.65, "In-Sync"),
                          (">", -1.96, "Declining"), (">", -2.58, "Cold Spot")], "High Exclusion Zone")
    if scheme == "c":
        return ladder(z, [(">", 2.58, "Significant Hotspot"), (">", 1.96, "Emerging Trend"),
                          ("<", -2.58, "Cold Spot"), ("<", -1.96, "Declining")], "In-Sync")
    if scheme == "d":
        return ladder(z, [(">", 2.576, "hotspot_99"), ("<", -2.576, "coldspot_99"),
                          (">", 1.96, "hotspot_95"), ("<", -1.96, "coldspot_95"),
                          (">", 1.645, "hotspot_90"), ("<", -1.645, "coldspot_90")], "not_significant")
    if scheme == "e":
        gate = p if p is not None else two_sided_p(z)
        step = ladder(F.abs(z), [(">=", 2.58, "99"), (">=", 1.96, "95"), (">=", 1.65, "90")], "0")
        side = F.when(z > 0, F.lit("hotspot_")).otherwise(F.lit("coldspot_"))
        return (F.when(z.isNull(), F.lit(None))
                 .when((gate <= 0.05) & (step != "0"), F.concat(side, step))
                 .otherwise(F.lit("not_significant")))
    raise ValueError(f"unknown ladder {scheme!r}")


def confidence_b(z: Column) -> Column:
    return ladder(z, [(">", 2.58, "99%"), (">", 1.96, "95%"), (">", 1.65, "90%"), (">", -1.65, "N/A"),
                      (">", -1.96, "90%"), (">", -2.58, "95%")], "99%")


def z_color(z: Column) -> Column:
    bounds = (2.58, 1.96, 1.65, -1.65, -1.96, -2.58)
    return ladder(z, [(">", b, c) for b, c in zip(bounds, Z_COLORS)], Z_COLORS[-1])


def value_color(v: Column, lo: Column, hi: Column) -> Column:
    """Red to yellow to green."""
    n = F.when(hi == lo, F.lit(0.5)).otherwise((v - lo) / F.nullif(hi - lo, F.lit(0.0)))
    red = F.when(n < 0.5, F.lit(255)).otherwise((F.lit(255.0) * (F.lit(2.0) - n * 2.0)).cast("int"))
    green = F.when(n < 0.5, (F.lit(255.0) * (n * 2.0)).cast("int")).otherwise(F.lit(255))
    two = lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")
    return F.concat(F.lit("#"), two(red), two(green), F.lit("00"))


def risk_level(s: Column) -> Column:
    return ladder(s, [(">=", 0.75, "Critical"), (">=", 0.6, "High")], "Moderate")


def risk_category(s: Column) -> Column:
    """Right-closed bins from 0; NULL outside (0, 1]."""
    return (F.when((s <= 0) | (s > 1), F.lit(None)).when(s <= 0.3, "Low").when(s <= 0.6, "Medium")
             .when(s <= 0.8, "High").when(s <= 1.0, "Critical"))


def gender_risk_level(ratio: Column) -> Column:
    return ladder(ratio, [("<", 0.40, "CRITICAL"), ("<", 0.44, "HIGH"), ("<", 0.46, "MODERATE")], "LOW")


def inclusion_risk_level(score: Column) -> Column:
    return ladder(score, [("<", 40, "CRITICAL"), ("<", 60, "HIGH"), ("<", 80, "MODERATE")], "LOW")


def anomaly_label(s: Column) -> Column:
    return ladder(s, [("<", 0.3, "Normal"), ("<", 0.7, "Suspicious")], "Highly Suspicious")


def band(s: Column, high: float = 0.8, medium: float = 0.5, closed: bool = True) -> Column:
    """Three risk bands; ``closed`` chooses >= or > at the cuts."""
    op = ">=" if closed else ">"
    return ladder(s, [(op, high, "high"), (op, medium, "medium")], "low")


def format_rupees(x: Column) -> Column:
    return (F.when(x >= 1e7, F.format_string("%.2f Cr", x / 1e7))
             .when(x >= 1e5, F.format_string("%.2f L", x / 1e5))
             .when(x >= 1e3, F.format_string("%.1f K", x / 1e3))
             .otherwise(F.format_string("%.0f", x)))


def format_short(x: Column, precision: int = 2) -> Column:
    f = f"%.{precision}f"
    return (F.when(F.abs(x) >= 1e6, F.format_string(f + "M", x / 1e6))
             .when(F.abs(x) >= 1e3, F.format_string(f + "K", x / 1e3))
             .otherwise(F.format_string(f, x)))


def clip(x: Column, lo: float | Column, hi: float | Column) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(x.isNotNull(), F.greatest(F.least(x, hi), lo))


def log_scale(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x) * 1000.0)


def truncate_text(c: Column, n: int = 100) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 3)), F.lit("..."))).otherwise(c)


def flatten_struct(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs to ``a_b`` columns, walking the schema."""

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out: list[Column] = []
        for f in schema.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here)))
        return out

    return df.select(*leaves(df.schema, ()))


def array_mean(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr)


def moment(arr: Column, mean: Column, k: int) -> Column:
    """k-th central moment of an array column (population)."""
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + F.pow(x - mean, F.lit(float(k)))) / F.size(arr)
