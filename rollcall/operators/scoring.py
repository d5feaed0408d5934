"""Risk and anomaly scores, labels, and what follows from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import spread
from rollcall.functions.scalar import clip, gender_risk_level, risk_level


def zscore_score(df: DataFrame, features: Sequence[str], out: str = "score") -> DataFrame:
    """Mean |z| over the features (population std), scaled to 0..1 over the table."""
    z = spread.with_totals(df, *[f(c).alias(f"_{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    mean_abs = reduce(lambda a, b: a + b, [
        F.coalesce(F.abs((F.col(c) - F.col(f"_m_{c}")) / F.nullif(f"_s_{c}", F.lit(0.0))), F.lit(0.0)) for c in features])
    z = z.withColumn("_c", mean_abs / float(len(features)))
    z = spread.with_totals(z, F.min("_c").alias("_lo"), F.max("_c").alias("_hi"))
    return (z.withColumn(out, (F.col("_c") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-10))
             .select(*df.columns, out))


def biometric_risk_score(df: DataFrame, days: Column, month: Column, quality: bool = True) -> DataFrame:
    """Weighted risk in 0..1 from update age, update ratios, age mix, place and season.

    With ``quality=False`` the last ten percent come from the min-max scaled
    ``update_frequency`` instead of ``centre_quality_score``.
    """
    part = lambda c, d: F.coalesce(clip(F.col(c), 0, 1), F.lit(float(d)))
    if quality:
        tenth = 1.0 - part("centre_quality_score", 0.5)
    else:
        df = spread.with_totals(df, F.min("update_frequency").alias("_lo"), F.max("update_frequency").alias("_hi"))
        tenth = 1.0 - (F.col("update_frequency") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-6)
    score = (F.lit(0.3) + clip(F.coalesce(days, F.lit(365)) / 730.0, 0, 1) * 0.25
             + (1.0 - part("biometric_update_ratio", 0.5)) * 0.20 + part("elderly_ratio", 0) * 0.20
             + part("age_65_plus_ratio", 0) * 0.05 + F.coalesce("is_high_risk_state", F.lit(0)) * 0.10
             + (1.0 - part("demographic_update_ratio", 0.5)) * 0.10 + tenth * 0.10
             + F.when(month.isin(6, 7, 8, 9), 0.05).otherwise(0.0))
    return df.withColumn("risk_score", clip(score, 0, 1)).drop("_lo", "_hi")


def proxy_risk(df: DataFrame) -> DataFrame:
    s = (F.col("is_high_risk_state") * 0.3 + (1.0 - F.col("biometric_update_ratio")) * 0.4 + F.col("adult_ratio") * 0.3)
    return df.withColumn("proxy_risk", s)


def high_risk_regions(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    factors = F.array_compact(F.array(
        F.when(F.col("biometric_update_ratio") < 0.3, F.lit("Low biometric update rate")),
        F.when(F.col("elderly_ratio") > 0.2, F.lit("High elderly population")),
        F.when(F.col("is_high_risk_state") == 1, F.lit("Known high-risk state")),
        F.when(F.col("demographic_update_ratio") < 0.3, F.lit("Low demographic update rate"))))
    return (df.filter(F.col("risk_score") >= threshold).withColumn("risk_level", risk_level(F.col("risk_score")))
              .withColumn("factors", factors).orderBy(F.desc("risk_score"), "state"))


def gender_risk(df: DataFrame, threshold: float = 0.46) -> DataFrame:
    """Districts below the female coverage threshold with a composite score."""
    r, gap, women = F.col("female_ratio"), F.col("gender_gap"), F.col("female")
    score = F.round(F.greatest(F.lit(0.0), (0.50 - r) * 100.0) * 0.4 + F.greatest(F.lit(0.0), gap * 100.0) * 0.3
                    + F.least(F.lit(10.0), 10.0 - F.log10(women + 1)) * 0.2 + 0.5)
    level = gender_risk_level(r)
    rank = F.create_map(*[F.lit(x) for kv in {"CRITICAL": 1, "HIGH": 2, "MODERATE": 3, "LOW": 4}.items() for x in kv])
    return (df.filter(r < threshold).withColumn("risk_score", score.cast("bigint")).withColumn("risk_level", level)
              .withColumn("priority", rank[F.col("risk_level")]))


def gender_label(df: DataFrame, ratio: str, threshold: float | None = 0.85, percentile: float = 0.15) -> DataFrame:
    """1 when coverage is below a fixed threshold, or below a percentile of the table."""
    if threshold is not None:
        return df.withColumn("label", (F.col(ratio) < threshold).cast("int"))
    q = spread.quantiles(df, [ratio], [percentile])
    return spread.with_global(df, q).withColumn("label", (F.col(ratio) < F.col(f"{ratio}_q0")).cast("int")).drop(f"{ratio}_q0")


def risk_label(df: DataFrame, score: str, threshold: float = 0.6) -> DataFrame:
    """score >= threshold; when that gives one class only, score >= median."""
    ends = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    med = spread.quantiles(df, [score], [0.5])
    out = spread.with_global(spread.with_global(df, ends), med)
    one_class = (F.col("_lo") >= threshold) | (F.col("_hi") < threshold)
    cut = F.when(one_class, F.col(f"{score}_q0")).otherwise(F.lit(float(threshold)))
    return out.withColumn("label", (F.col(score) >= cut).cast("int")).drop("_lo", "_hi", f"{score}_q0")


def target_shortfall(df: DataFrame, ratio: str, women: str, target: float) -> DataFrame:
    gap = F.when(F.col(ratio) < target, F.col(women) * (F.lit(target) - F.col(ratio)) / F.nullif(ratio, F.lit(0.0))).otherwise(0.0)
    return df.withColumn("shortfall", gap)


def ensemble_score(df: DataFrame, weights: Mapping[str, float], out: str = "ensemble") -> DataFrame:
    """Weighted mean over the scores present in a row (weights renormalised)."""
    num = reduce(lambda a, b: a + b, [F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()])
    den = reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in weights.items()])
    return df.withColumn(out, num / F.nullif(den, F.lit(0.0)))


def ensemble_vote(df: DataFrame, scores: Sequence[str], method: str = "voting", out: str = "combined") -> DataFrame:
    """voting = share of scores >= .5, stacking = largest, averaging = mean."""
    cols = [F.col(c) for c in scores]
    if method == "voting":
        v = reduce(lambda a, b: a + b, [(c >= 0.5).cast("double") for c in cols]) / float(len(cols))
    elif method == "stacking":
        v = F.greatest(*cols) if len(cols) > 1 else cols[0]
    else:
        v = reduce(lambda a, b: a + b, cols) / float(len(cols))
    return df.withColumn(out, v)


# ---------------------------------------------------------------- model bookkeeping

def model_selection(profile: DataFrame) -> DataFrame:
    """Detectors that suit a data profile."""
    complex_ = F.col("complexity").isin("medium", "high") | F.col("has_temporal")
    models = F.array_compact(F.array(F.lit("isolation_forest"), F.when(complex_, F.lit("autoencoder")),
                                     F.when(F.col("has_geo") | (F.col("n") > 100), F.lit("hdbscan"))))
    return profile.withColumn("models", models)


def balance_classes(df: DataFrame, label: str) -> DataFrame:
    """Weight n / (k * n_c) per row."""
    g = spread.pin(df.groupBy(label).agg(F.count(F.lit(1)).alias("_c")))
    g = spread.with_totals(g, F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    g = g.select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("weight"))
    return spread.join_stats(df, g, [label])


def confusion_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    y, p = F.col(label) == 1, F.col(prediction) == 1
    g = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    div = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    g = g.withColumn("accuracy", div(tp + tn, tp + fp + tn + fn)).withColumn("precision", div(tp, tp + fp)).withColumn("recall", div(tp, tp + fn))
    return g.withColumn("f1", F.coalesce(F.col("precision") * F.col("recall") * 2.0 / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def roc_pr_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """One point per distinct score, from exact running counts over range partitions."""
    g = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) != 1).alias("_n")).withColumn("_neg", -F.col(score))
    r = spread.running(g, [], ["_neg"], {"pos": "_p", "all_neg": "_n"})
    tp, fp = F.col("pos_before") + F.col("_p"), F.col("all_neg_before") + F.col("_n")
    return r.select(F.col(score).alias("threshold"), tp.alias("tp"), fp.alias("fp"), (tp / F.nullif("pos_all", F.lit(0))).alias("tpr"),
                    (fp / F.nullif("all_neg_all", F.lit(0))).alias("fpr"), (tp / (tp + fp)).alias("precision"), "_p", "_n", "pos_before", "pos_all", "all_neg_all")


def roc_pr_auc(points: DataFrame) -> DataFrame:
    """Area under both curves: trapezoids of the ROC, step sum of the PR curve."""
    area = F.sum(F.col("_n") * (F.col("pos_before") + F.col("_p") / 2.0)) / F.max(F.col("pos_all") * F.col("all_neg_all"))
    return points.agg(area.alias("roc_auc"), (F.sum(F.col("_p") * F.col("precision")) / F.max("pos_all")).alias("pr_auc"), F.count(F.lit(1)).alias("points"))


def importance_merge(df: DataFrame) -> DataFrame:
    """Mean over models of importances scaled by each model's largest."""
    top = df.groupBy("model").agg(F.max("importance").alias("_m"))
    out = df.join(top, "model").withColumn("_s", F.col("importance") / F.nullif("_m", F.lit(0.0)))
    return out.groupBy("feature").agg(F.avg(F.coalesce("_s", F.lit(0.0))).alias("importance"), F.count(F.lit(1)).alias("models"))


def linear_contribution(df: DataFrame, coefs: Mapping[str, float], k: int = 3) -> DataFrame:
    """Additive drivers coef * (x - mean) per row, the k largest first."""
    out = spread.with_totals(df, *[F.avg(c).alias(f"_m_{c}") for c in coefs])
    parts = F.array(*[F.struct(((F.col(c) - F.col(f"_m_{c}")) * float(w)).alias("value"), F.lit(c).alias("feature")) for c, w in coefs.items()])
    ordered = F.array_sort(parts, lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1).when(F.abs(a["value"]) < F.abs(b["value"]), 1)
                           .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0))
    total = reduce(lambda a, b: a + b, [(F.col(c) - F.col(f"_m_{c}")) * float(w) for c, w in coefs.items()])
    return (out.withColumn("total_contribution", total).withColumn("drivers", F.slice(ordered, 1, k)).drop(*[f"_m_{c}" for c in coefs]))


def global_contribution(df: DataFrame, coefs: Mapping[str, float]) -> DataFrame:
    """Mean |contribution| per feature."""
    out = spread.with_totals(df, *[F.avg(c).alias(f"_m_{c}") for c in coefs])
    one = out.agg(*[F.avg(F.abs((F.col(c) - F.col(f"_m_{c}")) * float(w))).alias(c) for c, w in coefs.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean_abs")) for c in coefs])
    return one.select(F.explode(rows).alias("e")).select("e.*")
