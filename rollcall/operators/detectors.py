"""Detectors run for real, their scores as columns for ensembles and strategies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions import spread
from rollcall.operators import density, models, neighbors, policy, scoring

# what is computed itself; every other technique is the z-score baseline
REAL = ("isolation_forest", "lof", "dbscan", "lof_share")


def detector_scores(df: DataFrame, key: str, features: Sequence[str], names: Sequence[str], k: int = 20, contamination: float = 0.1,
                    eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """``df`` with one column ``score_<name>`` in 0..1 per detector.

    ``lof`` is 1 for the rows whose factor is above the ``contamination``
    quantile, ``lof_share`` the factor from smallest to largest, ``dbscan`` 1 for
    noise, ``isolation_forest`` the forest's score, anything else the mean |z|.
    """
    out = df
    for name in dict.fromkeys(names):
        score = f"score_{name}"
        if name in ("lof", "lof_share"):
            found = spread.pin(neighbors.lof(df, key, features, k).select(F.col(key).alias("_k"), "lof"))
            if name == "lof":
                found = spread.with_global(found, spread.quantiles(found, ["lof"], [1.0 - contamination])).select(
                    "_k", (F.col("lof") > F.col("lof_q0")).cast("double").alias(score))
            else:
                found = spread.with_totals(found, F.min("lof").alias("_lo"), F.max("lof").alias("_hi")).select(
                    "_k", ((F.col("lof") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-10)).alias(score))
        elif name == "dbscan":
            found = density.dbscan(df, key, features, eps, min_samples).select(F.col(key).alias("_k"), (F.col("cluster") == -1).cast("double").alias(score))
        elif name == "isolation_forest":
            x = df.select(F.col(key).alias("_k"), F.array(*[F.col(c).cast("double") for c in features]).alias("_x"))
            found = models.isolation_forest(x, "_k", "_x", contamination=contamination).select("_k", F.col("iforest").alias(score))
        else:
            found = scoring.zscore_score(df, features, score).select(F.col(key).alias("_k"), score)
        out = out.join(found, out[key] == F.col("_k"), "left").drop("_k")
    return out


def ensemble_detectors(df: DataFrame, key: str, features: Sequence[str], weights: Mapping[str, float], **settings) -> DataFrame:
    """Every detector's score and their weighted mean; a detector without a score for a row does not count there."""
    scored = detector_scores(df, key, features, list(weights), **settings)
    return scoring.ensemble_score(scored, {f"score_{n}": w for n, w in weights.items()})


def run_strategy(df: DataFrame, key: str, strategy: str, features: Sequence[str], vigilance: str = "standard", **settings) -> DataFrame:
    """``policy.run_strategy`` with the strategy's own techniques instead of given score columns."""
    names = [n for n in policy.strategy_techniques(strategy) if n in REAL]
    scored = spread.pin(detector_scores(df, key, features, names, **settings))
    return policy.run_strategy(scored, strategy, features, vigilance, {n: F.coalesce(F.col(f"score_{n}"), F.lit(0.0)) for n in names})
