"""Quality classifier: document evidence combined with site and path posteriors by empirical Bayes.

* Evidence: a logistic model over a dozen shape features of the whole text
  (``features``), fitted by Newton steps on at most ``sample_rows`` labelled
  rows, taken in the order of a hash of ``doc_id``.
* Sites (``source``) and paths (``source``, ``lang``): expected bad documents
  are the labels where there are some and the evidence otherwise, summed by
  grouped aggregation over all rows.  The spread between sites beyond chance
  gives the weight of the global prior (moments), so a sparse site is drawn
  to the global share and a sparse path to its site.
* The score is the posterior probability of good quality: evidence relative
  to the share of the training sample, moved to the share of the path.

Defined results: a null text counts as empty; null ``source`` or ``lang`` is a
site or path of its own; repeated ids share a label (the lowest of several);
an empty table gives an empty result; without labels of both kinds nothing can
be learned and every score is 1.  Further columns are passed through.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import crc32_of, hold

FEATURES = ("log_words", "symbols", "upper", "pipes", "marks", "digits", "distinct", "repeats", "top_word",
            "word_length", "stops", "breaks")
_SYMBOLS = b"#$%&*@^~<>{}[]\\_=+`"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"


def measure(text: str | None) -> list[float]:
    """The features of one whole text; zeros for an empty one."""
    data = (text or "").encode()
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    return [math.log1p(n), (size - len(data.translate(None, _SYMBOLS))) / size,
            (size - len(data.translate(None, _UPPER))) / size, data.count(b"|") / n, data.count(b"!") / n,
            (size - len(data.translate(None, _DIGITS))) / size, len(counts) / n,
            sum(map(bytes.__eq__, words, words[1:])) / n, max(counts.values()) / n, min(size / n, 40.0) / 10,
            (data.count(b".") + data.count(b",")) / n, data.count(b"\n") / n]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features(texts: pd.Series) -> pd.Series:
    return pd.Series([measure(t) for t in texts])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> list[float]:
    """Weights (intercept first) on raw features, by damped Newton steps on standardised ones."""
    mean, spread = x.mean(0), x.std(0)
    spread[spread == 0] = 1.0
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / spread])
    w, pen = np.zeros(z.shape[1]), np.r_[0.0, np.full(x.shape[1], ridge)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - pen * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pen + 1e-9)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    raw = w[1:] / spread
    return [float(w[0] - (raw * mean).sum()), *map(float, raw)]


def logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def linear(weights: list[float], column: str) -> Column:
    return sum((F.lit(w) * F.element_at(column, i + 1) for i, w in enumerate(weights[1:])), F.lit(weights[0]))


def prior_weight(groups: DataFrame, most: float = 1e4) -> float:
    """Pseudo-count of the prior: from the variance of group shares around ``prior`` beyond binomial noise."""
    row = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("b") / F.col("n") - F.col("prior")) ** 2).alias("ss"),
                     F.sum(F.col("prior") * (1 - F.col("prior"))).alias("noise"),
                     F.avg(F.col("prior") * (1 - F.col("prior"))).alias("pq")).first()
    if not row["n"]:
        return most
    between = max(0.0, (row["ss"] - row["noise"]) / row["n"])
    return min(most, max(1.0, row["pq"] / between - 1)) if between > 0 else most


class QualityModel:
    """Fitted weights, base share and the table of path shares."""

    def __init__(self, weights: list[float] | None, base: float, paths: DataFrame | None):
        self.weights, self.base, self.paths = weights, base, paths

    def score(self, docs: DataFrame, measured: str | None = None) -> DataFrame:
        """``docs`` with ``__evidence`` (log odds of bad), ``__path_share`` and ``__score`` (probability of good).

        ``measured`` names a column of ``docs`` that holds the features already.
        """
        if self.weights is None:
            return docs.withColumns({"__evidence": F.lit(0.0), "__path_share": F.lit(0.0), "__score": F.lit(1.0)})
        seen = docs.withColumn("__features", F.col(measured) if measured else features(F.col("text").cast("string")))
        seen = seen.withColumn("__evidence", linear(self.weights, "__features")).drop("__features")
        table = self.paths.select(F.col("source").alias("__site"), F.col("lang").alias("__lang"), F.col("path_share").alias("__path_share"))
        same = F.col("source").cast("string").eqNullSafe(F.col("__site")) & F.col("lang").cast("string").eqNullSafe(F.col("__lang"))
        out = seen.join(table, same, "left").drop("__site", "__lang")
        base = math.log(self.base / (1 - self.base))
        return out.withColumn("__score", 1 - logistic(
            F.col("__evidence") - F.lit(base) + logit(F.coalesce("__path_share", F.lit(self.base)))))


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, held_out: int | None = 2) -> QualityModel:
    """Fit on ``docs`` (doc_id, text, source, lang) and ``labels`` (doc_id, quality).

    Labelled rows whose crc32 modulo 4 is ``held_out`` are used for nothing.
    """
    told = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").alias("_id")).agg(F.min("quality").alias("quality"))
    if held_out is not None:
        told = told.filter(crc32_of(F.col("_id")) % 4 != held_out)
    facts = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                        features(F.col("text").cast("string")).alias("_f"))
    facts = hold(facts.join(told, F.col("doc_id") == F.col("_id"), "left").drop("_id"), "quality")
    sample = (facts.filter(F.col("quality").isNotNull()).select("_f", (1 - F.col("quality")).alias("bad"), "doc_id")
              .orderBy(crc32_of(F.col("doc_id")), "doc_id", "_f").limit(sample_rows).toPandas())
    bad = sample["bad"].to_numpy(dtype=float)
    if not 0 < bad.sum() < len(bad):
        return QualityModel(None, 0.5, None)
    weights = fit_logistic(np.array(sample["_f"].tolist(), dtype=float), bad)
    expected = F.coalesce((1 - F.col("quality")).cast("double"), logistic(linear(weights, "_f")))
    per_path = hold(facts.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum(expected).alias("b")), "paths")
    whole = per_path.agg(F.sum("b") / F.sum("n")).first()[0]
    site = per_path.groupBy("source").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).withColumn("prior", F.lit(whole))
    k = prior_weight(site)
    site = site.select(F.col("source").alias("_s"), ((F.col("b") + k * F.lit(whole)) / (F.col("n") + k)).alias("prior"))
    path = per_path.join(site, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    k = prior_weight(path)
    path = path.select("source", "lang", ((F.col("b") + k * F.col("prior")) / (F.col("n") + k)).alias("path_share"))
    model = QualityModel(weights, float(bad.mean()), hold(path, "shares"))
    model.facts = facts
    return model


def quality(docs: DataFrame, labels: DataFrame, least: float = 0.5, **fit) -> DataFrame:
    """``doc_id, evidence, path_share, score, kept`` of every row; ``kept`` where ``score >= least``."""
    model = fit_quality(docs, labels, **fit)
    scored = model.score(docs) if model.weights is None else model.score(model.facts, "_f")
    return scored.select("doc_id", F.col("__evidence").alias("evidence"), F.col("__path_share").alias("path_share"),
                         F.col("__score").alias("score"), (F.col("__score") >= least).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **fit) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``least``."""
    scored = fit_quality(docs, labels, **fit).score(docs)
    return scored.filter(F.col("__score") >= least).select(*[F.col(f"`{c}`") for c in docs.columns])
