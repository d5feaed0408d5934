"""Exact likelihood of seasonal ARMA against the normal density written out, labels and fallback."""

import math

import numpy as np
import pytest

from rollcall.operators import arima, series


def covariance(terms, period, n, long=4000):
    """Autocovariances over the variance of e, from the weights of past errors."""
    found = arima.Fit(terms, 1.0, 0.0, np.zeros(1), 0.0, 0)
    psi = arima.weights(found, long, period)
    gamma = [float(psi[:long - h] @ psi[h:]) for h in range(n)]
    return np.array([[gamma[abs(i - j)] for j in range(n)] for i in range(n)])


@pytest.mark.parametrize("terms", [(0.6, -0.4, 0.0, 0.0), (-0.3, 0.5, 0.0, 0.0), (0.5, 0.3, 0.4, -0.5)])
def test_likelihood_is_the_normal_density(terms):
    w = np.random.default_rng(1).normal(size=30)
    c = covariance(terms, 4, 30)
    total, sigma2, state = arima.deviance(w, terms, 4)
    assert abs(sigma2 - w @ np.linalg.solve(c, w) / 30) < 1e-8
    assert abs(total - (30 * (math.log(2 * math.pi * sigma2) + 1) + np.linalg.slogdet(c)[1])) < 1e-6
    # what is expected next is the conditional mean given all values
    big = covariance(terms, 4, 33)
    want = big[30:, :30] @ np.linalg.solve(c, w)
    assert np.allclose(arima.ahead(arima.Fit(terms, sigma2, total, state, 0.0, 5), 3, 4), want, atol=1e-8)


def test_terms_are_found_again():
    rng = np.random.default_rng(2)
    e = rng.normal(size=700)
    w = np.zeros(700)
    for t in range(1, 700):
        w[t] = 0.7 * w[t - 1] + e[t] - 0.3 * e[t - 1]
    phi, theta, *_ = arima.fit(w, False, 12, True).terms
    assert abs(phi - 0.7) < 0.1 and abs(theta + 0.3) < 0.12


@pytest.mark.parametrize("n,label", [(23, "(1,1,1)"), (24, "(1,1,1)(1,1,1,12)"), (25, "(1,1,1)(1,1,1,12)"), (40, "(1,1,1)(1,1,1,12)")])
def test_label_names_what_was_fitted(n, label):
    y = 100 + np.random.default_rng(n).normal(size=n) * 5 + 10 * np.sin(np.arange(n) * math.pi / 6)
    r = series._forecast_series(y, 1, n >= 24, 6, 1.96)
    assert r["model"] == label and np.isfinite(r["mean"]).all() and (r["half"] > 0).all()
    assert (r["seasonal_theta"] != 0) == (n >= 24)


def test_fallback(spark):
    with pytest.raises(ValueError):
        series._forecast_series(np.array([1.0, 2.0] * 14 + [np.nan, 1.0]), 1, True, 6, 1.96)
    y = [100 + 2 * i + 9 * math.sin(i * math.pi / 6) for i in range(60)]
    r = series._fallback_series(np.array(y), 6, 1.96)
    months = spark.createDataFrame([("a", i, v) for i, v in enumerate(y)], "g string, i int, v double").selectExpr("g", "add_months(date'2000-01-01', i) m", "v")
    same = [x["predicted"] for x in series.holt_winters(months, "g", "m", "v").orderBy("period").collect()]
    assert r["model"] == "holt-winters" and np.allclose(r["mean"], same)
    assert series._fallback_series(np.array([3.0, 4.0]), 2, 1.96)["mean"].tolist() == [4.0, 4.0]
