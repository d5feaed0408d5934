"""Time series per region: long tables (group, date, value), bounded by the number of periods."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rollcall.functions import spread
from rollcall.operators import arima
from rollcall.operators.ordering import halves_trend, sma_centered

# 5 % critical values (Dickey-Fuller with constant; chi-square with 10 and 2 degrees).
DF_CRITICAL = -2.86
CHI2_10 = 18.307
CHI2_2 = 5.991


def series_by_group(df: DataFrame, group: str, date: str, value: str, min_points: int = 10) -> DataFrame:
    s = df.groupBy(group, date).agg(F.sum(value).alias("value"))
    return s.withColumn("points", F.count(F.lit(1)).over(W.partitionBy(group))).filter(F.col("points") >= min_points)


def indexed(df: DataFrame, group: str, date: str) -> DataFrame:
    return df.withColumn("idx", F.row_number().over(W.partitionBy(group).orderBy(date)) - 1)


def decompose_seasonal(df: DataFrame, group: str, date: str, value: str, period: int = 12) -> DataFrame:
    """Trend (centred mean), seasonal means, residual; short series keep their values as trend."""
    s = indexed(sma_centered(df, group, date, value, period, "_t"), group, date)
    g = W.partitionBy(group)
    enough = F.count(F.lit(1)).over(g) >= 2 * period
    s = s.withColumn("_ok", enough).withColumn("trend", F.when(F.col("_ok"), F.col("_t")).otherwise(F.col(value).cast("double")))
    s = s.withColumn("_slot", F.col("idx") % period).withColumn("_d", F.col(value) - F.col("trend"))
    slots = s.groupBy(group, "_slot").agg(F.avg("_d").alias("_a"))
    slots = slots.withColumn("_a", F.col("_a") - F.avg("_a").over(W.partitionBy(group)))
    s = s.join(slots, [group, "_slot"]).withColumn("seasonal", F.when(F.col("_ok"), F.col("_a")).otherwise(0.0))
    s = s.withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal"))
    has = F.col("_ok") & (F.stddev_pop("seasonal").over(g) > F.stddev_pop("residual").over(g) * 0.5)
    return s.withColumn("has_seasonality", has).drop("_t", "_ok", "_slot", "_d", "_a")


def series_anomalies(df: DataFrame, group: str, date: str, value: str, threshold: float = 2.0, min_points: int = 5) -> DataFrame:
    g = W.partitionBy(group)
    s = (df.withColumn("_m", F.avg(value).over(g)).withColumn("_s", F.stddev_pop(value).over(g)).withColumn("_n", F.count(F.lit(1)).over(g))
           .filter(F.col("_n") >= min_points))
    z = F.coalesce((F.col(value) - F.col("_m")) / F.nullif("_s", F.lit(0.0)), F.lit(0.0))
    s = s.withColumn("z", z).filter(F.abs("z") >= threshold)
    sev = F.when(F.abs("z") >= 3, "critical").when(F.abs("z") >= 2.5, "high").otherwise("medium")
    return (s.withColumn("severity", sev).withColumn("direction", F.when(F.col("z") > 0, "above_expected").otherwise("below_expected"))
             .withColumn("deviation", F.col(value) - F.col("_m"))
             .withColumn("pct_deviation", (F.col(value) - F.col("_m")) * 100.0 / F.nullif("_m", F.lit(0.0))).drop("_m", "_s", "_n"))


def linear_trend(df: DataFrame, group: str, date: str, value: str, min_points: int = 3) -> DataFrame:
    """Least squares on the point index; R2 is 0 for a flat series."""
    s = indexed(df, group, date)
    y, x = F.col(value).cast("double"), F.col("idx").cast("double")
    g = s.groupBy(group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                             F.when(F.var_pop(y) == 0, F.lit(0.0)).otherwise(F.regr_r2(y, x)).alias("r2"),
                             F.count(F.lit(1)).alias("points"), F.max(date).alias("last_date"), F.max_by(value, date).alias("current_value"))
    direction = F.when(F.col("slope") > 0.01, "increasing").when(F.col("slope") < -0.01, "decreasing").otherwise("stable")
    return g.filter(F.col("points") >= min_points).withColumn("direction", direction)


def project_trend(trend: DataFrame, periods: int = 6) -> DataFrame:
    out = trend.withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    return (out.withColumn("date", F.add_months("last_date", F.col("period")))
               .withColumn("predicted", F.col("slope") * (F.col("points") + F.col("period") - 1) + F.col("intercept")))


def regional_trends(df: DataFrame, group: str, date: str, value: str) -> DataFrame:
    t = linear_trend(df, group, date, value)
    t = t.withColumn("projected_3m", F.col("slope") * (F.col("points") + 2) + F.col("intercept"))
    t = spread.with_totals(t, *[F.count_if(F.col("direction") == n).alias(f"n_{n}") for n in ("increasing", "stable", "decreasing")])
    return t.orderBy(F.when(F.col("direction") == "decreasing", 0).otherwise(1), "slope", group)


def ma_trend_forecast(df: DataFrame, group: str, date: str, value: str, periods: int = 6, min_points: int = 3) -> DataFrame:
    """Recent mean plus halves trend per step; band 15 % times sqrt of the step; never below 0."""
    t = halves_trend(df, group, date, value).filter(F.col("points") >= min_points)
    out = t.withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    p = F.col("mean_recent") + F.col("trend") * F.col("period")
    width = p * 0.15 * F.sqrt(F.col("period").cast("double"))
    floor0 = lambda c: F.greatest(F.lit(0.0), c)
    return out.select(group, "period", F.add_months("last_date", F.col("period")).alias("date"), floor0(p).alias("predicted"),
                      floor0(p - width).alias("lower"), floor0(p + width).alias("upper"))


def curve_forecast(df: DataFrame, key: str, value: str, as_of: str, months: int = 6, season: float = 0.02, ci: float = 0.03,
                   ci_step: float = 0.15, growth: float = 0.008, z: str | None = None) -> DataFrame:
    """Fixed growth and season curve from the current value; the z variant lifts hotspots a little."""
    out = df.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(months - 1))))
    ahead = F.date_add(F.to_date(F.lit(as_of)), (F.col("step") + 1) * 30)
    p = F.col(value) * (1.0 + growth * (F.col("step") + 1)) * (1.0 + F.sin(F.lit(2 * math.pi) * F.month(ahead) / 12.0) * season)
    if z:
        p = p * (1.0 + F.col(z) * 0.002)
    width = p * ci * (1.0 + F.col("step") * ci_step)
    return out.select(key, F.date_format(ahead, "yyyy-MM").alias("month"), p.alias("predicted"), (p - width).alias("lower"), (p + width).alias("upper"))


def adf_stationarity(df: DataFrame, group: str, date: str, value: str) -> DataFrame:
    """Dickey-Fuller regression of the change on the previous level; d = 0 when clearly negative."""
    w = W.partitionBy(group).orderBy(date)
    s = df.withColumn("_p", F.lag(F.col(value).cast("double")).over(w)).withColumn("_d", F.col(value) - F.col("_p")).filter("_p is not null")
    g = s.groupBy(group).agg(F.corr("_d", "_p").alias("_r"), F.count(F.lit(1)).alias("n"))
    t = F.col("_r") * F.sqrt((F.col("n") - 2) / F.nullif(1.0 - F.col("_r") * F.col("_r"), F.lit(0.0)))
    return (g.withColumn("t_stat", t).withColumn("is_stationary", F.coalesce(F.col("t_stat") < DF_CRITICAL, F.lit(False)))
             .withColumn("d", F.when(F.col("is_stationary"), 0).otherwise(1)).drop("_r"))


# ---------------------------------------------------------------- fitted models

def _forecast_series(y: np.ndarray, d: int, seasonal: bool, periods: int, z: float, period: int = 12) -> dict[str, np.ndarray | float]:
    """Difference, fit by exact likelihood, forecast, integrate back; variance from the psi weights."""
    levels = [np.asarray(y, dtype=float)]
    steps: list[int] = []
    for s in ([period] if seasonal else []) + [1] * d:
        levels.append(levels[-1][s:] - levels[-1][:-s])
        steps.append(s)
    found = arima.fit(levels[-1], seasonal, period, centre=len(steps) < 2)
    path = arima.ahead(found, periods, period)
    psi = arima.weights(found, periods, period)
    for s, lev in zip(reversed(steps), reversed(levels[:-1])):
        tail = list(lev)
        for v in path:
            tail.append(tail[-s] + v)
        path = np.array(tail[len(lev):])
    for s in steps:
        for j in range(s, periods):
            psi[j] += psi[j - s]
    if not np.isfinite(path).all():
        raise ValueError("no finite forecast")
    phi, theta, sphi, stheta = found.terms
    aic = found.deviance + 2 * found.free
    return {"mean": path, "half": z * np.sqrt(found.sigma2 * np.cumsum(psi ** 2)), "aic": aic if math.isfinite(aic) else None, "phi": phi, "theta": theta,
            "seasonal_phi": sphi, "seasonal_theta": stheta, "model": f"(1,{d},1)" + (f"(1,1,1,{period})" if seasonal else "")}


def _fallback_series(y: np.ndarray, periods: int, z: float, period: int = 12, alpha: float = 0.3, beta: float = 0.05, gamma: float = 0.1) -> dict:
    """Additive level, trend and season where nothing could be fitted; the last value of a series too short for that."""
    y = np.asarray(y, dtype=float)
    none = {"aic": None, "phi": None, "theta": None, "seasonal_phi": None, "seasonal_theta": None}
    if len(y) < 2 * period:
        spread_ = float(np.std(np.diff(y))) if len(y) > 1 else 0.0
        return {"mean": np.full(periods, y[-1]), "half": z * spread_ * np.sqrt(np.arange(1, periods + 1)), "model": "last-value", **none}
    level, slope = y[:period].mean(), (y[period:2 * period].mean() - y[:period].mean()) / period
    season, errors = list(y[:period] - level), []
    for v in y[period:]:
        old = season.pop(0)
        errors.append(v - (level + slope + old))
        last = level
        level = (v - old) * alpha + (level + slope) * (1 - alpha)
        slope = (level - last) * beta + slope * (1 - beta)
        season.append((v - level) * gamma + old * (1 - gamma))
    steps = np.arange(1, periods + 1)
    return {"mean": level + slope * steps + np.array([season[(i - 1) % period] for i in steps]), "half": z * float(np.std(errors)) * np.sqrt(steps),
            "model": "holt-winters", **none}


# Two-sided normal quantiles.
Z_OF_LEVEL = {0.8: 1.2816, 0.9: 1.6449, 0.95: 1.9600, 0.99: 2.5758}

FORECAST_SCHEMA = "grp string, period int, predicted double, lower double, upper double, aic double, phi double, theta double, seasonal_phi double, seasonal_theta double, model string"


def _forecast(df: DataFrame, group: str, date: str, value: str, periods: int, level: float, min_points: int, seasonal: bool) -> DataFrame:
    z = Z_OF_LEVEL[level]
    s = series_by_group(df, group, date, value, min_points).select(F.col(group).cast("string").alias("grp"), F.col(date).alias("at"), "value")
    d = adf_stationarity(s, "grp", "at", "value").select("grp", "d")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        y = pdf["value"].to_numpy(dtype=float)
        use_season = seasonal and len(y) >= 24
        diff = 1 if seasonal else int(pdf["d"].iloc[0])
        try:
            r = _forecast_series(y, diff, use_season, periods, z)
        except (ValueError, ArithmeticError, np.linalg.LinAlgError):
            r = _fallback_series(y, periods, z)
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "period": range(1, periods + 1), "predicted": np.maximum(r["mean"], 0.0),
                             "lower": np.maximum(r["mean"] - r["half"], 0.0), "upper": np.maximum(r["mean"] + r["half"], 0.0),
                             **{c: r[c] for c in ("aic", "phi", "theta", "seasonal_phi", "seasonal_theta", "model")}})

    # few rows but long work: a given number of partitions is not put together again
    dealt = s.join(d, "grp").repartition(spread.shuffle_parts(df.sparkSession), "grp")
    return dealt.groupBy("grp").applyInPandas(run, FORECAST_SCHEMA).withColumnRenamed("grp", group)


def arima_forecast(df: DataFrame, group: str, date: str, value: str, periods: int = 6, level: float = 0.95, min_points: int = 10) -> DataFrame:
    """ARIMA(1,d,1) per group by exact likelihood, d from the Dickey-Fuller check; the last value where nothing can be fitted."""
    return _forecast(df, group, date, value, periods, level, min_points, seasonal=False)


def sarima_forecast(df: DataFrame, group: str, date: str, value: str, periods: int = 6, level: float = 0.95, min_points: int = 10) -> DataFrame:
    """(1,1,1)(1,1,1,12) per group from 24 points on, (1,1,1) below, by exact likelihood; Holt-Winters where that fails.

    The label names the terms that were fitted.
    """
    return _forecast(df, group, date, value, periods, level, min_points, seasonal=True)


def _ordered_values(df: DataFrame, group: str, date: str, value: str) -> DataFrame:
    """The values of a group as one ordered array (one entry per period)."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(date).alias("t"), F.col(value).cast("double").alias("v"))))
    return df.groupBy(group).agg(F.transform(pairs, lambda s: s["v"]).alias("ys"), F.max(date).alias("last_date"))


def exp_smooth(df: DataFrame, group: str, date: str, value: str, alpha: float = 0.3) -> DataFrame:
    a = _ordered_values(df, group, date, value)
    level = F.aggregate(F.slice("ys", 2, F.greatest(F.size("ys") - 1, F.lit(0))), F.element_at("ys", 1), lambda s, x: s * (1 - alpha) + x * alpha)
    return a.select(group, level.alias("level"), F.size("ys").alias("points"))


def holt_winters(df: DataFrame, group: str, date: str, value: str, periods: int = 6, period: int = 12,
                 alpha: float = 0.3, beta: float = 0.05, gamma: float = 0.1) -> DataFrame:
    """Additive level, trend and season, folded over the ordered values of a group (two periods at least)."""
    a = _ordered_values(df, group, date, value).filter(F.size("ys") >= 2 * period)
    mean_of = lambda start: F.aggregate(F.slice("ys", start, period), F.lit(0.0), lambda s, x: s + x) / float(period)
    a = a.withColumn("_l", mean_of(1)).withColumn("_b", (mean_of(period + 1) - mean_of(1)) / float(period))
    start = F.struct(F.col("_l").alias("l"), F.col("_b").alias("b"), F.transform(F.slice("ys", 1, period), lambda x: x - F.col("_l")).alias("s"))

    def step(st: Column, x: Column) -> Column:
        old = F.element_at(st["s"], 1)
        lev = (x - old) * alpha + (st["l"] + st["b"]) * (1 - alpha)
        slope = (lev - st["l"]) * beta + st["b"] * (1 - beta)
        season = (x - lev) * gamma + old * (1 - gamma)
        return F.struct(lev.alias("l"), slope.alias("b"), F.concat(F.slice(st["s"], 2, period - 1), F.array(season)).alias("s"))

    folded = F.aggregate(F.slice("ys", period + 1, F.size("ys") - period), start, step)
    out = a.select(group, "last_date", folded.alias("st")).withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    pred = F.col("st.l") + F.col("st.b") * F.col("period") + F.element_at("st.s", ((F.col("period") - 1) % period + 1).cast("int"))
    return out.select(group, "period", F.add_months("last_date", F.col("period")).alias("date"), F.greatest(F.lit(0.0), pred).alias("predicted"))


# ---------------------------------------------------------------- diagnostics

def trend_fit(df: DataFrame, group: str, date: str, value: str) -> DataFrame:
    """Actual, fitted and the 95 % band of the linear trend, per point."""
    t = linear_trend(df, group, date, value).select(group, "slope", "intercept")
    s = indexed(df, group, date).join(t, group)
    s = s.select(group, date, F.col(value).cast("double").alias("actual"), (F.col("slope") * F.col("idx") + F.col("intercept")).alias("fitted"))
    s = s.withColumn("residual", F.col("actual") - F.col("fitted"))
    sd = F.stddev_samp("residual").over(W.partitionBy(group))
    return s.withColumn("lower", F.col("fitted") - sd * 1.96).withColumn("upper", F.col("fitted") + sd * 1.96)


def fit_metrics(fit: DataFrame, group: str) -> DataFrame:
    e, a = F.col("actual") - F.col("fitted"), F.col("actual")
    return fit.groupBy(group).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.when(a != 0, F.abs(e / F.nullif(a, F.lit(0.0))))) * 100.0).alias("mape"),
        (F.avg(a.between(F.col("lower"), F.col("upper")).cast("double")) * 100.0).alias("ci_coverage"),
        F.count(F.lit(1)).alias("points"))


def residual_stats(fit: DataFrame, group: str) -> DataFrame:
    return fit.groupBy(group).agg(F.avg("residual").alias("mean"), F.stddev_samp("residual").alias("std"), F.skewness("residual").alias("skew"),
                                  F.kurtosis("residual").alias("kurtosis"), F.count(F.lit(1)).alias("n"))


def acf(df: DataFrame, group: str, date: str, value: str, max_lag: int = 20) -> DataFrame:
    """Autocorrelations for lags up to min(max_lag, n/2 - 1), all from one window pass."""
    w = W.partitionBy(group).orderBy(date)
    s = df.withColumn("_z", F.col(value) - F.avg(value).over(W.partitionBy(group)))
    s = s.select(group, "_z", *[(F.col("_z") * F.lag("_z", k).over(w)).alias(f"_c{k}") for k in range(1, max_lag + 1)])
    g = s.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_z") * F.col("_z")).alias("_den"),
                             *[F.sum(f"_c{k}").alias(f"_c{k}") for k in range(1, max_lag + 1)])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_c{k}").alias("c")) for k in range(1, max_lag + 1)])
    out = g.select(group, "n", "_den", F.explode(rows).alias("e"))
    return (out.filter(F.col("e.lag") <= F.floor(F.col("n") / 2) - 1)
               .select(group, F.col("e.lag").alias("lag"), (F.col("e.c") / F.nullif("_den", F.lit(0.0))).alias("acf"),
                       (F.lit(1.96) / F.sqrt("n")).alias("band"), "n"))


def pacf(df: DataFrame, group: str, date: str, value: str, max_lag: int = 20) -> DataFrame:
    """Partial autocorrelations from the autocorrelations (Durbin-Levinson)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        r = np.concatenate([[1.0], pdf["acf"].to_numpy(dtype=float)])
        phi = np.zeros(0)
        out = []
        for k in range(1, len(r)):
            num = r[k] - (phi @ r[k - 1:0:-1] if k > 1 else 0.0)
            den = 1.0 - (phi @ r[1:k] if k > 1 else 0.0)
            last = num / den if den else 0.0
            phi = np.append(phi - last * phi[::-1], last)
            out.append(last)
        return pd.DataFrame({"grp": pdf["grp"], "lag": pdf["lag"], "pacf": out})

    a = acf(df, group, date, value, max_lag).select(F.col(group).cast("string").alias("grp"), "lag", "acf")
    return a.groupBy("grp").applyInPandas(run, "grp string, lag int, pacf double").withColumnRenamed("grp", group)


def ljung_box(df: DataFrame, group: str, date: str, value: str, lags: int = 10) -> DataFrame:
    a = acf(df, group, date, value, lags)
    q = a.groupBy(group).agg((F.max(F.col("n") * (F.col("n") + 2.0)) * F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag")))).alias("q"))
    return q.withColumn("no_autocorrelation", F.col("q") < CHI2_10)


def normality_check(stats: DataFrame) -> DataFrame:
    jb = F.col("n") / 6.0 * (F.col("skew") * F.col("skew") + F.col("kurtosis") * F.col("kurtosis") / 4.0)
    return stats.withColumn("jarque_bera", jb).withColumn("is_normal", F.col("jarque_bera") < CHI2_2)


def diagnostics_table(df: DataFrame, group: str, date: str, value: str) -> DataFrame:
    """One row per group: errors, residual shape, autocorrelation and normality checks, by RMSE."""
    fit = trend_fit(df, group, date, value)
    out = (fit_metrics(fit, group).join(normality_check(residual_stats(fit, group)).drop("n"), group)
           .join(ljung_box(fit, group, date, "residual"), group, "left").join(adf_stationarity(df, group, date, value).drop("n"), group, "left"))
    return out.orderBy("rmse", group)


def survival_curve(df: DataFrame, score: str = "risk_score", base: float = 0.001, last_day: int = 1825, step: int = 30) -> DataFrame:
    """S(t) = exp(-lambda t) for all rows, and for the low and high risk groups when present."""
    one = df.agg(F.avg(score).alias("m"), F.count_if(F.col(score) < 0.4).alias("lo"), F.count_if(F.col(score) >= 0.6).alias("hi"))
    rows = F.array(F.struct(F.lit("overall").alias("curve"), (F.lit(base) * (1.0 + F.col("m") * 2.0)).alias("rate"), F.lit(1).cast("bigint").alias("n")),
                   F.struct(F.lit("low_risk").alias("curve"), F.lit(base * 0.5).alias("rate"), F.col("lo").alias("n")),
                   F.struct(F.lit("high_risk").alias("curve"), F.lit(base * 3).alias("rate"), F.col("hi").alias("n")))
    out = one.select(F.explode(rows).alias("e")).select("e.*").filter("n > 0").drop("n")
    out = out.withColumn("median_days", F.floor(F.log(F.lit(2.0)) / F.col("rate"))).withColumn("update_interval", F.least(F.col("median_days"), F.lit(730)))
    out = out.withColumns({f"year_{y}": F.exp(-F.col("rate") * (365 * y)) for y in (1, 3, 5)})
    return out.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(last_day - 1), F.lit(step)))).withColumn("survival", F.exp(-F.col("rate") * F.col("day")))
