"""Seasonal ARMA of one differenced series by exact likelihood; a few hundred points at most.

(1 - phi B)(1 - sphi B^s) w = (1 + theta B)(1 + stheta B^s) e, in state-space
form: the filter starts from the stationary distribution, so no value is lost
to starting lags, and 11 differenced values already carry all four terms.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

LIMIT = 0.99


@dataclass(frozen=True)
class Fit:
    """phi, theta, sphi, stheta; variance of e; -2 log likelihood; one-step state behind the last value; mean taken away."""

    terms: tuple[float, float, float, float]
    sigma2: float
    deviance: float
    state: np.ndarray
    mean: float
    free: int


def polynomials(terms: tuple[float, float, float, float], period: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of w[t-1], w[t-2], ... and of e[t-1], e[t-2], ..."""
    phi, theta, sphi, stheta = terms
    size = period + 1 if sphi or stheta else 1
    ar, ma = np.zeros(size), np.zeros(size)
    ar[0], ma[0] = phi, theta
    if size > 1:
        ar[period - 1], ma[period - 1] = sphi, stheta
        ar[period], ma[period] = -phi * sphi, theta * stheta
    return ar, ma


def filtered(w: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-step errors, their variances over that of e, and the state after the last value."""
    if len(ar) == len(ma) == 1:
        return _filtered_short(w.tolist(), float(ar[0]), float(ma[0]))
    r = max(len(ar), len(ma) + 1)
    move = np.zeros((r, r))
    move[:len(ar), 0] = ar
    move[:-1, 1:] = np.eye(r - 1)
    load = np.zeros(r)
    load[0], load[1:len(ma) + 1] = 1.0, ma
    noise = np.outer(load, load)
    p, power = noise.copy(), move.copy()
    for _ in range(40):  # p = sum of move^k noise move'^k, twice as many terms each time
        more = power @ p @ power.T
        p = p + more
        if np.abs(more).max() <= 1e-13 * np.abs(p).max():
            break
        power = power @ power
    a, errors, spreads, settled = np.zeros(r), np.empty(len(w)), np.empty(len(w)), False
    for t, value in enumerate(w):
        errors[t], spreads[t] = value - a[0], p[0, 0]
        if not settled:
            gain = p[:, 0] / p[0, 0]
            step = move @ (p - np.outer(gain, p[0])) @ move.T + noise
            settled = bool(np.abs(step - p).max() <= 1e-14 * p[0, 0])
            p = step
        a = move @ (a + gain * errors[t])
    return errors, spreads, a


def _filtered_short(w: list[float], phi: float, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for one term each, whose state has one free variance."""
    a0 = a1 = 0.0
    p = (1 + theta * theta + 2 * phi * theta) / (1 - phi * phi)
    errors, spreads = [], []
    for value in w:
        v = value - a0
        errors.append(v)
        spreads.append(p)
        a0 = phi * (a0 + v) + a1 + theta / p * v
        p = 1 + theta * theta - theta * theta / p
    return np.array(errors), np.array(spreads), np.array([a0, a1])


def deviance(w: np.ndarray, terms: tuple[float, float, float, float], period: int) -> tuple[float, float, np.ndarray]:
    """-2 log likelihood with the variance at its best, that variance, and the last state."""
    errors, spreads, a = filtered(w, *polynomials(terms, period))
    n = len(w)
    sigma2 = float((errors * errors / spreads).sum() / n)
    return n * (math.log(2 * math.pi * max(sigma2, 1e-300)) + 1) + float(np.log(spreads).sum()), sigma2, a


def descend(f: Callable[[np.ndarray], float], start: np.ndarray, step: float = 0.5, rounds: int = 150) -> tuple[float, np.ndarray]:
    """Downhill simplex."""
    points = [start, *(start + step * row for row in np.eye(len(start)))]
    known = sorted(((f(x), tuple(x)) for x in points))
    for _ in range(rounds):
        if known[-1][0] - known[0][0] < 1e-7:
            break
        x = np.array([k[1] for k in known])
        middle, worst = x[:-1].mean(axis=0), x[-1]
        tried = middle + (middle - worst)
        value = f(tried)
        if value < known[0][0]:
            far = middle + 2 * (middle - worst)
            known[-1] = min((value, tuple(tried)), (f(far), tuple(far)))
        elif value < known[-2][0]:
            known[-1] = (value, tuple(tried))
        else:
            near = middle + 0.5 * ((tried if value < known[-1][0] else worst) - middle)
            inner = f(near)
            if inner < min(value, known[-1][0]):
                known[-1] = (inner, tuple(near))
            else:
                known = [known[0], *((f(y), tuple(y)) for y in (x[0] + 0.5 * (x[1:] - x[0])))]
        known.sort()
    return known[0][0], np.array(known[0][1])


def fit(w: np.ndarray, seasonal: bool, period: int, centre: bool) -> Fit:
    """The most likely terms; raises ``ValueError`` where there is no finite likelihood."""
    mean = float(w.mean()) if centre else 0.0
    x, size = w - mean, 4 if seasonal else 2
    free = size + 1 + centre
    if np.abs(x).max(initial=0.0) <= 1e-9 * (1.0 + abs(mean)):
        return Fit((0.0, 0.0, 0.0, 0.0), 0.0, -math.inf, np.zeros(1), mean, free)

    def terms(raw: np.ndarray) -> tuple[float, float, float, float]:
        out = LIMIT * np.tanh(raw)
        return (*map(float, out), *([0.0] * (4 - size)))

    def cost(raw: np.ndarray) -> float:
        found = deviance(x, terms(raw), period)[0]
        return found if math.isfinite(found) else 1e300

    starts = [np.zeros(size) + 0.1, np.array([0.6, -0.6, 0.1, -0.6][:size])]
    value, raw = min((descend(cost, s) for s in starts), key=lambda r: r[0])
    if value >= 1e300:
        raise ValueError("no finite likelihood")
    total, sigma2, state = deviance(x, terms(raw), period)
    return Fit(terms(raw), sigma2, total, state, mean, free)


def ahead(found: Fit, periods: int, period: int) -> np.ndarray:
    """Expected next values of the differenced series."""
    ar, ma = polynomials(found.terms, period)
    r = max(len(ar), len(ma) + 1)
    move = np.zeros((r, r))
    move[:len(ar), 0] = ar
    move[:-1, 1:] = np.eye(r - 1)
    a = np.zeros(r)
    a[:len(found.state)] = found.state
    out = np.empty(periods)
    for t in range(periods):
        out[t] = a[0] + found.mean
        a = move @ a
    return out


def weights(found: Fit, periods: int, period: int) -> np.ndarray:
    """Weights of past errors in the differenced series."""
    ar, ma = polynomials(found.terms, period)
    psi = np.zeros(periods)
    for j in range(periods):
        psi[j] = 1.0 if j == 0 else (ma[j - 1] if j <= len(ma) else 0.0)
        psi[j] += sum(ar[k - 1] * psi[j - k] for k in range(1, min(j, len(ar)) + 1))
    return psi
