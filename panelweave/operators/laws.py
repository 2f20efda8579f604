"""Distribution functions of the fitted laws, by ratios of neighbouring masses, on Arrow batches.

A law is a count law (Poisson, negative binomial with linear or quadratic variance) under a zero model, or a binomial or
beta-binomial one. From the mass at the observed count the neighbours follow by their ratio, downwards if the count is at most
the mean and upwards otherwise, until they are negligible. So a count costs the width of its law, whatever its size.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from panelweave.operators.likelihood import ZEROS, count_logs, lgamma

# Ship these functions with the job, so that workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEGLIGIBLE = 1e-18


def _walk(y: np.ndarray, down: np.ndarray, last: np.ndarray, whole: np.ndarray, ratio: Callable) -> np.ndarray:
    """Sum of the masses beyond y over the mass at y: below it where ``down``, else above it.

    ``ratio(i, j)`` is mass(j) / mass(j - 1) of rows i, ``last`` the largest possible count. Rows that are ``whole`` (laws with two
    peaks) are summed to the end.
    """
    total, i, j, term = np.zeros(len(y)), np.arange(len(y)), y.copy(), np.ones(len(y))
    while len(i):
        go = np.where(down[i], j > 0, j < last[i])
        i, j, term = i[go], j[go], term[go]
        step = np.where(down[i], -1.0, 1.0)
        r = ratio(i, np.where(down[i], j, j + 1))
        factor = np.where(down[i], 1.0 / r, r)
        j, term = j + step, term * factor
        total[i] += term
        go = whole[i] | (factor >= 1.0) | (term > NEGLIGIBLE * total[i])
        i, j, term = i[go], j[go], term[go]
    return total


def count_law(y, mu, form, logk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(count < y), P(count = y) and log P(count = 0) without a zero model."""
    log_mass, log_zero, kmu = count_logs(y, lgamma(y + 1.0), np.log(mu), mu, form, logk)
    size = np.where(form == 0, np.inf, mu / np.where(kmu > 0, kmu, 1.0))

    def ratio(i, j):
        grown = (size[i] + j - 1.0) * (kmu[i] / (1.0 + kmu[i]))
        return np.where(form[i] == 0, mu[i], grown) / j

    mass, down = np.exp(log_mass), y <= mu
    with np.errstate(invalid="ignore"):
        beyond = mass * _walk(y, down, np.full(len(y), np.inf), np.zeros(len(y), bool), ratio)
    return np.where(down, beyond, 1.0 - mass - beyond), mass, log_zero


def proportion_logs(y, n, p, form, logk) -> np.ndarray:
    """log P(hits = y) out of n."""
    m = np.exp(-logk)
    ways = lgamma(n + 1.0) - lgamma(y + 1.0) - lgamma(n - y + 1.0)
    out = ways + y * np.log(p) + (n - y) * np.log1p(-p)
    mixed = form != 0
    if mixed.any():
        yy, nn, mm = y[mixed], n[mixed], m[mixed]
        aa, bb = p[mixed] * mm, (1.0 - p[mixed]) * mm
        out[mixed] = ways[mixed] + lgamma(yy + aa) + lgamma(nn - yy + bb) - lgamma(nn + mm) - lgamma(aa) - lgamma(bb) + lgamma(mm)
    return out


def proportion_law(y, n, p, form, logk) -> tuple[np.ndarray, np.ndarray]:
    """P(hits < y) and P(hits = y) out of n."""
    m, mixed = np.exp(-logk), form != 0
    a, b = p * m, (1.0 - p) * m
    log_mass = proportion_logs(y, n, p, form, logk)

    def ratio(i, j):
        odds = np.where(mixed[i], (a[i] + j - 1.0) / (b[i] + n[i] - j), p[i] / (1.0 - p[i]))
        return (n[i] - j + 1.0) / j * odds

    mass, down = np.exp(log_mass), y <= n * p
    beyond = mass * _walk(y, down, n, mixed, ratio)
    return np.where(down, beyond, 1.0 - mass - beyond), mass


def law_at(y, n, mu, q, form, zero, logk) -> tuple[np.ndarray, np.ndarray]:
    """P(< y) and P(= y) of every row. ``n`` is NaN for counts; ``mu`` is the mean before the zero model, or the share of hits.

    With a mean of 0, or a share of 0 or 1, all mass lies at that end.
    """
    below, mass = np.full(len(y), np.nan), np.full(len(y), np.nan)
    trials = ~np.isnan(n)
    fixed = (mu <= 0) | (trials & (mu >= 1))
    point = np.where(trials, mu * n, 0.0)
    below[fixed], mass[fixed] = (y > point)[fixed], (y == point)[fixed]
    at = trials & ~fixed
    if at.any():
        below[at], mass[at] = proportion_law(y[at], n[at], mu[at], form[at], logk[at])
    at = ~trials & (mu > 0)
    if at.any():
        b, m, log_zero = count_law(y[at], mu[at], form[at], logk[at])
        f0 = np.exp(log_zero)
        z, kept, none = zero[at], q[at], y[at] == 0
        hurdle = z == ZEROS["hurdle"]
        left = np.where(hurdle, kept / -np.expm1(log_zero), kept)  # what a positive count's own mass is multiplied by
        at_zero = np.where(hurdle, 1.0 - kept, 1.0 - kept + kept * f0)
        below[at] = np.where(none, 0.0, at_zero + left * (b - f0))
        mass[at] = np.where(none, at_zero, left * m)
    return np.clip(below, 0.0, 1.0), np.clip(mass, 0.0, 1.0)


def log_mass_at(y, n, mu, q, form, zero, logk) -> np.ndarray:
    """log P(= y) of every row, for means above 0 and shares inside (0, 1); NaN elsewhere. Arguments as in ``law_at``."""
    out = np.full(len(y), np.nan)
    trials = ~np.isnan(n)
    at = trials & (mu > 0) & (mu < 1)
    if at.any():
        out[at] = proportion_logs(y[at], n[at], mu[at], form[at], logk[at])
    at = ~trials & (mu > 0)
    if at.any():
        logs, log_zero, _ = count_logs(y[at], lgamma(y[at] + 1.0), np.log(mu[at]), mu[at], form[at], logk[at])
        hurdle, kept = zero[at] == ZEROS["hurdle"], q[at]
        left = np.where(hurdle, kept / -np.expm1(log_zero), kept)
        at_zero = np.where(hurdle, 1.0 - kept, 1.0 - kept + kept * np.exp(log_zero))
        plain = zero[at] == ZEROS["none"]
        with np.errstate(divide="ignore"):
            out[at] = np.where(plain, logs, np.where(y[at] == 0, np.log(at_zero), np.log(left) + logs))
    return out


def _logs(y: pd.Series, n: pd.Series, mu: pd.Series, q: pd.Series, form: pd.Series, zero: pd.Series, logk: pd.Series) -> pd.Series:
    table = np.stack([np.asarray(v, np.float64) for v in (y, n, mu, q, form, zero, logk)], axis=1)
    known = ~np.isnan(table[:, [0, 2]]).any(axis=1)
    out = np.full(len(table), np.nan)
    if known.any():
        out[known] = log_mass_at(*table[known].T)
    return pd.Series(out)


def log_chance(y: Column, law: str = "law") -> Column:
    """Log mass of a count under the row's law; NaN where the count is missing or the law has one value."""
    parts = [F.col(f"{law}.{name}").cast("double") for name in ("n", "mu", "q", "form", "zero", "logk")]
    return F.pandas_udf(_logs, "double")(y.cast("double"), *parts)


def _evaluated(y: pd.Series, n: pd.Series, mu: pd.Series, q: pd.Series, form: pd.Series, zero: pd.Series, logk: pd.Series) -> pd.DataFrame:
    table = np.stack([np.asarray(v, np.float64) for v in (y, n, mu, q, form, zero, logk)], axis=1)
    known = ~np.isnan(table[:, [0, 2]]).any(axis=1)
    out = np.full((len(table), 2), np.nan)
    if known.any():
        rows, index = np.unique(table[known], axis=0, return_inverse=True)  # equal rows share one evaluation
        out[known] = np.stack(law_at(*rows.T), axis=1)[index.ravel()]
    return pd.DataFrame({"below": out[:, 0], "mass": out[:, 1]})


def chances(y: Column, law: str = "law") -> Column:
    """Struct (below, mass) of a count under the row's law; NaN where the count is missing."""
    evaluated = F.pandas_udf(_evaluated, "below double, mass double")
    parts = [F.col(f"{law}.{name}").cast("double") for name in ("n", "mu", "q", "form", "zero", "logk")]
    return evaluated(y.cast("double"), *parts)
