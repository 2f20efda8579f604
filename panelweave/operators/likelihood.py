"""Row terms of the likelihoods, evaluated on Arrow batches.

Spark SQL has no lgamma and no digamma. Written out as column expressions these terms make generated
methods too large for the JVM to compile (80 microseconds per row were measured), so they are evaluated on
batches of plain number columns. Joins, predictors and the final sums stay in the JVM.

Counts share one parametrisation. The variance is mu (1 + k mu) with k = 0 (poisson), k = exp(logk) / mu
(linear) or k = exp(logk) (quadratic). A zero model keeps a count with probability q: always (none), with a
constant probability (mixture), (mu / (1 + mu))^a (tied), or through its own regression. A hurdle fits the
positive counts as truncated and the zeros by their share.

Weights are expected information, scores are exact, so scoring steps on grouped sums end at the maximum.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from panelweave.functions.special import DIGAMMA_SERIES, SHIFT, STIRLING

# Ship these functions with the job, so that workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMS = {"poisson": 0, "linear": 1, "quadratic": 2}
ZEROS = {"none": 0, "hurdle": 1, "mixture": 2, "tied": 3, "regression": 4}
LOGK_STEP = 0.02  # half width of the central differences in log dispersion
TINY = 1e-12


def stirling_excess(x: np.ndarray) -> np.ndarray:
    """lgamma(x) minus its leading Stirling terms, for x > 0."""
    big = np.where(x >= 10.0, x, x + SHIFT)
    inv = 1.0 / big
    total = inv * np.polynomial.polynomial.polyval(inv * inv, STIRLING)
    small = x < 10.0
    if small.any():
        v = x[small]
        product = np.prod(v[None, :] + np.arange(SHIFT)[:, None], axis=0)
        total[small] += (v + SHIFT - 0.5) * np.log(v + SHIFT) - SHIFT - (v - 0.5) * np.log(v) - np.log(product)
    return total


def digamma(x: np.ndarray) -> np.ndarray:
    big = np.where(x >= 10.0, x, x + SHIFT)
    sq = 1.0 / (big * big)
    total = np.log(big) - 0.5 / big + sq * np.polynomial.polynomial.polyval(sq, DIGAMMA_SERIES)
    small = x < 10.0
    if small.any():
        total[small] -= np.sum(1.0 / (x[small][None, :] + np.arange(SHIFT)[:, None]), axis=0)
    return total


def lgamma(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + stirling_excess(x)


def count_logs(y, lgy, eta, mu, form, logk):
    """Log mass at y and at zero. Keeps its digits as the dispersion goes to zero."""
    ek = np.exp(logk)
    kmu = np.where(form == 1, ek, np.where(form == 0, 0.0, ek * mu))
    k = np.where(form == 1, ek / mu, ek)
    log_zero = np.where(form == 0, -mu, -np.log1p(kmu) / k)
    mass = np.where(y == 0, log_zero, y * eta - mu - lgy)
    at = (form > 0) & (y > 0)
    if at.any():
        yy, kk, km = y[at], k[at], kmu[at]
        size = 1.0 / kk
        mass[at] = (
            (size + yy - 0.5) * np.log1p(yy * kk) - yy + stirling_excess(size + yy) - stirling_excess(size)
            + yy * eta[at] - (size + yy) * np.log1p(km) - lgy[at]
        )
    return mass, log_zero, kmu


def observed_log(mass, log_zero, y, q, zero):
    """Log likelihood of a row under its zero model."""
    occupied = -np.expm1(log_zero)
    positive = np.log(q) + mass
    out = np.where(y == 0, np.log(1.0 - q * occupied + TINY), positive)
    hurdle = np.where(y == 0, np.log1p(-q + TINY), positive - np.log(occupied))
    return np.where(zero == 0, mass, np.where(zero == 1, hurdle, out))


def count_scores(y, eta, ez, mu, mass, log_zero, kmu, form, zero, zpar) -> dict[str, np.ndarray]:
    """Scores in the predictor (s) and in the zero parameter (zs), and the pieces the information needs."""
    g = 1.0 / (1.0 + kmu)
    f0, occ = np.exp(log_zero), -np.expm1(log_zero)
    a = np.exp(zpar)
    tie = np.where(zero == 3, a / (1.0 + mu), 0.0)
    q = np.select(
        [zero == 0, zero == 3, zero == 4],
        [np.ones_like(mu), np.exp(-a * np.log1p(1.0 / mu)), 1.0 / (1.0 + np.exp(ez))],
        1.0 / (1.0 + np.exp(zpar)),
    )
    score = (y - mu) * g
    dz = -mu * g  # derivative of log f(0) in the predictor
    linear = form == 1
    if linear.any():
        size = mu[linear] / kmu[linear]
        yy = y[linear]
        score[linear] = size * (digamma(yy + size) - digamma(size) - np.log1p(kmu[linear]))
        dz[linear] = log_zero[linear]
    zero_row = y == 0
    p0 = 1.0 - q * occ + TINY
    t = np.where(zero == 3, -a * np.log1p(1.0 / mu), q - 1.0)  # derivative of log q in the zero parameter
    s0 = q * (f0 * dz - tie * occ) / p0
    zs0 = -occ * q * t / p0
    trunc = f0 * dz / (occ + TINY)
    s = np.where(
        zero == 0, score,
        np.where(zero == 1, np.where(zero_row, 0.0, score + trunc), np.where(zero_row, s0, tie + score)),
    )
    zs = np.where(zero >= 2, np.where(zero_row, zs0, t), 0.0)
    return {"s": s, "zs": zs, "g": g, "f0": f0, "occ": occ, "q": q, "tie": tie, "dz": dz, "p0": p0, "t": t,
            "s0": s0, "zs0": zs0, "trunc": trunc}


def count_terms(y, lgy, eta, ez, form, zero, logk, zpar) -> dict[str, np.ndarray]:
    """Scores, information and cross information (hz: predictor and zero parameter, hk: predictor and log
    dispersion, hzk: zero parameter and log dispersion; hr and hrk: the same of a zero regression's own predictor) per row."""
    mu = np.exp(eta)
    mass, log_zero, kmu = count_logs(y, lgy, eta, mu, form, logk)
    v = count_scores(y, eta, ez, mu, mass, log_zero, kmu, form, zero, zpar)
    f0, occ, q, tie, dz, p0, t = (v[n] for n in ("f0", "occ", "q", "tie", "dz", "p0", "t"))
    s0, zs0, trunc = v["s0"], v["zs0"], v["trunc"]
    info = mu * v["g"]
    floor = info * 1e-6
    kept = (info - f0 * dz * dz) / (occ + TINY) - trunc * trunc
    mixed = p0 * s0 * s0 + q * (tie * tie + info - f0 * (tie + dz) ** 2)
    hurdle = np.where(y == 0, 0.0, np.maximum(kept, floor))
    scalar_zero = (zero == 2) | (zero == 3)
    out = {
        "w": np.where(zero == 0, info, np.where(zero == 1, hurdle, np.maximum(mixed, floor))),
        "s": v["s"], "zs": v["zs"],
        "zi": np.where(zero >= 2, p0 * zs0 * zs0 + q * occ * t * t, 0.0),
        "hz": np.where(scalar_zero, p0 * s0 * zs0 + q * t * (tie * occ - f0 * dz), 0.0),
        "hk": np.zeros_like(mu), "hzk": np.zeros_like(mu),
        "hr": np.where(zero == 4, p0 * s0 * zs0 - q * t * f0 * dz, 0.0), "hrk": np.zeros_like(mu),
        "ll": observed_log(mass, log_zero, y, q, zero),
    }
    out["ll_lo"], out["ll_hi"] = out["ll"].copy(), out["ll"].copy()
    at = form > 0
    if at.any():
        sub = [x[at] for x in (y, lgy, eta, ez, mu, form, zero, zpar)]
        yy, ly, et, ezz, m, fo, ze, zp = sub
        ends = []
        for name, shift in (("ll_lo", -LOGK_STEP), ("ll_hi", LOGK_STEP)):
            mass_, log_zero_, kmu_ = count_logs(yy, ly, et, m, fo, logk[at] + shift)
            out[name][at] = observed_log(mass_, log_zero_, yy, q[at], ze)
            moved = count_scores(yy, et, ezz, m, mass_, log_zero_, kmu_, fo, ze, zp)
            ends.append((moved["s"], moved["zs"]))
        out["hk"][at] = -(ends[1][0] - ends[0][0]) / (2 * LOGK_STEP)
        zero_move = -(ends[1][1] - ends[0][1]) / (2 * LOGK_STEP)
        out["hzk"][at] = np.where(scalar_zero[at], zero_move, 0.0)
        out["hrk"][at] = np.where(ze == 4, zero_move, 0.0)
    return out


def proportion_terms(y, n, lgy, eta, form, logk) -> dict[str, np.ndarray]:
    """Hits y out of n on the logit scale: binomial (form 0) or beta-binomial (form 2, correlation
    exp(logk) / (1 + exp(logk))). The beta-binomial score is exact; its weight is the binomial one over
    1 + (n - 1) times the correlation, and its cross information with the dispersion is a central difference of
    the score."""
    p = 1.0 / (1.0 + np.exp(-eta))
    base = n * p * (1.0 - p)
    plain = y * np.log(p) + (n - y) * np.log1p(-p) + lgy
    none = np.zeros_like(p)
    out = {
        "w": base.copy(), "s": y - n * p, "zs": none, "zi": none, "hz": none, "hk": none.copy(), "hzk": none, "hr": none, "hrk": none,
        "ll": plain, "ll_lo": plain.copy(), "ll_hi": plain.copy(),
    }
    at = form != 0
    if at.any():
        yy, nn, pp, ly, lk = y[at], n[at], p[at], lgy[at], logk[at]

        def parts(shift):
            m = np.exp(-lk - shift)
            a, b = pp * m, (1.0 - pp) * m
            value = lgamma(yy + a) + lgamma(nn - yy + b) - lgamma(nn + m) - lgamma(a) - lgamma(b) + lgamma(m) + ly
            return value, m * pp * (1.0 - pp) * (digamma(yy + a) - digamma(a) - digamma(nn - yy + b) + digamma(b))

        (low, low_score), (here, score), (high, high_score) = (parts(s) for s in (-LOGK_STEP, 0.0, LOGK_STEP))
        out["w"][at] = base[at] / (1.0 + (nn - 1.0) / (1.0 + np.exp(-lk)))
        out["s"][at], out["ll"][at], out["ll_lo"][at], out["ll_hi"][at] = score, here, low, high
        out["hk"][at] = -(high_score - low_score) / (2 * LOGK_STEP)
    return out
