"""Count part and zero regression solved together: estimates, and their covariance, against dense algebra."""

from __future__ import annotations

import math

import numpy as np
import pytest

from panelweave.operators.fit import FitSpec, fit
from panelweave.sources.candidates import pick

PERIODS = ("P1", "P2")


def log_mass(y, eta, ez):
    """Log probability of a count that is always 0 with a probability of its own."""
    mu, pi = np.exp(eta), 1.0 / (1.0 + np.exp(-ez))
    plain = y * eta - mu - np.vectorize(math.lgamma)(y + 1.0)
    return np.where(y == 0, np.log(pi + (1 - pi) * np.exp(-mu)), np.log(1 - pi) + plain)


def gradient(y, eta, ez, step=1e-5):
    return np.stack([
        (log_mass(y, eta + step, ez) - log_mass(y, eta - step, ez)) / (2 * step),
        (log_mass(y, eta, ez + step) - log_mass(y, eta, ez - step)) / (2 * step),
    ])


@pytest.mark.parametrize("covariate", [None, "x"])
def test_joint_step_ends_at_the_maximum_with_the_full_covariance(spark, covariate):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(1600):
        d, x = k % 2, float(np.round(rng.normal(), 2))
        mu = math.exp(0.4 + 0.5 * d + (0.3 * x if covariate else 0.0))
        rows.append(("sp", PERIODS[d], x, 0.0 if rng.random() < (0.35, 0.2)[d] else float(rng.poisson(mu))))
    panel = spark.createDataFrame(rows, "species string, period string, x double, value double")
    got = fit(panel, FitSpec(PERIODS, covariate=covariate), [pick("glmmTMB", "poisson", True)]).coef.first()
    assert got["status"] == "ok" and got["iterations"] < 30
    beta, zeta = np.array(got["beta"]), np.array(got["zbeta"])
    d = np.array([PERIODS.index(r[1]) for r in rows])
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    design = np.stack([d == 0, d == 1] + ([x * (d == 0), x * (d == 1)] if covariate else []), axis=1).astype(float)
    eta, ez = design @ beta, zeta[d]
    s, z = gradient(y, eta, ez)
    assert np.abs(np.concatenate([design.T @ s, np.bincount(d, z)])).max() < 1e-3
    whole = np.concatenate([design, np.eye(2)[d]], axis=1)
    p, info = design.shape[1], np.zeros((design.shape[1] + 2,) * 2)
    for count in range(60):
        both = gradient(np.full(len(y), float(count)), eta, ez) * np.sqrt(np.exp(log_mass(np.full(len(y), float(count)), eta, ez)))
        scores = whole * np.concatenate([np.repeat(both[:1], p, axis=0), np.repeat(both[1:], 2, axis=0)]).T
        info += scores.T @ scores
    cov = np.linalg.inv(info)
    assert np.array(got["cov"]).reshape(p, p) == pytest.approx(cov[:p, :p], rel=1e-3, abs=1e-8)
    assert np.array(got["zcov"]).reshape(2, 2) == pytest.approx(cov[p:, p:], rel=1e-3, abs=1e-8)
    assert cov[0, 0] > 1.02 / info[0, 0]  # the part that a solve in turn would leave out
