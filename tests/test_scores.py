"""Scores of fits of several families against sums over draws and observations."""

from __future__ import annotations

import numpy as np
import pytest

from panelweave.operators import diagnostics, effects
from panelweave.operators.fit import FitSpec, fit
from panelweave.operators.laws import law_at, log_mass_at
from panelweave.sources.candidates import pick

PERIODS = ("P1", "P2")


def test_log_mass_is_the_log_of_the_mass_and_reaches_further():
    rng = np.random.default_rng(1)
    n = 400
    y, mu, q = rng.integers(0, 12, n).astype(float), rng.uniform(0.1, 8, n), rng.uniform(0.2, 1, n)
    form, zero, logk = rng.integers(0, 3, n), rng.integers(0, 5, n), rng.uniform(-2, 1, n)
    q = np.where(zero == 0, 1.0, q)
    none = np.full(n, np.nan)
    np.testing.assert_allclose(np.exp(log_mass_at(y, none, mu, q, form, zero, logk)), law_at(y, none, mu, q, form, zero, logk)[1], rtol=1e-9)
    of, p, form = y + rng.integers(0, 9, n), rng.uniform(0.05, 0.95, n), 2 * rng.integers(0, 2, n)
    np.testing.assert_allclose(np.exp(log_mass_at(y, of, p, q, form, zero, logk)), law_at(y, of, p, q, form, zero, logk)[1], rtol=1e-9)
    far = log_mass_at(np.array([2000.0]), np.array([np.nan]), np.array([1.0]), np.ones(1), np.zeros(1, int), np.zeros(1, int), np.zeros(1))
    assert far[0] < -10_000 and np.isfinite(far[0])


@pytest.mark.parametrize("trials", [False, True])
def test_scores_equal_sums_over_rows(spark, trials):
    rng = np.random.default_rng(6)
    rows = [(s, f"P{1 + k % 2}", float(rng.poisson(m) * rng.binomial(1, 0.7)), float(15 + k % 3)) for s, m in (("a", 3.0), ("b", 5.0)) for k in range(90)]
    rows = [(s, d, min(y, t), t) for s, d, y, t in rows] + [("a", "P1", None, 15.0)]
    panel = spark.createDataFrame(rows, "species string, period string, value double, trials double")
    names = ["betabinomial"] if trials else ["zeroinflatedpoisson0", "nbinomial", "nbinomial2"]
    chosen = [pick("inla", n, n.startswith("zero")) for n in names]
    fitted = fit(panel, FitSpec(PERIODS, covariate=None, trials="trials" if trials else None), chosen)
    got = {(r["species"], r["name"]): r for r in diagnostics.fit_scores(panel, fitted, 60).collect()}
    draws = effects.posterior_draws(fitted, 60).toPandas()
    assert len(got) == 2 * len(names)
    for r in effects.usable(fitted).collect():
        own = draws[(draws["species"] == r["species"]) & (draws["name"] == r["name"])]
        table = own.pivot(index="draw", columns="period", values="value").to_numpy()
        mu = (1 - table) / table if r["name"] == "nbinomial2" else table
        q = 1 / (1 + np.exp(r["zpar"])) if r["zero"] else 1.0

        def logs(mean):
            seen = [(y, t, PERIODS.index(d)) for s, d, y, t in rows if s == r["species"] and y is not None]
            y, t, d = (np.array(v) for v in zip(*seen))
            full = lambda v: np.full(len(y), v)
            mass = law_at(y, t if trials else full(np.nan), mean[d], full(q), full(r["form"]), full(r["zero"]), full(r["logk"]))[1]
            return np.log(mass)

        ll = np.stack([logs(m) for m in mu])
        lppd, p = np.log(np.exp(ll).mean(axis=0)).sum(), ll.var(axis=0, ddof=1).sum()
        out = got[(r["species"], r["name"])]
        assert out["p_waic"] == pytest.approx(p, rel=1e-6) and out["waic"] == pytest.approx(-2 * (lppd - p), rel=1e-6)
        assert out["dic"] == pytest.approx(-4 * ll.mean(axis=0).sum() + 2 * logs(mu.mean(axis=0)).sum(), rel=1e-6)
        assert out["log_score"] == pytest.approx(np.log(np.exp(-ll).mean(axis=0)).sum(), rel=1e-6)
