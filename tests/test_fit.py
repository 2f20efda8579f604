"""Fits against dense algebra, closed forms, known parameters and other layouts of the same data."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from panelweave.operators import effects
from panelweave.operators.batches import Layout, make_level_sums, split
from panelweave.operators.fit import FitSpec, fit, unit_effects
from panelweave.operators.solve import unpack
from panelweave.sources.candidates import COUNT_CANDIDATES, pick

PERIODS = ("P1", "P2", "P3", "P4")


def simulate(seed, reefs=12, sites=3, transects=4, years=8):
    rng = np.random.default_rng(seed)
    out, drawn = [], []
    for r in range(reefs):
        ur = rng.normal(0, 0.5)
        for s in range(sites):
            us = rng.normal(0, 0.3)
            drawn.append(ur + us)
            for t in range(transects):
                for y in range(years):
                    d = y % 4
                    x = rng.normal()
                    mu = np.exp(1.0 + [0, 0.3, -0.4, 0.6][d] + 0.2 * x + ur + us)
                    out.append(("sp", f"r{r}", f"r{r} {s}", f"r{r} {s} {t}", PERIODS[d], x, float(rng.poisson(mu))))
    frame = pd.DataFrame(out, columns=["species", "reef", "site", "transect", "period", "x", "value"])
    # variance components of the effects actually drawn (balanced analysis of variance)
    drawn = np.array(drawn).reshape(reefs, sites)
    within = drawn.var(axis=1, ddof=1).mean()
    between = max(drawn.mean(axis=1).var(ddof=1) - within / sites, 0.0)
    frame.attrs["sd"] = (np.sqrt(between), np.sqrt(within))
    return frame


def test_elimination_equals_dense_solve():
    """Grouped elimination of three nested levels against the full penalised system."""
    rng = np.random.default_rng(3)
    layout = Layout(4, 8, False)
    n, counts, precisions = 400, (4, 12, 24), (2.0, 3.0, 5.0)
    t = rng.integers(0, 24, n)
    ids = [t % 4, t % 12, t]
    X = rng.normal(size=(n, 10))
    X[:, :4] = np.eye(4)[rng.integers(0, 4, n)]
    w, z = rng.uniform(0.5, 2, n), rng.normal(size=n)
    blocks = [np.eye(c)[i] for c, i in zip(counts, ids)]
    Z = np.concatenate(blocks, axis=1)
    D = np.diag(np.repeat(precisions, counts))
    M = np.linalg.inv(np.diag(1 / w) + Z @ np.linalg.inv(D) @ Z.T)
    i, j = np.triu_indices(10)
    total = np.concatenate([(X.T * w @ X)[i, j], X.T @ (w * z), [0.0, 0.0]])
    table = pd.DataFrame(
        [[0, 0, u % 4, u % 12, u, (w * z)[t == u].sum(), *(w[t == u, None] * X[t == u]).sum(axis=0)] + [0.0] * (layout.width - 11) for u in range(24)],
        columns=["kid", "slot", "u1", "u2", "u3", *layout.names],
    )
    for level in (2, 1, 0):
        units = ["u1", "u2", "u3"][:level]
        out = pd.concat(make_level_sums(layout, units)(iter([table.assign(prec=precisions[level], zprec=1.0)])))
        keyed = out[out.slot > 0].sort_values("slot")[layout.names].to_numpy().ravel()[: len(total)]
        total = total + keyed
        if units:
            table = out[out.slot == 0].groupby(["kid", "slot", *units], as_index=False).sum()
    part = split(total[None], layout.parts)
    assert np.allclose(unpack(part["xx"], 10)[0], X.T @ M @ X)
    assert np.allclose(part["xz"][0], X.T @ M @ z)
    dense = np.linalg.slogdet(Z.T * w @ Z + D)[1] - np.linalg.slogdet(D)[1]
    assert part["ld"][0, 0] == pytest.approx(dense)


@pytest.fixture(scope="module")
def nested(spark):
    frame = simulate(seed=2)
    spec = FitSpec(PERIODS, levels=("reef", "site", "transect"), max_iterations=10)
    return frame.attrs["sd"], fit(spark.createDataFrame(frame), spec, [pick("glmmTMB", "poisson", False)])


def test_nested_fit_recovers_parameters(nested):
    drawn, fitted = nested
    for row in fitted.coef.collect():
        assert row["status"] in (*effects.FINISHED, "not_converged")
        se = np.sqrt(np.diag(np.reshape(row["coef_cov"], (8, 8))))
        truth = np.array([1.0, 0.3, -0.4, 0.6, 0.2, 0, 0, 0])
        assert np.all(np.abs(np.array(row["coef"]) - truth) < 4 * se)
        sd = 1 / np.sqrt(row["prec"])
        assert sd[:2] == pytest.approx(drawn, abs=0.12) and sd[2] < 0.2
    assert unit_effects(fitted).count() == 12 * 3 * 4


def test_splitting_hot_units_and_partitions_change_nothing(spark):
    frame = simulate(seed=4, reefs=3)
    chosen = [pick("inla", "zeroinflatednbinomial1", True)]
    results = []
    for parts, hot in ((2, 200_000), (7, 3)):
        spec = FitSpec(PERIODS, levels=("reef", "site", "transect"), max_iterations=3, hot_unit_rows=hot)
        results.append(fit(spark.createDataFrame(frame).repartition(parts), spec, chosen).coef.first())
    assert np.allclose(results[0]["coef"], results[1]["coef"], atol=1e-8)
    assert results[0]["ll"] == pytest.approx(results[1]["ll"], abs=1e-6)


def test_negative_binomial_size(spark):
    rng = np.random.default_rng(5)
    d = rng.integers(0, 4, 4000)
    y = rng.poisson(np.array([2.0, 3.0, 4.0, 2.5])[d] * rng.gamma(2.0, 0.5, 4000))
    panel = spark.createDataFrame(pd.DataFrame({"species": "s", "period": np.array(PERIODS)[d], "value": y.astype(float)}))
    fitted = fit(panel, FitSpec(PERIODS, covariate=None), [pick("inla", "nbinomial", False)])
    assert fitted.coef.first()["logk"] == pytest.approx(np.log(0.5), abs=0.15)


def test_degenerate_entities_get_a_status(spark):
    data = [("zero", "P1", 0.0), ("zero", "P2", 0.0), ("gap", "P1", 3.0), ("gap", "P1", 1.0), ("gap", "P3", 0.0), ("gap", "P2", 2.0)]
    panel = spark.createDataFrame(data, "species string, period string, value double")
    fitted = fit(panel, FitSpec(PERIODS, covariate=None), [pick("glmmTMB", "poisson", False)])
    status = {r["species"]: r["status"] for r in fitted.coef.collect()}
    assert status == {"zero": "all_zero", "gap": "period_unobserved"}
    means = {r["period"]: r["mean"] for r in effects.cellmeans_wald(fitted).collect()}
    assert means["P1"] == pytest.approx(2.0) and means["P2"] == pytest.approx(2.0)
    assert means["P3"] is None and means["P4"] is None


def test_periods_of_zeros_count_for_hurdles_and_priors(spark):
    """12 rows with 7 zeros, of which the third period has nothing else."""
    data = [("P1", 2.0), ("P1", 1.0), ("P2", 3.0), ("P2", 1.0), ("P2", 0.0), ("P4", 2.0)] + [("P3", 0.0)] * 6
    panel = spark.createDataFrame([("s", *r) for r in data], "species string, period string, value double")
    hurdle = fit(panel, FitSpec(PERIODS, covariate=None), [pick("inla", "zeroinflatedpoisson0", True)]).coef.first()
    assert hurdle["status"] == "ok" and hurdle["n_rows"] == 12
    assert 1 / (1 + np.exp(-hurdle["zpar"])) == pytest.approx(7 / 12)
    spec = FitSpec(PERIODS, covariate=None, prior_mean=(0.0, 0.0), prior_sd=(2.0, 1.0))
    held = fit(panel, spec, [pick("glmmTMB", "poisson", False)]).coef.first()
    mu = np.exp(held["beta"])
    assert held["status"] == "ok" and np.isfinite(mu).all()
    assert -6 * mu[2] - held["coef"][2] == pytest.approx(0.0, abs=1e-5)


def test_rows_without_a_unit_are_kept_or_counted(spark):
    frame = simulate(seed=6, reefs=3)
    frame.loc[:7, "transect"] = None
    spec = FitSpec(PERIODS, levels=("reef", "site", "transect"), max_iterations=3)
    fitted = fit(spark.createDataFrame(frame), spec, [pick("inla", "poisson", False), pick("glmmTMB", "poisson", False)])
    rows = {r["mod"]: r for r in fitted.coef.collect()}
    assert rows["inla"]["n_rows"] == len(frame) and rows["inla"]["n_dropped"] == 0
    assert rows["glmmTMB"]["n_rows"] == len(frame) - 8 and rows["glmmTMB"]["n_dropped"] == 8


def test_unfinished_fits_are_not_used(spark):
    panel = spark.createDataFrame(simulate(seed=2, reefs=2).assign(x=0.0))
    fitted = fit(panel, FitSpec(PERIODS, covariate=None, max_iterations=1), [pick("inla", "nbinomial", False)])
    assert fitted.coef.first()["status"] == "not_converged" and effects.usable(fitted).count() == 0


def test_mixture_and_regression_recover_zero_share(spark):
    rng = np.random.default_rng(11)
    n = 4000
    d = rng.integers(0, 4, n)
    y = rng.poisson(np.array([2.0, 3.0, 4.0, 2.5])[d]) * (rng.uniform(size=n) > 0.3)
    panel = spark.createDataFrame(pd.DataFrame({"species": "s", "period": np.array(PERIODS)[d], "value": y.astype(float)}))
    chosen = [c for c in COUNT_CANDIDATES if c.zi and "poisson" in c.name]
    fitted = fit(panel, FitSpec(PERIODS, covariate=None), chosen)
    rows = {(r["mod"], r["name"]): r for r in fitted.coef.collect()}
    assert all(r["status"] in effects.FINISHED for r in rows.values())
    mixture = rows[("inla", "zeroinflatedpoisson1")]
    assert 1 / (1 + np.exp(-mixture["zpar"])) == pytest.approx(0.3, abs=0.05)
    assert np.exp(mixture["beta"]) == pytest.approx([2.0, 3.0, 4.0, 2.5], rel=0.1)
    part = rows[("glmmTMB", "poisson")]
    assert 1 / (1 + np.exp(-np.array(part["zbeta"]))) == pytest.approx([0.3] * 4, abs=0.08)


def test_prior_solves_the_penalised_score_equations(spark):
    y = np.array([1.0, 2.0, 1.0, 3.0])
    panel = spark.createDataFrame([("s", p, v) for p, v in zip(PERIODS, y.tolist())], "species string, period string, value double")
    spec = FitSpec(PERIODS, covariate=None, prior_mean=(0.5, 0.0), prior_sd=(1.0, 0.3))
    coef = np.array(fit(panel, spec, [pick("glmmTMB", "poisson", False)]).coef.first()["coef"])
    mu = np.exp(coef[0] + np.concatenate([[0.0], coef[1:]]))
    assert (y - mu).sum() - (coef[0] - 0.5) == pytest.approx(0.0, abs=1e-5)
    assert (y - mu)[1:] - coef[1:] / 0.3**2 == pytest.approx(np.zeros(3), abs=1e-5)


def test_draws_agree_with_wald(spark):
    panel = spark.createDataFrame(simulate(seed=2, reefs=4).assign(x=0.0))
    fitted = fit(panel, FitSpec(PERIODS, covariate=None), [pick("inla", "poisson", False)])
    wald = {r["period"]: r for r in effects.contrasts_wald(fitted).filter("variable = 'Ratio'").collect()}
    drawn = {r["period"]: r for r in effects.draw_summary(fitted).filter("variable = 'Ratio'").collect()}
    for period, w in wald.items():
        assert drawn[period]["mean"] == pytest.approx(w["mean"], rel=0.02)
        assert drawn[period]["upper"] - drawn[period]["lower"] == pytest.approx(w["upper"] - w["lower"], rel=0.08)
