"""Fits without units work on counts of equal rows."""

from __future__ import annotations

import numpy as np
import pytest

from panelweave.operators.fit import FitSpec, collapsed, fit
from panelweave.sources.candidates import COUNT_CANDIDATES, pick


def panel(spark, copies, jitter=False):
    rng = np.random.default_rng(8)
    rows = [(s, f"P{1 + k % 2}", float(k % 5), float(rng.poisson(m) * rng.binomial(1, 0.7))) for s, m in (("a", 2.0), ("b", 6.0)) for k in range(150)]
    frame = spark.createDataFrame(rows * copies, "species string, period string, x double, value double")
    return frame.repartition(5) if jitter else frame


def test_equal_rows_become_one(spark):
    rows = spark.createDataFrame([(1, 2.0, 7), (1, 2.0, 8), (1, None, 9), (2, 2.0, 10)], "d int, y double, rid long")
    assert sorted(map(tuple, collapsed(rows).collect()), key=str) == [(1, 2.0, 2.0), (1, None, 1.0), (2, 2.0, 1.0)]
    assert collapsed(rows.limit(0)).count() == 0


@pytest.mark.parametrize("covariate", [None, "x"])
def test_copies_keep_estimates_and_multiply_information(spark, covariate):
    spec = FitSpec(("P1", "P2"), covariate=covariate)
    chosen = [pick("glmmTMB", "poisson", False), pick("glmmTMB", "nbinom2", False), pick("glmmTMB", "poisson", True)]
    once, many = (
        {(r["species"], r["cand"]): r for r in fit(panel(spark, n, n > 1), spec, chosen).coef.collect()} for n in (1, 4)
    )
    assert set(once) == set(many) and len(once) == 6
    for key, one in once.items():
        more = many[key]
        assert one["status"] == more["status"] == "ok" and more["n_rows"] == 4 * one["n_rows"]
        np.testing.assert_allclose(more["coef"], one["coef"], rtol=1e-5, atol=1e-6)
        plain, copied = (r["ll"] + 0.5 * r["logdet"] for r in (one, more))  # without the share of restricted likelihood
        np.testing.assert_allclose(copied, 4 * plain, rtol=1e-8)
        np.testing.assert_allclose(np.array(more["coef_cov"]) * 4, one["coef_cov"], rtol=1e-3)


def test_rounds_see_distinct_rows_only(spark):
    fitted = fit(panel(spark, 6), FitSpec(("P1", "P2"), covariate=None), [COUNT_CANDIDATES[0]])
    distinct = panel(spark, 1).select("species", "period", "value").distinct().count()
    weights = [r["weight"] for r in fitted.rows.select("weight").collect()]
    assert len(weights) == distinct and sum(weights) == 6 * 300
