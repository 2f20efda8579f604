"""Keys of few rows run their rounds within tasks, with the results of rounds over whole tables."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest

from panelweave.operators.fit import FitSpec, fit, unit_effects
from panelweave.session import Ledger
from panelweave.sources.candidates import COUNT_CANDIDATES, PROPORTION_CANDIDATES, pick

PERIODS = ("P1", "P2")


def panel(spark):
    """Two entities on units in sites; a site name, a response and a period are missing here and there."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        site, period = f"s{i % 6}", PERIODS[i // 6 % 2]
        y = float(rng.poisson(np.exp(0.4 + 0.5 * (period == "P2") + 0.3 * (i % 6 - 2.5))))
        rows.append((
            "ab"[i % 4 == 0], None if i % 40 == 7 else site, f"{site}-{i % 18}", None if i == 11 else period, float(rng.normal()),
            None if i == 30 else y, 60.0,
        ))
    rows += [("never", "s1", "s1-1", p, 0.0, 0.0, 60.0) for p in PERIODS]
    return spark.createDataFrame(rows, "species string, site string, unit string, period string, x double, value double, trials double")


@pytest.mark.parametrize("levels, trials, prior", [
    (("site", "unit"), None, None), ((), None, None), ((), None, (1.0, 0.5)), (("site",), "trials", None),
])
def test_tasks_give_what_rounds_give(spark, levels, trials, prior):
    spec = FitSpec(PERIODS, levels=levels, trials=trials, prior_sd=prior, max_iterations=6)
    chosen = PROPORTION_CANDIDATES if trials else [*COUNT_CANDIDATES[:5], pick("glmmTMB", "nbinom1", False), pick("glmmTMB", "poisson", True)]
    rows = panel(spark)
    told, known = fit(rows, spec, chosen), fit(rows, replace(spec, key_rows=0), chosen)
    kept = ["species", "cand", "status", "n_rows", "n_dropped", "iterations", "ll", "logk", "zpar", "coef", "coef_cov", "prec", "zbeta"]
    a, b = ({(r["species"], r["cand"]): r for r in f.coef.select(kept).collect()} for f in (told, known))
    assert set(a) == set(b) and {s for s, _ in a} == {"a", "b", "never"}
    for key in a:
        for name in kept[2:]:
            if isinstance(a[key][name], (str, type(None))):
                assert a[key][name] == b[key][name], (key, name)
            else:
                np.testing.assert_allclose(a[key][name], b[key][name], rtol=1e-5, atol=1e-6, err_msg=f"{key} {name}")
    if levels:
        a, b = ({tuple(r)[:-2]: tuple(r)[-2:] for r in unit_effects(f).collect()} for f in (told, known))
        assert set(a) == set(b) and len(a) > 0
        np.testing.assert_allclose([a[k] for k in a], [b[k] for k in a], rtol=1e-5, atol=1e-6)


def test_rounds_over_few_rows_are_no_jobs(spark, monkeypatch):
    names = []
    plain = Ledger.write
    monkeypatch.setattr(Ledger, "write", lambda self, df, name: names.append(name) or plain(self, df, name))
    fitted = fit(panel(spark), FitSpec(PERIODS, levels=("site", "unit"), max_iterations=30), [pick("inla", "zeroinflatednbinomial1", True)])
    assert fitted.rounds >= 6
    assert names == ["coef"]
