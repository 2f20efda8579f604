"""Distribution functions, moments and residuals of every family against plain sums over all counts."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import diagnostics, laws
from panelweave.operators.fit import FitSpec, fit, unit_effects
from panelweave.operators.likelihood import ZEROS
from panelweave.sources.candidates import pick

TOP = 3000


def masses(n, mu, q, form, zero, logk) -> np.ndarray:
    """Probabilities of 0, 1, 2 and so on, term by term from the textbook formulas."""
    k, lg = math.exp(logk), math.lgamma
    if not math.isnan(n):
        counts = range(int(n) + 1)
        ways = [lg(n + 1) - lg(j + 1) - lg(n - j + 1) for j in counts]
        if form == 0:
            return np.exp([w + j * math.log(mu) + (n - j) * math.log1p(-mu) for j, w in zip(counts, ways)])
        a, b = mu / k, (1 - mu) / k
        return np.exp([w + lg(j + a) + lg(n - j + b) - lg(n + a + b) - lg(a) - lg(b) + lg(a + b) for j, w in zip(counts, ways)])
    if form == 0:
        out = np.exp([j * math.log(mu) - mu - lg(j + 1) for j in range(TOP)])
    else:
        size = mu / k if form == 1 else 1 / k
        p = size / (size + mu)
        out = np.exp([lg(j + size) - lg(size) - lg(j + 1) + size * math.log(p) + j * math.log1p(-p) for j in range(TOP)])
    if zero == ZEROS["hurdle"]:
        out = np.concatenate([[1 - q], q * out[1:] / (1 - out[0])])
    elif zero != ZEROS["none"]:
        out = q * out
        out[0] += 1 - q
    return out


NAN = float("nan")
CASES = [
    (NAN, mu, q, form, zero, logk)
    for mu in (0.03, 1.7, 60.0) for form, logk in ((0, 0.0), (1, 0.4), (2, -1.0), (2, -9.0)) for zero, q in ((0, 1.0), (1, 0.3), (2, 0.8), (3, 0.6), (4, 0.5))
] + [(n, p, 1.0, form, 0, logk) for n in (1.0, 7.0, 400.0) for p in (0.02, 0.5, 0.97) for form, logk in ((0, 0.0), (2, -2.0), (2, 1.5))]


@pytest.mark.parametrize("case", CASES)
def test_chances_like_plain_sums(case):
    n, mu = case[:2]
    plain = masses(*case)
    y = np.arange(len(plain)) if not math.isnan(n) else np.array([0, 1, 2, 3, 5, 9, 40, 60, 61, 90, 200])
    rows = [np.full(len(y), v, float) for v in case]
    below, mass = laws.law_at(y.astype(float), *rows)
    before = np.concatenate([[0.0], np.cumsum(plain)])
    assert below == pytest.approx(before[y], abs=1e-9)
    assert mass == pytest.approx(plain[y], rel=1e-8, abs=1e-12)


def test_large_counts_cost_the_width_of_the_law():
    below, mass = laws.law_at(*[np.array([v]) for v in (1e9 + 3e4, NAN, 1e9, 1.0, 0.0, 0.0, 0.0)])
    assert below[0] == pytest.approx(0.5 * (1 + math.erf(3e4 / math.sqrt(2e9))), abs=1e-4) and 0 < mass[0] < 1e-4


def test_a_law_at_its_end_is_one_point():
    y, n = np.array([0.0, 1.0, 0.0, 2.0, 2.0]), np.array([NAN, NAN, 2.0, 2.0, 2.0])
    mu = np.array([0.0, 0.0, 0.0, 0.0, 1.0])
    below, mass = laws.law_at(y, n, mu, *[np.zeros(5) + v for v in (1, 0, 0, 0)])
    assert below.tolist() == [0, 1, 0, 1, 0] and mass.tolist() == [1, 0, 1, 0, 1]


def test_moments_like_plain_sums(spark):
    schema = "i int, law struct<n:double,mu:double,q:double,form:int,zero:int,logk:double>"
    rows = [(i, (None if math.isnan(c[0]) else c[0], *c[1:])) for i, c in enumerate(CASES)]
    mean, variance = diagnostics.moments("law")
    for i, got_mean, got_variance in spark.createDataFrame(rows, schema).select("i", mean, variance).collect():
        plain = masses(*CASES[i])
        at = np.arange(len(plain))
        m = (at * plain).sum()
        trials = 1.0 if math.isnan(CASES[i][0]) else CASES[i][0]
        assert got_mean * trials == pytest.approx(m, rel=1e-6)
        assert got_variance == pytest.approx(((at - m) ** 2 * plain).sum(), rel=1e-5)


def test_residuals_of_a_nested_fit_with_covariate(spark):
    """Means hold the unit effects; a missing unit has none, and a missing count no residual."""
    rng = np.random.default_rng(8)
    rows = []
    for u in range(12):
        effect = 0.6 * rng.normal()
        for k in range(30):
            d, x = k % 2, float(np.round(rng.normal(), 2))
            kept = rng.random() > 0.3
            rows.append(("sp", f"P{d + 1}", f"u{u}", x, float(rng.poisson(math.exp(0.8 + 0.4 * d + 0.3 * x + effect)) * kept), u * 100 + k))
    panel = spark.createDataFrame(rows, "species string, period string, unit string, x double, value double, at int")
    spec = FitSpec(("P1", "P2"), levels=("unit",))
    fitted = fit(panel, spec, [pick("inla", "zeroinflatedpoisson1", True), pick("inla", "poisson", False)])
    more = panel.union(spark.createDataFrame([("sp", "P1", None, 0.0, 1.0, 9000), ("sp", "P1", "u0", 0.0, None, 9001)], panel.schema))
    got = {r["at"]: r for r in diagnostics.pit_residuals(diagnostics.fitted_rows(more, fitted), ["at"]).collect()}
    assert set(got) == {r[5] for r in rows} | {9000, 9001} and got[9001]["residual"] is None
    one = fitted.coef.filter("cand = 1").first()
    units = {r["unit"]: r["effect"] for r in unit_effects(fitted).filter("zi").collect()}
    beta, q = one["beta"], 1 / (1 + math.exp(one["zpar"]))
    for _, period, unit, x, _, at in [*rows[::17], ("sp", "P1", None, 0.0, 1.0, 9000)]:
        d = int(period[1]) - 1
        eta = beta[d] + beta[d + 2] * x + units.get(unit, 0.0)
        assert got[at]["fitted"] == pytest.approx(q * math.exp(eta), rel=1e-9)
    shares = np.sort([got[r[5]]["residual"] for r in rows])
    assert np.abs(shares - (np.arange(len(shares)) + 0.5) / len(shares)).max() < 0.08
    other = spark.createDataFrame([("sp", 2)], "species string, cand int")
    plain = diagnostics.fitted_rows(panel, fitted, other)
    assert plain.count() == len(rows) and plain.filter(F.col("law.zero") != 0).count() == 0


@pytest.mark.parametrize("trials", [None, "n"])
def test_residuals_of_a_period_without_estimate(spark, trials):
    """Nothing was hit in P2 and, for proportions, everything in P3: all mass lies there."""
    hits = {"P1": [1, 0, 2, 1], "P2": [0, 0, 0, 0], "P3": [3, 3, 3, 3]}
    rows = [("sp", p, float(v), 3.0, 10 * int(p[1]) + i) for p, values in hits.items() for i, v in enumerate(values)]
    panel = spark.createDataFrame(rows, "species string, period string, value double, n double, at int")
    name = pick("glmmTMB", "binomial" if trials else "nbinom2", False)
    fitted = fit(panel, FitSpec(("P1", "P2", "P3"), covariate=None, trials=trials), [name])
    rows = diagnostics.fitted_rows(panel, fitted)
    got = {r["at"]: r for r in diagnostics.pit_residuals(rows, ["at"]).collect()}
    assert [got[20 + i]["fitted"] for i in range(4)] == [0.0] * 4 and got[10]["fitted"] == pytest.approx(1 / 3 if trials else 1.0)
    assert [got[30 + i]["fitted"] for i in range(4)] == pytest.approx([1.0 if trials else 3.0] * 4)
    assert all(0 <= r["residual"] <= 1 for r in got.values()) and len({got[20 + i]["residual"] for i in range(4)}) == 4
    assert diagnostics.dispersion_check(rows, ["species"]).first()["n"] == (4 if trials else 8)
