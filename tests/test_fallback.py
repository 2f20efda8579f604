"""Families in order: later ones are fitted only to keys that the earlier ones left over."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from panelweave.operators import fallback
from panelweave.operators.fit import FitSpec
from panelweave.sources.candidates import pick


def test_later_families_see_failed_keys_only(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(s, f"P{1 + k % 2}", 0.0 if s == "none" else float(rng.poisson(3.0))) for s in ("a", "b", "c", "none") for k in range(60)]
    panel = spark.createDataFrame(rows, "species string, period string, value double")
    fails = {"poisson": ["b", "c"], "nbinomial": ["c"]}
    seen, real = [], fallback.fit

    def failing(left, spec, candidates):
        seen.append(sorted(r[0] for r in left.select("species").distinct().collect()))
        out = real(left, spec, candidates)
        bad = F.col("species").isin(fails.get(candidates[0].name, [""]))
        out.coef = out.coef.withColumn("status", F.when(bad, "not_converged").otherwise(F.col("status")))
        return out

    monkeypatch.setattr(fallback, "fit", failing)
    chain = [pick("inla", "poisson", False), pick("inla", "nbinomial", False), pick("inla", "nbinomial2", False), pick("inla", "zeroinflatedpoisson0", True)]
    found, tried = fallback.fit_in_order(panel, FitSpec(("P1", "P2"), covariate=None), chain)
    assert {r["species"]: (r["name"], r["attempt"]) for r in found.collect()} == {"a": ("poisson", 1), "b": ("nbinomial", 2), "c": ("nbinomial2", 3)}
    assert tried == [3, 2, 1] and seen == [["a", "b", "c", "none"], ["b", "c"], ["c"]]
