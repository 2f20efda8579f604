"""Results stored by kind, engine and name, and tables of chosen candidates."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import effects, publish
from panelweave.operators.fit import FitSpec, fit
from panelweave.sources import tables
from panelweave.sources.candidates import pick


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(4)
    rows = [(s, f"P{1 + k % 2}", float(rng.poisson(m))) for s, m in (("a", 2.0), ("b", 5.0), ("c", 1.0)) for k in range(80)]
    panel = spark.createDataFrame(rows, "species string, period string, value double")
    chain = [pick("inla", "poisson", False), pick("inla", "nbinomial2", False), pick("glmmTMB", "poisson", False)]
    return fit(panel, FitSpec(("P1", "P2"), covariate=None), chain)


CHOSEN = [("a", "inla", "poisson"), ("b", "inla", "poisson"), ("c", "glmmTMB", "poisson"), ("a", "inla", "nbinomial")]


def test_stored_results_come_back_and_replace(spark, fitted, tmp_path):
    path = str(tmp_path / "kept")
    for _ in range(2):
        publish.store_results([fitted], path, 50)
    want, got = publish.collate_contrasts([fitted], 50), publish.collate_stored(spark, path)
    assert got.count() == want.count() and want.exceptAll(got.select(want.columns)).count() == 0
    assert publish.collate_stored(spark, path, "model").count() == fitted.coef.count()
    assert publish.collate_stored(spark, path, "cellmeans").count() == 3 * 3 * 2


def test_choice_reads_its_folders_only(spark, fitted, tmp_path):
    path, side = str(tmp_path / "kept"), str(tmp_path / "chosen")
    publish.store_results([fitted], path, 50)
    tables.write_stage(spark.createDataFrame(CHOSEN, "species string, engine string, name string"), side)
    out = publish.stored_choice(spark, path, tables.read_stage(spark, side), "species", rows=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert sorted((r["species"], r["name"]) for r in out.select("species", "name").distinct().collect()) == [("a", "poisson"), ("b", "poisson")]


def test_only_chosen_keys_are_drawn(spark, fitted):
    names = spark.createDataFrame([(s, n) for s, _, n in CHOSEN], "species string, name string")
    kept = publish.only_chosen(fitted, names, "species", rows=4)
    assert sorted((r["species"], r["mod"], r["name"]) for r in kept.coef.collect()) == [(s, "inla", "poisson") for s in "abc"]
    whole = effects.draw_summary(fitted, 50).filter((F.col("mod") == "inla") & (F.col("name") == "poisson"))
    drawn = effects.draw_summary(kept, 50)
    assert drawn.count() == whole.count() and whole.exceptAll(drawn.select(whole.columns)).count() == 0
    assert publish.only_chosen(fitted, names.limit(0), "species", rows=0).coef.count() == 0
