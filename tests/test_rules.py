"""Missing-value, ordering and key rules on small hand-written frames."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.functions import links, special, text
from panelweave.operators import effects, laws, levels, likelihood, lookup, panel, summary
from panelweave.sources import tables


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_cover_sums_and_fan_out(spark):
    raw = spark.createDataFrame(
        [("a", None, 1, 10, 1), ("a", None, None, 10, 2), ("b", 2.0, 1, 5, 1), ("b", 3.0, 2, None, 2), ("b", 3.0, 2, None, 2)],
        "k string, hc double, n_points int, total_points int, ab int",
    )
    out = rows(panel.cover_by_unit(raw, ["k"]), "k", "total_points")
    assert out == [("a", 0.0, None, 10), ("b", 5.0, 3, None), ("b", 5.0, 3, 5)]


def test_full_join_matches_missing_keys(spark):
    left = spark.createDataFrame([("r", None, 1.0), ("r", "1", 2.0)], "k string, s string, v double")
    right = spark.createDataFrame([("r", None, 9.0), (None, "1", 8.0)], "k string, s string, hc double")
    out = panel.full_join_panel(left, right, ["k", "s"])
    assert sorted(rows(out, "k"), key=str) == sorted([("r", None, 1.0, 9.0), ("r", "1", 2.0, None), (None, "1", None, 8.0)], key=str)


def test_semi_join_matches_missing_keys(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "f string, v int")
    keys = spark.createDataFrame([(None,), ("a",)], "f string")
    assert [r[1] for r in rows(panel.keep_matching(df, keys, ["f"]), "v")] == [1, 2]


@pytest.mark.parametrize("code,digit", [("A1", "1"), ("A12", "2"), ("A", "A"), ("1B", "1B")])
def test_last_digit(spark, code, digit):
    assert spark.range(1).select(text.last_digit(F.lit(code))).first()[0] == digit


def test_paste_and_numbers(spark):
    df = spark.createDataFrame([(None, "2", "19x9"), ("Reef", "1", "1999")], "a string, b string, y string")
    out = df.select(text.paste(F.col("a"), F.col("b")).alias("p"), text.to_number(F.col("y")).alias("y"))
    assert rows(out, "p") == [("NA 2", None), ("Reef 1", 1999.0)]


def test_zero_units_go_per_entity(spark):
    df = spark.createDataFrame(
        [("x", "s1", 0.0), ("x", "s1", 0.0), ("x", "s2", 1.0), ("y", "s1", 3.0)], "species string, site string, value double"
    )
    assert rows(panel.drop_zero_units(df), "species", "site") == [("x", "s2", 1.0), ("y", "s1", 3.0)]


def test_number_rows_is_global_and_repeatable(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    for parts in (1, 9):
        out = panel.number_rows(df.repartition(parts), [F.col("k")], "n").orderBy("k").collect()
        assert [r["n"] for r in out] == list(range(1, 5001))


def test_prediction_rows(spark):
    df = spark.createDataFrame([("x", "P1", 2.0)], "species string, period string, value double")
    out = rows(panel.with_prediction_rows(df, "species", ("P1", "P2"), trials=1), "is_pred", "period")
    assert out == [("x", "P1", 2.0, False, None), ("x", "P1", None, True, 1), ("x", "P2", None, True, 1)]


def test_nesting_check(spark):
    df = spark.createDataFrame([("r1", "s1"), ("r2", "s1"), ("r1", "s2")], "reef string, site string")
    assert rows(panel.units_with_several_parents(df, "site", "reef"), "site") == [("s1", 2)]


def test_overrides_also_to_missing_and_choice(spark):
    table = spark.createDataFrame(
        [("a", "Poisson", "FALSE"), ("b", "Poisson", "FALSE"), ("c", "poisson", "FALSE"), ("d", "Poisson", "TRUE"), ("e", "Poisson", None)],
        "species string, best_model string, exclude string",
    )
    table = lookup.override_values(table, [("b", "x"), ("b", None)], "species", "best_model")
    entities = spark.createDataFrame([(s,) for s in "abcdef"], "species string")
    out = lookup.choose_models(entities, table).select("species", "name")
    assert rows(out, "species") == [("a", "poisson"), ("b", "zeroinflatednbinomial0"), ("c", "zeroinflatednbinomial0")]


def test_caterpillar_rank_follows_first_panel(spark):
    df = spark.createDataFrame(
        [("g1", "x", "P2", 3.0), ("g1", "y", "P2", 1.0), ("g1", "z", "P3", 0.1), ("g0", "w", "P3", 9.0)],
        "g string, e string, p string, m double",
    )
    out = levels.caterpillar_rank(df, "g", "e", "p", "m")
    assert [(r["e"], r["display_rank"]) for r in out.orderBy("display_rank").collect()] == [("w", 1), ("y", 2), ("x", 3), ("z", 4)]


def test_effect_class_and_labels(spark):
    df = spark.createDataFrame([(1.1, 2.0), (0.2, 0.9), (0.5, 1.5), (None, None)], "lower double, upper double")
    got = [r[0] for r in df.select(text.effect_class(F.col("lower"), F.col("upper"))).collect()]
    assert got == ["Positive", "Negative", "None", "None"]
    label = spark.range(1).select(text.percent_change_label(F.lit(1.25)), text.display_name(F.lit("A_b_c"))).first()
    assert tuple(label) == ("25.0%", "A b_c")


def test_links(spark):
    df = spark.createDataFrame([(0.0,), (1.5,), (-2.0,)], "x double")
    out = {r["x"]: r for r in df.select("x", *[links.inverse_link(F.col("x"), n).alias(n.replace("/", "_").replace("^", "")) for n in links.LINKS]).collect()}
    assert out[0.0]["inverse"] is None and out[-2.0]["1_mu2"] is None
    for x, r in out.items():
        assert r["probit"] == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), abs=1e-13)
        assert r["softplus"] == pytest.approx(math.log1p(math.exp(x)))
    with pytest.raises(ValueError):
        links.inverse_link(F.col("x"), "unknown")


def test_special_functions(spark):
    values = [1e-3, 0.2, 1.0, 3.7, 9.9, 10.1, 250.0, 1e6]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for x, g in df.select("x", special.lgamma(F.col("x"))).collect():
        assert g == pytest.approx(math.lgamma(x), rel=5e-12, abs=5e-12)
    for x, g in zip(values, likelihood.digamma(np.array(values))):
        step = x * 1e-5
        assert g == pytest.approx((math.lgamma(x + step) - math.lgamma(x - step)) / (2 * step), rel=1e-5, abs=1e-5)


def test_poisson_tail(spark):
    df = spark.createDataFrame([(0.0, 2.0), (3.0, 2.0), (900.0, 1000.0), (4000.0, 3.0)], "y double, mu double")
    law = F.expr("named_struct('n', NULL, 'mu', mu, 'q', 1.0D, 'form', 0, 'zero', 0, 'logk', 0.0D)")
    told = df.withColumn("law", law).withColumn("at", laws.chances(F.col("y")))
    for y, mu, below in told.select("y", "mu", "at.below").collect():
        exact = math.fsum(math.exp(j * math.log(mu) - mu - math.lgamma(j + 1)) for j in range(int(y)))
        assert below == pytest.approx(exact, abs=1e-9)


def test_t_quantile(spark):
    got = spark.range(1).select(*[summary.t_quantile(F.lit(n)) for n in (1, 2, 10, 199, 200, 1000)]).first()
    assert list(got) == pytest.approx([12.7062047, 4.30265273, 2.22813885, 1.97195654, 1.97189622, 1.96233908], rel=1e-7)


def test_shortest_interval_takes_first_on_ties(spark):
    df = spark.createDataFrame([("k", float(v)) for v in (0, 1, 2, 3, 4)], "k string, v double")
    assert rows(effects.shortest_interval(df, ["k"], "v", 5, 0.6), "k") == [("k", 0.0, 3.0)]


def test_artefact_table_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("inla", "poisson", "x", 1.0), ("glmmTMB", "poisson", "x", 2.0)], "engine string, name string, species string, mean double")
    tables.write_artefacts(df, str(tmp_path / "a"), "contrasts")
    got = tables.read_artefacts(spark, str(tmp_path / "a"), "contrasts", engine="inla", names=["poisson"])
    assert [r["mean"] for r in got.collect()] == [1.0]
    (tmp_path / "l.csv").write_text("entity,trophic,family,best_model,exclude\nx,T,F,NA,TRUE\n")
    assert tables.read_lookup_csv(spark, str(tmp_path / "l.csv")).first()["best_model"] is None
    assert tables.tidy_names(spark.createDataFrame([(1,)], "`Best model` int")).columns == ["best_model"]
