"""Queries for fits, predictions, contrasts, publication tables and diagnostics, with their SQL counterparts.

Where a fit has a closed form (period-only models), the SQL computes that.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators import diagnostics, effects, publish
from panelweave.operators.design import covariate_scale
from panelweave.operators.fallback import fit_in_order
from panelweave.operators.fit import Fit, FitSpec, fit
from panelweave.operators.lookup import choose_models, override_values
from panelweave.operators.nested import System, eliminate, with_effects
from panelweave.operators.nested import effects as nested_effect_stages
from panelweave.plans import inputs as I
from panelweave.plans.prepare import SQL, best_model, rounded
from panelweave.session import scratch_folder
from panelweave.sources import tables
from panelweave.sources.candidates import (
    COUNT_CANDIDATES, DRAFT_ORDER, FALLBACK_ORDER, PROPORTION_CANDIDATES, Candidate, pick,
)

PERIOD_ONLY = FitSpec(I.PERIODS, covariate=None)
COVER_ONLY = FitSpec(I.PERIODS, keys=("species",), response="n_points", trials="total_points", covariate=None)
NESTED = FitSpec(I.PERIODS, levels=("reef", "site", "transect"), max_iterations=40)
POISSON_DRAWS = pick("inla", "poisson", False)
SUCCESSES_DRAWS = pick("inla", "nbinomial2", False)
POISSON_WALD = pick("glmmTMB", "poisson", False)
DRAWS = 1000


def fit_counts(
    spark: SparkSession, folder: str, *candidates: Candidate, spec: FitSpec = PERIOD_ONLY, raw: DataFrame | None = None
) -> Fit:
    panel = I.model_panel(spark, folder, raw) if spec.covariate else I.model_input(spark, folder, raw)
    return fit(panel, spec, list(candidates))


def cover_rows(spark: SparkSession, folder: str, raw: DataFrame | None = None) -> DataFrame:
    return I.coral_panel(spark, folder, raw).withColumn("species", F.lit("cover"))


def fit_cover(
    spark: SparkSession, folder: str, *candidates: Candidate, spec: FitSpec = COVER_ONLY, raw: DataFrame | None = None
) -> Fit:
    return fit(cover_rows(spark, folder, raw), spec, list(candidates))


def parameters(fitted: Fit, *extra: str) -> DataFrame:
    """Readable estimates of a fit: status, likelihood, scalar parameters and coefficients."""
    out = fitted.coef.select(
        *fitted.spec.keys, "mod", "name", "zi", "status", F.round("ll", 4).alias("loglik"),
        F.round("logk", 4).alias("log_dispersion"), F.round("zpar", 4).alias("zero_parameter"),
        F.transform("coef", lambda v: F.round(v, 4)).alias("coef"), *extra,
    )
    return out.withColumn("coef", F.array_join(F.col("coef").cast("array<string>"), ",", "NA"))


# --- fits -----------------------------------------------------------------------------------------------


def fit_poisson(spark: SparkSession, folder: str) -> DataFrame:
    fitted = fit_counts(spark, folder, POISSON_WALD)
    frame = effects._wald_frame(fitted, None).select(
        "species", "period", effects.known(F.exp("eta")).alias("mean"), effects.known(F.sqrt("v")).alias("se_log")
    )
    return rounded(frame, "mean", "se_log")


def fit_poisson_prior(spark: SparkSession, folder: str) -> DataFrame:
    """Weakly informative Gaussian priors on intercept and slopes."""
    spec = FitSpec(I.PERIODS, covariate=None, prior_mean=(-2.3, 0.0), prior_sd=(2.0, 3.0))
    fitted = fit_counts(spark, folder, POISSON_WALD, spec=spec)
    names = ["intercept", *I.PERIODS[1:]]
    return rounded(fitted.coef.select("species", *[F.col("coef")[i].alias(n) for i, n in enumerate(names)]), *names, digits=5)


def _means(fitted: Fit) -> DataFrame:
    return rounded(effects.cellmeans_wald(fitted).select("species", "period", "mean"), "mean", digits=5)


def fit_nb(spark: SparkSession, folder: str) -> DataFrame:
    return _means(fit_counts(spark, folder, pick("glmmTMB", "nbinom2", False)))


def fit_nb_linear(spark: SparkSession, folder: str) -> DataFrame:
    return parameters(fit_counts(spark, folder, pick("glmmTMB", "nbinom1", False)))


def fit_nb_successes(spark: SparkSession, folder: str) -> DataFrame:
    """Success probability per period for a fixed count of one success."""
    return _means(fit_counts(spark, folder, pick("inla", "nbinomial2", False)))


def fit_hurdle(spark: SparkSession, folder: str) -> DataFrame:
    fitted = fit_counts(
        spark, folder, pick("inla", "zeroinflatedpoisson0", True), pick("inla", "zeroinflatednbinomial0", True)
    )
    share = 1.0 / (1.0 + F.exp(-F.col("zpar")))
    return rounded(effects.usable(fitted).select("species", "name", share.alias("zero_share")), "zero_share")


def fit_zi_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return parameters(fit_counts(
        spark, folder, pick("inla", "zeroinflatedpoisson1", True), pick("inla", "zeroinflatednbinomial1", True)
    ))


def fit_zi_tied(spark: SparkSession, folder: str) -> DataFrame:
    return parameters(fit_counts(spark, folder, pick("inla", "zeroinflatednbinomial2", True)))


def fit_zi_regression(spark: SparkSession, folder: str) -> DataFrame:
    zero = F.array_join(F.transform("zbeta", lambda v: F.round(v, 3)).cast("array<string>"), ",").alias("zero_coef")
    return parameters(fit_counts(
        spark, folder, pick("glmmTMB", "poisson", True), pick("glmmTMB", "nbinom2", True), pick("glmmTMB", "nbinom1", True)
    ), zero)


def fit_binomial(spark: SparkSession, folder: str) -> DataFrame:
    return _means(fit_cover(spark, folder, pick("glmmTMB", "binomial", False)))


def fit_betabinomial(spark: SparkSession, folder: str) -> DataFrame:
    return parameters(fit_cover(spark, folder, pick("inla", "betabinomial", False), pick("glmmTMB", "betabinomial", False)))


def fit_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate for every entity, with covariate and three nested random intercepts, in one job."""
    fitted = fit_counts(spark, folder, *COUNT_CANDIDATES, spec=NESTED)
    sd = F.array_join(F.transform("prec", lambda v: F.round(1 / F.sqrt(v), 3)).cast("array<string>"), ",")
    return parameters(fitted, sd.alias("unit_sd"))


def fit_all_cover(spark: SparkSession, folder: str) -> DataFrame:
    spec = FitSpec(I.PERIODS, response="n_points", trials="total_points", covariate=None, levels=NESTED.levels)
    fitted = fit_cover(spark, folder, *PROPORTION_CANDIDATES, spec=spec)
    sd = F.array_join(F.transform("prec", lambda v: F.round(1 / F.sqrt(v), 3)).cast("array<string>"), ",")
    return parameters(fitted, sd.alias("unit_sd"))


def nested_scale(spark: SparkSession, folder: str, rounds: int = 24) -> Fit:
    """The benchmark fit: all candidates on the customer-level panel."""
    spec = FitSpec(I.PERIODS, levels=NESTED.levels, max_iterations=rounds)
    return fit(I.panel_scale(spark, folder), spec, COUNT_CANDIDATES)


def _fallback(spark: SparkSession, folder: str, order: list[str]) -> DataFrame:
    chain = [pick("inla", name, name.startswith("zero")) for name in order]
    return fit_in_order(I.model_input(spark, folder), PERIOD_ONLY, chain)[0]


def fallback_model(spark: SparkSession, folder: str) -> DataFrame:
    """First family in the fallback order with a usable fit, on period means without covariate and unit effects."""
    return _fallback(spark, folder, FALLBACK_ORDER)


def fallback_model_draft(spark: SparkSession, folder: str) -> DataFrame:
    """The same in the order of the draft analysis."""
    return _fallback(spark, folder, DRAFT_ORDER)


def nested_effects(spark: SparkSession, folder: str) -> DataFrame:
    """Gaussian model of ln(1 + count) with one mean and fixed variances: mean and unit effects."""
    levels = ["reef", "site", "transect"]
    precision = {"reef": "4.0D", "site": "8.0D", "transect": "16.0D"}
    system = System("c", 1)
    rows = I.model_input(spark, folder).selectExpr("species", *levels, "ln(1.0D + value) AS y")
    n, total = "CAST(count(*) AS DOUBLE)", "sum(y)"
    sums = {"c_a": n, "c_c": total, "c_ld": "0.0D", "c_b0": n, "c_xz0": total, "c_xx0_0": n}
    tables = {"transect": rows.groupBy("species", *levels).agg(*[F.expr(f"{t} AS {k}") for k, t in sums.items()])}
    tables["site"] = eliminate(tables["transect"], ["species", "reef", "site"], {system: precision["transect"]})
    tables["reef"] = eliminate(tables["site"], ["species", "reef"], {system: precision["site"]})
    top = eliminate(tables["reef"], ["species"], {system: precision["reef"]})
    beta = top.selectExpr("species", "array(c_xz0 / c_xx0_0) AS beta")
    above = None
    for i, level in enumerate(levels):
        keys = ["species", *levels[: i + 1]]
        linked = tables[level].select(*keys, "c_a", "c_c", "c_b0").join(beta, "species")
        if above is not None:
            linked = linked.join(above.drop("c_u", "c_v"), ["species", *levels[:i]])
        stages = [nested_effect_stages(system, precision[level], "beta", None, above is None)]
        above = with_effects(linked, [*keys, "beta"], stages, totals_only=False)
        above = above.drop("beta") if level != "transect" else above
    return rounded(
        above.selectExpr("species", *levels, "beta[0] AS mean", "c_u AS effect", "c_v AS variance", "c_o AS total"),
        "mean", "effect", "variance", "total",
    )


# --- predictions and contrasts ----------------------------------------------------------------------------


def cellmeans_wald(spark: SparkSession, folder: str) -> DataFrame:
    out = effects.cellmeans_wald(fit_counts(spark, folder, POISSON_WALD))
    return rounded(out.select("species", "period", "mean", "lower", "upper"), "mean", "lower", "upper")


def cellmeans_at_mean_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Marginal means of the covariate model, at the raw cover mean of each entity."""
    panel = I.model_panel(spark, folder)
    fitted = fit(panel, FitSpec(I.PERIODS), [POISSON_WALD, pick("glmmTMB", "nbinom2", False)])
    scale = covariate_scale(panel, ["species"])
    at = scale.selectExpr("species", "(ln(x_raw_mean + 0.01D) - x_centre) / x_scale AS x0")
    out = effects.cellmeans_wald(fitted, at).drop("mod", "fam", "type")
    return rounded(out, "mean", "lower", "upper", digits=4)


def contrasts_wald(spark: SparkSession, folder: str) -> DataFrame:
    out = effects.contrasts_wald(fit_counts(spark, folder, POISSON_WALD))
    return rounded(out.select("species", "period", "variable", "mean", "lower", "upper"), "mean", "lower", "upper")


def contrasts_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Odds ratios and differences of cover between periods."""
    out = effects.contrasts_wald(fit_cover(spark, folder, pick("glmmTMB", "binomial", False)))
    return rounded(out.select("period", "variable", "mean", "lower", "upper"), "mean", "lower", "upper")


def posterior_draws(spark: SparkSession, folder: str) -> DataFrame:
    out = effects.posterior_draws(fit_counts(spark, folder, POISSON_DRAWS), DRAWS)
    return rounded(out.select("species", "draw", "period", "value").filter("value IS NOT NULL"), "value", digits=5)


def cellmeans_draws(spark: SparkSession, folder: str) -> DataFrame:
    out = effects.cellmeans_draws(fit_counts(spark, folder, POISSON_DRAWS), DRAWS)
    return rounded(out.select("species", "period", "mean", "lower", "upper"), "mean", "lower", "upper", digits=5)


def draw_contrasts(spark: SparkSession, folder: str) -> DataFrame:
    out = effects.draw_contrasts(fit_counts(spark, folder, POISSON_DRAWS), DRAWS)
    return rounded(out.select("species", "draw", "period", "Ratio", "Values"), "Ratio", "Values", digits=5)


def draw_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = effects.draw_summary(fit_counts(spark, folder, POISSON_DRAWS), DRAWS)
    names = ["mean", "lower", "upper", "pl1", "pg1", "pl0", "pg0"]
    return rounded(out.select("species", "period", "variable", *names), *names, digits=5)


def linear_combination(spark: SparkSession, folder: str) -> DataFrame:
    """Intercept plus the last period contrast."""
    out = effects.linear_combination(fit_counts(spark, folder, POISSON_DRAWS), [1.0, 0.0, 0.0, 1.0])
    out = out.select("species", effects.known(F.col("estimate")).alias("estimate"), effects.known(F.col("se")).alias("se"))
    return rounded(out, "estimate", "se")


# --- publication tables -----------------------------------------------------------------------------------


def collated(spark: SparkSession, folder: str) -> DataFrame:
    return publish.collate_contrasts([fit_counts(spark, folder, POISSON_DRAWS, POISSON_WALD)], DRAWS)


def collate_contrasts(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(collated(spark, folder), "mean", "lower", "upper", digits=5)


def candidate_comparison(spark: SparkSession, folder: str) -> DataFrame:
    out = publish.candidate_comparison(collated(spark, folder), "species", "Priority_urgent")
    return rounded(out, "mean", "lower", "upper", digits=5)


def listed_models(spark: SparkSession, fitted: Fit) -> DataFrame:
    """Listed entities of a fit with the candidate of their label, each of which has a closed form."""
    schema = "species string, trophic string, family string, best_model string, exclude string"
    labels = override_values(spark.createDataFrame(I.LOOKUP, schema), [("Priority_medium", "Poisson")], "species", "best_model")
    return choose_models(fitted.cells.select("species").distinct(), labels, lookup_rows=len(I.LOOKUP))


def _table(fitted: Fit, names: DataFrame, group: str, cover: Fit | None, digits: int) -> DataFrame:
    """Effect table of the candidate chosen for each entity; only those keys are drawn. ``cover`` goes beside it."""
    drawn = effects.draw_summary(publish.only_chosen(fitted, names, "species", rows=len(I.LOOKUP)), DRAWS)
    chosen = publish.chosen_contrasts(drawn, names.select("species", group, "name"), "species", rows=len(I.LOOKUP))
    side = None
    if cover is not None:
        side = effects.draw_summary(cover, DRAWS).filter("variable = 'Ratio'").select("period", "mean", "lower", "upper")
    table = publish.effect_table(chosen, group, "species", overlay=side)
    return rounded(table, *[c for c in table.columns if c.split("_")[-1] in ("mean", "lower", "upper")], digits=digits)


def family_effects(spark: SparkSession, folder: str) -> DataFrame:
    """Effects of the listed entities by family, each under the candidate of its label, with binomial cover beside them."""
    raw = I.stored_cover(spark, folder)
    fitted = fit_counts(spark, folder, POISSON_DRAWS, SUCCESSES_DRAWS, raw=raw)
    cover = fit_cover(spark, folder, pick("inla", "binomial", False), raw=raw)
    return _table(fitted, listed_models(spark, fitted), "family", cover, 5)


def trophic_effects(spark: SparkSession, folder: str) -> DataFrame:
    fitted = fit_counts(spark, folder, POISSON_DRAWS, SUCCESSES_DRAWS)
    return _table(fitted, listed_models(spark, fitted), "trophic", None, 5)


def collate_all(spark: SparkSession, folder: str) -> DataFrame:
    """Contrasts of every count candidate of every entity and of every cover candidate, from what the fits stored."""
    raw = I.stored_cover(spark, folder)
    fits = [fit_counts(spark, folder, *COUNT_CANDIDATES, raw=raw), fit_cover(spark, folder, *PROPORTION_CANDIDATES, raw=raw)]
    path = f"{scratch_folder(spark)}/artefacts"
    publish.store_results(fits, path, DRAWS)
    return rounded(publish.collate_stored(spark, path), "mean", "lower", "upper", digits=4)


def contrasts_from_artefacts(spark: SparkSession, folder: str) -> DataFrame:
    """Contrasts of two engines, stored and collated again."""
    path = f"{scratch_folder(spark)}/artefacts"
    publish.store_results([fit_counts(spark, folder, POISSON_DRAWS, POISSON_WALD)], path, DRAWS)
    return rounded(publish.collate_stored(spark, path), "mean", "lower", "upper", digits=5)


def chosen_from_artefacts(spark: SparkSession, folder: str) -> DataFrame:
    """Stored ratios of each listed entity's candidate; folders of other candidates aren't read."""
    root = scratch_folder(spark)
    fitted = fit_counts(spark, folder, POISSON_DRAWS, SUCCESSES_DRAWS, POISSON_WALD)
    publish.store_results([fitted], f"{root}/artefacts", DRAWS)
    names = listed_models(spark, fitted).select("species", "family", F.lit(POISSON_DRAWS.mod).alias("engine"), "name")
    tables.write_stage(names, f"{root}/chosen")
    stored = publish.stored_choice(spark, f"{root}/artefacts", tables.read_stage(spark, f"{root}/chosen"), "species", rows=len(I.LOOKUP))
    out = stored.filter("variable = 'Ratio'").select("family", "species", "name", "period", "mean", "lower", "upper")
    return rounded(out, "mean", "lower", "upper", digits=5)


def _chosen(spark: SparkSession, folder: str, group: str, overlay: bool) -> DataFrame:
    raw = I.stored_cover(spark, folder) if overlay else None
    panel = I.model_input(spark, folder, raw)
    names = best_model(spark, folder, panel)
    fitted = fit(panel, PERIOD_ONLY, [c for c in COUNT_CANDIDATES if c.mod == "inla"])
    cover = fit_cover(spark, folder, pick("inla", "betabinomial", False), raw=raw) if overlay else None
    return _table(fitted, names, group, cover, 4)


def chosen_family_effects(spark: SparkSession, folder: str) -> DataFrame:
    """Effect table in which each listed entity has the candidate that the lookup chooses, with beta-binomial cover beside it."""
    return _chosen(spark, folder, "family", True)


def chosen_trophic_effects(spark: SparkSession, folder: str) -> DataFrame:
    """The same by trophic group, without cover."""
    return _chosen(spark, folder, "trophic", False)


# --- diagnostics ------------------------------------------------------------------------------------------

ROW_ORDER = ["species", "site", "transect", "report_year"]


def residual_rows(spark: SparkSession, folder: str) -> DataFrame:
    panel = I.model_input(spark, folder)
    fitted = fit(panel, PERIOD_ONLY, [POISSON_WALD])
    return diagnostics.fitted_rows(panel, fitted)


def residuals(spark: SparkSession, folder: str) -> DataFrame:
    return diagnostics.pit_residuals(residual_rows(spark, folder), ROW_ORDER)


def pit_residuals(spark: SparkSession, folder: str) -> DataFrame:
    out = residuals(spark, folder).select(*ROW_ORDER, "obs", "value", "fitted", "residual")
    return rounded(out, "fitted", "residual")


def uniformity_check(spark: SparkSession, folder: str) -> DataFrame:
    rows = residuals(spark, folder).withColumn("residual", F.round("residual", 9))
    out = diagnostics.uniformity_check(rows, ["species"], len(I.ENTITIES))
    return rounded(out, "distance", "p_value", digits=5)


def residual_trend(spark: SparkSession, folder: str) -> DataFrame:
    rows = residuals(spark, folder).withColumn("fitted", F.round("fitted", 9))
    out = diagnostics.residual_trend(rows, ["species"], len(I.ENTITIES))
    return rounded(out, "fitted", "q25", "q50", "q75", digits=5)


def residual_trend_drawn(spark: SparkSession, folder: str) -> DataFrame:
    """The trend over the mean of the draws."""
    panel = I.model_input(spark, folder)
    fitted = fit(panel, PERIOD_ONLY, [POISSON_DRAWS])
    rows = diagnostics.pit_residuals(diagnostics.fitted_rows(panel, fitted), ROW_ORDER)
    rows = diagnostics.with_drawn_mean(rows, fitted, DRAWS).withColumn("fitted", F.round("fitted", 9))
    return rounded(diagnostics.residual_trend(rows, ["species"], len(I.ENTITIES)), "fitted", "q25", "q50", "q75", digits=5)


def dispersion_check(spark: SparkSession, folder: str) -> DataFrame:
    out = diagnostics.dispersion_check(residual_rows(spark, folder), ["species"])
    return rounded(out, "x2", "ratio", "score", digits=5)


def cover_residual_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = cover_rows(spark, folder).filter("total_points > 0")
    return diagnostics.fitted_rows(rows, fit(rows, COVER_ONLY, [pick("glmmTMB", "binomial", False)]))


def pit_residuals_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Residuals of hits out of trials."""
    out = diagnostics.pit_residuals(cover_residual_rows(spark, folder), ROW_ORDER, "n_points")
    return rounded(out.select(*ROW_ORDER, "obs", "n_points", "total_points", "fitted", "residual"), "fitted", "residual")


def dispersion_check_cover(spark: SparkSession, folder: str) -> DataFrame:
    out = diagnostics.dispersion_check(cover_residual_rows(spark, folder), ["species"], "n_points")
    return rounded(out, "x2", "ratio", "score", digits=5)


def successes_rows(spark: SparkSession, folder: str) -> DataFrame:
    panel = I.model_input(spark, folder)
    return diagnostics.fitted_rows(panel, fit(panel, PERIOD_ONLY, [pick("inla", "nbinomial2", False)]))


def pit_residuals_successes(spark: SparkSession, folder: str) -> DataFrame:
    """Residuals of the negative binomial with a fixed count of one success."""
    out = diagnostics.pit_residuals(successes_rows(spark, folder), ROW_ORDER)
    return rounded(out.select(*ROW_ORDER, "obs", "value", "fitted", "residual"), "fitted", "residual")


def dispersion_check_successes(spark: SparkSession, folder: str) -> DataFrame:
    out = diagnostics.dispersion_check(successes_rows(spark, folder), ["species"])
    return rounded(out, "x2", "ratio", "score", digits=5)


def pit_residuals_chosen(spark: SparkSession, folder: str) -> DataFrame:
    """Residuals of each listed entity under the candidate that the lookup chooses for it."""
    wanted = [c for c in COUNT_CANDIDATES if c.mod == "inla"]
    panel = I.model_input(spark, folder)
    number = F.create_map(*[v for i, c in enumerate(wanted) for v in (F.lit(c.name), F.lit(i + 1))])
    chosen = best_model(spark, folder, panel).select("species", number[F.col("name")].alias("cand"))
    rows = diagnostics.fitted_rows(panel, fit(panel, PERIOD_ONLY, wanted), chosen)
    out = diagnostics.pit_residuals(rows, ROW_ORDER).select(*ROW_ORDER, "obs", "value", "fitted", "residual")
    return rounded(out, "fitted", "residual", digits=4)


def fit_scores(spark: SparkSession, folder: str) -> DataFrame:
    panel = I.model_input(spark, folder)
    out = diagnostics.fit_scores(panel, fit(panel, PERIOD_ONLY, [POISSON_DRAWS]), DRAWS)
    return rounded(out.select("species", "dic", "waic", "p_waic", "log_score"), "dic", "waic", "p_waic", "log_score", digits=4)


def fit_scores_families(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every candidate of the draws engine, for choosing among families."""
    panel = I.model_input(spark, folder)
    out = diagnostics.fit_scores(panel, fit(panel, PERIOD_ONLY, [c for c in COUNT_CANDIDATES if c.mod == "inla"]), DRAWS)
    return rounded(out.select("species", "name", "dic", "waic", "p_waic", "log_score"), "dic", "waic", "p_waic", "log_score", digits=3)


def fit_scores_successes(spark: SparkSession, folder: str) -> DataFrame:
    panel = I.model_input(spark, folder)
    out = diagnostics.fit_scores(panel, fit(panel, PERIOD_ONLY, [SUCCESSES_DRAWS]), DRAWS)
    return rounded(out.select("species", "dic", "waic", "p_waic", "log_score"), "dic", "waic", "p_waic", "log_score", digits=4)


QUERIES = {
    "fit_poisson": fit_poisson,
    "fit_poisson_prior": fit_poisson_prior,
    "fit_nb": fit_nb,
    "fit_nb_linear": fit_nb_linear,
    "fit_nb_successes": fit_nb_successes,
    "fit_hurdle": fit_hurdle,
    "fit_zi_mixture": fit_zi_mixture,
    "fit_zi_tied": fit_zi_tied,
    "fit_zi_regression": fit_zi_regression,
    "fit_binomial": fit_binomial,
    "fit_betabinomial": fit_betabinomial,
    "fit_all": fit_all,
    "fit_all_cover": fit_all_cover,
    "fallback_model": fallback_model,
    "fallback_model_draft": fallback_model_draft,
    "nested_effects": nested_effects,
    "cellmeans_wald": cellmeans_wald,
    "cellmeans_at_mean_cover": cellmeans_at_mean_cover,
    "contrasts_wald": contrasts_wald,
    "contrasts_cover": contrasts_cover,
    "posterior_draws": posterior_draws,
    "cellmeans_draws": cellmeans_draws,
    "draw_contrasts": draw_contrasts,
    "draw_summary": draw_summary,
    "linear_combination": linear_combination,
    "collate_contrasts": collate_contrasts,
    "candidate_comparison": candidate_comparison,
    "collate_all": collate_all,
    "chosen_family_effects": chosen_family_effects,
    "chosen_trophic_effects": chosen_trophic_effects,
    "contrasts_from_artefacts": contrasts_from_artefacts,
    "chosen_from_artefacts": chosen_from_artefacts,
    "family_effects": family_effects,
    "trophic_effects": trophic_effects,
    "pit_residuals": pit_residuals,
    "uniformity_check": uniformity_check,
    "residual_trend": residual_trend,
    "residual_trend_drawn": residual_trend_drawn,
    "dispersion_check": dispersion_check,
    "pit_residuals_cover": pit_residuals_cover,
    "dispersion_check_cover": dispersion_check_cover,
    "pit_residuals_successes": pit_residuals_successes,
    "dispersion_check_successes": dispersion_check_successes,
    "pit_residuals_chosen": pit_residuals_chosen,
    "fit_scores": fit_scores,
    "fit_scores_families": fit_scores_families,
    "fit_scores_successes": fit_scores_successes,
}

# --- SQL --------------------------------------------------------------------------------------------------

Z = repr(effects.Z)
CELLS = """, cells AS (SELECT species, period, sum(value) AS s, CAST(count(*) AS DOUBLE) AS n FROM seen GROUP BY ALL),
pois AS (SELECT species, period, CASE WHEN s > 0 THEN s / n END AS m, CASE WHEN s > 0 THEN 1 / s END AS v FROM cells
  WHERE species IN (SELECT species FROM cells GROUP BY species HAVING sum(s) > 0)),
grid AS (SELECT * FROM (SELECT DISTINCT species FROM pois) CROSS JOIN (VALUES ('P1'), ('P2'), ('P3'), ('P4')) g(period)),
pm AS (SELECT species, period, m, v FROM grid LEFT JOIN pois USING (species, period)),
pb AS (SELECT a.species, a.period, a.m, a.v, b.m AS m1, b.v AS v1 FROM pm a JOIN pm b USING (species) WHERE b.period = 'P1')
"""
WALD = f""", wald AS (
  SELECT species, period, 'Ratio' AS variable, exp(ln(m) - ln(m1)) AS mean,
    exp(ln(m) - ln(m1) - {Z} * sqrt(v + v1)) AS lower, exp(ln(m) - ln(m1) + {Z} * sqrt(v + v1)) AS upper
  FROM pb WHERE period <> 'P1' UNION ALL
  SELECT species, period, 'Values', m - m1, m - m1 - {Z} * sqrt(m * m * v + m1 * m1 * v1),
    m - m1 + {Z} * sqrt(m * m * v + m1 * m1 * v1) FROM pb WHERE period <> 'P1')
"""


def _deviate(j: int) -> str:
    a, b = math.sqrt(effects.PRIMES[2 * j]), math.sqrt(effects.PRIMES[2 * j + 1])
    return (
        f"sqrt(-2 * ln(i * {a!r} - floor(i * {a!r}))) * cos({2 * math.pi!r} * (i * {b!r} - floor(i * {b!r})))"
    )


DRAW = f""", deviates AS (
  SELECT i AS draw, 'P' || (j + 1) AS period, CASE j WHEN 0 THEN {_deviate(0)} WHEN 1 THEN {_deviate(1)}
    WHEN 2 THEN {_deviate(2)} ELSE {_deviate(3)} END AS e
  FROM (SELECT unnest(range(1, {DRAWS + 1}))::DOUBLE AS i) CROSS JOIN (SELECT unnest(range(0, 4)) AS j)),
draws AS (SELECT species, CAST(draw AS INT) AS draw, period, exp(ln(m) + e * sqrt(v)) AS value
  FROM pb JOIN deviates USING (period) WHERE m IS NOT NULL AND m1 IS NOT NULL)
"""
DRAW_CONTRASTS = """, dc AS (SELECT a.species, a.draw, a.period, exp(ln(a.value) - ln(b.value)) AS Ratio, a.value - b.value AS Values
  FROM draws a JOIN draws b USING (species, draw) WHERE b.period = 'P1' AND a.period <> 'P1'),
dl AS (SELECT species, draw, period, 'Ratio' AS variable, Ratio AS x FROM dc UNION ALL SELECT species, draw, period, 'Values', Values FROM dc)
"""


def _summary(source: str, name: str, keys: str) -> str:
    reach = int(DRAWS * 0.95)
    return f""", {name}_spans AS (
  SELECT {keys}, x AS low, lead(x, {reach}) OVER (PARTITION BY {keys} ORDER BY x) AS high FROM {source}),
{name}_hdi AS (SELECT {keys}, arg_min(low, high - low) AS lower, arg_min(high, high - low) AS upper
  FROM {name}_spans WHERE high IS NOT NULL GROUP BY {keys}),
{name} AS (SELECT {keys}, avg(x) AS mean, avg((x < 1)::INT) AS pl1, avg((x > 1)::INT) AS pg1, avg((x < 0)::INT) AS pl0,
  avg((x > 0)::INT) AS pg0 FROM {source} GROUP BY {keys})
"""


SUMMARY = _summary("dl", "ds", "species, period, variable")
BINOMIAL = """, bm AS (SELECT period, sum(n_points) / sum(total_points) AS p,
  1 / (sum(total_points) * (sum(n_points) / sum(total_points)) * (1 - sum(n_points) / sum(total_points))) AS v
  FROM coral GROUP BY period)
"""
COVER_DRAW = f""", cdev AS (SELECT bm.period, draw, 1 / (1 + exp(-(ln(p / (1 - p)) + e * sqrt(v)))) AS value
  FROM bm JOIN deviates USING (period)),
cdl AS (SELECT a.period, exp(ln(a.value) - ln(b.value)) AS x FROM cdev a JOIN cdev b USING (draw)
  WHERE b.period = 'P1' AND a.period <> 'P1')
"""
COLLATED = f""", res AS (
  SELECT species, 'inla' AS mod, 'poisson' AS name, 'Poisson' AS fam, '' AS type, FALSE AS zi, period, variable, mean, lower, upper
  FROM ds JOIN ds_hdi USING (species, period, variable) UNION ALL
  SELECT species, 'glmmTMB', 'poisson', 'Poisson', '', FALSE, period, variable, mean, lower, upper FROM wald)
"""
DRAWN = SQL + CELLS + DRAW + DRAW_CONTRASTS + SUMMARY
# Draws of the candidate chosen for each entity: log means, or success probabilities for one success.
CHOSEN = """, listed(species, trophic, family, name) AS (VALUES ('Priority_urgent', 'Upper', 'Fast', 'poisson'),
  ('Priority_high', 'Upper', 'Fast', 'nbinomial2'), ('Priority_medium', 'Lower', 'Slow', 'poisson')),
mix AS (SELECT species, draw, period, CASE name WHEN 'poisson' THEN exp(ln(m) + e * sqrt(v))
    ELSE 1 / (1 + exp(ln(m) - e * sqrt(v * (1 + m)))) END AS value
  FROM pb JOIN deviates USING (period) JOIN listed USING (species) WHERE m IS NOT NULL AND m1 IS NOT NULL),
mixl AS (SELECT a.species, a.period, exp(ln(a.value) - ln(b.value)) AS x FROM mix a JOIN mix b USING (species, draw)
  WHERE b.period = 'P1' AND a.period <> 'P1')
""" + _summary("mixl", "ms", "species, period")


def _published_sql(group: str, overlay: bool) -> str:
    side = ", overlay_mean, overlay_lower, overlay_upper" if overlay else ""
    extra = (
        COVER_DRAW + _summary("cdl", "cs", "period") + """, ov AS (SELECT period, round(mean, 5) AS overlay_mean,
        round(lower, 5) AS overlay_lower, round(upper, 5) AS overlay_upper FROM cs JOIN cs_hdi USING (period))"""
        if overlay else ""
    )
    return SQL + CELLS + DRAW + (BINOMIAL if overlay else "") + CHOSEN + extra + f""", ch AS (
      SELECT {group}, species, period, mean, lower, upper FROM ms JOIN ms_hdi USING (species, period) JOIN listed USING (species)),
      f AS (SELECT {group}, species, min({{'p': period, 'm': mean}}) AS first FROM ch GROUP BY ALL),
      o AS (SELECT species, row_number() OVER (ORDER BY {group}, first.p, first.m, species) AS display_rank FROM f)
      SELECT {group}, species, period, round(mean, 5) AS mean, round(lower, 5) AS lower, round(upper, 5) AS upper, display_rank,
        CASE WHEN lower > 1 THEN 'Positive' WHEN upper < 1 THEN 'Negative' ELSE 'None' END AS effect{side}
      FROM ch JOIN o USING (species){" LEFT JOIN ov USING (period)" if overlay else ""}"""


RESIDUALS = """, numbered AS (SELECT *, row_number() OVER (ORDER BY species, site, transect, report_year) AS obs FROM seen),
fr AS (SELECT numbered.*, coalesce(m, 0) AS fitted FROM numbered JOIN pm USING (species, period)),
pit AS (SELECT *, CASE WHEN fitted = 0 THEN (value > 0)::INT + (obs * 0.6180339887498949 - floor(obs * 0.6180339887498949)) * (value = 0)::INT
  ELSE list_sum(list_transform(range(0, CAST(value AS BIGINT) + 1), lambda j:
    (CASE WHEN j < value THEN 1 ELSE obs * 0.6180339887498949 - floor(obs * 0.6180339887498949) END)
    * exp(j * ln(fitted) - fitted - lgamma(j + 1.0)))) END AS residual FROM fr)
"""

FRACTION = "(obs * 0.6180339887498949 - floor(obs * 0.6180339887498949))"
SUCCESSES = f""", numbered AS (SELECT *, row_number() OVER (ORDER BY species, site, transect, report_year) AS obs FROM seen),
fr AS (SELECT numbered.*, coalesce(m, 0) AS fitted FROM numbered JOIN pm USING (species, period)),
pit AS (SELECT *, 1 - pow(fitted / (1 + fitted), value) + {FRACTION} * pow(fitted / (1 + fitted), value) / (1 + fitted) AS residual FROM fr)
"""
COVER_LAW = f""", bm AS (SELECT period, sum(n_points) / sum(total_points) AS p FROM coral GROUP BY period),
fr AS (SELECT 'cover' AS species, site, transect, report_year, n_points, total_points, p AS fitted,
  row_number() OVER (ORDER BY site, transect, report_year) AS obs FROM coral JOIN bm USING (period) WHERE total_points > 0),
pit AS (SELECT *, list_sum(list_transform(range(0, CAST(n_points AS BIGINT) + 1), lambda j:
  (CASE WHEN j < n_points THEN 1 ELSE {FRACTION} END) * exp(lgamma(total_points + 1.0) - lgamma(j + 1.0) - lgamma(total_points - j + 1.0)
    + j * ln(fitted) + (total_points - j) * ln(1 - fitted)))) AS residual FROM fr)
"""

NESTED_SQL = """, t AS (SELECT species, reef, site, transect, CAST(count(*) AS DOUBLE) AS a, sum(ln(1 + value)) AS c FROM seen GROUP BY ALL),
s AS (SELECT species, reef, site, sum(a * 16 / (a + 16)) AS a, sum(c * 16 / (a + 16)) AS c FROM t GROUP BY ALL),
r AS (SELECT species, reef, sum(a * 8 / (a + 8)) AS a, sum(c * 8 / (a + 8)) AS c FROM s GROUP BY ALL),
k AS (SELECT species, sum(a * 4 / (a + 4)) AS a, sum(c * 4 / (a + 4)) AS c FROM r GROUP BY ALL),
re AS (SELECT r.species, reef, k.c / k.a AS beta, (r.c - r.a * k.c / k.a) / (r.a + 4) AS o, 1 / (r.a + 4) AS vo
  FROM r JOIN k USING (species)),
se AS (SELECT s.species, s.reef, site, beta, o + (s.c - s.a * (beta + o)) / (s.a + 8) AS o,
  1 / (s.a + 8) + vo * pow(1 - s.a / (s.a + 8), 2) AS vo FROM s JOIN re ON s.species = re.species AND s.reef = re.reef)
SELECT t.species, t.reef, t.site, transect, round(beta, 6) AS mean, round((t.c - t.a * (beta + o)) / (t.a + 16), 6) + 0.0 AS effect,
  round(1 / (t.a + 16) + pow(t.a / (t.a + 16), 2) * vo, 6) AS variance,
  round(o + (t.c - t.a * (beta + o)) / (t.a + 16), 6) + 0.0 AS total
FROM t JOIN se ON t.species = se.species AND t.reef = se.reef AND t.site = se.site"""

# Newton steps on intercept a and contrasts b: the matrix is an arrow, so b is eliminated.
PRIOR_SQL = """, w AS (SELECT species, """ + ", ".join(
    f"coalesce(sum(value) FILTER (WHERE period = 'P{i}'), 0) AS s{i}, (count(*) FILTER (WHERE period = 'P{i}'))::DOUBLE AS n{i}"
    for i in range(1, 5)
) + """ FROM seen GROUP BY species),
newton AS (
  SELECT species, 0 AS turn, ln((s1 + s2 + s3 + s4 + 0.5) / (n1 + n2 + n3 + n4)) AS a, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3, 0.0::DOUBLE AS b4 FROM w
  UNION ALL
  SELECT species, turn + 1, a + da, b2 + (g2 - m2 * da) / (m2 + 1 / 9), b3 + (g3 - m3 * da) / (m3 + 1 / 9), b4 + (g4 - m4 * da) / (m4 + 1 / 9)
  FROM (SELECT *, greatest(least((g0 - m2 * g2 / (m2 + 1 / 9) - m3 * g3 / (m3 + 1 / 9) - m4 * g4 / (m4 + 1 / 9))
      / (m1 + m2 + m3 + m4 + 0.25 - m2 * m2 / (m2 + 1 / 9) - m3 * m3 / (m3 + 1 / 9) - m4 * m4 / (m4 + 1 / 9)), 2), -2) AS da
    FROM (SELECT *, s1 + s2 + s3 + s4 - m1 - m2 - m3 - m4 - (a + 2.3) / 4 AS g0, s2 - m2 - b2 / 9 AS g2, s3 - m3 - b3 / 9 AS g3, s4 - m4 - b4 / 9 AS g4
      FROM (SELECT *, n1 * exp(a) AS m1, n2 * exp(a + b2) AS m2, n3 * exp(a + b3) AS m3, n4 * exp(a + b4) AS m4 FROM newton JOIN w USING (species))))
  WHERE turn < 60)
SELECT species, round(a, 5) + 0.0 AS intercept, round(b2, 5) + 0.0 AS P2, round(b3, 5) + 0.0 AS P3, round(b4, 5) + 0.0 AS P4 FROM newton WHERE turn = 60"""

ORACLES = {
    "fit_poisson_prior": SQL.replace("WITH ", "WITH RECURSIVE ", 1) + PRIOR_SQL,
    "fit_poisson": SQL + CELLS + "SELECT species, period, round(m, 6) AS mean, round(sqrt(v), 6) AS se_log FROM pm",
    "fit_nb": SQL + CELLS + "SELECT species, period, round(m, 5) AS mean FROM pm",
    "fit_nb_successes": SQL + CELLS + "SELECT species, period, round(1 / (1 + m), 5) AS mean FROM pm",
    "fit_binomial": SQL + "SELECT 'cover' AS species, period, round(sum(n_points) / sum(total_points), 5) AS mean FROM coral GROUP BY period",
    "fit_hurdle": SQL + """, z AS (SELECT species, avg((value = 0)::INT) AS zs FROM seen GROUP BY species
      HAVING sum(value) > 0) SELECT species, name, round(greatest(zs, 1e-9), 6) AS zero_share FROM z
      CROSS JOIN (VALUES ('zeroinflatedpoisson0'), ('zeroinflatednbinomial0')) c(name)""",
    "nested_effects": SQL + NESTED_SQL,
    "cellmeans_wald": SQL + CELLS + f"""SELECT species, period, round(m, 6) AS mean, round(exp(ln(m) - {Z} * sqrt(v)), 6) AS lower,
      round(exp(ln(m) + {Z} * sqrt(v)), 6) AS upper FROM pm""",
    "contrasts_wald": SQL + CELLS + WALD + """SELECT species, period, variable, round(mean, 6) + 0.0 AS mean,
      round(lower, 6) + 0.0 AS lower, round(upper, 6) + 0.0 AS upper FROM wald""",
    "contrasts_cover": SQL + BINOMIAL + f""", b AS (SELECT a.period, a.p, a.v, c.p AS p1, c.v AS v1,
      ln(a.p / (1 - a.p)) - ln(c.p / (1 - c.p)) AS d, a.p * (1 - a.p) AS g, c.p * (1 - c.p) AS g1
      FROM bm a CROSS JOIN bm c WHERE c.period = 'P1' AND a.period <> 'P1')
      SELECT period, 'Ratio' AS variable, round(exp(d), 6) AS mean, round(exp(d - {Z} * sqrt(v + v1)), 6) AS lower,
        round(exp(d + {Z} * sqrt(v + v1)), 6) AS upper FROM b UNION ALL
      SELECT period, 'Values', round(p - p1, 6) + 0.0, round(p - p1 - {Z} * sqrt(g * g * v + g1 * g1 * v1), 6) + 0.0,
        round(p - p1 + {Z} * sqrt(g * g * v + g1 * g1 * v1), 6) + 0.0 FROM b""",
    "posterior_draws": SQL + CELLS + DRAW + "SELECT species, draw, period, round(value, 5) AS value FROM draws",
    "cellmeans_draws": SQL + CELLS + DRAW + """SELECT species, period, round(avg(value), 5) AS mean,
      round(quantile_cont(value, 0.025), 5) AS lower, round(quantile_cont(value, 0.975), 5) AS upper FROM draws GROUP BY species, period""",
    "draw_contrasts": SQL + CELLS + DRAW + DRAW_CONTRASTS
    + "SELECT species, draw, period, round(Ratio, 5) AS Ratio, round(Values, 5) + 0.0 AS Values FROM dc",
    "draw_summary": DRAWN + """SELECT species, period, variable, round(mean, 5) + 0.0 AS mean, round(lower, 5) + 0.0 AS lower,
      round(upper, 5) + 0.0 AS upper, round(pl1, 5) AS pl1, round(pg1, 5) AS pg1, round(pl0, 5) AS pl0, round(pg0, 5) AS pg0
      FROM ds JOIN ds_hdi USING (species, period, variable)""",
    "linear_combination": SQL + CELLS + """SELECT species, CASE WHEN m1 IS NOT NULL THEN round(ln(m), 6) + 0.0 END AS estimate,
      CASE WHEN m1 IS NOT NULL THEN round(sqrt(v), 6) END AS se FROM pb WHERE period = 'P4'""",
    "collate_contrasts": DRAWN + WALD + COLLATED + """SELECT species, mod, name, fam, type, zi, period, variable,
      round(mean, 5) + 0.0 AS mean, round(lower, 5) + 0.0 AS lower, round(upper, 5) + 0.0 AS upper FROM res""",
    "candidate_comparison": DRAWN + WALD + COLLATED + """SELECT species, fam, zi, mod, type, period, round(mean, 5) AS mean,
      round(lower, 5) AS lower, round(upper, 5) AS upper FROM res WHERE species = 'Priority_urgent' AND variable = 'Ratio'""",
    "contrasts_from_artefacts": DRAWN + WALD + COLLATED + """SELECT species, mod, name, fam, type, zi, period, variable,
      round(mean, 5) + 0.0 AS mean, round(lower, 5) + 0.0 AS lower, round(upper, 5) + 0.0 AS upper FROM res""",
    "chosen_from_artefacts": SQL + CELLS + DRAW + CHOSEN + """SELECT family, species, name, period, round(mean, 5) AS mean,
      round(lower, 5) AS lower, round(upper, 5) AS upper FROM ms JOIN ms_hdi USING (species, period) JOIN listed USING (species)""",
    "family_effects": _published_sql("family", True),
    "trophic_effects": _published_sql("trophic", False),
    "pit_residuals": SQL + CELLS + RESIDUALS + """SELECT species, site, transect, report_year, obs, value, round(fitted, 6) AS fitted,
      round(residual, 6) + 0.0 AS residual FROM pit""",
    "uniformity_check": SQL + CELLS + RESIDUALS + """, q AS (SELECT species, round(residual, 9) AS r,
      row_number() OVER (PARTITION BY species ORDER BY round(residual, 9), obs) AS i, count(*) OVER (PARTITION BY species) AS n FROM pit),
      d AS (SELECT species, n, max(greatest(i / n - r, r - (i - 1) / n)) AS distance FROM q GROUP BY species, n)
      SELECT species, n, round(distance, 5) AS distance, round(CASE WHEN sqrt(n) * distance < 0.2 THEN 1.0 ELSE
        greatest(least(list_sum(list_transform(range(1, 31), lambda k: 2 * pow(-1, k - 1) * exp(-2 * k * k * n * distance * distance))), 1), 0)
        END, 5) + 0.0 AS p_value FROM d""",
    "residual_trend": SQL + CELLS + RESIDUALS + """, q AS (SELECT species, residual, fitted,
      row_number() OVER (PARTITION BY species ORDER BY round(fitted, 9), obs) AS i, count(*) OVER (PARTITION BY species) AS n FROM pit)
      SELECT species, CAST(floor((i - 1) * 4 / n) + 1 AS BIGINT) AS bin, count(*) AS n, round(avg(fitted), 5) AS fitted,
        round(quantile_cont(residual, 0.25), 5) AS q25, round(quantile_cont(residual, 0.5), 5) AS q50,
        round(quantile_cont(residual, 0.75), 5) AS q75 FROM q GROUP BY species, bin""",
    "residual_trend_drawn": SQL + CELLS + DRAW + RESIDUALS + """, dm AS (SELECT species, period, avg(value) AS drawn FROM draws GROUP BY ALL),
      w AS (SELECT species, residual, obs, coalesce(drawn, 0) AS fitted FROM pit LEFT JOIN dm USING (species, period)),
      q AS (SELECT species, residual, fitted,
        row_number() OVER (PARTITION BY species ORDER BY round(fitted, 9), obs) AS i, count(*) OVER (PARTITION BY species) AS n FROM w)
      SELECT species, CAST(floor((i - 1) * 4 / n) + 1 AS BIGINT) AS bin, count(*) AS n, round(avg(fitted), 5) AS fitted,
        round(quantile_cont(residual, 0.25), 5) AS q25, round(quantile_cont(residual, 0.5), 5) AS q50,
        round(quantile_cont(residual, 0.75), 5) AS q75 FROM q GROUP BY species, bin""",
    "dispersion_check": SQL + CELLS + RESIDUALS + """, x AS (SELECT species, sum((value - fitted) * (value - fitted) / fitted) AS x2,
      count(*) AS n FROM fr WHERE fitted > 0 GROUP BY species)
      SELECT species, round(x2, 5) AS x2, n, round(x2 / n, 5) AS ratio, round((x2 - n) / sqrt(2.0 * n), 5) AS score FROM x""",
    "pit_residuals_cover": SQL + COVER_LAW + """SELECT species, site, transect, report_year, obs, n_points, total_points,
      round(fitted, 6) AS fitted, round(residual, 6) + 0.0 AS residual FROM pit""",
    "dispersion_check_cover": SQL + COVER_LAW + """, x AS (SELECT species, count(*) AS n,
      sum(pow(n_points - total_points * fitted, 2) / (total_points * fitted * (1 - fitted))) AS x2 FROM fr GROUP BY species)
      SELECT species, round(x2, 5) AS x2, n, round(x2 / n, 5) AS ratio, round((x2 - n) / sqrt(2.0 * n), 5) AS score FROM x""",
    "pit_residuals_successes": SQL + CELLS + SUCCESSES + """SELECT species, site, transect, report_year, obs, value,
      round(fitted, 6) AS fitted, round(residual, 6) + 0.0 AS residual FROM pit""",
    "dispersion_check_successes": SQL + CELLS + SUCCESSES + """, x AS (SELECT species, count(*) AS n,
      sum(pow(value - fitted, 2) / (fitted * (1 + fitted))) AS x2 FROM fr WHERE fitted > 0 GROUP BY species)
      SELECT species, round(x2, 5) AS x2, n, round(x2 / n, 5) AS ratio, round((x2 - n) / sqrt(2.0 * n), 5) AS score FROM x""",
    "fit_scores_successes": SQL + CELLS + DRAW + """, cy AS (SELECT species, period, value AS y, count(*) AS n FROM seen GROUP BY ALL),
      gd AS (SELECT species, period, exp(ln(m) - e * sqrt(v * (1 + m))) AS mu FROM pb JOIN deviates USING (period)
        WHERE m IS NOT NULL AND m1 IS NOT NULL),
      pt AS (SELECT species, period, y, n, ln(avg(exp(ll))) AS lpd, var_samp(ll) AS sp, avg(ll) AS ml, ln(avg(exp(-ll))) AS cpo, avg(mu) AS mu
        FROM (SELECT gd.species, gd.period, y, n, mu, y * ln(mu) - (y + 1) * ln(1 + mu) AS ll
          FROM gd JOIN cy ON gd.species = cy.species AND gd.period = cy.period) GROUP BY species, period, y, n)
      SELECT species, round(2 * sum(-2 * n * ml) - sum(-2 * n * (y * ln(mu) - (y + 1) * ln(1 + mu))), 4) AS dic,
        round(-2 * (sum(n * lpd) - sum(n * sp)), 4) AS waic, round(sum(n * sp), 4) AS p_waic, round(sum(n * cpo), 4) AS log_score
      FROM pt GROUP BY species""",
    "fit_scores": SQL + CELLS + DRAW + """, cy AS (SELECT species, period, value AS y, count(*) AS n FROM seen GROUP BY ALL),
      pt AS (SELECT species, period, y, n, ln(avg(exp(ll))) AS lpd, var_samp(ll) AS sp, avg(ll) AS ml, ln(avg(exp(-ll))) AS cpo, avg(mu) AS mu
        FROM (SELECT d.species, d.period, y, n, value AS mu, y * ln(value) - value - lgamma(y + 1) AS ll
          FROM draws d JOIN cy ON d.species = cy.species AND d.period = cy.period) GROUP BY species, period, y, n)
      SELECT species, round(2 * sum(-2 * n * ml) - sum(-2 * n * (y * ln(mu) - mu - lgamma(y + 1))), 4) AS dic,
        round(-2 * (sum(n * lpd) - sum(n * sp)), 4) AS waic, round(sum(n * sp), 4) AS p_waic, round(sum(n * cpo), 4) AS log_score
      FROM pt GROUP BY species""",
}
