"""Collation of results over candidates, model choice and ranked effect tables."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.text import effect_class
from panelweave.operators.effects import LABELS, cellmeans_draws, cellmeans_wald, contrasts_wald, draw_summary
from panelweave.operators.fit import Fit
from panelweave.operators.levels import caterpillar_rank
from panelweave.session import bounded_join
from panelweave.sources import tables
from panelweave.sources.candidates import DRAWS, WALD

RESULT = ["period", "variable", "mean", "lower", "upper"]


def collate_contrasts(fits: list[Fit], draws: int = 1000, at: DataFrame | None = None) -> DataFrame:
    """Contrasts of every candidate of every entity in one table: draw summaries for the draws engine, Wald
    limits for the other. Keys whose fit failed are absent."""
    parts = []
    for fit in fits:
        by_draws = draw_summary(fit, draws).filter(F.col("mod") == DRAWS)
        by_wald = contrasts_wald(fit, at).filter(F.col("mod") == WALD)
        parts += [f.select(*fit.spec.keys, *LABELS, *RESULT) for f in (by_draws, by_wald)]
    return reduce(DataFrame.unionByName, parts)


def store_results(fits: list[Fit], path: str, draws: int = 1000, at: DataFrame | None = None) -> None:
    """Write models, cell means and contrasts of all fits below ``path``, in folders by kind, engine and name.

    Models of every status are stored; means and contrasts belong to the usable ones. Storing again replaces what was there.
    """
    models = [f.coef.drop("packed") for f in fits]
    means = []
    for fit in fits:
        both = cellmeans_draws(fit, draws).filter(F.col("mod") == DRAWS), cellmeans_wald(fit, at).filter(F.col("mod") == WALD)
        means += [m.select(*fit.spec.keys, *LABELS, "period", "mean", "lower", "upper") for m in both]
    for kind, parts in (("model", models), ("cellmeans", means), ("contrasts", [collate_contrasts(fits, draws, at)])):
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        tables.write_artefacts(whole.withColumnRenamed("mod", "engine"), path, kind)


def collate_stored(spark: SparkSession, path: str, kind: str = "contrasts") -> DataFrame:
    """One kind of result of everything stored below ``path``."""
    return tables.read_artefacts(spark, path, kind).drop("kind").withColumnRenamed("engine", "mod")


def stored_choice(
    spark: SparkSession, path: str, chosen: DataFrame, entity: str, rows: int | None = None, kind: str = "contrasts"
) -> DataFrame:
    """Stored results of the candidate chosen for each entity, draws engine only.

    ``chosen`` (entity, ``engine``, ``name`` and group columns) comes from a table of at most ``rows`` rows. As engine and name are
    folders of the artefacts, the join lets Spark read only the folders that ``chosen`` names.
    """
    wanted = chosen.filter(F.col("engine") == DRAWS)
    return bounded_join(tables.read_artefacts(spark, path, kind).drop("kind"), wanted, [entity, "engine", "name"], rows=rows)


def only_chosen(fit: Fit, chosen: DataFrame, entity: str, rows: int | None = None) -> Fit:
    """The fit with the keys of each entity's chosen candidate alone, so that no others are drawn.

    Entities without a chosen candidate, or whose candidate wasn't fitted, are absent.
    """
    wanted = chosen.select(entity, "name").distinct()
    kept = bounded_join(fit.coef.filter(F.col("mod") == DRAWS), wanted, [entity, "name"], "left_semi", rows=rows)
    return replace(fit, coef=kept)


def candidate_comparison(results: DataFrame, entity: str, value: str, variable: str = "Ratio") -> DataFrame:
    """All candidates of one entity side by side."""
    return results.filter((F.col(entity) == value) & (F.col("variable") == variable)).select(
        entity, "fam", "zi", "mod", "type", "period", "mean", "lower", "upper"
    )


def chosen_contrasts(results: DataFrame, chosen: DataFrame, entity: str, rows: int | None = None) -> DataFrame:
    """Contrasts of the candidate chosen for each entity, draws engine only."""
    return bounded_join(results.filter(F.col("mod") == DRAWS), chosen, [entity, "name"], rows=rows)


def effect_table(
    chosen: DataFrame, group: str, entity: str, exclude: list[str] | None = None, overlay: DataFrame | None = None
) -> DataFrame:
    """Ratios of the chosen models, classed and ranked for display; ``overlay`` (one row per period) adds
    reference columns."""
    ratios = chosen.filter(F.col("variable") == "Ratio")
    if exclude:
        ratios = ratios.filter(~F.col(entity).isin(*exclude))
    ranked = caterpillar_rank(ratios.select(group, entity, "period", "mean", "lower", "upper"), group, entity, "period", "mean")
    ranked = ranked.withColumn("effect", effect_class(F.col("lower"), F.col("upper")))
    if overlay is not None:
        side = overlay.select("period", *[F.col(c).alias(f"overlay_{c}") for c in ("mean", "lower", "upper")])
        ranked = ranked.join(F.broadcast(side), "period", "left")  # one row per period of the fixed grid
    return ranked
