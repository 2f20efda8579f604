"""Queries for panel preparation, lookups and publication order, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions import text
from panelweave.functions.links import LINKS, inverse_link
from panelweave.operators import design, levels, lookup, summary
from panelweave.operators import panel as P
from panelweave.plans import inputs as I
from panelweave.session import scratch_folder
from panelweave.sources import tables
from panelweave.sources.candidates import COUNT_CANDIDATES, PROPORTION_CANDIDATES, candidate_table

# Shared SQL prefix: the derived survey tables.
BASE = """
WITH units AS (
  SELECT c_custkey, r_name AS reef, n_name, right(n_name, 1) AS site_no, right(c_name, 1) AS transect_no
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), ord AS (
  SELECT o_orderkey, o_custkey, o_orderstatus = 'F' AS done, o_totalprice, o_orderpriority,
         CAST(year(o_orderdate) AS DOUBLE) AS report_year FROM orders
), counts AS (
  SELECT reef, site_no, transect_no, report_year,
    CAST(count(*) FILTER (done AND o_orderpriority = '1-URGENT') AS DOUBLE) AS Priority_urgent,
    CAST(count(*) FILTER (done AND o_orderpriority = '2-HIGH') AS DOUBLE) AS Priority_high,
    CAST(count(*) FILTER (done AND o_orderpriority = '3-MEDIUM') AS DOUBLE) AS Priority_medium,
    CAST(count(*) FILTER (done AND o_orderpriority = '4-NOT SPECIFIED') AS DOUBLE) AS Priority_unspecified,
    CAST(count(*) FILTER (done AND o_orderpriority = '5-LOW') AS DOUBLE) AS Priority_low,
    CAST(count(*) FILTER (done AND o_orderpriority = '1-URGENT' AND o_totalprice > 497000) AS DOUBLE) AS Rare_urgent
  FROM ord JOIN units ON o_custkey = c_custkey GROUP BY ALL
), raw0 AS (
  SELECT reef, site_no, transect_no, report_year, l_returnflag AS family, {status} AS p_code, count(*) AS n_points
  FROM lineitem JOIN ord ON l_orderkey = o_orderkey JOIN units ON o_custkey = c_custkey
  GROUP BY ALL
), raw1 AS (
  SELECT *, CAST(sum(n_points) OVER (PARTITION BY reef, site_no, transect_no, report_year) AS BIGINT) AS total_points
  FROM raw0
), every AS (
  SELECT p_code, reef, report_year, site_no, transect_no, family,
    reef || '_S' || site_no AS reefsite, reef || '_S' || site_no || '_T' || transect_no AS reefsitetransect,
    CASE WHEN report_year <= 1996 THEN 'P1' WHEN report_year <= 1998 THEN 'P2' WHEN report_year = 1999 THEN 'P3'
         ELSE 'P4' END AS period,
    CASE WHEN family IN ('A', 'R') THEN 100.0 * n_points / total_points ELSE 0.0 END AS hc, n_points, total_points
  FROM raw1
), cover AS (
  SELECT p_code, reef, reefsite, reefsitetransect, report_year, period, CAST(sum(hc) AS DOUBLE) AS hc,
         site_no, transect_no
  FROM every GROUP BY ALL
), coral AS (
  SELECT reef, reefsite AS site, reefsitetransect AS transect, report_year, period,
         CAST(sum(hc) AS DOUBLE) AS hc, CAST(sum(n_points) AS BIGINT) AS n_points, total_points, site_no, transect_no
  FROM every WHERE family IN (SELECT family FROM every WHERE hc > 0)
  GROUP BY p_code, reef, reefsite, reefsitetransect, report_year, period, total_points, site_no, transect_no
), joined AS (
  SELECT coalesce(a.reef, b.reef) AS reef, coalesce(a.site_no, b.site_no) AS site_no,
    coalesce(a.transect_no, b.transect_no) AS transect_no, coalesce(a.report_year, b.report_year) AS report_year,
    Priority_urgent, Priority_high, Priority_medium, Priority_unspecified, Priority_low, Rare_urgent,
    a.reef AS reef_name, reefsite, reefsitetransect, period, hc
  FROM (SELECT * FROM counts WHERE report_year < 2001) a
  FULL JOIN cover b ON a.reef IS NOT DISTINCT FROM b.reef AND a.site_no IS NOT DISTINCT FROM b.site_no
    AND a.transect_no IS NOT DISTINCT FROM b.transect_no AND a.report_year IS NOT DISTINCT FROM b.report_year
), keyed AS (
  SELECT *, coalesce(reef_name, 'NA') || ' ' || site_no AS site,
    coalesce(reef_name, 'NA') || ' ' || site_no || ' ' || transect_no AS transect
  FROM joined WHERE site_no IS NOT NULL AND hc IS NOT NULL
), long AS (
  SELECT reef, site, transect, report_year, period, hc, species, value FROM keyed CROSS JOIN LATERAL (VALUES
    ('Priority_urgent', Priority_urgent), ('Priority_high', Priority_high), ('Priority_medium', Priority_medium),
    ('Priority_unspecified', Priority_unspecified), ('Priority_low', Priority_low), ('Rare_urgent', Rare_urgent)
  ) v(species, value)
), seen AS (
  SELECT l.* FROM long l WHERE value IS NOT NULL AND (species, site) NOT IN (
    SELECT (species, site) FROM long WHERE value IS NOT NULL GROUP BY species, site HAVING sum(value) = 0)
)
"""
SQL = BASE.replace("{status}", "'LT'")
SQL_STATUS = BASE.replace("{status}", "l_linestatus")
LOOKUP_SQL = """, lookup(species, trophic, family, label, exclude) AS (VALUES
  ('Priority_urgent', 'Upper', 'Fast', 'Poisson', 'FALSE'),
  ('Priority_high', 'Upper', 'Fast', NULL, 'FALSE'),
  ('Priority_medium', 'Lower', 'Slow', 'Zero-inflated poisson 1', 'FALSE'),
  ('Priority_low', 'Lower', 'Slow', 'Zero-inflated Poisson 1', 'TRUE'),
  ('Rare_urgent', 'Upper', 'Rare', 'Zero-inflated poisson 1', NULL))
"""
PERIOD_VALUES = "(VALUES ('P1'), ('P2'), ('P3'), ('P4')) g(period)"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Round doubles so that two engines agree; adding zero folds -0.0 into 0.0."""
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


# --- panel ----------------------------------------------------------------------------------------------


def benthic_cover(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(I.benthic_cover(spark, folder), "hc")


def benthic_cover_by_status(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(I.benthic_cover(spark, folder, split_status=True), "hc")


COVER_SQL = """SELECT reef, reefsite, reefsitetransect, report_year, period, round(hc, 6) AS hc, site_no, transect_no
FROM cover"""


def join_panel(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(I.join_panel(spark, folder), "hc")


def panel_keys(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["reef", "report_year", "period", "site", "transect", "hc"]
    return rounded(I.panel_keys(spark, folder).select(*keys), "hc")


def panel_long(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(I.panel_long(spark, folder), "hc")


def coral_panel(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(I.coral_panel(spark, folder), "hc")


def entity_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Entity columns found by name, each with its total in the wide counts."""
    wide = I.counts_wide(spark, folder)
    names = P.columns_like(wide, I.ENTITY_PATTERN)
    sums = wide.agg(*[F.sum(n).alias(n) for n in names])
    return sums.unpivot([], names, "species", "total")


def drop_zero_sites(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(I.model_input(spark, folder), "hc")


def obs_number(spark: SparkSession, folder: str) -> DataFrame:
    """Observation numbers: the wide row order, shared by all entities and kept with gaps after filtering."""
    order = ["reef", "site", "transect", "report_year"]
    wide = I.panel_keys(spark, folder).select(*order, *I.ENTITIES)
    numbered = P.number_rows(wide, [F.col(c) for c in order], "obs")
    return P.to_long(numbered, I.ENTITIES).filter(F.col("value").isNotNull())


def nest_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Nested export, summarised by what the nested lists hold."""
    nested = P.to_nested(I.panel_long(spark, folder), "species", ["site", "transect", "report_year", "value"])
    total = F.aggregate("data", F.lit(0.0), lambda acc, row: acc + F.coalesce(row["value"], F.lit(0.0)))
    return nested.groupBy("species").agg(
        F.sum(F.size("data")).alias("n_rows"), F.sum(total).alias("total")
    )


def prediction_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = P.with_prediction_rows(I.model_input(spark, folder), "species", I.PERIODS)
    return rounded(rows, "hc")


def period_levels(spark: SparkSession, folder: str) -> DataFrame:
    return levels.levels_table(I.panel_keys(spark, folder), "period")


# --- model input ----------------------------------------------------------------------------------------


def scaled_covariate(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["species", "site", "transect", "report_year"]
    return rounded(I.model_panel(spark, folder).select(*keys, "x"), "x")


def design_matrix(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["species", "site", "transect", "report_year"]
    full = design.design_matrix(I.model_panel(spark, folder), "period", I.PERIODS, "x")
    names = [c for c in full.columns if c.startswith("x_")]
    return rounded(full.select(*keys, *names), *names)


SCALED_SQL = """, stats AS (
  SELECT species, avg(ln(hc + 0.01)) AS m, stddev_samp(ln(hc + 0.01)) AS s FROM seen GROUP BY species
), scaled AS (SELECT seen.*, (ln(hc + 0.01) - m) / s AS x FROM seen JOIN stats USING (species))
"""


def zero_share(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(summary.zero_share(I.model_input(spark, folder), ["species", "period"]), "zero_fraction")


def raw_log_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = summary.raw_log_summary(
        I.model_input(spark, folder), ["species", "period"], len(I.ENTITIES) * (len(I.PERIODS) + 1)
    )
    return rounded(out, "log_mean", "log_median", "log_sd")


def raw_mean_ci(spark: SparkSession, folder: str) -> DataFrame:
    out = summary.raw_mean_interval(I.model_input(spark, folder), ["species", "period"])
    return rounded(out, "mean", "lower", "upper")


def inverse_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every inverse link applied to the scaled covariate of the order-count panel."""
    x = I.model_panel(spark, folder).select("species", "site", "transect", "report_year", F.round("x", 6).alias("x"))
    names = {f"inv_{link.replace('/', '_').replace('^', '')}": link for link in LINKS}
    out = x.withColumns({name: inverse_link(F.col("x"), link) for name, link in names.items()})
    return rounded(out, *names)


# --- lookups and publication order ------------------------------------------------------------------------


def lookup_table(spark: SparkSession) -> DataFrame:
    schema = "species string, trophic string, family string, best_model string, exclude string"
    table = spark.createDataFrame(I.LOOKUP, schema)
    return lookup.override_values(table, I.OVERRIDES, "species", "best_model")


def entity_totals(spark: SparkSession, folder: str, panel: DataFrame | None = None) -> DataFrame:
    panel = I.model_input(spark, folder) if panel is None else panel
    return panel.groupBy("species").agg(F.sum("value").alias("total"))


def lookup_overrides(spark: SparkSession, folder: str) -> DataFrame:
    return entity_totals(spark, folder).join(F.broadcast(lookup_table(spark)), "species", "left")


def best_model(spark: SparkSession, folder: str, panel: DataFrame | None = None) -> DataFrame:
    """Listed entities with their chosen candidate; ``panel`` is the model input if it was made already."""
    return lookup.choose_models(
        entity_totals(spark, folder, panel), lookup_table(spark), lookup_rows=len(I.LOOKUP)
    )


def entity_order(spark: SparkSession, folder: str) -> DataFrame:
    listed = entity_totals(spark, folder).join(F.broadcast(lookup_table(spark)), "species", "left")
    return levels.entity_order(listed, "family", "species")


def candidate_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Every entity with every candidate, and cover with its own candidates."""
    entities = entity_totals(spark, folder).select("species")
    counts = entities.crossJoin(F.broadcast(candidate_table(spark, COUNT_CANDIDATES)))
    cover = I.coral_panel(spark, folder).select(F.lit("cover").alias("species")).distinct()
    return counts.unionByName(cover.crossJoin(F.broadcast(candidate_table(spark, PROPORTION_CANDIDATES))))


def _candidate_values() -> str:
    rows = []
    for species, table in (("", COUNT_CANDIDATES), ("cover", PROPORTION_CANDIDATES)):
        for i, c in enumerate(table):
            rows.append(f"('{species}', {i + 1}, '{c.mod}', '{c.name}', '{c.fam}', '{c.type}', {str(c.zi).upper()})")
    return "(VALUES " + ", ".join(rows) + ") c(part, cand, mod, name, fam, type, zi)"


def raw_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """Raw period-to-baseline ratio per unit with rough limits, input for the labelling queries."""
    cell = I.model_input(spark, folder).groupBy("species", "site", "period").agg(
        F.sum("value").alias("total"), F.count("*").alias("n")
    )
    base = cell.filter(F.col("period") == I.PERIODS[0]).select(
        "species", "site", F.col("total").alias("t1"), F.col("n").alias("n1")
    )
    log_ratio = F.ln(F.col("total") / F.col("n")) - F.ln(F.col("t1") / F.col("n1"))
    error = F.sqrt(1 / F.col("total") + 1 / F.col("t1"))
    later = cell.filter((F.col("period") != I.PERIODS[0]) & (F.col("total") > 0))
    return later.join(base.filter(F.col("t1") > 0), ["species", "site"]).select(
        "species", "site", "period", F.exp(log_ratio).alias("mean"),
        F.exp(log_ratio - 1.96 * error).alias("lower"), F.exp(log_ratio + 1.96 * error).alias("upper"),
    )


def effect_class(spark: SparkSession, folder: str) -> DataFrame:
    out = raw_ratios(spark, folder).withColumn("effect", text.effect_class(F.col("lower"), F.col("upper")))
    return rounded(out, "mean", "lower", "upper")


def effect_labels(spark: SparkSession, folder: str) -> DataFrame:
    ratio = F.round("mean", 6)
    out = raw_ratios(spark, folder).select(
        text.display_name(F.col("species")).alias("species"), "site", "period",
        text.percent_change(ratio).alias("percent"), text.percent_change_label(ratio).alias("label"),
    )
    return rounded(out, "percent", digits=4)


def caterpillar_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Display order of sites within each entity group, by raw ratio."""
    ratios = raw_ratios(spark, folder).withColumn("mean", F.round("mean", 6))
    ranked = levels.caterpillar_rank(ratios.withColumn("unit", F.concat_ws("/", "species", "site")),
                                     "species", "unit", "period", "mean")
    return ranked.select("species", "site", "period", "mean", "display_rank")


RATIO_SQL = """, cell AS (SELECT species, site, period, sum(value) AS total, count(*) AS n FROM seen GROUP BY ALL
), ratios AS (
  SELECT c.species, c.site, c.period, exp(ln(c.total / c.n) - ln(b.total / b.n)) AS mean,
    exp(ln(c.total / c.n) - ln(b.total / b.n) - 1.96 * sqrt(1 / c.total + 1 / b.total)) AS lower,
    exp(ln(c.total / c.n) - ln(b.total / b.n) + 1.96 * sqrt(1 / c.total + 1 / b.total)) AS upper
  FROM cell c JOIN cell b ON c.species = b.species AND c.site = b.site AND b.period = 'P1'
  WHERE c.period <> 'P1' AND c.total > 0 AND b.total > 0)
"""

# --- sources and sinks ------------------------------------------------------------------------------------


def cover_from_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The cover table written as CSV and read again with its declared schema; the text NA means missing."""
    cover = I.benthic_cover(spark, folder)
    path = f"{scratch_folder(spark)}/cover.csv"
    cover.write.csv(path, header=True, nullValue="NA")
    schema = ", ".join(f"{name} {kind}" for name, kind in cover.dtypes)
    return rounded(tables.read_lookup_csv(spark, path, schema), "hc")


def join_panel_from_stage(spark: SparkSession, folder: str) -> DataFrame:
    """The joined panel written as a stage in folders by period and read again; a first synonym gives the year its name."""
    path = f"{scratch_folder(spark)}/panel"
    tables.write_stage(I.join_panel(spark, folder).withColumnRenamed("report_year", "year"), path, ["period"])
    stage = tables.read_stage(spark, path)
    return rounded(P.rename_first(stage, {"report_year": ["report_year", "year"]}).select(
        "reef", "site_no", "transect_no", "report_year", "period", "hc", *I.ENTITIES), "hc")


def ratios_from_artefacts(spark: SparkSession, folder: str) -> DataFrame:
    """Entity totals by period stored as artefacts of two engines and read again for one of them."""
    totals = I.model_input(spark, folder).groupBy("species", "period").agg(F.sum("value").alias("total"))
    path = f"{scratch_folder(spark)}/artefacts"
    named = totals.withColumn("name", F.lit("poisson"))
    both = named.withColumn("engine", F.lit("inla")).unionByName(named.withColumn("engine", F.lit("glmmTMB")))
    tables.write_artefacts(both, path, "cellmeans")
    return tables.read_artefacts(spark, path, "cellmeans", "inla", ["poisson"]).select("species", "period", "total", "engine")


QUERIES = {
    "cover_from_csv": cover_from_csv,
    "join_panel_from_stage": join_panel_from_stage,
    "ratios_from_artefacts": ratios_from_artefacts,
    "benthic_cover": benthic_cover,
    "benthic_cover_by_status": benthic_cover_by_status,
    "join_panel": join_panel,
    "panel_keys": panel_keys,
    "panel_long": panel_long,
    "coral_panel": coral_panel,
    "entity_columns": entity_columns,
    "drop_zero_sites": drop_zero_sites,
    "obs_number": obs_number,
    "nest_counts": nest_counts,
    "prediction_rows": prediction_rows,
    "period_levels": period_levels,
    "scaled_covariate": scaled_covariate,
    "design_matrix": design_matrix,
    "zero_share": zero_share,
    "raw_log_summary": raw_log_summary,
    "raw_mean_ci": raw_mean_ci,
    "inverse_links": inverse_links,
    "lookup_overrides": lookup_overrides,
    "best_model": best_model,
    "entity_order": entity_order,
    "candidate_grid": candidate_grid,
    "effect_class": effect_class,
    "effect_labels": effect_labels,
    "caterpillar_rank": caterpillar_rank,
}

ORACLES = {
    "cover_from_csv": SQL + COVER_SQL,
    "join_panel_from_stage": SQL + """SELECT reef, site_no, transect_no, report_year, period, round(hc, 6) AS hc, Priority_urgent,
      Priority_high, Priority_medium, Priority_unspecified, Priority_low, Rare_urgent FROM joined""",
    "ratios_from_artefacts": SQL + "SELECT species, period, sum(value) AS total, 'inla' AS engine FROM seen GROUP BY species, period",
    "benthic_cover": SQL + COVER_SQL,
    "benthic_cover_by_status": SQL_STATUS + COVER_SQL,
    "join_panel": SQL + "SELECT * REPLACE (round(hc, 6) AS hc) FROM joined",
    "panel_keys": SQL + "SELECT reef, report_year, period, site, transect, round(hc, 6) AS hc FROM keyed",
    "panel_long": SQL + "SELECT * REPLACE (round(hc, 6) AS hc) FROM long",
    "coral_panel": SQL + "SELECT * REPLACE (round(hc, 6) AS hc) FROM coral",
    "entity_columns": SQL + """SELECT species, sum(value) AS total FROM counts CROSS JOIN LATERAL (VALUES
      ('Priority_urgent', Priority_urgent), ('Priority_high', Priority_high), ('Priority_medium', Priority_medium),
      ('Priority_unspecified', Priority_unspecified), ('Priority_low', Priority_low), ('Rare_urgent', Rare_urgent)
      ) v(species, value) GROUP BY species""",
    "drop_zero_sites": SQL + "SELECT * REPLACE (round(hc, 6) AS hc) FROM seen",
    "obs_number": SQL + """, numbered AS (
      SELECT *, row_number() OVER (ORDER BY reef, site, transect, report_year) AS obs FROM keyed)
      SELECT reef, site, transect, report_year, obs, species, value FROM numbered CROSS JOIN LATERAL (VALUES
      ('Priority_urgent', Priority_urgent), ('Priority_high', Priority_high), ('Priority_medium', Priority_medium),
      ('Priority_unspecified', Priority_unspecified), ('Priority_low', Priority_low), ('Rare_urgent', Rare_urgent)
      ) v(species, value) WHERE value IS NOT NULL""",
    "nest_counts": SQL + "SELECT species, count(*) AS n_rows, coalesce(sum(value), 0.0) AS total FROM long GROUP BY species",
    "prediction_rows": SQL + f"""SELECT reef, site, transect, report_year, period, round(hc, 6) AS hc, species, value,
      FALSE AS is_pred FROM seen UNION ALL SELECT NULL, NULL, NULL, NULL, period, NULL, species, NULL, TRUE
      FROM (SELECT DISTINCT species FROM seen) CROSS JOIN {PERIOD_VALUES}""",
    "period_levels": SQL + """SELECT period, dense_rank() OVER (ORDER BY period) AS level
      FROM (SELECT DISTINCT period FROM keyed WHERE period IS NOT NULL)""",
    "scaled_covariate": SQL + SCALED_SQL
    + "SELECT species, site, transect, report_year, round(x, 6) + 0.0 AS x FROM scaled",
    "design_matrix": SQL + SCALED_SQL + """SELECT species, site, transect, report_year, 1.0::DOUBLE AS x_intercept,
      (period = 'P2')::INT::DOUBLE AS x_p2, (period = 'P3')::INT::DOUBLE AS x_p3, (period = 'P4')::INT::DOUBLE AS x_p4,
      round(x, 6) + 0.0 AS x_cov, CASE WHEN period = 'P2' THEN round(x, 6) + 0.0 ELSE 0.0 END AS x_cov_p2,
      CASE WHEN period = 'P3' THEN round(x, 6) + 0.0 ELSE 0.0 END AS x_cov_p3,
      CASE WHEN period = 'P4' THEN round(x, 6) + 0.0 ELSE 0.0 END AS x_cov_p4 FROM scaled""",
    "zero_share": SQL + """SELECT species, period, sum(value) AS total, count(*) FILTER (value = 0) AS n_zeros,
      count(*) AS n, round(count(*) FILTER (value = 0) / count(*), 6) AS zero_fraction FROM seen GROUP BY ALL""",
    "raw_log_summary": SQL + """SELECT species, period,
      round(CASE WHEN avg(value) > 0 THEN ln(avg(value)) END, 6) + 0.0 AS log_mean,
      round(CASE WHEN median(value) > 0 THEN ln(median(value)) END, 6) + 0.0 AS log_median,
      round(CASE WHEN stddev_samp(value) > 0 THEN ln(stddev_samp(value)) END, 6) + 0.0 AS log_sd
      FROM seen GROUP BY species, period""",
    "raw_mean_ci": None,
    "inverse_links": SQL + SCALED_SQL + """, r AS (SELECT species, site, transect, report_year, round(x, 6) AS x FROM scaled),
      p AS (SELECT *, CASE WHEN abs(x) > 6 THEN (x > 0)::INT::DOUBLE ELSE 0.5 + exp(-x * x / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 80),
        lambda n: sign(x) * exp((2 * n + 1) * ln(greatest(abs(x), 1e-300)) + n * ln(2) + lgamma(n + 1.0) - lgamma(2.0 * n + 2)))) END AS phi FROM r)
      SELECT species, site, transect, report_year, x, round(x, 6) + 0.0 AS inv_identity, round(exp(x), 6) AS inv_log,
        round(exp(x) + 1, 6) AS inv_logm1, round(exp(x) - 1, 6) + 0.0 AS inv_log1p,
        CASE WHEN x <> 0 THEN round(1 / x, 6) + 0.0 END AS inv_inverse, round(x * x, 6) AS inv_sqrt,
        CASE WHEN x > 0 THEN round(1 / sqrt(x), 6) END AS inv_1_mu2, round(2 * atan(x), 6) + 0.0 AS inv_tan_half,
        round(1 / (1 + exp(-x)), 6) AS inv_logit, round(phi, 6) + 0.0 AS inv_probit, round(0.5 + atan(x) / pi(), 6) AS inv_cauchit,
        round(1 - exp(-exp(x)), 6) AS inv_cloglog, round(phi, 6) + 0.0 AS inv_probit_approx,
        round(ln(1 + exp(x)), 6) AS inv_softplus FROM p""",
    "lookup_overrides": SQL + LOOKUP_SQL + """SELECT species, sum(value) AS total, trophic, family, label AS best_model, exclude
      FROM seen LEFT JOIN lookup USING (species) GROUP BY ALL""",
    "best_model": SQL + LOOKUP_SQL + """, t AS (SELECT species, sum(value) AS total FROM seen GROUP BY species)
      SELECT species, total, trophic, family, coalesce(label, 'Zero-inflated Negative Binomial 0') AS best_model, exclude,
        CASE label WHEN 'Zero-inflated poisson 1' THEN 'zeroinflatedpoisson1' WHEN 'Zero-inflated poisson 0' THEN 'zeroinflatedpoisson0'
          WHEN 'Zero-inflated negative binomial 1' THEN 'zeroinflatednbinomial1' WHEN 'Negative binomial' THEN 'nbinomial'
          WHEN 'Negative binomial 1' THEN 'nbinomial2' WHEN 'Poisson' THEN 'poisson' ELSE 'zeroinflatednbinomial0' END AS name
      FROM t LEFT JOIN lookup USING (species) WHERE exclude <> 'TRUE'""",
    "entity_order": SQL + LOOKUP_SQL + """SELECT family, species,
      dense_rank() OVER (ORDER BY family NULLS LAST, species) AS display_order
      FROM (SELECT DISTINCT species FROM seen) LEFT JOIN lookup USING (species)""",
    "candidate_grid": SQL + f"""SELECT CASE WHEN part = 'cover' THEN part ELSE species END AS species,
      cand, mod, name, fam, type, zi FROM {_candidate_values()}
      LEFT JOIN (SELECT DISTINCT species FROM seen) s ON part = ''""",
    "effect_class": SQL + RATIO_SQL + """SELECT species, site, period, round(mean, 6) AS mean, round(lower, 6) AS lower,
      round(upper, 6) AS upper, CASE WHEN lower > 1 THEN 'Positive' WHEN upper < 1 THEN 'Negative' ELSE 'None' END AS effect
      FROM ratios""",
    "effect_labels": SQL + RATIO_SQL + """SELECT regexp_replace(species, '_', ' ') AS species, site, period,
      round(100 * (round(mean, 6) - 1), 4) + 0.0 AS percent, printf('%.1f%%', 100.0 * (round(mean, 6) - 1)) AS label FROM ratios""",
    "caterpillar_rank": SQL + RATIO_SQL + """, f AS (
      SELECT species, site, min({'period': period, 'mean': round(mean, 6)}) AS first FROM ratios GROUP BY ALL),
      o AS (SELECT species, site, row_number() OVER (ORDER BY species, first.period, first.mean, species || '/' || site) AS display_rank FROM f)
      SELECT species, site, period, round(mean, 6) AS mean, display_rank FROM ratios JOIN o USING (species, site)""",
}


def _t_table_sql() -> str:
    """SQL for the t quantile by the same published asymptotic expansion, checked for n of 30 and more."""
    z = 1.959963984540054
    z2 = z * z
    terms = [z * (z2 + 1) / 4, z * (5 * z2**2 + 16 * z2 + 3) / 96, z * (3 * z2**3 + 19 * z2**2 + 17 * z2 - 15) / 384,
             z * (79 * z2**4 + 776 * z2**3 + 1482 * z2**2 - 1920 * z2 - 945) / 92160]
    return f"({z!r}" + "".join(f" + {t!r} / pow(n - 1, {i})" for i, t in enumerate(terms, start=1)) + ")"


ORACLES["raw_mean_ci"] = SQL + f""", s AS (
  SELECT species, period, avg(value) AS m, stddev_samp(value) AS sd, count(value) AS n FROM seen GROUP BY ALL)
  SELECT species, period, round(m, 6) AS mean, round(m - {_t_table_sql()} * sd / sqrt(n), 6) + 0.0 AS lower,
    round(m + {_t_table_sql()} * sd / sqrt(n), 6) + 0.0 AS upper, n FROM s"""
