"""Survey tables derived from the star-schema tables.

Region, nation and customer stand for reef, site and transect; order counts by priority are the entities and
line return flags are the cover families.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelweave.operators import panel as P
from panelweave.operators.design import with_scaled_covariate
from panelweave.session import Ledger
from panelweave.sources.tables import read_table

PERIODS = ("P1", "P2", "P3", "P4")
ENTITY_PATTERN = "[A-Z][a-z]+\\_[a-z]+"
PRIORITIES = {
    "Priority_urgent": "1-URGENT",
    "Priority_high": "2-HIGH",
    "Priority_medium": "3-MEDIUM",
    "Priority_unspecified": "4-NOT SPECIFIED",
    "Priority_low": "5-LOW",
}
ENTITIES = [*PRIORITIES, "Rare_urgent"]
JOIN_KEYS = ["reef", "site_no", "transect_no", "report_year"]
COVER_KEYS = ["p_code", "reef", "c_report_year", "period", "reefsite", "reefsitetransect"]

# Entity lookup: entity, trophic group, family, chosen model, exclude flag. One entity is left out.
LOOKUP = [
    ("Priority_urgent", "Upper", "Fast", "Poisson", "FALSE"),
    ("Priority_high", "Upper", "Fast", "Negative binomial 1", "FALSE"),
    ("Priority_medium", "Lower", "Slow", None, "FALSE"),
    ("Priority_low", "Lower", "Slow", "Zero-inflated Poisson 1", "TRUE"),
    ("Rare_urgent", "Upper", "Rare", "Zero-inflated poisson 1", None),
]
OVERRIDES = [
    ("Priority_high", None),
    ("Priority_medium", "Poisson"),
    ("Priority_medium", "Zero-inflated poisson 1"),
]


def period_label(year):
    return (
        F.when(year <= 1996, "P1")
        .when(year <= 1998, "P2")
        .when(year == 1999, "P3")
        .when(year > 1999, "P4")
    )


def units(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer with its nested codes. Nation and region are tiny; the optimizer sees that."""
    customer = read_table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = read_table(spark, folder, "nation")
    region = read_table(spark, folder, "region")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "c_custkey",
            F.col("r_name").alias("reef"),
            F.col("n_name").alias("nation_name"),
            F.right(F.col("n_name"), F.lit(1)).alias("site_no"),
            F.right(F.col("c_name"), F.lit(1)).alias("transect_no"),
        )
    )


def order_counts(orders: DataFrame) -> list:
    done = F.col("o_orderstatus") == "F"
    counts = [
        F.count_if(done & (F.col("o_orderpriority") == text)).cast("double").alias(name)
        for name, text in PRIORITIES.items()
    ]
    rare = done & (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 497000)
    return [*counts, F.count_if(rare).cast("double").alias("Rare_urgent")]


def orders_of(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """Orders with their year; the bound on the year is put on the stored date, where the scan can use it."""
    orders = read_table(spark, folder, "orders")
    if before is not None:
        orders = orders.filter(F.col("o_orderdate") < F.make_timestamp_ntz(*[F.lit(v) for v in (before, 1, 1, 0, 0, 0)]))
    return orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
        F.year("o_orderdate").cast("double").alias("report_year"),
    )


def counts_wide(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """Counts per unit and year; orders are counted per customer and year before they meet the units."""
    orders = orders_of(spark, folder, before).drop("o_orderkey")
    by_customer = orders.groupBy("o_custkey", "report_year").agg(*order_counts(orders))
    joined = by_customer.join(units(spark, folder), F.col("o_custkey") == F.col("c_custkey"))
    names = [*PRIORITIES, "Rare_urgent"]
    wide = joined.groupBy("reef", "site_no", "transect_no", "report_year").agg(*[F.sum(n).alias(n) for n in names])
    return wide.withColumn("reef_name", F.col("reef"))


def cover_raw(spark: SparkSession, folder: str, split_status: bool = False) -> DataFrame:
    """Raw cover rows: one per unit, year and family, in the column order of the survey export.

    Orders meet their units before the lines, so that lines, the most rows, are shuffled once.
    """
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    extra = ["l_linestatus"] if split_status else []
    keys = ["reef", "site_no", "transect_no", "report_year"]
    orders = orders_of(spark, folder).join(units(spark, folder), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", *keys)
    counted = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(*keys, F.col("l_returnflag").alias("family"), *extra)
        .agg(F.count("*").alias("n_points"))
        .withColumn("total_points", F.sum("n_points").over(Window.partitionBy(*keys)))
    )
    share = 100.0 * F.col("n_points") / F.col("total_points")
    site = F.concat_ws("_S", "reef", "site_no")
    return counted.select(
        (F.col("l_linestatus") if split_status else F.lit("LT")).alias("p_code"),
        "reef",
        F.col("report_year").cast("int").cast("string").alias("c_report_year"),
        period_label(F.col("report_year")).alias("period"),
        site.alias("reefsite"),
        F.concat_ws("_T", site, F.col("transect_no")).alias("reefsitetransect"),
        F.when(F.col("family").isin("A", "R"), share).otherwise(0.0).alias("hc"),
        "n_points",
        "total_points",
        F.when(F.col("family") == "A", 1.0).when(F.col("family") == "R", 2.0).otherwise(3.0).alias("ab"),
        "family",
    )


def benthic(raw: DataFrame) -> DataFrame:
    """Cover per transect-year with numeric year and unit numbers."""
    summed = P.cover_by_unit(raw, COVER_KEYS, columns=P.column_range(raw, "p_code", "ab"))
    return P.unit_numbers(summed, "reefsite", "reefsitetransect", "c_report_year").filter(
        F.col("reef").isNotNull()
    )


def stored_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Raw cover rows, written once for a job that makes both panels from them."""
    return Ledger(spark).keep(cover_raw(spark, folder), "cover")


def benthic_cover(spark: SparkSession, folder: str, split_status: bool = False, raw: DataFrame | None = None) -> DataFrame:
    raw = cover_raw(spark, folder, split_status) if raw is None else raw
    return benthic(raw).select(
        "reef", "reefsite", "reefsitetransect", "report_year", "period", "hc", "site_no", "transect_no"
    )


def coral_panel(spark: SparkSession, folder: str, raw: DataFrame | None = None) -> DataFrame:
    """Cover pass: only families that ever have cover, with hits and trials kept."""
    raw = cover_raw(spark, folder) if raw is None else raw
    present = raw.filter(F.col("hc") > 0).select("family")
    kept = P.keep_matching(raw, present, ["family"])
    return benthic(kept).select(
        "reef", F.col("reefsite").alias("site"), F.col("reefsitetransect").alias("transect"),
        "report_year", "period", "hc", "n_points", "total_points", "site_no", "transect_no",
    )


def join_panel(spark: SparkSession, folder: str, raw: DataFrame | None = None) -> DataFrame:
    counts = counts_wide(spark, folder, before=2001)
    return P.full_join_panel(counts, benthic_cover(spark, folder, raw=raw), JOIN_KEYS)


def panel_keys(spark: SparkSession, folder: str, raw: DataFrame | None = None) -> DataFrame:
    return P.add_unit_keys(join_panel(spark, folder, raw)).filter(
        F.col("site_no").isNotNull() & F.col("hc").isNotNull()
    )


def panel_long(spark: SparkSession, folder: str, raw: DataFrame | None = None) -> DataFrame:
    wide = panel_keys(spark, folder, raw).select(
        "reef", "site", "transect", "report_year", "period", "hc", *ENTITIES
    )
    return P.to_long(wide, P.columns_like(wide, ENTITY_PATTERN))


def model_input(spark: SparkSession, folder: str, raw: DataFrame | None = None) -> DataFrame:
    """Long panel without missing counts and without sites where the entity never occurs.

    The long panel is written once, as it is read for the sums per site and again for the rows. ``raw`` is the raw cover if it is stored.
    """
    long = panel_long(spark, folder, raw).filter(F.col("value").isNotNull())
    return P.drop_zero_units(Ledger(spark).keep(long, "panel"))


def model_panel(spark: SparkSession, folder: str, raw: DataFrame | None = None) -> DataFrame:
    return with_scaled_covariate(model_input(spark, folder, raw), ["species"], n_keys=len(ENTITIES))


def panel_scale(spark: SparkSession, folder: str) -> DataFrame:
    """Strictly nested panel at customer level, the benchmark input: region, nation, customer, year."""
    orders = orders_of(spark, folder)
    lines = (
        read_table(spark, folder, "lineitem")
        .select("l_orderkey", "l_returnflag")
        .groupBy("l_orderkey")
        .agg(
            F.count_if(F.col("l_returnflag").isin("A", "R")).alias("hits"), F.count("*").alias("lines")
        )
    )
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    wide = (
        joined.groupBy("o_custkey", "report_year")
        .agg(*order_counts(orders), F.sum("hits").alias("hits"), F.sum("lines").alias("lines"))
        .join(units(spark, folder), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "reef",
            F.col("nation_name").alias("site"),
            F.col("c_custkey").cast("string").alias("transect"),
            "report_year",
            period_label(F.col("report_year")).alias("period"),
            F.coalesce(F.try_divide(100.0 * F.col("hits"), F.col("lines")), F.lit(0.0)).alias("hc"),
            *ENTITIES,
        )
    )
    long = P.drop_zero_units(P.to_long(wide, P.columns_like(wide, ENTITY_PATTERN)))
    return with_scaled_covariate(long, ["species"], n_keys=len(ENTITIES))
