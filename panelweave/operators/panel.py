"""Panel preparation: cover per unit, null-safe joins, wide to long, unit and entity filters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.text import last_digit, paste, to_number
from panelweave.session import BROADCAST_ROW_LIMIT, Ledger, bounded_join, null_safe


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in table order, both included."""
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """Columns whose name contains a match; looks at the schema only."""
    return [name for name in df.columns if re.search(pattern, name)]


def rename_first(df: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """Rename the first present synonym of each target name."""
    renames = {}
    for target, names in synonyms.items():
        found = next((n for n in names if n in df.columns), None)
        if found and found != target:
            renames[found] = target
    return df.withColumnsRenamed(renames)


def keep_matching(df: DataFrame, keys: DataFrame, names: list[str], rows: int | None = None) -> DataFrame:
    """Rows whose key occurs in ``keys``; a missing key matches a missing key."""
    right = keys.select(*[F.col(n).alias(f"__{n}") for n in names]).distinct()
    if rows is not None:
        right = bounded_side(right, rows)
    return df.join(right, null_safe(df, right, names, "__"), "left_semi")


def bounded_side(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROW_LIMIT else df


def cover_by_unit(
    raw: DataFrame,
    keys: list[str],
    cover: str = "hc",
    hits: str = "n_points",
    trials: str = "total_points",
    columns: list[str] | None = None,
) -> DataFrame:
    """Cover per unit: missing covers count as 0, a missing hit count makes the sum missing, and a group
    with several distinct trial counts (missing is one of them) yields one row per trial count.

    Rows are de-duplicated, then summed per (keys, trials) with map-side partial sums, so even a group
    that holds most of the rows reaches the second step as a handful of rows.
    """
    rows = raw.select(*(columns or raw.columns)).distinct()
    part = rows.groupBy(*keys, trials).agg(
        F.sum(cover).alias("__cover"),
        F.sum(hits).alias("__hits"),
        F.count_if(F.col(hits).isNull()).alias("__gaps"),
    )
    whole = Window.partitionBy(*keys)
    return part.select(
        *keys,
        F.coalesce(F.sum("__cover").over(whole), F.lit(0.0)).alias(cover),
        F.when(F.sum("__gaps").over(whole) == 0, F.sum("__hits").over(whole)).alias(hits),
        trials,
    )


def unit_numbers(df: DataFrame, site_code: str, transect_code: str, year_label: str) -> DataFrame:
    """Numeric year and the last-digit unit numbers used as join keys."""
    return df.withColumns(
        {
            "report_year": to_number(F.col(year_label)),
            "site_no": last_digit(F.col(site_code)),
            "transect_no": last_digit(F.col(transect_code)),
        }
    )


def full_join_panel(counts: DataFrame, cover: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join in which missing keys match each other; repeated keys fan out."""
    right = cover.select(*[F.col(c).alias(f"__{c}" if c in keys else c) for c in cover.columns])
    joined = counts.join(right, null_safe(counts, right, keys, "__"), "full")
    merged = [F.coalesce(counts[k], right[f"__{k}"]).alias(k) for k in keys]
    rest = [counts[c] for c in counts.columns if c not in keys]
    return joined.select(*merged, *rest, *[right[c] for c in cover.columns if c not in keys])


def add_unit_keys(df: DataFrame, reef: str = "reef_name", site: str = "site_no", transect: str = "transect_no") -> DataFrame:
    """Nested unit keys: site inside reef, transect inside site."""
    site_key = paste(F.col(reef), F.col(site))
    return df.withColumns({"site": site_key, "transect": paste(site_key, F.col(transect))})


def units_with_several_parents(df: DataFrame, child: str, parent: str) -> DataFrame:
    """Units that sit under more than one parent; an empty result means the design is nested."""
    pairs = df.select(child, parent).distinct()
    return pairs.groupBy(child).agg(F.count("*").alias("parents")).filter(F.col("parents") > 1)


def to_long(df: DataFrame, entities: list[str], entity: str = "species", value: str = "value") -> DataFrame:
    """One row per (survey row, entity); missing values are kept."""
    return df.unpivot([c for c in df.columns if c not in entities], entities, entity, value)


def to_nested(long: DataFrame, entity: str, columns: list[str], size: int = 1000) -> DataFrame:
    """Export form: lists of row structs per entity, in chunks of bounded length.

    Rows are spread over chunks by a hash of their content, so one entity never becomes one giant value.
    """
    order = F.struct(*columns)
    counts = long.groupBy(entity).agg(F.count("*").alias("__n"))
    chunk = F.pmod(F.xxhash64(*columns), F.greatest(F.ceil(F.col("__n") / size), F.lit(1)))
    return (
        long.join(counts, entity)
        .withColumn("chunk", chunk)
        .groupBy(entity, "chunk")
        .agg(F.sort_array(F.collect_list(order)).alias("data"))
    )


def drop_zero_units(long: DataFrame, entity: str = "species", unit: str = "site", value: str = "value") -> DataFrame:
    """Remove, for each entity, the units in which it was never counted."""
    empty = long.groupBy(entity, unit).agg(F.sum(value).alias("__total")).filter(F.col("__total") == 0)
    return long.join(empty.drop("__total"), [entity, unit], "left_anti")


def number_rows(df: DataFrame, order: list, name: str, start: int = 1) -> DataFrame:
    """Consecutive numbers over a global order, without putting the table in one task.

    Rows are range-partitioned on the order, numbered inside each partition, and shifted by the row counts
    of the partitions before it (a table of one row per partition). The order should identify rows. The
    partitioned rows are written once: range boundaries come from a sample, so evaluating the plan twice
    could give different ones.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(partitions, *order)
        .sortWithinPartitions(*order)
        .withColumns(
            {
                "__part": F.spark_partition_id(),
                "__pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
            }
        )
    )
    ranged = Ledger(spark).keep(ranged, "ranged")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("__part")
        .agg(F.count("*").alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    return (
        bounded_join(ranged, offsets, ["__part"], rows=partitions)
        .withColumn(name, F.col("__before") + F.col("__pos") + F.lit(start))
        .drop("__part", "__pos", "__before")
    )


def prediction_grid(long: DataFrame, entity: str, periods: tuple[str, ...], period: str = "period") -> DataFrame:
    """Every entity crossed with the fixed list of periods."""
    spark = long.sparkSession
    grid = spark.createDataFrame([(p,) for p in periods], f"{period} string")
    return long.select(entity).distinct().crossJoin(F.broadcast(grid))


def with_prediction_rows(
    long: DataFrame, entity: str, periods: tuple[str, ...], period: str = "period", **fill
) -> DataFrame:
    """Append one flagged row per (entity, period); other columns are missing unless given in ``fill``."""
    grid = prediction_grid(long, entity, periods, period).withColumns(
        {"is_pred": F.lit(True), **{name: F.lit(v) for name, v in fill.items()}}
    )
    return long.withColumn("is_pred", F.lit(False)).unionByName(grid, allowMissingColumns=True)
