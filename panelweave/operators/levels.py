"""Dictionary levels of label columns and display orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.panel import number_rows


def levels_table(df: DataFrame, column: str, level: str = "level") -> DataFrame:
    """Labels still in use with their position in sorted order, the first being the baseline."""
    used = df.filter(F.col(column).isNotNull()).select(column).distinct()
    return number_rows(used, [F.col(column)], level)


def level_index(column: str, periods: tuple[str, ...]):
    """Zero-based position of a label in a fixed list; missing if it is not listed."""
    position = F.array_position(F.array(*[F.lit(p) for p in periods]), F.col(column)).cast("int")
    return F.when(position > 0, position - 1)


def entity_order(df: DataFrame, group: str, entity: str, name: str = "display_order") -> DataFrame:
    """Order of entities by (group, entity); entities without a group come last."""
    pairs = df.select(group, entity).distinct()
    return number_rows(pairs, [F.col(group).asc_nulls_last(), F.col(entity)], name)


def caterpillar_rank(
    effects: DataFrame, group: str, entity: str, period: str, estimate: str, name: str = "display_rank"
) -> DataFrame:
    """One display order for all panels: entities in the order in which they first appear when panels are
    visited by (group, period) and sorted by estimate inside each panel."""
    first = effects.groupBy(group, entity).agg(
        F.min(F.struct(F.col(period), F.col(estimate))).alias("__first")
    )
    ordered = number_rows(
        first,
        [
            F.col(group).asc_nulls_last(),
            F.col(f"__first.{period}"),
            F.col(f"__first.{estimate}").asc_nulls_last(),
            F.col(entity),
        ],
        name,
    ).drop("__first")
    other = ordered.select(F.col(group).alias("__g"), F.col(entity).alias("__e"), name)
    return effects.join(other, F.expr(f"{group} <=> __g AND {entity} = __e")).drop("__g", "__e")
