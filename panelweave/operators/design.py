"""Covariate scaling and design columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.session import bounded_join

LOG_OFFSET = 0.01


def covariate_scale(
    long: DataFrame, keys: list[str], covariate: str = "hc", offset: float = LOG_OFFSET
) -> DataFrame:
    """Per entity: centre and n-1 standard deviation of ln(covariate + offset), and the raw mean.

    Prediction rows, whose covariate is missing, do not count.
    """
    x = F.col(covariate)
    logged = F.when(x + offset > 0, F.ln(x + offset))
    return long.groupBy(*keys).agg(
        F.avg(logged).alias("x_centre"), F.stddev_samp(logged).alias("x_scale"), F.avg(x).alias("x_raw_mean")
    )


def with_scaled_covariate(
    long: DataFrame,
    keys: list[str],
    covariate: str = "hc",
    offset: float = LOG_OFFSET,
    name: str = "x",
    n_keys: int | None = None,
) -> DataFrame:
    """Add the scaled log covariate; rows without one (prediction rows) sit at 0."""
    scale = covariate_scale(long, keys, covariate, offset)
    x = F.col(covariate)
    logged = F.when(x + offset > 0, F.ln(x + offset))
    joined = bounded_join(long, scale, keys, "left", rows=n_keys)
    scaled = F.try_divide(logged - F.col("x_centre"), F.col("x_scale"))
    return joined.withColumn(name, F.coalesce(scaled, F.lit(0.0))).drop("x_centre", "x_scale", "x_raw_mean")


def design_matrix(
    df: DataFrame, period: str, periods: tuple[str, ...], covariate: str | None = None
) -> DataFrame:
    """Treatment-coded design: intercept, period contrasts against the first period, and, with a covariate,
    its main effect and its interactions."""
    columns = {"x_intercept": F.lit(1.0)}
    for p in periods[1:]:
        columns[f"x_{p.lower()}"] = F.when(F.col(period) == p, 1.0).otherwise(0.0)
    if covariate:
        columns["x_cov"] = F.col(covariate)
        for p in periods[1:]:
            columns[f"x_cov_{p.lower()}"] = F.when(F.col(period) == p, F.col(covariate)).otherwise(0.0)
    return df.withColumns(columns)
