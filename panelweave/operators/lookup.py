"""Entity lookups: overrides, defaults and coded choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.session import bounded_join

# Chosen-model labels and the candidate each one selects. Labels match exactly.
MODEL_LABELS = {
    "Zero-inflated poisson 1": "zeroinflatedpoisson1",
    "Zero-inflated poisson 0": "zeroinflatedpoisson0",
    "Zero-inflated negative binomial 1": "zeroinflatednbinomial1",
    "Negative binomial": "nbinomial",
    "Negative binomial 1": "nbinomial2",
    "Poisson": "poisson",
}
DEFAULT_MODEL = "zeroinflatednbinomial0"
DEFAULT_LABEL = "Zero-inflated Negative Binomial 0"


def coded(label: Column, codes: dict[str, str], default: str) -> Column:
    """First matching code in order, else the default."""
    chain = None
    for text, code in codes.items():
        chain = F.when(label == text, code) if chain is None else chain.when(label == text, code)
    return chain.otherwise(default)


def override_values(df: DataFrame, overrides: list[tuple], key: str, value: str) -> DataFrame:
    """Replace values of listed keys, also by missing; a later entry for the same key wins."""
    final = list(dict(overrides).items())
    kind = df.schema[value].dataType.simpleString()
    table = df.sparkSession.createDataFrame(
        [(k, v, True) for k, v in final], f"{key} string, __new {kind}, __hit boolean"
    )
    joined = bounded_join(df, table, [key], "left", rows=len(final))
    return joined.withColumn(value, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(value))).drop(
        "__new", "__hit"
    )


def choose_models(entities: DataFrame, lookup: DataFrame, entity: str = "species", lookup_rows: int | None = None) -> DataFrame:
    """Attach group columns and the chosen model; flagged entities and entities not listed drop out."""
    joined = bounded_join(entities, lookup, [entity], "left", rows=lookup_rows)
    label = F.coalesce(F.col("best_model"), F.lit(DEFAULT_LABEL))
    return (
        joined.withColumn("best_model", label)
        .filter(F.col("exclude") != "TRUE")
        .withColumn("name", coded(F.col("best_model"), MODEL_LABELS, DEFAULT_MODEL))
    )
