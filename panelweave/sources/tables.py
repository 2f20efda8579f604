"""Table sources and sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

STAR_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
}

LOOKUP_SCHEMA = "entity string, trophic string, family string, best_model string, exclude string"


def read_table(spark: SparkSession, folder: str, name: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Read one Parquet table with a declared schema (no inference job)."""
    reader = spark.read
    schema = schema or STAR_SCHEMAS.get(name)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(f"{folder}/{name}.parquet")


def read_lookup_csv(spark: SparkSession, path: str, schema: str = LOOKUP_SCHEMA) -> DataFrame:
    """Read a header CSV in which the text NA means missing; columns follow the declared schema."""
    return spark.read.csv(path, header=True, nullValue="NA", schema=schema, enforceSchema=True)


def tidy_names(df: DataFrame) -> DataFrame:
    """Lower-case column names without dots and spaces, so that no backticks are needed."""
    return df.toDF(*[re.sub(r"[^0-9A-Za-z]+", "_", name).strip("_").lower() for name in df.columns])


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a stage table; the key columns in ``partition_by`` become folders that readers can prune."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


ARTEFACT_KEYS = ["kind", "engine", "name"]
ARTEFACT_KINDS = ("model", "cellmeans", "contrasts", "residuals")


def write_artefacts(df: DataFrame, path: str, kind: str) -> None:
    """Store results of one kind in the artefact table, one folder per (kind, engine, name)."""
    if kind not in ARTEFACT_KINDS:
        raise ValueError(f"kind must be one of {ARTEFACT_KINDS}")
    write_stage(df, f"{path}/kind={kind}", ["engine", "name"])


def read_artefacts(
    spark: SparkSession, path: str, kind: str, engine: str | None = None, names: list[str] | None = None
) -> DataFrame:
    """Read results of one kind; engine and name filters prune folders instead of reading them."""
    df = spark.read.option("basePath", path).parquet(f"{path}/kind={kind}")
    if engine is not None:
        df = df.filter(df.engine == engine)
    if names is not None:
        df = df.filter(df.name.isin(names))
    return df
