"""Small helpers shared by the text operators."""

from __future__ import annotations

import math
import sys
import types
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.session import scratch_folder

def sent_along(name: str) -> None:
    """Sends a module's code with the jobs that use it, so workers need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


sent_along(__name__)


def worker_store() -> dict:
    """What a worker process keeps from task to task; not part of what is sent along."""
    return sys.modules.setdefault("_panelweave_store", types.ModuleType("_panelweave_store")).__dict__


# A word is a run of characters other than the blank and the controls 9 to 13.
BLANKS = "[\\x20\\x09-\\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def quoted(name: str) -> Column:
    """Column by its exact name, also when it holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, **own: Column) -> DataFrame:
    """All columns of ``df`` as one struct ``row`` beside ``own``, so that no column name can clash."""
    whole = F.struct(*[quoted(c) for c in df.columns]).alias("row")
    return df.select(whole, *[column.alias(name) for name, column in own.items()])


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))


def count_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def new_folder(spark: SparkSession) -> str:
    """A new folder below the shared one that the cluster names."""
    return scratch_folder(spark)


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and outlives lost executors."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def rows_at_once(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of at most ``most`` rows for what is run inside; the session's own number holds if it is smaller, and again afterwards.

    Batches are cut by rows alone, so those of texts take memory in the JVM and the worker by the length of the texts.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(own)) if int(own) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def partitions_for(spark: SparkSession, size: float, each: float) -> int:
    """Partitions that hold about ``each`` units of ``size``, and no fewer than the session's shuffle partitions."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(size / each))
