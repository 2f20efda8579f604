"""Session helpers: the shared scratch folder and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side may hold at most this many rows (a key table row is a few hundred bytes).
BROADCAST_ROW_LIMIT = 100_000


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Session for tests and benches on one machine; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("panelweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for intermediate tables, inside the shared folder the cluster names.

    Outside local mode an unset ``spark.checkpoint.dir`` is an error: a machine-local folder would not
    survive the loss of an executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="panelweave-")
    return f"{base.rstrip('/')}/panelweave/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own making, in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Ledger:
    """Cuts lineage by writing tables to the shared scratch folder, reusing a few slots per name."""

    def __init__(self, spark: SparkSession, slots: int = 3):
        self.spark = spark
        self.root = scratch_folder(spark)
        self.slots = slots
        self._turn: dict[str, int] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        turn = self._turn.get(name, -1) + 1
        self._turn[name] = turn
        path = f"{self.root}/{name}/slot{turn % self.slots}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete the slots; what ``keep`` wrote stays."""
        for name in self._turn:
            for slot in range(self.slots):
                remove(self.spark, f"{self.root}/{name}/slot{slot}")
        self._turn.clear()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write to a slot of its own, for tables the caller holds on to."""
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def bounded_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: int | None = None
) -> DataFrame:
    """Join that broadcasts ``right`` only when ``rows``, a known bound on its rows, is small enough.

    Beyond the bound, or without one, the join is left to the optimizer (sort-merge with adaptive
    skew splitting), so the result is the same at any size.
    """
    if rows is not None and rows <= BROADCAST_ROW_LIMIT:
        right = F.broadcast(right)
    return left.join(right, on, how)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], prefix: str = "") -> Column:
    """Equality of all keys where a missing key matches a missing key."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[prefix + key])
    return condition
