"""Connected components of links in a table, by stars; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import written


def _large(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest one."""
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, folder: str, name: str, most: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b) other than the smallest ones of components.

    Large and small stars alternate until nothing moves; each round is written to ``folder``, which cuts the lineage.
    The number of rounds grows with the logarithm of the longest chain.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
                  folder, f"{name}-0")
    state = None
    for turn in range(1, most):
        now = written(_small(_large(now)).distinct(), folder, f"{name}-{turn}")
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = seen
    raise RuntimeError(f"components did not settle in {most} rounds")
