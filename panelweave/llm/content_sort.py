"""Exact deduplication by sorting content.

Rows are range-partitioned by sampled splitters, sorted (on disk where need be), and each text is compared in full with
its neighbour; a run of equal texts is one group. The splitters hold the first characters of a text and a hash of
all of it, so they stay small however long the texts are and texts with one long common opening still spread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import new_folder, packed, quoted, written

OPENING = 48


def _hot_texts(rows: DataFrame, share: float, sample: float) -> DataFrame:
    """Hashes of texts that hold more than ``share`` of a sample: fewer than 1/share rows.

    They only say which groups are laid out in parts; no result depends on them.
    """
    seen = rows.select("h").sample(fraction=sample, seed=7).groupBy("h").agg(F.count("*").alias("c"))
    total = seen.agg(F.sum("c").alias("n"))
    return seen.where((F.col("c") > 4) & (F.col("c") > share * total.select("n").scalar())).select("h")


def _laid_out(
    docs: DataFrame, id_col: str, text_col: str, normalise, parts: int, hot_share: float, sample: float, whole: bool
) -> DataFrame:
    """Rows by range of opening, hash and part; ``row`` holds all columns if ``whole``, else nothing else is read."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    rows = (packed(docs, id=quoted(id_col), text=text) if whole else docs.select(
        quoted(id_col).alias("id"), text.alias("text"))).withColumn("h", F.xxhash64("text"))
    hot = _hot_texts(rows, hot_share, sample).withColumn("hot", F.lit(True))
    # the broadcast side holds under 1/hot_share rows whatever the input
    return rows.join(F.broadcast(hot), "h", "left").select(
        *(["row"] if whole else []), "id", "text", F.left("text", F.lit(OPENING)).alias("opening"), "h",
        F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(parts))).otherwise(F.lit(0)).cast("int").alias("part"),
        F.coalesce("hot", F.lit(False)).alias("hot"),
    ).repartitionByRange("opening", "h", "part")


RUN = ["opening", "h", "part", "text"]


def _order(keep: str) -> Column:
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    return F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()


def group_equal(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "smallest",
    parts: int = 32,
    hot_share: float = 0.002,
    sample: float = 0.05,
) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size (long), kept (boolean), text_sha256.

    Texts are equal when ``normalise`` (default: no change) gives the same string; null counts as empty. ``keep`` is
    ``smallest`` or ``largest``: the id that stays. A null id never stays beside another id; if all ids of a group are
    null, keep_id is null and one of its rows is kept. Of rows that repeat the kept id exactly one is kept. An empty
    table gives an empty table; other columns of ``docs`` are not looked at.

    A text that holds more than ``hot_share`` of the rows is laid out in ``parts`` by a hash of the id; its parts are
    sorted and compared like other groups and then added up by digest on one row per part.
    """
    order = _order(keep)
    best = F.min if keep == "smallest" else F.max
    run = Window.partitionBy(*RUN)
    found = _laid_out(docs, id_col, text_col, normalise, parts, hot_share, sample, False).select(
        "id", "part", "hot", F.sha2("text", 256).alias("sha"),
        best("id").over(run).alias("keep_id"),
        F.count(F.lit(1)).over(run).alias("size"),
        F.row_number().over(run.orderBy(order)).alias("nth"),
    )
    found = written(found, new_folder(docs.sparkSession), "runs")
    totals = found.where(F.col("hot") & (F.col("nth") == 1)).groupBy("sha").agg(
        best("keep_id").alias("all_keep"), F.sum("size").alias("all_size"), F.min("part").alias("first_part")
    )
    out = found.join(F.broadcast(totals), "sha", "left")  # under 1/hot_share rows
    keep_id = F.when(F.col("hot"), F.col("all_keep")).otherwise(F.col("keep_id"))
    first = F.when(F.col("id").isNull() & F.col("hot"), F.col("part") == F.col("first_part")).otherwise(F.lit(True))
    return out.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.when(F.col("hot"), F.col("all_size")).otherwise(F.col("size")).alias("group_size"),
        ((F.col("nth") == 1) & F.col("id").eqNullSafe(keep_id) & first).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def kept_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "smallest",
    parts: int = 32,
    hot_share: float = 0.002,
    sample: float = 0.05,
) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: one per group of equal texts, as ``group_equal`` says."""
    order = _order(keep)
    heads = _laid_out(docs, id_col, text_col, normalise, parts, hot_share, sample, True).withColumn(
        "nth", F.row_number().over(Window.partitionBy(*RUN).orderBy(order))
    ).where("nth = 1")
    # at most `parts` rows for each of under 1/hot_share texts
    of_hot = heads.where("hot").withColumn("nth", F.row_number().over(Window.partitionBy("text").orderBy(order)))
    return heads.where(~F.col("hot")).select("row.*").unionByName(of_hot.where("nth = 1").select("row.*"))


def exact_query(spark, folder: str) -> DataFrame:
    return group_equal(spark.read.parquet(f"{folder}/documents.parquet"), keep="largest")


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
