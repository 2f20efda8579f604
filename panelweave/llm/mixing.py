"""Mixing sources to target weights by hash thresholds.

Each document has a hash of its id. Words are summed by source and hash bucket; the bucket in which a source reaches its
budget is split again by the next bits of the hash until it is one hash value, and a document is taken if its hash
lies below. Budgets are nested: a larger one takes a superset. Nothing is sorted, and only the boundary
bucket of each source is looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import count_words, new_folder, packed, quoted, written
from panelweave.operators.panel import number_rows
from panelweave.session import BROADCAST_ROW_LIMIT

HASH_BITS = 60
LEVEL_BITS = 10


def doc_hash(ident: Column) -> Column:
    """The first 60 bits of the MD5 of the id as text; ids that are null hash like an empty one."""
    return F.conv(F.left(F.md5(F.coalesce(ident.cast("string"), F.lit(""))), F.lit(15)), 16, 10).cast("long")


def _with_source(rows: DataFrame, per_source: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Joins by source, null to null; the side with a row per source is broadcast only if counted to be small."""
    other = per_source.withColumnRenamed("source", "its")
    other = F.broadcast(other) if few else other
    return rows.join(other, F.col("source").eqNullSafe(F.col("its")), how).drop("its")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2) -> DataFrame:
    """(source, source_size, target) from ``sizes`` (source, source_size).

    Sources by code point, null last, take ``weights`` in turn and share ``percent`` of all sizes. A target
    stops at ``most`` times the source's size; the excess is shared again by weight until none is above. Only totals
    come to the driver.
    """
    ranked = number_rows(sizes, [F.col("source").asc_nulls_last()], "nth")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = ranked.select("source", "source_size", weight.cast("long").alias("weight"), (most * F.col("source_size")).alias("top"))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    each = None
    while True:
        above = F.lit(False) if each is None else F.col("weight") * F.lit(each) > F.col("top")
        found = rows.agg(
            F.sum(F.when(above, F.col("top"))).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("open")
        ).first()
        if not found["open"]:
            break
        new = (total * percent / 100 - (found["held"] or 0)) / found["open"]
        if new == each:
            break
        each = new
    target = F.least(F.col("top").cast("double"), F.col("weight") * F.lit(float(each or 0)))
    return rows.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """(source, source_size, target, copies, cut, with_cut) for ``rows`` (source, size, u) and their ``wanted`` targets.

    Every document is taken ``copies`` times, and once more if u < cut, or u = cut and with_cut.
    """
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    state = wanted.withColumn("copies", times).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    state = state.withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long"))
    folder = new_folder(rows.sparkSession)
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        own = rows
        if level:
            own = _with_source(rows, state.select("source", "prefix"), few).where(
                F.shiftright("u", shift + LEVEL_BITS) == F.col("prefix")
            )
        sums = own.groupBy("source", F.shiftright("u", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        found = _with_source(sums, state.select("source", "rest", "below"), few)
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        found = found.withColumn("upto", F.col("below") + upto).where(F.col("upto") > F.col("rest"))
        edge = found.groupBy("source").agg(
            F.min(F.struct("bucket", "upto", "words")).alias("edge")
        ).select("source", F.col("edge.bucket").alias("bucket"), F.col("edge.upto").alias("upto"), F.col("edge.words").alias("words"))
        state = _with_source(state.drop("upto"), edge, few, "left").select(
            "source", "source_size", "target", "copies", "rest",
            F.coalesce("bucket", F.lit(1 << (LEVEL_BITS * (level + 1)))).alias("prefix"),
            F.coalesce(F.col("upto") - F.col("words"), F.col("below")).alias("below"),
            F.coalesce("upto", "below").alias("upto"),
        )
        state = written(state, folder, f"level-{level}")
    nearer = F.col("upto") - F.col("rest") < F.col("rest") - F.col("below")
    return state.select(
        "source", "source_size", "target", "copies", F.col("prefix").alias("cut"), ((F.col("upto") > F.col("rest")) & nearer).alias("with_cut")
    )


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    percent: int = 150,
    most: int = 2,
) -> DataFrame:
    """One row per row of ``docs``: struct ``row`` with its columns, size, source_size, target, copies and taken.

    Size is the number of words; a null text has none and a null source is a source. ``copies`` says how often the mix
    holds the document: never more than ``most`` times. Taken words of a source differ from its target by at most
    half the largest size of one hash value. Repeated rows share a hash and are taken alike; an
    empty table gives an empty table. Only ids decide, so reruns agree.
    """
    narrow = written(
        docs.select(quoted(source_col).alias("source"), count_words(quoted(text_col)).alias("size"), doc_hash(quoted(id_col)).alias("u")),
        new_folder(docs.sparkSession), "sizes",
    )
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    few = sizes.count() <= BROADCAST_ROW_LIMIT
    state = thresholds(narrow, targets(sizes, weights, percent, most), few)
    rows = packed(docs, source=quoted(source_col), size=count_words(quoted(text_col)), u=doc_hash(quoted(id_col)))
    below = (F.col("u") < F.col("cut")) | ((F.col("u") == F.col("cut")) & F.col("with_cut"))
    copies = F.least(F.col("copies") + below.cast("int"), F.lit(most))
    return _with_source(rows, state, few).select(
        "row", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )


def taken_rows(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix with the columns of ``docs``; one taken twice comes twice."""
    found = mixed(docs, **how).where("copies > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def mixing_query(spark, folder: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{folder}/documents.parquet")).select(
        "row.doc_id", "size", "source_size", "target", "taken"
    )


MIXING_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS u
  FROM documents),
s AS MATERIALIZED (
  SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS top,
    [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight
  FROM d GROUP BY source),
b AS (SELECT sum(source_size) * 1.5::DOUBLE AS budget FROM s),
f AS (
  SELECT 1 AS turn, (SELECT budget FROM b) / (SELECT sum(weight) FROM s)::DOUBLE AS each
  UNION ALL
  SELECT turn + 1, ((SELECT budget FROM b) - (SELECT coalesce(sum(top), 0) FROM s WHERE weight * each > top))::DOUBLE
    / (SELECT sum(weight) FROM s WHERE NOT weight * each > top)::DOUBLE
  FROM f WHERE turn < (SELECT count(*) + 1 FROM s)),
t AS (
  SELECT source, source_size, least(top::DOUBLE, weight * (SELECT arg_max(each, turn) FROM f)) AS target FROM s),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS copies,
    target - copies * source_size AS rest FROM t),
h AS (
  SELECT source, u, sum(size) AS z, sum(sum(size)) OVER (PARTITION BY source ORDER BY u) AS upto FROM d GROUP BY source, u),
e AS (
  SELECT h.source, min({'u': h.u, 'upto': upto, 'z': z}) AS x FROM h JOIN r ON h.source IS NOT DISTINCT FROM r.source
  WHERE upto > rest GROUP BY h.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (copies + CASE WHEN e.x IS NULL OR d.u < e.x.u
    OR (d.u = e.x.u AND e.x.upto - rest < rest - (e.x.upto - e.x.z)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
