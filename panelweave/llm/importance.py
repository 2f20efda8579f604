"""Importance resampling towards a target distribution.

Texts are read as bags of hashed word and word-pair features. Features of all documents and of all target texts are counted in
buckets; a bucket's gain is the log ratio of its smoothed shares. A document weighs the mean gain of its features, and adding
a Gumbel number that follows from its id makes taking the highest scores a draw without replacement in proportion to the weights.

Arrow does the work inside a task: texts are lower-cased and split, words are coded by a dictionary, shifted codes form the
pairs, and a CRC is taken once for each distinct word or pair of a slice of texts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.arrow_words import distinct, numbered, rows_of, slices, split_words
from panelweave.llm.common import new_folder, packed, quoted, sent_along, written
from panelweave.llm.crc_sql import crc32_sql
from panelweave.operators.panel import number_rows

sent_along(__name__)

# Between words, after A-Z are lower-cased: all of ASCII but digits and small letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
SCALE = 1000.0


def feature_buckets(texts: pa.Array, width: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... ``width`` words: the buckets of the distinct runs, for every run the index of its own, the
    number of its text, and the bounds of the texts' words."""
    words, bounds = split_words(texts, SEPARATORS, lower=True)
    names, own = numbered(words)
    text = rows_of(bounds)
    crcs = np.array([zlib.crc32(w) for w in names], np.int64)
    yield crcs % buckets, own, text, bounds
    codes = own
    for n in range(2, width + 1):
        whole = text[n - 1 :] == text[: max(len(text) - n + 1, 0)]
        following = own[n - 1 :]
        pair = codes[: len(whole)] * max(len(names), 1) + following
        found, codes_whole = distinct(pair[whole])
        before, last = np.divmod(found, max(len(names), 1))
        spaced = [zlib.crc32(b" ", c) for c in crcs.tolist()]
        crcs = np.array(list(map(zlib.crc32, [names[i] for i in last.tolist()], [spaced[i] for i in before.tolist()])), np.int64)
        codes = np.zeros(len(whole), np.int64)
        codes[whole] = codes_whole
        yield crcs % buckets, codes_whole, text[: len(whole)][whole], bounds


def bucket_counts(texts: DataFrame, width: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all rows of ``texts`` (text), repeats counted; a task tells at most one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches):
            for own_bucket, own, _, _ in feature_buckets(part.column("text"), width, buckets):
                times = np.bincount(own, minlength=len(own_bucket))
                np.add.at(total, own_bucket, times)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _filled(counts: DataFrame, buckets: int) -> list[int]:
    """The counts of all buckets; ``buckets`` bounds the rows that come to the driver."""
    out = [0] * buckets
    for row in counts.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """Floored thousandfold log ratio of the smoothed shares of every bucket."""
    buckets, S, T = len(corpus), sum(corpus), sum(target)
    ratio = [float(t + 1) * float(S + buckets) / (float(s + 1) * float(T + buckets)) for s, t in zip(corpus, target)]
    return np.array([math.floor(SCALE * math.log(r)) for r in ratio], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, width: int = 2) -> DataFrame:
    """(id, n_words, n_features, weight) for rows of ``docs`` (id, text)."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_bucket = pa.array(gain)
        for part in slices(batches):
            n = part.num_rows
            total, features = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for own_bucket, own, text, bounds in feature_buckets(part.column("text"), width, buckets):
                per_run = pc.take(pc.take(per_bucket, pa.array(own_bucket)), pa.array(own)).to_numpy(zero_copy_only=False)
                upto = np.concatenate(([0], np.cumsum(per_run, dtype=np.int64)))
                ends = np.searchsorted(text, np.arange(n + 1))
                total += upto[ends[1:]] - upto[ends[:-1]]
                features += np.diff(ends)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(np.diff(bounds)), pa.array(features), pa.array(weight)],
                names=["id", "n_words", "n_features", "weight"],
            )

    return docs.mapInArrow(weigh, "id long, n_words long, n_features long, weight long")


def gumbel(ident: Column, seed: int) -> Column:
    """Thousandfold Gumbel number of an id, floored; a null id counts as an empty one."""
    digits = F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256), F.lit(8))
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    width: int = 2,
    buckets: int = BUCKETS,
    min_words: int = 20,
    percent: int = 25,
    seed: int = 7,
) -> DataFrame:
    """One row per row of ``docs``: its id, n_features, weight, score and rank (all long), and n_words.

    Words are runs of digits, letters and all beyond ASCII, A-Z lower-cased; features are runs of 1 to ``width`` words. Of the
    rows with at least ``min_words`` words the ``percent`` with the highest scores are drawn, floored, equal scores by
    smaller id, and ranked from 1; all others have a null rank.

    A null or blank text has no features and weight 0. A null id draws the number of an empty one and comes last among equal
    scores. Rows that repeat an id have equal Gumbel numbers and are ranked one after the other. Without target texts all
    target shares are equal; an empty table gives an empty table. Only the id and text columns are looked at.
    """
    texts = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    corpus = _filled(bucket_counts(texts, width, buckets), buckets)
    wanted = _filled(bucket_counts(target.select(quoted(target_col).alias("text")), width, buckets), buckets)
    folder = new_folder(docs.sparkSession)
    scored = weighed(texts, gains(corpus, wanted), width).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    scored = written(scored, folder, "scored")
    able = scored.where(F.col("n_words") >= min_words).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row").asc()]  # rows that repeat an id spread
    ranked = number_rows(able, order, "nth").drop("row")
    n_drawn = able.count() * percent // 100
    others = scored.where(F.col("n_words") < min_words).withColumn("nth", F.lit(None).cast("long"))
    return ranked.unionByName(others).select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_features", "weight", "score",
        F.when(F.col("nth") <= n_drawn, F.col("nth")).alias("rank"), "n_words",
    )


def drawn_rows(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; rows that share a drawn id come together."""
    drawn = resampled(docs, target, id_col, **how).where(F.col("rank").isNotNull()).select(F.col(id_col).alias("drawn")).distinct()
    return packed(docs, id=quoted(id_col)).join(drawn, F.col("id").eqNullSafe(F.col("drawn")), "left_semi").select("row.*")


def resampling_query(spark, folder: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark"))
    return resampled(docs, target).drop("n_words")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(table: str, ident: str) -> str:
    lowered = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return f"SELECT {ident} AS id, regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"


def _features(words: str) -> str:
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"SELECT id, unnest(w || {pairs}) AS feature FROM {words}"


RESAMPLING_SQL = f"""
WITH dw AS MATERIALIZED ({_words("documents", "doc_id")}),
bw AS ({_words("benchmark", "NULL")}),
df AS MATERIALIZED (SELECT id, feature, count(*) AS n FROM ({_features("dw")}) GROUP BY ALL),
bf AS MATERIALIZED (SELECT feature, count(*) AS n FROM ({_features("bw")}) GROUP BY ALL),
names AS MATERIALIZED (SELECT feature, {crc32_sql("feature")} % 10000 AS bucket
  FROM (SELECT feature FROM df UNION SELECT feature FROM bf)),
ds AS (SELECT bucket, sum(n) AS s FROM df JOIN names USING (feature) GROUP BY bucket),
bs AS (SELECT bucket, sum(n) AS t FROM bf JOIN names USING (feature) GROUP BY bucket),
total AS (SELECT (SELECT coalesce(sum(n), 0) FROM df)::DOUBLE AS all_s, (SELECT coalesce(sum(n), 0) FROM bf)::DOUBLE AS all_t),
gain AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (all_s + 10000)
  / ((coalesce(s, 0)::DOUBLE + 1) * (all_t + 10000))))::BIGINT AS g FROM (SELECT unnest(range(0, 10000)) AS bucket)
  LEFT JOIN ds USING (bucket) LEFT JOIN bs USING (bucket) CROSS JOIN total),
w AS (SELECT id, sum(n) AS features, sum(n * g) AS points FROM df JOIN names USING (feature) JOIN gain USING (bucket) GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(features, 0)::BIGINT AS n_features,
    coalesce(floor(points / features), 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS g
  FROM dw LEFT JOIN w USING (id)),
ranked AS (SELECT *, weight + g AS score, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + g DESC, doc_id) AS nth FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_words >= 20 AND nth <= 25 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN nth END AS rank
FROM ranked
"""
