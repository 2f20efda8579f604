"""A quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. Their votes are counted by pattern over all
documents; expectation-maximisation on the counts estimates how each labeller votes on good and on bad ones, without a
known label, and so the posterior of every pattern. The posteriors of a bounded sample train a linear scorer on hashed
words and word shapes, and the scorer, which also sees what no labeller asks for, judges all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import new_folder, quoted, sent_along, words_of, written
from panelweave.llm.pretokens import text_slices
from panelweave.llm.shingles import mixed, word_hashes

sent_along(__name__)

GOOD, BAD, NONE = "g", "b", "-"
LABELLERS = ("symbols", "shouting", "menus", "variety", "capitals", "sentences", "short_words", "same_word")
WIDTH = 1 << 14
#: At most about so many documents train the scorer.
SAMPLE = 12_000


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(NONE)


def voted_rows(base: DataFrame) -> DataFrame:
    """``base`` (id, text) with votes, one letter per labeller in the order of LABELLERS, and n, the number of words.

    All abstain on a text without words. What the labellers look at is a column each, so it is counted once.
    """
    text, words = F.col("text"), F.col("words")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    pairs = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)))
    seen = base.select("id", "text", words_of(text).alias("words")).select(
        "id", "text", F.size(words).alias("n"), F.length(text).alias("chars"),
        count("[#*$%&|<>]").alias("symbols"), count("!!").alias("shouts"), count(" \\| ").alias("bars"),
        F.size(F.array_distinct(words)).alias("distinct"), count("\\p{Lu}").alias("capitals"), count("[.!?]").alias("ends"),
        F.size(F.filter(words, lambda w: F.length(w) <= 3)).alias("few"),
        F.size(F.filter(pairs, lambda i: F.get(words, i) == F.get(words, i - 1))).alias("same"),
    )
    n, chars, symbols, shouts, bars, distinct, capitals, ends, few, same = (
        F.col(c) for c in ("n", "chars", "symbols", "shouts", "bars", "distinct", "capitals", "ends", "few", "same")
    )
    each = (
        _vote(100 * symbols > 3 * chars, 200 * symbols <= chars),
        _vote(100 * shouts > 8 * n, shouts == 0),
        _vote(100 * bars > 8 * n, bars == 0),
        _vote((n >= 20) & (100 * distinct < 40 * n), (n >= 20) & (100 * distinct > 50 * n)),
        _vote(100 * capitals > 25 * chars, 100 * capitals < 12 * chars),
        _vote((n >= 20) & (50 * ends < n), (n >= 10) & (25 * ends >= n) & (2 * ends <= n)),
        _vote((n >= 20) & ((100 * few < 8 * n) | (100 * few > 80 * n)), (n >= 20) & (100 * few >= 15 * n)),
        _vote(100 * same > 10 * n, (n >= 10) & (100 * same <= 5 * n)),
    )
    return seen.select("id", "text", F.when(n == 0, NONE * len(each)).otherwise(F.concat(*each)).alias("votes"), "n")


@dataclass(frozen=True)
class LabelModel:
    """``share`` of good documents; ``chance[l, y, v]``: labeller l, where it votes, votes v (GOOD, BAD) on class y (bad, good)."""

    share: float
    chance: np.ndarray

    def accuracy(self) -> dict[str, float]:
        """How often a labeller is right where it votes."""
        p = np.array([1 - self.share, self.share])
        right = self.chance[:, 1, 0] * p[1] + self.chance[:, 0, 1] * p[0]
        return dict(zip(LABELLERS, right.round(4).tolist()))

    def posterior(self, patterns: list[str]) -> np.ndarray:
        at = np.array([["gb-".index(v) for v in p] for p in patterns], np.int64).reshape(len(patterns), len(LABELLERS))
        labeller = np.arange(at.shape[1])
        silent = np.zeros((*self.chance.shape[:2], 1))
        logs = np.concatenate((np.log(self.chance), silent), 2)
        logs = np.stack([
            logs[labeller, y, at].sum(1) + np.log(max(p, 1e-9)) for y, p in ((0, 1 - self.share), (1, self.share))
        ], 1)
        odds = np.clip(logs[:, 0] - logs[:, 1], -500, 500)
        return 1 / (1 + np.exp(odds))


def estimate(patterns: list[str], counts: list[int], rounds: int = 200) -> LabelModel:
    """Expectation-maximisation; an abstention says nothing. There are at most 3^labellers patterns."""
    n = np.array(counts, float)
    at = np.array([["gb-".index(v) for v in p] for p in patterns], np.int64).reshape(len(patterns), len(LABELLERS))
    good = 0.9 * 0.1 ** (at == 1).sum(1)  # each labeller looks for one fault of many, so one bad vote counts at first
    model = LabelModel(0.5, np.full((len(LABELLERS), 2, 2), 1 / 2))
    for _ in range(rounds):
        chance = np.empty((at.shape[1], 2, 2))
        for y, weight in ((0, n * (1 - good)), (1, n * good)):
            for v in range(2):
                chance[:, y, v] = ((at == v) * weight[:, None]).sum(0) + 0.5
        chance /= chance.sum(2, keepdims=True)
        model = LabelModel(float((n * good).sum() / max(n.sum(), 1)), chance)
        new = model.posterior(patterns)
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return model


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 66, 48, 97


def _shape(text: bytes) -> bytes:
    """Letters, capitals and digits as one sign each, and runs of a sign as one."""
    raw = _SHAPE[np.frombuffer(text, np.uint8)]
    keep = np.ones(len(raw), bool)
    keep[1:] = raw[1:] != raw[:-1]
    return raw[keep].tobytes()


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, value) of hashed words, shapes and repeats; a text's values of each kind sum to one at most."""
    rows, places, values = [], [], []
    words, bounds = word_hashes(texts)
    shapes, shape_bounds = word_hashes([_shape(t) for t in texts])
    same = np.flatnonzero(words[1:] == words[:-1]) + 1
    for kind, (hashes, ends) in enumerate(((words, bounds), (shapes, shape_bounds), (np.full(len(same), 7, np.uint64), np.searchsorted(same, bounds)))):
        size = np.diff(ends)
        text = np.repeat(np.arange(len(texts)), size)
        place = (mixed(hashes + np.uint64(kind)) & np.uint64(WIDTH - 1)).astype(np.int64)
        of = np.maximum(size if kind < 2 else np.diff(bounds), 1)[text]
        keys, number = np.unique(text * WIDTH + place, return_inverse=True)
        rows.append(keys // WIDTH)
        places.append(keys % WIDTH)
        values.append(np.bincount(number, 1 / of, minlength=len(keys)) * (1 if kind else 0.3))
    return np.concatenate(rows), np.concatenate(places), np.concatenate(values)


ROUNDS, PENALTY = 300, 1e-5


def _packed_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, seen) of (id, text): a text's features, places then values; at most two WIDTH and one, however long it is."""
    for part, texts in text_slices(batches, "text"):
        row, place, value = features([t.encode() for t in texts])
        order = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[order], np.arange(len(texts) + 1))
        place, value = place[order].astype("<u2"), value[order].astype("<f8")
        seen = [place[a:b].tobytes() + value[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(seen, pa.binary())], names=["id", "seen"])


def _fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Logistic weights for soft labels by accelerated gradient steps over the whole sample."""
    sizes = np.array([len(b) // 10 for b in rows["seen"]], np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    place = np.concatenate([np.frombuffer(b, "<u2", n) for b, n in zip(rows["seen"], sizes)]).astype(np.int64)
    value = np.concatenate([np.frombuffer(b, "<f8", n, 2 * n) for b, n in zip(rows["seen"], sizes)])
    goal, n = rows["posterior"].to_numpy(float), len(rows)
    share = np.clip(goal.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(goal >= 0.5, 0.5 / share, 0.5 / (1 - share))  # both classes count alike
    w = np.zeros(WIDTH + 1)
    square = np.full(WIDTH + 1, 1e-8)
    for _ in range(ROUNDS):
        score = np.bincount(row, value * w[place], minlength=n) + w[-1]
        miss = weight * (1 / (1 + np.exp(-np.clip(score, -500, 500))) - goal) / n
        step = np.append(np.bincount(place, value * miss[row], minlength=WIDTH), miss.sum()) + PENALTY * w
        square += step * step
        w -= 0.5 * step / np.sqrt(square)
    return pd.DataFrame({"weights": [w.astype("<f8").tobytes()]})


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[DataFrame, LabelModel]:
    """A row per row of ``docs``: its id, votes, posterior, score (double), kept (score of 0.5 or more), and the model.

    All documents are voted on and counted. ``sample`` bounds the documents that train the scorer: those with the smallest hashes
    of their ids, about so many. An id that repeats gives one of them, of its smallest posterior and then its smallest text hash. A text without words (null, empty, blank) has no features and the score of the
    bias alone, 0.5 or less, and isn't kept. Repeated rows are judged alike; an empty table gives an empty table.
    """
    folder = new_folder(docs.sparkSession)
    base = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    voted = written(voted_rows(base).select("id", "votes", (F.col("n") > 0).alias("worded"), F.xxhash64("text").alias("h")), folder, "votes")
    counts = voted.where("worded").groupBy("votes").count().orderBy("votes").collect()  # at most 3^8 rows
    patterns = [r["votes"] for r in counts]
    model = estimate(patterns, [r["count"] for r in counts])
    of_pattern = dict(zip(patterns, model.posterior(patterns).tolist()))
    total = sum(r["count"] for r in counts)
    share = min(1.0, sample / total) if total else 0.0

    table = docs.sparkSession.createDataFrame([*of_pattern.items()] or [("", 0.0)], "votes string, posterior double")
    chosen = voted.where(F.col("worded") & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))))
    chosen = chosen.join(F.broadcast(table), "votes").groupBy("id").agg(F.min(F.struct("posterior", "h")).alias("least"))  # the table is a row a pattern
    chosen = chosen.select("id", "least.posterior", "least.h")
    # the sample is bounded, so its ids are few
    texts = base.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen.select("id", "h")), ["id", "h"]).select("id", "text")
    kind = base.schema["id"].dataType.simpleString()
    seen = texts.mapInArrow(_packed_features, f"id {kind}, seen binary").groupBy("id").agg(F.min("seen").alias("seen"))  # equal texts as one
    train = seen.join(F.broadcast(chosen), "id").select("seen", "posterior", F.lit(0).alias("all"))
    fitted = train.groupBy("all").applyInPandas(_fit, "weights binary").first()
    weights = np.frombuffer(fitted["weights"], "<f8") if fitted else np.zeros(WIDTH + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            row, place, value = features([t.encode() for t in texts])
            raw = np.bincount(row, value * weights[place], minlength=len(texts)) + weights[-1]
            worded = np.bincount(row, minlength=len(texts)) > 0
            p = np.where(worded, 1 / (1 + np.exp(-np.clip(raw, -500, 500))), 0.0)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("votes"), pa.array(p)], names=["id", "votes", "score"])

    scored = voted_rows(base).select("id", "text", "votes").mapInArrow(score, f"id {kind}, votes string, score double")
    out = scored.join(F.broadcast(table), "votes", "left").select(
        F.col("id").alias(id_col), "votes", "posterior", "score", (F.col("score") >= 0.5).alias("kept")
    )
    return out, model


def quality_query(spark, folder: str) -> DataFrame:
    return quality(spark.read.parquet(f"{folder}/documents.parquet"))[0]
