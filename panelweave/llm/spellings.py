"""Groups of spelling variants: words one edit apart, the rarer ones pointing to a much more frequent form.

Words are counted with Spark. For the search a word is a vector of letter counts: one edit changes the squared distance of two
vectors by at most two, so NumPy products of blocks of vectors give all candidates, and the edits of those are verified.

Blocks: the alphabet is dealt into five sets of letters. One edit touches at most two letters, so two words one edit apart agree on
the counts of at least three whole sets. A word therefore stands in ten blocks, one for each three sets and its counts there, and a
pair is told only in the first block it shares. Large blocks are cut into parts of bounded size that meet in pairs. So no task holds
an unbounded block and no pair of near words is lost.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.arrow_words import distinct, numbered, rows_of, slices, split_words
from panelweave.llm.common import new_folder, quoted, sent_along, written
from panelweave.llm.crc_sql import crc32_sql
from panelweave.session import bounded_join

sent_along(__name__)

SEPARATORS = r"[^A-Za-z\x{00C0}-\x{00FF}]+"
LETTERS = "etaoinshrdlcumwfgypbvkjxqz" + "".join(map(chr, range(0xC0, 0x100)))
SETS = 5
SET_OF = [i % SETS if (i // SETS) % 2 == 0 else SETS - 1 - i % SETS for i in range(len(LETTERS))]
AGREEING = list(combinations(range(SETS), SETS - 2))
BLOCK_ROWS = 3000
ROWS_AT_ONCE = 1000
HELD_WORDS = 400_000


def altered(run: str, crc: int) -> str:
    """The run without the code point that the hash picks."""
    at = crc % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, every: int, least_length: int, held: int = HELD_WORDS) -> DataFrame:
    """(word, n) over all rows of ``docs`` (id, text); a task adds up its own words before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"]
            )
            total.clear()
            return out

        for part in slices(batches):
            words, bounds = split_words(part.column("text"), SEPARATORS, lower=True)
            names, own = numbered(words)
            pairs, index = distinct(rows_of(bounds) * max(len(names), 1) + own)
            times = np.bincount(index, minlength=len(pairs))
            row, name = np.divmod(pairs, max(len(names), 1))
            ids = ["" if i is None else str(i) for i in part.column("id").to_pylist()]
            opening = [zlib.crc32(f"{i}:".encode()) for i in ids]
            crcs = np.array(list(map(zlib.crc32, [names[i] for i in name.tolist()], [opening[i] for i in row.tolist()])), np.int64)
            changed = crcs % every == 0 if len(crcs) else np.zeros(0, bool)
            long = pc.greater_equal(pc.utf8_length(pa.array(names, pa.binary()).cast(pa.string())), least_length).to_pylist()
            plain = np.bincount(name[~changed], weights=times[~changed], minlength=len(names)).astype(np.int64).tolist()
            for word, n, good in zip(names, plain, long):
                if good and n:
                    total[word] += n
            for i, crc, n in zip(name[changed].tolist(), crcs[changed].tolist(), times[changed].tolist()):
                word = altered(names[i].decode(), crc)
                if len(word) >= least_length:
                    total[word.encode()] += n
            if len(total) > held:
                yield told()
        yield told()

    return docs.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_counts(words: list[str]) -> np.ndarray:
    """A row of letter counts a word, in the order of ``LETTERS``."""
    place = np.full(0x100, -1)
    place[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    flat = np.bincount(row * len(LETTERS) + place[codes], minlength=len(words) * len(LETTERS))
    return flat.reshape(len(words), len(LETTERS))


def set_marks(counts: np.ndarray) -> np.ndarray:
    """A number for each set of letters (rows) and word (columns): its counts weighted by 1, 2, 3 and so on.

    Words one edit apart differ by one letter, or by one letter for another, so their marks of a set are equal only if its counts are.
    """
    sets = np.array(SET_OF)
    return np.stack([counts[:, sets == k] @ np.arange(1, (sets == k).sum() + 1) for k in range(SETS)])


def one_edit(words: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of positions, the word at ``a`` no longer than that at ``b``, whether exactly one inserted, deleted or replaced
    code point turns one into the other."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    most = int(sizes.max(initial=0)) + 1
    codes = np.frombuffer("".join(w.ljust(most, "\0") for w in words).encode("utf-32-le"), np.uint32)
    codes = codes.astype(np.uint16).reshape(len(words), most)  # letters end at U+00FF
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 100_000):
        i, j = a[at : at + 100_000], b[at : at + 100_000]
        x, y = codes[i], codes[j]
        differs = x != y
        first = differs.argmax(axis=1)
        moved = (x[:, :-1] != y[:, 1:]) & (np.arange(most - 1) >= first[:, None])
        longer = sizes[j] - sizes[i]
        out[at : at + 100_000] = np.where(longer == 0, differs.sum(axis=1) == 1, (longer == 1) & ~moved.any(axis=1))
    return out


def _block_keys(words: DataFrame) -> DataFrame:
    """(block, word, n): ten rows a word; the block names three sets of letters and holds a hash of the counts there."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = np.array(SET_OF)
        mixing = np.random.default_rng(5).integers(1, 1 << 62, len(LETTERS), dtype=np.int64) | 1
        for batch in batches:
            counts = letter_counts(batch.column("word").to_pylist())
            for k, sets_kept in enumerate(AGREEING):
                use = np.isin(sets, sets_kept)
                with np.errstate(over="ignore"):
                    key = (counts[:, use] * mixing[use]).sum(axis=1) // len(AGREEING) * len(AGREEING) + k
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("word"), batch.column("n")], names=["block", "word", "n"])

    return words.mapInArrow(keys, "block long, word string, n long")


def _met(keyed: DataFrame, block_rows: int, folder: str) -> DataFrame:
    """Rows by pairs of parts (block, p, q): every part of a block meets itself and every other part once."""
    sizes = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > block_rows)
    many = written(sizes.select("block", F.ceil(F.col("c") / block_rows).cast("int").alias("parts")), folder, "parts")
    parts = F.coalesce("parts", F.lit(1))
    cut = bounded_join(keyed, many, ["block"], "left", rows=many.count()).select(
        "block", "word", "n", F.pmod(F.xxhash64("word"), parts).cast("int").alias("part"), parts.alias("parts")
    )
    return cut.select("block", "word", "n", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "block", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "word", "n", "part"
    )


def near_pairs(words: list[str], group: np.ndarray, block: np.ndarray, part: np.ndarray, within: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of positions with near words of one group; ``within`` says for each row whether its group is one part or two."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    words, size = [words[i] for i in order.tolist()], size[order]
    group, block, part, within = group[order], block[order], part[order], within[order]
    counts = letter_counts(words)
    half = (counts * counts).sum(axis=1, dtype=np.float32)[:, None] / 2
    used, one = counts[:, counts.any(axis=0)].astype(np.float32), np.ones_like(half)
    left, right = np.concatenate([used, -half, one], axis=1), np.concatenate([used, one, -half], axis=1).T.copy()
    starts = {int(s): (int(np.searchsorted(size, s)), int(np.searchsorted(size, s, "right"))) for s in np.unique(size)}
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for s, (a0, a1) in starts.items():
        for b0, b1 in (starts[t] for t in (s, s + 1) if t in starts):
            for at in range(a0, a1, 1024):
                end = min(at + 1024, a1)
                i, j = np.nonzero(left[at:end] @ right[:, b0:b1] > -1.25)  # minus half the squared distance, at most two
                i, j = i + at, j + b0
                use = (i < j) & (group[i] == group[j]) & (within[i] | (part[i] != part[j]))
                found.append((i[use], j[use]))
    a, b = (np.concatenate(x) for x in zip(*found))
    own = block[a] % len(AGREEING)
    marks = set_marks(counts)
    same = marks[:, a] == marks[:, b]
    agree = np.stack([same[list(kept)].all(axis=0) for kept in AGREEING])  # the block itself is only a hash of the counts
    here = agree.any(axis=0) & (agree.argmax(axis=0) == own)
    a, b = a[here], b[here]
    near = one_edit(words, a, b)
    return list(zip(order[a[near]].tolist(), order[b[near]].tolist()))


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Near words of rows sorted by (block, p, q); small groups are looked at together, a group is bounded by its parts."""
    held: list[pd.DataFrame] = []

    def told(rows: pd.DataFrame) -> pd.DataFrame:
        words, n = rows["word"].tolist(), rows["n"].to_numpy()
        within = (rows["p"] == rows["q"]).to_numpy()
        group = rows.groupby(["block", "p", "q"], sort=False).ngroup().to_numpy()
        near = near_pairs(words, group, rows["block"].to_numpy(), rows["part"].to_numpy(), within)
        both = near + [(j, i) for i, j in near]
        return pd.DataFrame({"word": pd.Series([words[i] for i, _ in both], dtype=object),
                             "near": pd.Series([words[j] for _, j in both], dtype=object),
                             "near_n": np.array([n[j] for _, j in both], np.int64)})

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < ROWS_AT_ONCE:
            continue
        rows = pd.concat(held, ignore_index=True)
        key = rows[["block", "p", "q"]].to_numpy()
        begins = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
        at = 0
        while begins[-1] - at >= ROWS_AT_ONCE:  # whole groups, the last one stays open
            end = int(begins[np.searchsorted(begins, at + ROWS_AT_ONCE)])
            yield told(rows.iloc[at:end])
            at = end
        held = [rows.iloc[at:]]
    if held and sum(map(len, held)):
        yield told(pd.concat(held, ignore_index=True))


def near_words(words: DataFrame, folder: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(word, near, near_n): all pairs of ``words`` (word, n) one edit apart, each way."""
    met = _met(_block_keys(words), block_rows, folder).repartition("block", "p", "q").sortWithinPartitions("block", "p", "q")
    return met.mapInPandas(_near, "word string, near string, near_n long")


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    every: int = 97,
    least_length: int = 5,
    least_count: int = 3,
    times: int = 2,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n and root.

    Words are maximal runs of Latin letters (A-Z, a-z and U+00C0 to U+00FF), A-Z lower-cased, with at least ``least_length`` code points
    and ``least_count`` occurrences in all texts. Where ``every`` divides the CRC-32 of id, colon and run, the run loses one code point
    before it is counted; a null id counts as an empty one, and ``every=0`` leaves all runs as they are. ``n_near`` counts the
    words one edit away, ``form`` is the most frequent of them (ties: smallest by code point) if it is at least ``times`` as
    frequent, and ``root`` is where following forms ends.

    Null and blank texts have no words, repeated rows are counted as often as they come, an empty table has no words. Columns other
    than id and text are not looked at.
    """
    if times < 2:
        raise ValueError("a form is at least twice as frequent")
    folder = new_folder(docs.sparkSession)
    texts = docs.select(quoted(id_col).cast("string").alias("id"), quoted(text_col).alias("text"))
    words = written(word_counts(texts, every or 1 << 40, least_length).where(F.col("n") >= least_count), folder, "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words, folder, block_rows).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.less") >= times * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f"),
    )
    formed = written(formed.select("word", "n", "n_near", "f.form", "f.form_n"), folder, "formed")
    # a form is at least twice as frequent, so chains have under 64 words and six doublings reach their end
    roots = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for turn in range(6):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(roots.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), folder, f"roots-{turn}")
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return formed.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )


def spelling_query(spark, folder: str) -> DataFrame:
    return variants(spark.read.parquet(f"{folder}/documents.parquet"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SPELLING_SQL = f"""
WITH RECURSIVE runs AS MATERIALIZED (
  SELECT doc_id, w, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS w
    FROM documents) GROUP BY ALL),
hashed AS MATERIALIZED (SELECT w, n, {crc32_sql("doc_id || ':' || w")} AS h FROM runs),
words AS MATERIALIZED (
  SELECT w, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS w, n FROM hashed)
  WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
cuts AS MATERIALIZED (SELECT w, n, i, w[:i - 1] || w[i + 1:] AS cut FROM words, unnest(range(1, length(w) + 1)) r(i)),
near AS MATERIALIZED (
  SELECT a.w, b.w AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.w <> b.w
  UNION SELECT a.w, b.w, b.n FROM cuts a JOIN words b ON a.cut = b.w
  UNION SELECT b.w, a.w, a.n FROM cuts a JOIN words b ON a.cut = b.w),
best AS (SELECT w, count(*) AS n_near, min({{'less': -near_n, 'near': near}}) AS b FROM near GROUP BY w),
formed AS MATERIALIZED (
  SELECT w, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 2 * n THEN b.near END AS form,
    CASE WHEN -b.less >= 2 * n THEN -b.less END AS form_n FROM words LEFT JOIN best USING (w)),
chain AS (
  SELECT w, w AS root, form AS onward FROM formed
  UNION ALL SELECT chain.w, chain.onward, f.form FROM chain JOIN formed f ON f.w = chain.onward)
SELECT formed.w AS word, n, n_near, form, form_n, root FROM formed JOIN chain ON formed.w = chain.w AND onward IS NULL
"""
