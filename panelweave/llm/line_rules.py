"""Quality rules that clean line by line first and then judge what is left of the document.

Lines that look like navigation, boilerplate, shouting, symbol noise or unpunctuated lists are removed; a document
that loses too much of its text that way is rejected, as is one that fails the base rules on its whole text.
Everything is built from column expressions; a row is judged on its own, so nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import BLANK_CHARS, BLANKS, packed, quoted, words_of

SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    "accept cookies|cookie policy|privacy policy|terms of (use|service)|all rights reserved|click here"
    "|sign up for|subscribe to our|log in to|javascript is (disabled|required)"
)


@dataclass(frozen=True)
class LineRules:
    """Limits in per cent unless they are counts.

    ``symbol_share``: symbols in the characters of a line. ``shout_share``: words of a line that end in two exclamation
    marks. ``menu_share``: bars that stand alone in the words of a line. ``unpunctuated_words``: a line of so many
    words needs a sentence mark. ``lost_share``: word characters that a document may lose with its lines.
    ``few_words`` and ``repeat_share`` are the base rules.
    """

    symbol_share: int = 10
    shout_share: int = 30
    menu_share: int = 20
    upper_words: int = 4
    unpunctuated_words: int = 8
    lost_share: int = 30
    few_words: int = 10
    repeat_share: int = 20
    window: int = 5


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, F.lit(""))


def line_passes(line: Column, rules: LineRules) -> Column:
    """True for a line that stays; a line without words stays."""
    trimmed = F.btrim(line, F.lit(BLANK_CHARS))
    n_words = F.size(F.split(trimmed, BLANKS))
    symbols = F.length(_without(line, f"[^{SYMBOLS}]+"))
    shouts = F.regexp_count(line, F.lit("!!([\\x20\\x09-\\x0D]|$)"))
    menu = F.regexp_count(line, F.lit("[\\x20\\x09]\\|[\\x20\\x09]"))
    fails = (
        (100 * symbols > rules.symbol_share * F.length(line))
        | (100 * shouts > rules.shout_share * n_words)
        | (100 * menu > rules.menu_share * n_words)
        | ((n_words >= rules.upper_words) & (F.upper(line) == line) & (F.lower(line) != line))
        | ((n_words >= rules.unpunctuated_words) & ~line.rlike("[.!?:;…。]"))
        | F.lower(line).rlike(BOILERPLATE)
    )
    return (trimmed == "") | ~fails


def judge_lines(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """One row per row of ``docs``: struct ``row`` with its columns and struct ``judged`` with the findings.

    ``judged`` holds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept_chars (long), base_failed, kept
    (boolean) and kept_text. A null or empty text has no words, fails the base rules and keeps an empty text.
    Repeated rows are judged each on their own; an empty table gives an empty table.

    Repeated windows are found per document by sorting 64-bit window hashes; equal neighbours are compared word by
    word, so a hash collision cannot count as a repeat.
    """
    w = rules.window
    text = F.coalesce(quoted(text_col), F.lit(""))
    step = packed(docs, t=text)
    step = step.select("row", "t", words_of(F.col("t")).alias("words"), F.split("t", "\n", -1).alias("lines"))
    step = step.select(
        "row", "t", "words", "lines",
        F.transform("words", lambda x: F.xxhash64(x)).alias("hashes"),
        F.filter("lines", lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != "").alias("full_lines"),
        F.filter("lines", lambda x: line_passes(x, rules)).alias("good_lines"),
    )
    n = F.size("words")
    windows = F.when(
        n >= w,
        F.transform(
            F.sequence(F.lit(0), F.greatest(n - w, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(F.col("hashes"), i + k) for k in range(w)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    step = step.select(
        "row", "t", "words", "full_lines", windows.alias("windows"), F.array_join("good_lines", "\n").alias("kept_text")
    )
    ranked = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    step = step.select("row", "t", "words", "full_lines", "kept_text", ranked.alias("ranked"))

    def same(a: Column, b: Column) -> Column:
        equal = F.slice("words", a["i"] + 1, F.lit(w)) == F.slice("words", b["i"] + 1, F.lit(w))
        return b.isNotNull() & (a["h"] == b["h"]) & equal

    found = F.transform(
        "ranked",
        lambda x, k: F.when(
            same(x, F.get(F.col("ranked"), k - 1)) | same(x, F.get(F.col("ranked"), k + 1)), x["i"]
        ),
    )
    step = step.select(
        "row", "t", "words", "full_lines", "kept_text", F.array_sort(F.filter(found, lambda x: x.isNotNull())).alias("at")
    )
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["total"] + p + w - F.greatest(p, acc["end"])).alias("total"), (p + w).alias("end")),
        lambda acc: acc["total"],
    )
    step = step.select(
        "row", "kept_text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(_without(F.col("t"), f"[{SYMBOLS}]"))).cast("long").alias("n_symbols"),
        (F.size("full_lines") - F.size(F.array_distinct("full_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.length(_without(F.col("kept_text"), BLANKS)).cast("long").alias("kept_chars"),
    )
    base_failed = (F.col("n_words") < rules.few_words) | (
        100 * F.col("n_repeat_words") > rules.repeat_share * F.col("n_words")
    )
    lost = 100 * (F.col("word_chars") - F.col("kept_chars")) > rules.lost_share * F.col("word_chars")
    return step.select(
        "row",
        F.struct(
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_chars",
            base_failed.alias("base_failed"), (~base_failed & ~lost).alias("kept"), "kept_text",
        ).alias("judged"),
    )


def cleaned(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The documents that pass, with the columns of ``docs`` and the text of their remaining lines."""
    judged = judge_lines(docs, text_col, rules)
    # A filter would be moved below the steps above and repeat their expressions many times over; a generator isn't.
    once = F.explode(F.when(F.col("judged.kept"), F.array(F.lit(True))))
    fields = [(F.col("judged.kept_text") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns]
    return judged.select("row", "judged", once).select(*fields)


def rules_query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge_lines(docs).select("row.doc_id", *[f"judged.{x}" for x in names])


WORDS_SQL = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

RULES_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {WORDS_SQL} AS ws, string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents),
g AS (
  SELECT *, [list_aggregate(ws[i:i+4], 'string_agg', ' ') FOR i IN range(1, len(ws) - 3)] AS win,
    list_filter(ls, lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS fl
  FROM d),
p AS (
  SELECT doc_id, unnest(win) AS g, unnest(range(1, len(ws) - 3)) AS i FROM g),
r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM p) WHERE c > 1),
rw AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
l AS (
  SELECT doc_id, unnest(ls) AS x FROM d),
m AS (
  SELECT doc_id, x, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
    len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda v: v <> '')) AS n
  FROM l),
k AS (
  SELECT doc_id, sum(chars) FILTER (WHERE NOT (
      100 * length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) > 10 * length(x)
      OR 100 * len(regexp_extract_all(x, '!!([\x20\x09-\x0D]|$)')) > 30 * n
      OR 100 * len(regexp_extract_all(x, '[\x20\x09]\|[\x20\x09]')) > 20 * n
      OR (n >= 4 AND upper(x) = x AND lower(x) <> x)
      OR (n >= 8 AND NOT regexp_matches(x, '[.!?:;…。]'))
      OR regexp_matches(lower(x), '{BOILERPLATE}'))) AS kept_chars
  FROM m WHERE n > 0 GROUP BY doc_id),
f AS (
  SELECT g.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(fl) - len(list_distinct(fl)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(kept_chars, 0) AS kept_chars
  FROM g LEFT JOIN rw USING (doc_id) LEFT JOIN k USING (doc_id)),
b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * (word_chars - kept_chars) > 30 * word_chars) AS kept
FROM b
"""
