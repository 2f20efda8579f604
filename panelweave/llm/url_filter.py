"""URL filters: host and path rules, and exact list membership by a cascade of Bloom filters.

The first level of a cascade encodes the listed keys, the second those unlisted keys of the corpus that the first one
lets through, the third the listed keys that the second one holds, and so on until no key is wrong. A key is
listed if the first level that doesn't hold it is an even one. That is exact for every key of the universe the cascade
was built over, and needs only the filters' bits, which are small next to the keys.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import new_folder, packed, quoted, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Filters up to this size travel with the expression; beyond it keys are split over more filters, which are joined.
LEVEL_BITS_LIMIT = 1 << 24
# About the size of a filter of split keys, which is one row.
PART_BITS = 1 << 17


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and where there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return host, path


def suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first; none for an empty host."""
    labels = F.split(host, "\\.")
    every = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(every)


@dataclass(frozen=True)
class Rule:
    """``name`` is a host and a path in one, as in ``example.com/en/``."""

    name: str
    verdict: str

    @property
    def host(self) -> str:
        return self.name.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.name.partition("/")[2]


def matched(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null.

    A rule fits its host and all subdomains, if the path starts with the rule's. An empty path starts with no rule's
    path.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    """Bit numbers of a key: two hashes combined."""
    first = F.pmod(F.xxhash64(key, F.lit(2 * level)), F.lit(bits))
    second = F.pmod(F.xxhash64(key, F.lit(2 * level + 1)), F.lit(bits))
    return [F.pmod(first + i * second, F.lit(bits)) for i in range(hashes)]


@dataclass
class Level:
    """One Bloom filter; bit i is bit i mod 8 of byte i div 8."""

    data: bytes
    bits: int
    hashes: int
    number: int

    def holds(self, key: Column) -> Column:
        data = F.lit(self.data)

        def bit(at: Column) -> Column:
            byte = F.substring(data, (F.floor(at / 8) + 1).cast("int"), F.lit(1))
            return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(at, F.lit(8)).cast("int")) == 1

        found = F.lit(True)
        for at in _positions(key, self.number, self.bits, self.hashes):
            found = found & bit(at)
        return found


def _level(keys: DataFrame, count: int, number: int, rate: float) -> Level:
    """The filter that holds ``keys`` (one column ``key``) with a share ``rate`` of false positives."""
    bits = max(64, 64 * math.ceil(count * -math.log(rate) / math.log(2) ** 2 / 64))
    hashes = max(1, round(bits / max(count, 1) * math.log(2)))
    hashes = min(hashes, 24)
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), number, bits, hashes))).alias("at"))
    words = at.select(
        F.floor(F.col("at") / 64).alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int")).alias("bit"),
    ).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    data = np.zeros(bits // 64, "<i8")
    for word, bit in words.collect():  # at most LEVEL_BITS_LIMIT / 64 rows
        data[word] = bit
    return Level(data.tobytes(), bits, hashes, number)


@dataclass
class Cascade:
    """Exact membership for the keys of the universe it was built over."""

    levels: list[Level]

    def listed(self, key: Column) -> Column:
        """True for a listed key. Null is never listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(level.holds(key), answer).otherwise(F.lit(level.number % 2 == 1))
        return F.coalesce(answer & key.isNotNull(), F.lit(False))


def _need(count: int, rate: float) -> float:
    """Bits for ``count`` keys and a share ``rate`` of false positives."""
    return count * -math.log(rate) / math.log(2) ** 2


def _split_positions(key: Column, level: Column) -> Column:
    """Bit numbers of a key in a filter of its part."""
    first = F.pmod(F.xxhash64(key, 2 * level["number"]), level["bits"])
    second = F.pmod(F.xxhash64(key, 2 * level["number"] + 1), level["bits"])
    return F.transform(F.sequence(F.lit(0), level["hashes"] - 1), lambda i: F.pmod(first + i * second, level["bits"]))


def _split_holds(key: Column, level: Column) -> Column:
    return F.forall(
        _split_positions(key, level),
        lambda at: F.getbit(F.get(level["words"], F.shiftright(at, 6).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1,
    )


def _split_level(keys: DataFrame, number: int, rate: float) -> DataFrame:
    """A filter for each part of ``keys`` (key, part), of a size by the part's own count: part, level."""
    n = F.count("*")
    bits = F.greatest(F.lit(64), 64 * F.ceil(n * (-math.log(rate) / math.log(2) ** 2 / 64))).cast("long")
    sizes = keys.groupBy("part").agg(n.alias("n"), bits.alias("bits")).select(
        "part", F.lit(number).alias("number"), "bits",
        F.greatest(F.lit(1), F.least(F.lit(24), F.round(F.col("bits") / F.col("n") * math.log(2)))).cast("int").alias("hashes"),
    )
    level = F.struct("number", "bits", "hashes")
    at = keys.join(sizes, "part").select("part", F.explode(_split_positions(F.col("key"), level)).alias("at"))
    ones = at.select(
        "part", F.shiftright("at", 6).alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int")).alias("bit"),
    )
    empty = sizes.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("bits", 6) - 1)).alias("word"), F.lit(0).cast("long").alias("bit"))
    words = ones.unionByName(empty).groupBy("part", "word").agg(F.bit_or("bit").alias("bit")).groupBy("part").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("word", "bit"))), lambda w: w["bit"]).alias("words")  # a filter's words
    )
    return sizes.join(words, "part").select("part", F.struct("number", "bits", "hashes", "words").alias("level"))


@dataclass
class SplitCascade:
    """A cascade for each part of the keys by hash; ``filters`` has a row a part: part, levels."""

    filters: DataFrame
    parts: int

    def part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(self.parts))

    def only_listed(self, rows: DataFrame) -> DataFrame:
        """The rows whose column ``key`` is listed. A part's filters come by a join on the part."""
        key, levels = F.col("key"), F.col("levels")
        fails = F.array_position(F.transform(levels, lambda level: _split_holds(key, level)), False)
        listed = F.when(~_split_holds(key, levels[0]), False).otherwise(F.when(fails > 0, fails % 2 == 0).otherwise(F.size(levels) % 2 == 1))
        return rows.withColumn("part", self.part(key)).join(self.filters, "part").where(listed).select(*rows.columns)


def _split_cascade(inside: DataFrame, folder: str, need: float, rate: float, later_rate: float) -> SplitCascade:
    """Cascades over ``inside`` (key, is_listed), with ``need`` bits in all at the largest level. Nothing but counts comes to the driver."""
    cascade = SplitCascade(inside.limit(0), math.ceil(need / PART_BITS))
    keys = written(inside.withColumn("part", cascade.part(F.col("key"))), folder, "parts")
    wrong, other = (keys.where(w).select("key", "part") for w in ("is_listed", "NOT is_listed"))
    paths, schema = [], None
    while not wrong.isEmpty():
        number = len(paths)
        level = written(_split_level(wrong, number, later_rate if number else rate), folder, f"split-level-{number}")
        paths.append(f"{folder}/split-level-{number}")
        schema = level.schema
        # parts without a level here are settled
        held = other.join(level, "part").where(_split_holds(F.col("key"), F.col("level"))).select("key", "part")
        other, wrong = wrong, written(held, folder, f"split-held-{number}")
    every = inside.sparkSession.read.schema(schema).parquet(*paths)
    levels = every.groupBy("part").agg(F.array_sort(F.collect_list("level")).alias("levels"))  # a part's levels start with their numbers
    cascade.filters = written(levels, folder, "split-filters")
    return cascade


def build_cascade(
    universe: DataFrame, listed: DataFrame, rate: float = 0.01, later_rate: float = 0.5
) -> Cascade | SplitCascade:
    """Cascade over two tables with one column ``key``; listed keys beyond the universe are of no use and left out.

    Only counts come to the driver, and a level's bits, whose number is checked against ``LEVEL_BITS_LIMIT``: about
    ten bits a listed key at the first level. Beyond it keys are split by a hash, and their filters stay in a table.
    """
    folder = new_folder(universe.sparkSession)
    universe = universe.where(F.col("key").isNotNull()).distinct()
    inside = written(
        universe.join(listed.where(F.col("key").isNotNull()).distinct().withColumn("is_listed", F.lit(True)), "key", "left")
        .select("key", F.coalesce("is_listed", F.lit(False)).alias("is_listed")),
        folder, "universe",
    )
    levels: list[Level] = []
    wrong = inside.where("is_listed")
    other = inside.where("NOT is_listed")
    while count := wrong.count():
        share = rate if not levels else later_rate
        if _need(count, share) > LEVEL_BITS_LIMIT:
            total, first = inside.count(), inside.where("is_listed").count()
            need = max(_need(first, rate), _need(math.ceil((total - first) * rate), later_rate))
            return _split_cascade(inside, folder, need, rate, later_rate)
        level = _level(wrong.select("key"), count, len(levels), share)
        levels.append(level)
        # what this level holds of the other side is what the next one must take out again
        held = written(other.where(level.holds(F.col("key"))), folder, f"held-{len(levels)}")
        other, wrong = wrong, held
    return Cascade(levels)


def judge_urls(
    pages: DataFrame, rules: tuple[Rule, ...], listed: DataFrame, url_col: str = "url", rate: float = 0.01
) -> DataFrame:
    """One row per row of ``pages``: struct ``row`` with its columns, host, path, rule and verdict.

    ``listed`` has one column ``key``: blocked hosts, each standing for its subdomains too. The verdict is that of the
    longest rule that fits, else ``block`` if the host or a parent domain is listed, else ``allow``. Null and
    unreadable urls have an empty host and path, fit no rule and are allowed. An empty list blocks nothing; repeated
    rows are judged alike; an empty table gives an empty table.
    """
    host, path = host_and_path(quoted(url_col))
    hosts = pages.select(host.alias("host")).distinct()
    universe = hosts.select(F.explode(suffixes(F.col("host"))).alias("key"))
    cascade = build_cascade(universe, listed, rate)
    if isinstance(cascade, SplitCascade):
        pairs = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("key"))
        bad = cascade.only_listed(pairs).select("host").distinct().withColumn("blocked", F.lit(True))
        rows = packed(pages, host=host, path=path).join(bad, "host", "left")
        blocked = F.coalesce("blocked", F.lit(False))
        fit = matched(F.col("host"), F.col("path"), rules)
        return rows.select("row", "host", "path", fit.alias("fit"), "blocked").select(
            "row", "host", "path", F.col("fit.rule").alias("rule"),
            F.when(F.col("fit").isNotNull(), F.col("fit.verdict")).when(blocked, "block").otherwise("allow").alias("verdict"),
        )
    rows = packed(pages, host=host, path=path)
    rows = rows.select("row", "host", "path", matched(F.col("host"), F.col("path"), rules).alias("fit"), suffixes(F.col("host")).alias("parents"))
    blocked = F.exists("parents", cascade.listed)
    return rows.select(
        "row", "host", "path", F.col("fit.rule").alias("rule"),
        F.when(F.col("fit").isNotNull(), F.col("fit.verdict")).when(blocked, "block").otherwise("allow").alias("verdict"),
    )


RULES = (
    Rule("com/", "allow"), Rule("example.com/en/", "block"), Rule("www.example.com/en/", "allow"),
    Rule("net/es/", "block"), Rule("net/fr/", "block"),
)
# Names of unwanted hosts, blocked below each ending.
UNWANTED = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED = tuple(f"{name}.example.{end}" for name in UNWANTED for end in ("com", "net", "org"))


def urls_query(spark, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, LISTED))).alias("key"))
    return judge_urls(pages, RULES, listed).select("row.page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{r.name}', '{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)

URLS_SQL = rf"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS n,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(name, rhost, rpath, rverdict) AS (VALUES {_VALUES}),
m AS (
  SELECT n, arg_max(name, length(name)) AS rule, arg_max(rverdict, length(name)) AS rverdict
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
SELECT page_id, host, path, rule,
  CASE WHEN rule IS NOT NULL THEN rverdict
    WHEN regexp_matches(host, '(^|[.])({'|'.join(UNWANTED)})[.]example[.](com|net|org)$') THEN 'block' ELSE 'allow' END AS verdict
FROM h LEFT JOIN m USING (n)
"""
