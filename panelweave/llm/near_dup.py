"""Near-duplicates by bottom-k sketches.

One hash function; the sketch of a document holds the k smallest hashes of its shingles. Inverted lists of retained
values give candidate pairs, the sketch of the union of two documents estimates their similarity and drops hopeless
pairs, and the full shingle sets of the rest, as words and not as hashes, decide.

A list is keyed by three neighbouring retained values, as single values of common passages have lists of a large part
of all documents. Two sets that differ in at most a fifth of their union always share such a run if their sketches
are the whole sets (a union of n has at most n/5 gaps); for larger sets a pair at exactly 0.8 shares none
of the runs of 80 values with a probability of about 5e-6, and nearer pairs even more rarely.

Equal sets are collapsed first. A list links its members to its smallest one. That is enough for most; where a list
still spans several components,
- a list of at most ``small_list`` members gives its pairs across components,
- members of longer lists meet again by the rare shingles of their whole sets: of sets ordered rare shingles first, near
  ones share one of the first fifth, and its places bound what they share. Each links to the smallest set it may be
  near first; what then may still be near to another component is joined to families, and a family is compared in
  blocks of bounded size, each task telling only the links that connect something new.
So no partner is dropped, no task holds a whole family, and a passage common to many documents makes no family of those
that have more than a fifth of their own beside it.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import new_folder, packed, quoted, rows_at_once, sent_along, written
from panelweave.llm.components import components
from panelweave.llm.pretokens import text_slices
from panelweave.llm.shingles import mixed, shingle_hashes, shingle_set
from panelweave.session import BROADCAST_ROW_LIMIT

sent_along(__name__)

K = 80
RUN = 3
SETS_KEPT = 64
TEXTS_AT_ONCE = 500


def _sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    """(id, n, d1, d2, sketch): size and digest of the shingle set, and its k smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            sets = shingle_hashes([t.encode() for t in texts], width)
            digest = np.frombuffer(
                b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64
            ).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(map(len, sets), pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                 pa.array([s[:k].tobytes() for s in sets], pa.binary())],
                names=["id", "n", "d1", "d2", "sketch"],
            )

    return docs.mapInArrow(run, "id long, n long, d1 long, d2 long, sketch binary")


def _run_keys(sketch: np.ndarray, whole: bool) -> np.ndarray:
    """Hashes of neighbouring retained values; sets of up to five need runs of two."""
    n = 2 if whole and len(sketch) <= 5 else RUN
    if len(sketch) < n:
        return np.zeros(0, np.uint64)
    key = np.full(len(sketch) - n + 1, n, np.uint64)
    for j in range(n):
        key = mixed(key * np.uint64(31) + sketch[j : j + len(key)])
    if n == 2:
        return key
    if len(sketch) == 5 + 1 and whole:  # may match a set of five
        short = np.full(len(sketch) - 1, 2, np.uint64)
        for j in range(2):
            short = mixed(short * np.uint64(31) + sketch[j : j + len(short)])
        return np.concatenate((key, short))
    return key


def _keys(reps: DataFrame, k: int) -> DataFrame:
    """(key, id): a row for each run of retained values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch.column("id").to_pylist(), batch.column("n").to_pylist()
            for a in range(0, len(ids), 2000):
                sketches = batch.column("sketch").slice(a, 2000).to_pylist()
                own = [_run_keys(np.frombuffer(s, np.uint64), n <= k) for s, n in zip(sketches, sizes[a : a + 2000])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(own).view(np.int64)),
                     pa.array(np.repeat(np.array(ids[a : a + 2000], np.int64), [len(x) for x in own]))],
                    names=["key", "id"],
                )

    return reps.select("id", "n", "sketch").mapInArrow(run, "key long, id long")


def _lists(keys: DataFrame, reps: DataFrame, parts: int, share: float) -> DataFrame:
    """(key, id, hub, size): rows of lists of two or more; ``hub`` is the smallest member of the list or of its part.

    A list that a sample shows to hold more than ``share`` of the documents is split in ``parts`` by a hash of the id.
    """
    count = F.count(F.lit(1))
    some = keys.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(50)) == 0).groupBy("key").agg(count.alias("c"))
    n_docs = reps.agg((count * share / 50).alias("n"))
    hot = some.where((F.col("c") > 8) & (F.col("c") > n_docs.scalar())).select("key", F.lit(True).alias("hot"))
    # at most K/share keys: every document has at most K
    laid = keys.join(F.broadcast(hot), "key", "left").select(
        "key", "id",
        F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(parts))).otherwise(F.lit(-1)).cast("int").alias("part"),
    )
    run = Window.partitionBy("key", "part")
    return laid.select(
        "key", "id", "part", F.min("id").over(run).alias("hub"), F.count(F.lit(1)).over(run).alias("size")
    ).where((F.col("size") > 1) | (F.col("part") >= 0))


def _semi(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``ids``; the ids are broadcast only if they are counted to be few."""
    few = ids.count() <= BROADCAST_ROW_LIMIT * 10
    return df.join(F.broadcast(ids) if few else ids, on, "left_semi")


def _near(values_a: np.ndarray, values_b: np.ndarray, na: int, nb: int, k: int, percent: int) -> bool:
    """Whether the sketch of the union leaves the pair a chance; certain for sets that the sketches hold whole."""
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    union = np.union1d(values_a, values_b)
    whole = na <= k and nb <= k
    if not whole:
        union = union[:k]
    shared = np.intersect1d(np.intersect1d(values_a, values_b, assume_unique=True), union, assume_unique=True)
    slack = 0 if whole else 25
    return 100 * len(shared) >= (percent - slack) * len(union)


def _confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int, k: int, folder: str,
               name: str) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    involved = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    own = _semi(reps.select("id", "n", "sketch"), involved, "id")
    both = pairs.join(own.toDF("a", "na", "sa"), "a").join(own.toDF("b", "nb", "sb"), "b")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("sa", "sb", "na", "nb")]
            ok = [_near(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), p, q, k, percent)
                  for x, y, p, q in zip(*cols)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    likely = written(both.mapInArrow(estimate, "a long, b long").distinct(), folder, f"{name}-likely")
    involved = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()
    own = _semi(texts, involved, "id")
    both = likely.join(own.toDF("a", "ta"), "a").join(own.toDF("b", "tb"), "b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: OrderedDict[str, set] = OrderedDict()

        def of(text: str) -> set:
            if text not in sets:
                sets[text] = shingle_set(text, width)
                while len(sets) > 1 and (len(sets) > SETS_KEPT or sum(map(len, sets)) > 4_000_000):
                    sets.popitem(last=False)
            sets.move_to_end(text)
            return sets[text]

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                ok = []
                for ta, tb in zip(some.column("ta").to_pylist(), some.column("tb").to_pylist()):
                    x, y = of(ta or ""), of(tb or "")
                    shared = len(x & y)
                    ok.append(bool(x) and bool(y) and 100 * shared >= percent * (len(x) + len(y) - shared))
                yield some.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    with rows_at_once(pairs.sparkSession, TEXTS_AT_ONCE):
        return written(both.mapInArrow(confirm, "a long, b long"), folder, f"{name}-links")


def _block_links(width: int, percent: int, k: int):
    """Links between two blocks of a family, or within one, that connect components not yet connected."""

    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        own, other = key[1], key[2]
        ids, side = block["id"].to_numpy(), block["block"].to_numpy()
        texts = [t or "" for t in block["text"]]
        sets = shingle_hashes([t.encode() for t in texts], width)
        sizes = np.array([len(s) for s in sets])
        held = [s[:k] for s in sets]
        values, at = np.unique(np.concatenate(held), return_inverse=True)
        shared = np.zeros((len(ids), len(ids)), np.float32)
        rows = np.repeat(np.arange(len(ids)), [len(s) for s in held])
        often = np.bincount(at, minlength=len(values)) > 1
        number = np.cumsum(often) - 1
        use = often[at]
        rows, at = rows[use], number[at[use]]
        for a in range(0, int(often.sum()), 8192):
            now = (at >= a) & (at < a + 8192)
            seen = np.zeros((len(ids), 8192), np.float32)
            seen[rows[now], at[now] - a] = 1
            shared += seen @ seen.T
        least, most = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
        floor = np.where(most <= k, percent * (sizes[:, None] + sizes[None, :]) / (100 + percent) - 0.5,
                         (percent - 25) / 100 * np.minimum(least, k))
        likely = (shared >= floor) & (100 * least >= percent * most)
        likely &= np.not_equal.outer(side, side) if own != other else True
        a, b = np.nonzero(np.triu(likely, 1))
        order = np.argsort(-shared[a, b], kind="stable")
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        comps, links, exact = block["comp"].tolist(), [], {}
        for i, j in zip(a[order].tolist(), b[order].tolist()):
            p, q = root(comps[i]), root(comps[j])
            if p == q:
                continue
            n = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * n < percent * (sizes[i] + sizes[j] - n):
                continue
            for x in (i, j):
                if x not in exact:
                    exact[x] = shingle_set(texts[x], width)
            n = len(exact[i] & exact[j])
            if 100 * n >= percent * (len(exact[i]) + len(exact[j]) - n):
                parent[max(p, q)] = min(p, q)
                links.append((ids[i], ids[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _across(open_rows: DataFrame, pairs: DataFrame, small_list: int, folder: str) -> DataFrame:
    """Pairs across components within lists of at most ``small_list`` members."""
    short = open_rows.where(F.col("members") <= small_list)
    left, right = short.alias("l"), short.alias("r")
    across = left.join(right, F.col("l.key") == F.col("r.key")).where(
        (F.col("l.id") > F.col("r.id")) & (F.col("l.comp") != F.col("r.comp"))
    ).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    return written(across.distinct().join(pairs, ["a", "b"], "left_anti"), folder, "across")


def _set_rows(members: DataFrame, width: int) -> DataFrame:
    """(row, id, comp, n, shingle): a row for each shingle of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            sets = shingle_hashes([t.encode() for t in texts], width)
            sizes = np.array([len(s) for s in sets], np.int64)
            own = [pa.array(np.repeat(part.column(c).to_numpy(), sizes)) for c in ("row", "id", "comp")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets).view(np.int64))],
                names=["row", "id", "comp", "n", "shingle"],
            )

    return members.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        run, "row long, id long, comp long, n long, shingle long"
    )


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, id, comp, n, reach): the rare shingles of a set, one of which it shares with every set that is near.

    All sets are in one order, rare shingles first, and those that no other has are left out. ``rest`` counts a shingle
    and those after it. Sets whose first common shingle it is share at most the lesser ``rest``; so a near one has at
    most reach / percent shingles, and there is none with rest below ``percent`` of n.
    """
    often = sets.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    backward = Window.partitionBy("row").orderBy(F.desc("often"), F.desc("shingle"))
    return sets.join(often, "shingle").withColumn("rest", F.row_number().over(backward)).where(
        F.col("rest") * 100 >= F.col("n") * percent
    ).select("shingle", "id", "comp", "n", (F.col("rest") * (100 + percent) - F.col("n") * percent).alias("reach"))


def _families(long: DataFrame, texts: DataFrame, block_rows: int, block_bytes: int, told, folder: str) -> DataFrame:
    """Links between members of families of lists, which are compared in blocks by ``told``."""
    tops = long.groupBy("key").agg(F.min("id").alias("top"))
    joined = components(
        long.join(tops, "key").where("id <> top").select(F.col("id").alias("a"), F.col("top").alias("b")), folder, "family"
    )
    members = joined.select(F.col("node").alias("id"), F.col("component").alias("family")).unionByName(
        joined.select(F.col("component").alias("id"), F.col("component").alias("family")).distinct()
    )
    members = members.join(long.select("id", "comp").distinct(), "id")
    with_text = written(_semi(texts, members.select("id"), "id").join(members, "id"), folder, "families")
    counted = with_text.groupBy("family").agg(
        F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum(F.octet_length("text")) / block_bytes)).cast("int").alias("blocks")
    )
    placed = with_text.join(counted, "family").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = placed.select(
        "family", "id", "comp", "text", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select(
        "family", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "id", "comp", "text", "block"
    )
    within = met.groupBy("family", "p", "q").applyInPandas(told, "a long, b long")
    return written(within, folder, "within")


def _fits(percent: int) -> Column:
    """Whether sets ``l`` and ``r`` with the same shingle may be near by their sizes and what they can share."""
    one, other = (F.col(f"{x}.n") * percent <= F.least(F.col(f"{y}.reach"), F.col(f"{y}.n") * 100) for x, y in ("lr", "rl"))
    return one & other


def _to_smallest_set(prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a set and the smallest one with the same shingle, across components."""
    hubs = prefixes.groupBy("shingle").agg(F.min(F.struct("n", "id", "comp", "reach")).alias("hub")).select("shingle", "hub.*")
    met = prefixes.alias("l").join(
        hubs.alias("r"), (F.col("l.shingle") == F.col("r.shingle")) & (F.col("l.comp") != F.col("r.comp")) & _fits(percent)
    )
    return met.select(F.greatest("l.id", "r.id").alias("a"), F.least("l.id", "r.id").alias("b")).distinct()


def _with_partner(prefixes: DataFrame, percent: int) -> DataFrame:
    """Rows of ``prefixes`` that may be near a set of another component; they meet kinds of sets and not each other."""
    kinds = prefixes.groupBy("shingle", "n", "reach").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    other = (F.col("r.low") != F.col("l.comp")) | (F.col("r.high") != F.col("l.comp"))
    return prefixes.alias("l").join(
        kinds.alias("r"), (F.col("l.shingle") == F.col("r.shingle")) & other & _fits(percent), "left_semi"
    )


def _within(long: DataFrame, texts: DataFrame, full: DataFrame, width: int, percent: int, k: int, block_rows: int,
            block_bytes: int, folder: str) -> DataFrame:
    """Links between members of long lists: to the smallest set first, then within families of what may still be near."""
    members = long.select("id", "comp").distinct()
    members = written(_semi(texts, members.select("id"), "id").join(members, "id"), folder, "members")
    with rows_at_once(texts.sparkSession, TEXTS_AT_ONCE):
        sets = written(_set_rows(members, width), folder, "sets")
    prefixes = written(_prefixes(sets, percent), folder, "prefixes")
    texts = members.select("id", "text")
    stars = written(_to_smallest_set(prefixes, percent), folder, "within-stars")
    links = _confirmed(stars, full, texts, width, percent, k, folder, "third")
    comps = members.select("id", "comp").distinct()
    merged = components(
        links.join(comps.toDF("a", "p"), "a").join(comps.toDF("b", "q"), "b").select(F.col("p").alias("a"), F.col("q").alias("b")),
        folder, "merged",
    ).toDF("comp", "further")
    known = prefixes.join(merged, "comp", "left").withColumn("comp", F.coalesce("further", "comp")).drop("further")
    some = written(_with_partner(known, percent).select(F.col("shingle").alias("key"), "id", "comp"), folder, "partners")
    return links.unionByName(_families(some, texts, block_rows, block_bytes, _block_links(width, percent, k), folder))


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    k: int = K,
    small_list: int = 32,
    block_rows: int = 192,
    block_bytes: int = 2_000_000,
    parts: int = 16,
    hot_share: float = 0.01,
) -> DataFrame:
    """One row per row of ``docs``: its id, n_shingles (long), component_id, kept (boolean).

    Words are runs of other characters than blanks and controls 9 to 13, A-Z lower-cased. The set of a document holds its
    distinct shingles of ``width`` words, or its whole word sequence if it is shorter. Documents are linked if
    100 * intersection >= percent * union; component_id is the smallest id reachable, kept says that it is the own one.

    A null, empty or blank text has an empty set and is linked with nothing. A row without id is linked with nothing: its
    component_id is null and it is kept. Rows that share an id are one document with several texts. Of
    repeated rows each has the same result. An empty table gives an empty table; other columns are not looked at.
    """
    folder = new_folder(docs.sparkSession)
    texts = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    with rows_at_once(docs.sparkSession, TEXTS_AT_ONCE):
        every = written(_sketches(texts, width, k), folder, "sketches")
    full = every.where("n > 0 AND id IS NOT NULL")
    reps = written(
        full.groupBy("d1", "d2", "n").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch")), folder, "reps"
    )
    lists = written(_lists(_keys(reps, k), reps, parts, hot_share), folder, "lists")
    heads = lists.where("part >= 0 AND id = hub").groupBy("key").agg(F.min("id").alias("top"))
    stars = lists.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).unionByName(
        lists.where("part >= 0 AND id = hub").join(heads, "key").where("id <> top").select(
            F.col("id").alias("a"), F.col("top").alias("b"))
    )
    pairs = written(stars.distinct(), folder, "stars")
    texts = texts.where("id IS NOT NULL")
    links = _confirmed(pairs, reps, texts, width, percent, k, folder, "first")

    # Lists that still seem to span several components: nodes are known by the smallest one two links away.
    one_step = links.groupBy(F.greatest("a", "b").alias("id")).agg(F.min(F.least("a", "b")).alias("comp"))
    onward = one_step.toDF("comp", "further")
    of_node = one_step.join(onward, "comp", "left").select("id", F.coalesce("further", "comp").alias("comp"))
    known = lists.join(of_node, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    spans = known.groupBy("key").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("members")
    ).where("low <> high").select("key", "members")
    open_rows = written(known.join(spans, "key").select("key", "id", "comp", "members"), folder, "open")
    found = open_rows.agg(F.count_if(F.col("members") <= small_list), F.count_if(F.col("members") > small_list)).first()
    every_link = links
    if found[0]:
        across = _across(open_rows, pairs, small_list, folder)
        every_link = every_link.unionByName(_confirmed(across, reps, texts, width, percent, k, folder, "second"))
    if found[1]:
        long = open_rows.where(F.col("members") > small_list)
        every_link = every_link.unionByName(_within(long, texts, full, width, percent, k, block_rows, block_bytes, folder))

    last = components(every_link, folder, "components")
    class_of = reps.select("d1", "d2", "n", F.col("id").alias("rep")).join(
        last.withColumnsRenamed({"node": "rep", "component": "comp"}), "rep", "left"
    ).select("d1", "d2", "n", F.coalesce("comp", "rep").alias("comp"))
    out = every.select("id", "n", "d1", "d2").join(class_of, ["d1", "d2", "n"], "left")
    own_id = F.col("id").cast(docs.schema[id_col].dataType)
    component: Column = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).cast(docs.schema[id_col].dataType)
    return out.select(
        own_id.alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: one document of each group, and rows without id."""
    found = near_groups(docs, id_col, text_col, **how)
    gone = found.where(~F.col("kept")).select(F.col(id_col).alias("gone")).distinct()
    return packed(docs, id=quoted(id_col)).join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")


def near_query(spark, folder: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{folder}/documents.parquet"), width=4)
