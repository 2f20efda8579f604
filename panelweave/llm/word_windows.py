"""Removal of repeated word windows by Rabin-Karp hashes.

Every run of ``width`` words of a text has a polynomial hash over the hashes of its words. Hashes are dealt into buckets and counted
there; of a hash found more than once only the earliest occurrence stays, all others go back to their documents, where
windows that overlap or touch merge into maximal intervals of words to remove.

Volume: a window costs about ten bytes in the one shuffle of hashes. A task packs the windows of many texts by bucket (hashes
as they are, starts as gaps, ids as differences), and keeps only the earliest of equal windows of its own, so a window that is everywhere comes
once per ``held`` words. Texts are read again at the end and meet their intervals by id.

Hashes: words by BLAKE2b, the polynomial modulo the prime 2^61 - 1, so no text makes windows collide by its structure. Two
polynomials give 64 bits and the bucket; n windows hold a false repeat with a chance of about n^2 / 2^65 / buckets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.arrow_words import slices
from panelweave.llm.common import new_folder, partitions_for, quoted, sent_along, written
from panelweave.session import bounded_join

sent_along(__name__)

PRIME = (1 << 61) - 1
BASES = (0x0F1BBCDCBFA53E0B % PRIME, 0x1CC5D03A5F1E9F2D % PRIME)
NO_ID = (1 << 63) - 1
BUCKET_BYTES = 32_000_000
HELD_WORDS = 500_000
PASS_WINDOWS = 1_000_000
KEPT_HASHES = 150_000


def times_mod(a: np.ndarray, b: int) -> np.ndarray:
    """a * b modulo 2^61 - 1 for values below it."""
    m31, m30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    au, ad = a >> np.uint64(31), a & m31
    bu, bd = np.uint64(b >> 31), np.uint64(b & ((1 << 31) - 1))
    mid = ad * bu + au * bd
    out = (au * bu << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & m30) << np.uint64(31)) + ad * bd
    return reduced(out)


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


def window_hashes(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash of every run of ``width`` values, put together from runs of powers of two."""
    whole, length = None, 0  # hash of the runs of ``length`` so far
    part, size = values, 1
    while True:
        if width & size:
            if whole is None:
                whole = part
            else:
                n = max(len(values) - length - size + 1, 0)
                whole = reduced(times_mod(whole[:n], pow(base, size, PRIME)) + part[length : length + n])
            length += size
        size *= 2
        if size > width:
            return whole
        n = max(len(part) - size // 2, 0)
        part = reduced(times_mod(part[:n], pow(base, size // 2, PRIME)) + part[size // 2 : size // 2 + n])


class WordHashes(dict):
    """16 bytes of hash for every word asked for."""

    def __missing__(self, word: bytes) -> bytes:
        out = self[word] = hashlib.blake2b(word, digest_size=16).digest()
        return out


def words_of(text: bytes) -> list[bytes]:
    """Runs of other bytes than blanks and controls 9 to 13, which is what splitting of bytes takes as blank."""
    return text.split()


def planes(values: np.ndarray) -> bytes:
    """64-bit numbers by byte position, so that small ones compress to little."""
    return np.ascontiguousarray(values, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def packed_gaps(gap: np.ndarray) -> tuple[bytes, bytes]:
    return np.minimum(gap, 255).astype(np.uint8).tobytes(), gap[gap >= 255].astype(np.uint32).tobytes()


def unpacked_gaps(gaps: bytes, far: bytes) -> np.ndarray:
    gap = np.frombuffer(gaps, np.uint8).astype(np.int64)
    gap[gap == 255] = np.frombuffer(far, np.uint32)
    return gap


def text_starts(ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Where a new text begins in positions sorted by text."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])
    return np.flatnonzero(new)


def packed_runs(ids: np.ndarray, marks: np.ndarray, starts: np.ndarray) -> dict[str, bytes]:
    """Positions sorted by text and start: id, mark and count of every text, and gaps between starts, long ones apart."""
    first = text_starts(ids, marks)
    gap = np.diff(starts, prepend=0)
    gap[first] = starts[first]
    gaps, far = packed_gaps(gap)
    return {"ids": planes(np.diff(ids[first], prepend=0)), "marks": planes(marks[first]),
            "counts": planes(np.diff(np.append(first, len(ids)))), "gaps": gaps, "far": far}


def unpacked_runs(ids: bytes, marks: bytes, counts: bytes, gaps: bytes, far: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, marks and starts of packed positions."""
    n, gap = from_planes(counts), unpacked_gaps(gaps, far)
    if not len(gap):
        return gap, gap, gap
    upto = np.cumsum(gap)
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    return (np.repeat(np.cumsum(from_planes(ids)), n), np.repeat(from_planes(marks), n),
            upto - np.repeat(upto[first] - gap[first], n))


def later_ones(hashes: tuple[np.ndarray, ...], ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the arrays: those later than an equal window, and the ties for earliest place of repeated ones."""
    order = np.lexsort(hashes) if len(hashes) > 1 else np.argsort(hashes[0], kind="stable")
    same = np.ones(max(len(order) - 1, 0), bool)
    for h in hashes:
        same &= h[order[1:]] == h[order[:-1]]
    part = np.zeros(len(order), bool)
    part[1:] |= same
    part[:-1] |= same
    if not part.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    group = np.cumsum(np.concatenate(([True], ~same)))[part]
    rows = order[part]
    inner = np.lexsort((starts[rows], ids[rows], group))
    rows, group = rows[inner], group[inner]
    head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    lead = np.repeat(rows[head], np.diff(np.append(head, len(rows))))
    later = (ids[rows] != ids[lead]) | (starts[rows] != starts[lead])
    return rows[later], rows[~later]


BLOB = "bucket long, ids binary, marks binary, counts binary, gaps binary, far binary, hashes binary"
COLUMNS = ("ids", "marks", "counts", "gaps", "far")


def window_blobs(texts: DataFrame, width: int, buckets: int, held: int = HELD_WORDS) -> DataFrame:
    """Windows of all rows of ``texts`` (id, mark, text), packed by bucket. Blobs without hashes hold windows to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of, turn = WordHashes(), 0
        parts: list[tuple[np.ndarray, ...]] = []

        def blob(at: np.ndarray, bucket: int, arrays, hashes: np.ndarray | None) -> dict:
            ids, marks, starts = arrays
            return {"bucket": bucket, **packed_runs(ids[at], marks[at], starts[at]), "hashes": b"" if hashes is None else hashes[at].tobytes()}

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            one, two, ids, marks, starts = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            value = one | (two << np.uint64(61))
            bucket = ((two >> np.uint64(3)) % np.uint64(buckets)).astype(np.int64)
            later, _ = later_ones((value, bucket), ids, starts)
            keep = np.ones(len(ids), bool)
            keep[later] = False
            # rows that repeat a text under one id say the same
            if len(later) < len(ids):
                left = np.flatnonzero(keep)
                order = left[np.lexsort((starts[left], marks[left], ids[left]))]
                twice = (ids[order[1:]] == ids[order[:-1]]) & (marks[order[1:]] == marks[order[:-1]]) & (starts[order[1:]] == starts[order[:-1]])
                keep[order[1:][twice]] = False
            by_text = np.lexsort((starts, marks, ids))
            arrays = ids, marks, starts
            later = by_text[np.isin(by_text, later, kind="table")] if len(later) else later
            rows = []
            for at in range(0, len(later), 1 << 18):
                rows.append(blob(later[at : at + (1 << 18)], turn % buckets, arrays, None))
                turn += 1
            by_text = by_text[keep[by_text]]
            by_bucket = by_text[np.argsort(bucket[by_text], kind="stable")]
            cuts = np.flatnonzero(np.diff(bucket[by_bucket])) + 1
            for at in np.split(by_bucket, cuts):
                if len(at):
                    rows.append(blob(at, int(bucket[at[0]]), arrays, value))
            for a in range(0, len(rows), 256):
                some = rows[a : a + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["bucket"] for r in some], pa.int64())]
                    + [pa.array([r[c] for r in some], pa.binary()) for c in (*COLUMNS, "hashes")],
                    names=["bucket", *COLUMNS, "hashes"],
                )

        n = 0
        for part in slices(batches):
            texts_words = [words_of(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
            lengths = np.fromiter(map(len, texts_words), np.int64, len(texts_words))
            if len(hash_of) > KEPT_HASHES:
                hash_of.clear()
            digests = b"".join(map(hash_of.__getitem__, chain.from_iterable(texts_words)))
            del texts_words
            values = np.frombuffer(digests, np.uint64).reshape(-1, 2) % np.uint64(PRIME)
            text, begins = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths) - lengths
            count = max(len(text) - width + 1, 0)
            whole = text[:count] == text[len(text) - count :]
            one, two = (window_hashes(np.ascontiguousarray(values[:, k]), width, BASES[k])[:count][whole] for k in (0, 1))
            text = text[:count][whole]
            ids, marks = (part.column(c).to_numpy(zero_copy_only=False)[text] for c in ("id", "mark"))
            parts.append((one, two, ids, marks, np.flatnonzero(whole) - begins[text]))
            n += len(text)
            if n >= held:
                yield from told()
                n = 0
        if n:
            yield from told()

    return texts.mapInArrow(run, BLOB)


def _removed(key: tuple, blobs: pd.DataFrame) -> pd.DataFrame:
    """Windows of a bucket that also start earlier."""
    columns = [blobs[c].tolist() for c in (*COLUMNS, "hashes")]
    sure, n = [], 0
    for row in zip(*columns):
        if row[-1]:
            n += len(row[-1]) // 8
        else:
            sure.append(unpacked_runs(*row[:-1]))
    passes = -(-n // PASS_WINDOWS)
    for k in range(passes):  # the windows of a share of the hashes at once
        parts = []
        for row in zip(*columns):
            if row[-1]:
                hashes = np.frombuffer(row[-1], np.uint64)
                use = (hashes >> np.uint64(30)) % np.uint64(passes) == k
                parts.append((hashes[use], *(x[use] for x in unpacked_runs(*row[:-1]))))
        hashes, ids, marks, starts = (np.concatenate(x) for x in zip(*parts))
        del parts
        later, _ = later_ones((hashes,), ids, starts)
        sure.append((ids[later], marks[later], starts[later]))
    ids, marks, starts = (np.concatenate(x) for x in zip(*sure))
    return pd.DataFrame({"id": ids, "mark": marks, "start": starts})


def removed_windows(texts: DataFrame, width: int, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, mark, starts): for every text with something to remove, the starts of the windows."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = partitions_for(spark, size, bucket_bytes)
    blobs = window_blobs(texts, width, parts)
    found = blobs.repartition(parts, "bucket").groupBy("bucket").applyInPandas(
        _removed, "id long, mark long, start int")
    return found.groupBy("id", "mark").agg(F.collect_list("start").alias("starts"))


def spans_of(starts: list[int], width: int) -> np.ndarray:
    """Maximal intervals (from, to) of words covered by the windows that start there."""
    starts = np.unique(np.array(starts, np.int64))
    new = np.flatnonzero(np.concatenate(([True], np.diff(starts) > width)))
    last = np.append(new[1:], len(starts)) - 1
    return np.stack([starts[new], starts[last] + width], axis=1)


def without(words: list[bytes], spans: np.ndarray) -> list[bytes]:
    left, at = [], 0
    for a, b in spans.tolist():
        left += words[at:a]
        at = b
    return left + words[at:]


def cleaned(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, bucket_bytes: int = BUCKET_BYTES,
    with_text: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed (long), kept (string), kept_sha256, and spans, an array of (start, end).

    ``with_text=False`` leaves ``kept`` null, for callers that need the digest only.

    Words are runs of other characters than blanks and controls 9 to 13, unchanged. A word goes if it lies in a run of ``width``
    words of its text that also starts earlier: at a smaller id, or at an earlier place of the same id. Windows are judged on the
    input. ``kept`` holds the other words joined by one blank; spans are maximal, in words from 0, the end excluded.

    Null, blank and short texts keep all their words. A null id counts as the largest. Rows that share an id are versions of one
    document: windows at the same place of different versions leave one another alone, and rows repeated as wholes have equal
    results. An empty table gives an empty table; other columns are not looked at. No task holds more than the
    windows of a bucket (about ``bucket_bytes`` of text, and of hot windows one for each ``HELD_WORDS`` words) or one text.
    """
    ident = F.coalesce(quoted(id_col).cast("long"), F.lit(NO_ID))
    texts = docs.select(ident.alias("id"), quoted(id_col).isNull().alias("no_id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    again = texts.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id", F.lit(True).alias("again"))
    again = written(again, new_folder(docs.sparkSession), "again")
    n_again = again.count()
    mark = F.lit(0).cast("long")
    if n_again:  # versions of one id are told apart by a hash of the text
        texts = bounded_join(texts, again, ["id"], "left", rows=n_again)
        mark = F.when(F.col("again"), F.xxhash64("text")).otherwise(mark)
    texts = texts.select("id", mark.alias("mark"), "no_id", "text")
    removed = removed_windows(texts.select("id", "mark", "text"), width, bucket_bytes)
    joined = texts.join(removed, ["id", "mark"], "left").select("id", "no_id", "text", "starts")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for text, starts in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("starts").to_pylist()):
                own = words_of(text)
                spans = spans_of(starts, width) if starts else np.zeros((0, 2), np.int64)
                left = without(own, spans)
                kept = b" ".join(left)
                out.append((len(own), len(own) - len(left), kept if with_text else None, hashlib.sha256(kept).hexdigest(),
                            [{"start": a, "end": b} for a, b in spans.tolist()]))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            arrays[2] = arrays[2].cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("no_id"), *arrays],
                names=["id", "no_id", "n_words", "n_removed", "kept", "kept_sha256", "spans"],
            )

    found = joined.mapInArrow(clean, "id long, no_id boolean, n_words long, n_removed long, kept string, kept_sha256 string, "
                                     "spans array<struct<start: long, end: long>>")
    return found.select(
        F.when(~F.col("no_id"), F.col("id")).cast(docs.schema[id_col].dataType).alias(id_col),
        "n_words", "n_removed", "kept", "kept_sha256", "spans",
    )


def windows_query(spark, folder: str) -> DataFrame:
    return cleaned(spark.read.parquet(f"{folder}/documents.parquet"), with_text=False).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


WINDOWS_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS MATERIALIZED (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS h FROM d, unnest(range(1, len(w) - 18)) r(i)),
f AS (SELECT h, min({'d': doc_id, 'i': i}) AS first FROM v GROUP BY h HAVING count(*) > 1),
g AS MATERIALIZED (SELECT doc_id, list(i) AS starts FROM v JOIN f USING (h) WHERE {'d': doc_id, 'i': i} > first GROUP BY doc_id),
c AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 20)))) AS gone FROM g),
k AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN c USING (doc_id)),
p AS (SELECT k.doc_id, list(x ORDER BY k.i) AS kept FROM (
    SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) k
  LEFT JOIN (SELECT doc_id, unnest(gone) AS i, TRUE AS out FROM c) z ON k.doc_id = z.doc_id AND k.i = z.i WHERE out IS NULL GROUP BY k.doc_id)
SELECT k.doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k LEFT JOIN p USING (doc_id)
"""
