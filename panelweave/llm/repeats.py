"""Removal of byte strings that repeat across documents, by prefix-free parsing.

Triggers of a rolling hash cut all texts into phrases: a window of ``length`` bytes belongs to its smallest rolling hash
(the leftmost of equals), and the windows that lie side by side and have the same trigger make a phrase. Phrases
overlap by ``length`` - 1 bytes, so every window lies in exactly one, and equal windows have equal triggers.

1. Parse: each phrase goes with its document to the dictionary by the hash of its trigger. A phrase that a smaller
   document has too is repeated with all its windows. On repetitive text that settles nearly everything.
2. Dictionary: phrases that share a trigger with other phrases are put in order of their suffixes, as far as ``length``
   bytes; equal neighbours are windows that repeat though their phrases differ.
3. Both answers go back to the texts, where the windows' bytes are removed.

Texts are kept in compressed chunks of bounded size, and what leaves a chunk for a hash bucket is one packed row,
with equal phrases of the chunk sent once. A trigger with very many different phrases is spread by its windows.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import new_folder, quoted, sent_along, written
from panelweave.llm.shingles import BYTE, mixed, powers

sent_along(__name__)

LENGTH = 50
GRAM = 24
CHUNK_BYTES = 4_000_000
SLICE_BYTES = 500_000
BUCKET_BYTES = 6_000_000
SPREAD_OVER = 100_000
LATE = np.iinfo(np.int64).max  # stands for a missing id: later than all others


def _sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums from which the hash of any stretch of ``raw`` follows, and the factors that shift it."""
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * up, out=total[1:])
    return total, down


def _parse(raw: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """Phrases of texts that lie end to end: text number, first and last window, hash of trigger and of phrase."""
    n, places = len(raw), length - gram + 1
    windows = n - length + 1
    if windows <= 0:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    total, down = _sums(raw)
    rolling = mixed((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    low = np.uint64(0xFFFFFF)
    value = (rolling & ~low) | np.arange(len(rolling), dtype=np.uint64)
    rows = -(-len(value) // places) + 1
    grid = np.full(rows * places, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(value)] = value
    grid = grid.reshape(rows, places)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    trigger = (np.minimum(back[:windows], ahead[places - 1 : places - 1 + windows]) & low).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:windows]
    inside = np.arange(windows) + length <= bounds[1:][text]
    starts = np.ones(windows, bool)
    starts[1:] = (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(starts & inside)
    # a phrase ends before the next one starts, or where its text has no more windows
    after = np.append(np.flatnonzero(starts), windows)
    last = np.minimum(after[np.searchsorted(after, first, side="right")] - 1, bounds[1:][text[first]] - length)
    body = mixed((total[last + length] - total[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    # the smallest hashes of windows crowd at the low end, so they are mixed again
    return [text[first], first, last, mixed(rolling[trigger[first]] ^ np.uint64(0x9E3779B97F4A7C15)), body]


class _Chunk:
    """A chunk's texts and their phrases."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes, length: int, gram: int):
        self.ids, sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        self.raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, int(sizes.sum()))), np.uint8)
        self.bounds = np.concatenate(([0], np.cumsum(sizes)))
        found = []
        for a, b, start, end in self._slices(length):
            local = np.clip(self.bounds[a : b + 1], start, end) - start
            part = _parse(self.raw[start:end], local, length, gram)
            found.append([part[0] + a, part[1] + start, part[2] + start, *part[3:]])
        self.text, self.first, self.last, self.trigger, self.body = map(np.concatenate, zip(*found)) if found else _parse(self.raw, self.bounds, length, gram)
        # the order in which phrases leave and answers come back
        order = np.lexsort((self.ids[self.text], self.body, self.trigger)) if len(self.text) else np.zeros(0, np.int64)
        for name in ("text", "first", "last", "trigger", "body"):
            setattr(self, name, getattr(self, name)[order])
        self.doc = self.ids[self.text]
        self.head = np.ones(len(order), bool)  # first of equal phrases, which has the smallest id
        self.head[1:] = (self.trigger[1:] != self.trigger[:-1]) | (self.body[1:] != self.body[:-1])
        self.group = np.cumsum(self.head) - 1

    def _slices(self, length: int) -> Iterator[tuple[int, int, int, int]]:
        """Texts a:b and bytes start:end, of about a slice; a longer text in pieces that overlap by a window less one."""
        a, count = 0, len(self.bounds) - 1
        while a < count:
            b = max(a + 1, int(np.searchsorted(self.bounds, self.bounds[a] + SLICE_BYTES, side="right")) - 1)
            start, end = int(self.bounds[a]), int(self.bounds[b])
            if end - start <= 2 * SLICE_BYTES:
                yield a, b, start, end
            else:
                for k in range(start, end - length + 1, SLICE_BYTES):
                    yield a, b, k, min(end, k + SLICE_BYTES + length - 1)
            a = b

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the phrases that are sent, and whether another document of the chunk has the phrase."""
        at = np.flatnonzero(self.head)
        latest = np.maximum.reduceat(self.doc, at) if len(at) else self.doc[at]
        return at, latest != self.doc[at]


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of unsigned numbers, all first bytes first: equal bytes stand together."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(data: bytes, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").ravel().astype(np.uint64), at + n * width


def _bucket_of(trigger: np.ndarray, buckets: int) -> np.ndarray:
    return (((trigger >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _pack(ids: np.ndarray, text: np.ndarray, trigger: np.ndarray, body: np.ndarray, more: np.ndarray, bits: int) -> bytes:
    """Phrases in order of their triggers: differences of triggers, bodies, documents."""
    used, number = np.unique(text, return_inverse=True)
    steps = np.diff((trigger >> np.uint64(64 - bits)), prepend=np.uint64(0))
    width = max(1, (int(steps[1:].max(initial=0)).bit_length() + 7) // 8)
    wide = max(1, (len(used).bit_length() + 7) // 8)
    own = ids[used].view(np.uint64)
    return b"".join((
        struct.pack("<QQBBQ", len(text), len(used), width, wide, int(steps[0])), _planes(np.diff(own, prepend=np.uint64(0)), 8),
        _planes(steps[1:], width), _planes(body, 6), _planes(number.astype(np.uint64), wide), np.packbits(more).tobytes(),
    ))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, body, document, more) of ``_pack``."""
    n, used, width, wide, start = struct.unpack_from("<QQBBQ", data)
    at = struct.calcsize("<QQBBQ")
    own, at = _unplaned(data, at, used, 8)
    steps, at = _unplaned(data, at, n - 1, width)
    body, at = _unplaned(data, at, n, 6)
    number, at = _unplaned(data, at, n, wide)
    more = np.unpackbits(np.frombuffer(data, np.uint8, -1, at), count=n).astype(bool)
    trigger = np.cumsum(np.concatenate((np.array([start], np.uint64), steps)), dtype=np.uint64)
    return trigger, body, np.cumsum(own, dtype=np.uint64).view(np.int64)[number.astype(np.int64)], more


def _dictionary(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For each phrase of a bucket: 1 if a smaller document has it, 2 if its trigger has other phrases too, or
    3 if it has very many, 0 if it is of no interest."""
    parts = [_unpack(x) for x in rows["data"]]
    sizes = [len(p[0]) for p in parts]
    trigger, body, doc, more = map(np.concatenate, zip(*parts))
    del parts
    order = np.lexsort((doc, body, trigger))
    t, b, d, m = trigger[order], body[order], doc[order], more[order]
    del trigger, body, doc, more
    new_t = np.ones(len(t), bool)
    new_t[1:] = t[1:] != t[:-1]
    new_b = new_t.copy()
    new_b[1:] |= b[1:] != b[:-1]
    at_t, at_b = np.flatnonzero(new_t), np.flatnonzero(new_b)
    of_t, of_b = np.cumsum(new_t) - 1, np.cumsum(new_b) - 1
    shared = (np.maximum.reduceat(d, at_t) != np.minimum.reduceat(d, at_t)) | np.logical_or.reduceat(m, at_t)
    kinds = np.add.reduceat(new_b.astype(np.int64), at_t)
    code = np.where(shared & (kinds > 1), np.where(kinds > SPREAD_OVER, 3, 2), 0)[of_t].astype(np.uint8)
    code[d[at_b][of_b] < d] = 1
    out = np.empty(len(t), np.uint8)
    out[order] = code
    ends = np.cumsum(sizes)
    packed = [_zipped(out[e - n : e]) for e, n in zip(ends, sizes)]
    return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "codes": packed})


def _zipped(codes: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(codes.tobytes())


def _unzipped(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _answers(chunk: _Chunk, codes: list) -> np.ndarray:
    """The dictionary's code for each phrase of the chunk; a later one of equal phrases in it is repeated."""
    at, _ = chunk.entries()
    sent = np.concatenate([np.frombuffer(_unzipped(c), np.uint8) for _, c in sorted((r["bucket"], r["codes"]) for r in codes)]) if codes else np.zeros(0, np.uint8)
    code = sent[chunk.group] if len(at) else sent
    return np.where(chunk.doc > chunk.doc[at][chunk.group], 1, code) if len(at) else code


def _open_windows(chunk: _Chunk, code: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Phrases that the dictionary must look into: (place, first window, last window, hash to send it by).

    Phrases of code 3 come window by window.
    """
    two, three = np.flatnonzero(code == 2), np.flatnonzero(code == 3)
    count = chunk.last[three] - chunk.first[three] + 1
    place = np.repeat(three, count)
    window = chunk.first[place] + np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
    own = np.array([int.from_bytes(hashlib.blake2b(chunk.raw[w : w + length], digest_size=8).digest(), "little") for w in window.tolist()], np.uint64)
    return (np.concatenate((two, place)), np.concatenate((chunk.first[two], window)), np.concatenate((chunk.last[two], window)),
            np.concatenate((chunk.trigger[two], own)))


def _suffixes(length: int):
    """Windows of a bucket of phrases that a smaller document has too, as bits in the phrases' order."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sizes, docs, texts, counts = [], [], [], []
        for data in rows["data"]:
            n, blob = struct.unpack_from("<Q", data)[0], _unzipped(data[8:])
            docs.append(np.frombuffer(blob, np.int64, n))
            sizes.append(np.frombuffer(blob, np.int64, n, 8 * n))
            texts.append(blob[16 * n :])
            counts.append(n)
        size, doc = np.concatenate(sizes), np.concatenate(docs)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        start = np.cumsum(size) - size
        windows = size - length + 1
        total, down = _sums(raw)
        at = np.repeat(start - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        own = np.repeat(doc, windows)
        hashed = mixed((total[at + length] - total[at]) * down[at])
        order = np.lexsort((own, hashed))
        h, d, a = hashed[order], own[order], at[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = np.flatnonzero(d[head] < d)
        for k in range(0, len(later), 20_000):  # equal hashes are compared byte by byte
            some = later[k : k + 20_000]
            span = np.arange(length)
            same = (raw[a[some][:, None] + span] == raw[a[head[some]][:, None] + span]).all(1)
            if not same.all():
                raise RuntimeError("two windows share a 64-bit hash: choose another hash base")
        found = np.zeros(len(h), bool)
        found[order[later]] = True
        ends = np.cumsum([w.sum() for w in np.split(windows, np.cumsum(counts)[:-1])])
        bits = [np.packbits(x).tobytes() for x in np.split(found, ends[:-1])]
        return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "bits": bits})

    return run


CHUNKS = "chunk long, ids binary, nulls binary, sizes binary, data binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in chunks of about CHUNK_BYTES, or of one longer text."""
    part, number = TaskContext.get().partitionId(), 0
    ids, nulls, texts, held = [], [], [], 0

    def packed() -> pa.RecordBatch:
        nonlocal ids, nulls, texts, held, number
        row = [
            part << 32 | number, np.array(ids, np.int64).tobytes(), np.array(nulls, bool).tobytes(),
            np.array([len(t) for t in texts], np.int64).tobytes(), zstandard.ZstdCompressor(level=6).compress(b"".join(texts)),
        ]
        ids, nulls, texts, held, number = [], [], [], 0, number + 1
        return pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(row, (pa.int64(), *[pa.binary()] * 4))], names=[c.split()[0] for c in CHUNKS.split(", ")]
        )

    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            some = batch.slice(k, 500)
            for ident, text in zip(some.column("id").to_pylist(), some.column("text").to_pylist()):
                text = text or b""
                if texts and (held + len(text) > CHUNK_BYTES or len(texts) >= 60_000):
                    yield packed()
                ids.append(LATE if ident is None else ident)
                nulls.append(ident is None)
                texts.append(text)
                held += len(text)
    if texts:
        yield packed()


def _column(batch: pa.RecordBatch, row: int, name: str):
    return batch.column(name)[row].as_py()


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, texts: bool = False
) -> DataFrame:
    """One row per row of ``docs``: its id, n_bytes, n_removed, n_spans (long), kept_sha256, and with ``texts`` kept.

    Every byte covered by a string of ``length`` bytes that also starts in a document with a smaller id is removed;
    strings are judged on the input and don't cross documents. A null text is empty. A missing id counts as later than
    all others. Rows that share an id are the same document, so they don't repeat each other. Texts shorter than ``length``
    keep all bytes. An empty table gives an empty table; other columns are not looked at.
    """
    folder = new_folder(docs.sparkSession)
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("binary").alias("text"))
    chunks = written(rows.mapInArrow(_chunks, CHUNKS), folder, "chunks")
    size = docs.agg(F.sum(F.octet_length(quoted(text_col)))).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    bits = min(64, max(8, int(size).bit_length() + 10))

    def open_chunk(batch: pa.RecordBatch, k: int) -> _Chunk:
        return _Chunk(*[_column(batch, k, c) for c in ("ids", "sizes", "data")], length, gram)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = open_chunk(batch, k)
                at, more = chunk.entries()
                bucket = _bucket_of(chunk.trigger[at], buckets)
                used, starts = np.unique(bucket, return_index=True)
                cut = list(zip(starts.tolist(), [*starts[1:].tolist(), len(at)]))
                data = [_pack(chunk.ids, chunk.text[at[a:b]], chunk.trigger[at[a:b]], chunk.body[at[a:b]], more[a:b], bits) for a, b in cut]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), _column(batch, k, "chunk"))), pa.array(used.astype(np.int32)), pa.array(data, pa.binary())],
                    names=["chunk", "bucket", "data"],
                )

    sent = chunks.mapInArrow(parse, "chunk long, bucket int, data binary")
    codes = sent.groupBy("bucket").applyInPandas(_dictionary, "chunk long, bucket int, codes binary")
    codes = written(codes, folder, "codes").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "codes")).alias("codes"))

    def open_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = open_chunk(batch, k)
                place, first, last, sent_by = _open_windows(chunk, _answers(chunk, _column(batch, k, "codes") or []), length)
                bucket = _bucket_of(sent_by, buckets)
                names, data = [], []
                for b in np.unique(bucket).tolist():
                    own = np.flatnonzero(bucket == b)
                    text = b"".join([chunk.raw[x : y + length].tobytes() for x, y in zip(first[own].tolist(), last[own].tolist())])
                    head = chunk.doc[place[own]].tobytes() + (last[own] - first[own] + length).astype(np.int64).tobytes()
                    names.append(b)
                    data.append(struct.pack("<Q", len(own)) + zstandard.ZstdCompressor(level=3).compress(head + text))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(names), _column(batch, k, "chunk"))), pa.array(names, pa.int32()), pa.array(data, pa.binary())],
                    names=["chunk", "bucket", "data"],
                )

    answered = chunks.join(codes, "chunk", "left")
    found = answered.mapInArrow(open_phrases, "chunk long, bucket int, data binary").groupBy("bucket").applyInPandas(
        _suffixes(length), "chunk long, bucket int, bits binary"
    )
    found = written(found, folder, "windows").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = open_chunk(batch, k)
                code = _answers(chunk, _column(batch, k, "codes") or [])
                _, first, last, sent_by = _open_windows(chunk, code, length)
                edge = np.zeros(len(chunk.raw) + 1, np.int32)
                whole = np.flatnonzero(code == 1)
                np.add.at(edge, chunk.first[whole], 1)
                np.add.at(edge, chunk.last[whole] + length, -1)
                bucket = _bucket_of(sent_by, buckets)
                for b, packed in ((r["bucket"], r["bits"]) for r in _column(batch, k, "bits") or []):
                    own = np.flatnonzero(bucket == b)
                    count = last[own] - first[own] + 1
                    window = np.repeat(first[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    window = window[np.unpackbits(np.frombuffer(packed, np.uint8), count=len(window)).astype(bool)]
                    np.add.at(edge, window, 1)
                    np.add.at(edge, window + length, -1)
                gone = np.cumsum(edge)[:-1] > 0
                nulls = np.frombuffer(_column(batch, k, "nulls"), bool)
                out = []
                for i, (a, b) in enumerate(zip(chunk.bounds[:-1].tolist(), chunk.bounds[1:].tolist())):
                    own, raw = gone[a:b], chunk.raw[a:b]
                    removed = int(np.count_nonzero(own))
                    spans = int(own[0]) + int(np.count_nonzero(own[1:] & ~own[:-1])) if removed else 0
                    kept = (raw[~own] if removed else raw).tobytes()
                    row = [None if nulls[i] else int(chunk.ids[i]), b - a, removed, spans, hashlib.sha256(kept).hexdigest()]
                    out.append(row + [kept] * texts)
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()][: 1 + texts]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    result = answered.join(found, "chunk", "left").mapInArrow(remove, schema)
    return result.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def repeats_query(spark, folder: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{folder}/documents.parquet"))
