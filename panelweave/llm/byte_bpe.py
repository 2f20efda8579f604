"""Byte-level BPE encoding and decoding with a ranked vocabulary.

Two tiers: a pre-token that is itself in the vocabulary is resolved by one probe of a minimal perfect hash; any other
one is merged by a heap over a linked list of its bytes, lowest rank first and leftmost among equals.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import quoted, sent_along, worker_store
from panelweave.llm.pretokens import pieces, text_slices

sent_along(__name__)

CACHED_PIECES = 300_000
CACHED_PAIRS = 500_000
_NONE = -1


class PerfectHash:
    """Minimal perfect hash of distinct byte strings by hashing and displacing.

    Keys go to buckets by one half of a digest. Buckets, largest first, take the first displacement that sends all
    their keys to free slots; ``slots`` names the key at each of exactly len(keys) slots.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        n = max(len(keys), 1)
        self.n, self.m = n, max(1, n // per_bucket)
        halves = [self._halves(k) for k in keys]
        buckets: list[list[int]] = [[] for _ in range(self.m)]
        for i, (a, _, _) in enumerate(halves):
            buckets[a % self.m].append(i)
        self.shift = [0] * self.m
        slots = [_NONE] * n
        free = n - 1
        for b in sorted(range(self.m), key=lambda x: -len(buckets[x])):
            own = buckets[b]
            if len(own) == 1:  # any free slot, named directly
                while slots[free] != _NONE:
                    free -= 1
                self.shift[b] = -free - 1
                slots[free] = own[0]
            elif own:
                d = 0
                while True:
                    at = {self._place(*halves[i][1:], d) for i in own}
                    if len(at) == len(own) and all(slots[s] == _NONE for s in at):
                        break
                    d += 1
                self.shift[b] = d
                for i in own:
                    slots[self._place(*halves[i][1:], d)] = i
        self.slots = slots

    @staticmethod
    def _halves(key: bytes) -> tuple[int, int, int]:
        a, b, c = struct.unpack("<QQQ", hashlib.blake2b(key, digest_size=24).digest())
        return a, b, c | 1

    def _place(self, b: int, c: int, d: int) -> int:
        """Slot under displacement ``d``; each displacement scatters the keys anew."""
        return ((b + d * 0x9E3779B97F4A7C15) * c % (1 << 64) >> 20) % self.n

    def slot(self, key: bytes) -> int:
        """The key number at the only slot where ``key`` can be; the caller compares the key itself."""
        a, b, c = self._halves(key)
        d = self.shift[a % self.m]
        return self.slots[-d - 1 if d < 0 else self._place(b, c, d)]


class Codec:
    """Encoder and decoder for one vocabulary; ``tokens[i]`` is the string of bytes with id ``ids[i]``."""

    def __init__(self, tokens: list[bytes], ids: list[int], pattern: str):
        self.tokens, self.ids = tokens, ids
        self.hash = PerfectHash(tokens)
        self.text_of = dict(zip(ids, tokens))
        self.pattern = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}
        self.pairs: dict[int, int] = {}
        self.single = [self.rank(bytes([b])) for b in range(256)]

    def rank(self, key: bytes) -> int:
        i = self.hash.slot(key)
        return self.ids[i] if i != _NONE and self.tokens[i] == key else _NONE

    def _joined(self, left: int, right: int) -> int:
        """Id of two neighbours put together, or none; remembered for as many pairs as fit."""
        key = left << 32 | right
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self.rank(self.text_of[left] + self.text_of[right])
        return got

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that isn't in the vocabulary."""
        joined, ids = self._joined, [self.single[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := joined(ids[i], ids[i + 1])) != _NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = rank, _NONE
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := joined(rank, ids[k])) != _NONE:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            h = before[i]
            if h >= 0 and (r := joined(ids[h], rank)) != _NONE:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return [x for x in ids if x != _NONE]

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        rank = self.rank(raw)
        ids = [rank] if rank != _NONE else self.merge(raw)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.cache) >= CACHED_PIECES:
            self.cache.clear()
        if len(piece) <= 64:
            self.cache[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get, miss = self.cache.get, self._piece
        return b"".join([get(p) or miss(p) for some in pieces(self.pattern, text) for p in some])

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.text_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def read_ranks(path: str) -> tuple[list[bytes], list[int]]:
    """Tokens and ids of a rank file: a line holds a token in base 64 and its id."""
    tokens, ids = [], []
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            tokens.append(base64.b64decode(token))
            ids.append(int(rank))
    return tokens, ids


def coded(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ids (packed, binary) and decoded (binary).

    A null text counts as empty and gives no ids. Repeated rows, null ids and an empty table pass through. The
    vocabulary is read on the driver and broadcast; its size is fixed by the file. Workers hold a bounded number
    of encoded pieces and about a megabyte of text at once.
    """
    tokens, ids = read_ranks(rank_file)
    vocabulary = docs.sparkSession.sparkContext.broadcast((tokens, ids))
    name = hashlib.sha1(repr((rank_file, len(ids), pattern)).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, vocabulary, pattern)
        for part, texts in text_slices(batches, "text"):
            packed = [codec.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(packed, pa.binary()), pa.array([codec.decode(p) for p in packed], pa.binary())],
                names=["id", "ids", "decoded"],
            )

    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids binary, decoded binary").withColumnRenamed("id", id_col)


def _codec(name: str, vocabulary, pattern: str) -> Codec:
    """The worker's codec, built once and used for all its tasks."""
    store = worker_store()
    if store.get("codec_name") != name:
        store["codec"], store["codec_name"] = Codec(*vocabulary.value, pattern), name
    return store["codec"]


def digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of what ``coded`` returns."""
    return coded(docs, rank_file, pattern, id_col, text_col).select(
        quoted(id_col),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def bpe_query(spark, folder: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
