"""Token counts by merging batches of pre-tokens rank by rank in numpy arrays.

A batch of pre-tokens is one flat array of symbols with row bounds. In a step every row that still has a known pair
applies its lowest-ranked pair, at all its places at once, so a row takes as many steps as it has different merges and
all rows of the batch step together. The symbols that survive are the tokens.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import quoted, sent_along, worker_store
from panelweave.llm.pretokens import pieces, text_slices

sent_along(__name__)

CACHED_PIECES = 400_000
NEVER = np.iinfo(np.int32).max
# Fixed value: how byte-level vocabularies write bytes as characters. Printable bytes stand for themselves,
# the others follow from 256 on in order.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
# Fixed value: the split that byte-level vocabularies of this format are made with.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    made = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [made[b] for b in range(256)]


class Merges:
    """The merges of a vocabulary as arrays sorted by pair."""

    def __init__(self, first: np.ndarray, pairs: np.ndarray, ranks: np.ndarray, made: np.ndarray, width: int):
        self.first, self.pairs, self.ranks, self.width = first, pairs, ranks, width
        self.made = np.zeros(int(ranks.max(initial=-1)) + 1, np.int64)
        self.made[ranks] = made

    @staticmethod
    def read(path: str) -> tuple[tuple, list[str]]:
        """Arguments of this class and the special strings of a tokenizer file of plain byte-level BPE."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and spec["normalizer"] is None and pre["type"] == "ByteLevel"
        if not plain or pre["add_prefix_space"] or not pre["use_regex"] or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without normalizer and prefix blank is supported")
        ids, width = model["vocab"], 1 << 20
        rows = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([ids[a] * width + ids[b] for a, b in rows], np.int64)
        made = np.array([ids[a + b] for a, b in rows], np.int64)
        order = np.argsort(pairs, kind="stable")
        first = np.array([ids[c] for c in byte_characters()], np.int64)
        special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        return (first, pairs[order], np.arange(len(rows), dtype=np.int32)[order], made[order], width), special

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.ranks[at], NEVER)

    def count(self, rows: list[bytes]) -> np.ndarray:
        """Symbols that survive in each row; no row may be empty."""
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        counts = sizes.copy()
        symbols = self.first[np.frombuffer(b"".join(rows), np.uint8)]
        row = np.arange(len(rows))  # numbers of the rows still in work
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        rank = np.full(len(symbols), NEVER, np.int32)
        rank[:-1] = self.rank(symbols[:-1], symbols[1:])
        rank[starts + sizes - 1] = NEVER
        while len(row):
            lowest = np.minimum.reduceat(rank, starts)
            busy = lowest != NEVER
            if not busy.all():
                stay = np.repeat(busy, sizes)
                counts[row[~busy]] = sizes[~busy]
                symbols, rank = symbols[stay], rank[stay]
                row, sizes, lowest = row[busy], sizes[busy], lowest[busy]
                if not len(row):
                    break
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            hit = rank == np.repeat(lowest, sizes)
            at = np.flatnonzero(hit)
            # In a run of overlapping places (aaa) the first, third ... are merged. A row's last place never hits.
            head = np.ones(len(at), bool)
            head[1:] = np.diff(at) != 1
            nth = np.arange(len(at)) - np.flatnonzero(head)[np.cumsum(head) - 1]
            at = at[nth % 2 == 0]
            symbols[at] = self.made[rank[at]]
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            last = np.zeros(len(symbols), bool)
            last[starts + sizes - 1] = True
            last[at] = last[at + 1]
            moved = at - np.arange(len(at))  # places after the gaps are closed
            sizes = sizes - np.add.reduceat(gone, starts)
            symbols, rank, last = symbols[~gone], rank[~gone], last[~gone]
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            new = np.unique(np.concatenate((moved, moved[moved > 0] - 1)))
            inner = new[~last[new]]
            rank[inner] = self.rank(symbols[inner], symbols[inner + 1])
            rank[new[last[new]]] = NEVER
        return counts


class Counter:
    """Counts tokens of texts; remembers the counts of a bounded number of pre-tokens."""

    def __init__(self, merges: Merges, special: list[str]):
        self.merges, self.cache = merges, {}
        self.split = regex.compile(SPLIT)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def counts(self, texts: list[str]) -> list[int]:
        if sum(map(len, texts)) > 4_000_000:  # one very long text: its pre-tokens come in bounded lists
            return [self._long(t) for t in texts]
        specials, held = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            specials.append(len(parts) - 1)
            held.append([p for part in parts for some in pieces(self.split, part) for p in some])
        self._learn({p for own in held for p in own})
        get = self.cache.__getitem__
        return [n + sum(map(get, own)) for n, own in zip(specials, held)]

    def _long(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        total = len(parts) - 1
        for part in parts:
            for some in pieces(self.split, part):
                self._learn(set(some))
                total += sum(map(self.cache.__getitem__, some))
        return total

    def _learn(self, wanted: set[str]) -> None:
        new = [p for p in wanted if p not in self.cache]
        if len(self.cache) + len(new) > CACHED_PIECES:
            self.cache.clear()
            new = list(wanted)
        if new:
            self.cache.update(zip(new, self.merges.count([p.encode() for p in new]).tolist()))


def _counter(arrays: tuple, special: list[str]) -> Counter:
    return Counter(Merges(*arrays), special)


def token_counts(
    docs: DataFrame, tokenizer_file: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: its id, n_bytes, n_tokens (long) and over_limit (boolean: more than ``limit``).

    A null text counts as empty: no bytes, no tokens. A special string inside a text is one token. Repeated rows, null
    ids and empty tables pass through. The vocabulary is read on the driver and broadcast; the file fixes its size.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(Merges.read(tokenizer_file))
    name = hashlib.sha1(tokenizer_file.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store()
        if store.get("counter_name") != name:
            store["counter"], store["counter_name"] = _counter(*broadcast.value), name
        counter = store["counter"]
        for part, texts in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("n_bytes"), pa.array(counter.counts(texts), pa.int64())],
                names=["id", "n_bytes", "n_tokens"],
            )

    text = F.coalesce(quoted(text_col), F.lit(""))
    rows = docs.select(quoted(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def counts_query(spark, folder: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
