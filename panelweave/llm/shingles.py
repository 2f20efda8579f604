"""Word shingles of many texts at once: 64-bit hashes in numpy, and the exact sets for confirming."""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np

from panelweave.llm.common import sent_along, worker_store

sent_along(__name__)

WORD = re.compile("[^\x20\x09-\x0d]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER_A_Z = {c: c + 32 for c in range(65, 91)}


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: all bits of the result depend on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse; a worker keeps up to ``most`` of them."""
    store = worker_store()
    kept = store.get("powers")
    if kept is None or n > len(kept[0]):
        size = max(1 << 20, 1 << (n - 1).bit_length())
        kept = _powers(_BASE, size), _powers(_INVERSE, size)
        if size <= most:
            store["powers"] = kept
    return kept[0][:n], kept[1][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and the bounds: text i has words bounds[i]:bounds[i + 1]."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = _BLANK[raw]
    first = ~blank
    first[1:] &= blank[:-1]
    last = ~blank
    last[:-1] &= blank[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    bounds = np.searchsorted(starts, offsets)
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[_LOWER[raw]] * up, out=total[1:])
    hashes = (total[ends] - total[starts]) * down[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), bounds


class WordDigests(dict):
    """Eight bytes of BLAKE2b for every word asked for: no text makes words collide by its structure."""

    def __missing__(self, word: bytes) -> bytes:
        out = self[word] = hashlib.blake2b(word, digest_size=8).digest()
        return out


def word_digests(texts: list[bytes], most: int = 50_000, at_once: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the words of all texts, A-Z lower-cased, and the bounds; a worker remembers about ``most`` words.

    Words are split off ``at_once`` bytes of texts at a time (a longer text comes alone), as lists of them take many times the texts.
    """
    known = worker_store().setdefault("word_digests", WordDigests())
    counts, digests, start, held = [0], [], 0, 0
    for i, text in enumerate(texts, 1):
        held += len(text)
        if held < at_once and i < len(texts):
            continue
        if len(known) > most:
            known.clear()
        words = [t.lower().split() for t in texts[start:i]]  # of bytes: ASCII letters and blanks only
        counts += map(len, words)
        digests.append(b"".join(map(known.__getitem__, chain.from_iterable(words))))
        start, held = i, 0
    return np.frombuffer(b"".join(digests), np.uint64), np.cumsum(counts)


def shingle_hashes(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; a text with fewer words is one shingle."""
    words, bounds = word_digests(texts)
    factors = [int(x) | 1 for x in mixed(np.arange(1, width + 1, dtype=np.uint64))]
    n = len(words)
    full = np.zeros(max(n - width + 1, 0), np.uint64)
    for k, f in enumerate(factors):
        full += words[k : k + len(full)] * np.uint64(f)
    full = mixed(full)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            own = np.sort(full[a : b - width + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            few = words[a:b] * np.array(factors[: b - a], np.uint64)
            out.append(mixed(few.sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_set(text: str, width: int) -> set[tuple[str, ...]]:
    """The exact set."""
    words = WORD.findall(text.translate(LOWER_A_Z))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*[words[k:] for k in range(width)]))
