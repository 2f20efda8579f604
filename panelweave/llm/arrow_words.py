"""Words of many texts at once with Arrow's kernels, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from panelweave.llm.common import sent_along

sent_along(__name__)

SLICE_BYTES = 2_000_000


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of one slice hold about ``size`` bytes; a longer text comes alone."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(lengths, dtype=np.int64)
        start, before = 0, 0
        while start < batch.num_rows:
            end = max(int(np.searchsorted(upto, before + size, "right")), start + 1)
            yield batch.slice(start, end - start)
            start, before = end, int(upto[end - 1])


def split_words(texts: pa.Array, separators: str, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in one flat array, and the bounds: text i has words bounds[i]:bounds[i + 1].

    ``separators`` is a pattern of what lies between words. ``lower`` lower-cases A-Z and nothing else. A null text has no words.
    """
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    pieces = pc.split_pattern_regex(texts, separators)
    flat, ends = pc.list_flatten(pieces), np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False), dtype=np.int64)
    held = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate(([0], np.cumsum(held.to_numpy(zero_copy_only=False), dtype=np.int64)))
    return flat.filter(held), upto[np.concatenate(([0], ends))]


def numbered(words: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The distinct words in UTF-8 and, for every word, the index of its own."""
    coded = words.dictionary_encode()
    return coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order of appearance, and the index of each code's own."""
    coded = pa.array(codes).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """For every word the number of its text."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
