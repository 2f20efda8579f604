"""Pre-tokenizing of Arrow batches in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
import regex

from panelweave.llm.common import sent_along

sent_along(__name__)

SLICE_CHARS = 1_000_000
PIECES_AT_ONCE = 200_000


def text_slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cuts batches so that the texts decoded at once hold about ``chars`` bytes; a longer text comes alone.

    Missing texts come as empty ones.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > chars:
                part = batch.slice(start, i - start)
                yield part, [t or "" for t in part.column(column).to_pylist()]
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            part = batch.slice(start)
            yield part, [t or "" for t in part.column(column).to_pylist()]


def pieces(pattern: regex.Pattern, text: str) -> Iterator[list[str]]:
    """The matches of ``pattern`` in a text, in lists of bounded length."""
    if len(text) <= PIECES_AT_ONCE:
        yield pattern.findall(text)
        return
    matches = (m.group() for m in pattern.finditer(text))
    while some := list(islice(matches, PIECES_AT_ONCE)):
        yield some
