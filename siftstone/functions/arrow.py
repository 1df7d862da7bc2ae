"""Arrow batches in small parts, so that a task holds the Python objects of a few texts at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Texts, and their bytes, that a task has as Python objects at a time; a longer text is a part of its own.
ROWS, BYTES = 256, 2_000_000


def parts(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, some at a time by their number and the bytes of a string column."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch[text]), 0).to_pylist()
        lo = held = 0
        for at, more in enumerate(size):
            if at > lo and (at - lo >= ROWS or held + more > BYTES):
                yield batch.slice(lo, at - lo)
                lo, held = at, 0
            held += more
        if lo < len(size):
            yield batch.slice(lo)
