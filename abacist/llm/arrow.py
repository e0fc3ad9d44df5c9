"""Helpers for Arrow batch functions over columns of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at once; longer single texts make a slice of their own.
SLICE_BYTES = 8 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each slice holds about the same bytes of text, whatever the rows' lengths are."""
    for batch in batches:
        lengths, start, held = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), 0, 0
        for i, length in enumerate(lengths):
            if held and held + length > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += length
        if start < len(lengths):
            yield batch.slice(start)
