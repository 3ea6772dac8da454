"""Cut Arrow batches into slices of bounded text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

SLICE_BYTES = 1 << 22
STEP = 256


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES
           ) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with about ``most`` bytes of text, one row at least."""
    for whole in batches:
        for at in range(0, whole.num_rows, STEP):  # few texts are held twice
            batch = whole.slice(at, STEP)
            texts = as_bytes(batch.column(column))
            start, size = 0, 0
            for i, text in enumerate(texts):
                if size and size + len(text) > most:
                    yield batch.slice(start, i - start), texts[start:i]
                    start, size = i, 0
                size += len(text)
            yield batch.slice(start), texts[start:]
        pa.default_memory_pool().release_unused()
