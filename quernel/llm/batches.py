"""Arrow batches cut by bytes, so that a Python worker holds a few megabytes of text at a time, however texts are sized."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text, one row at least."""
    sizes = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)])
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(column: pa.Array) -> list[bytes]:
    """The texts' bytes; null counts as empty."""
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]
