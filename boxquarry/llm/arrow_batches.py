"""Small slices of Arrow batches, so that work arrays stay small however long the texts are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def byte_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Consecutive slices with at most ``most`` bytes in ``column``, or one row."""
    values = batch.column(column)
    if not len(values):
        return
    kind = np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32
    bounds = np.frombuffer(values.buffers()[1], dtype=kind)[values.offset : values.offset + len(values) + 1]
    at = 0
    while at < len(values):
        upto = max(at + 1, int(np.searchsorted(bounds, int(bounds[at]) + most, side="right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto
