"""A batch in parts of bounded size: a worker holds several arrays for each byte that it works on at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts, or of ids, that a worker works on at a time.
SLICE_BYTES = 1 << 20


def lengths(values: pa.Array) -> np.ndarray:
    """Bytes of texts or items of lists; null has none."""
    found = pc.list_value_length(values) if pa.types.is_list(values.type) or pa.types.is_large_list(values.type) else pc.binary_length(values)
    return found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batch: pa.RecordBatch, column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with at most so many bytes of a column of texts, or of lists of numbers, together; a longer one is a part of its own."""
    most, values = most or SLICE_BYTES, batch.column(column)
    ends = np.cumsum(lengths(values) * (8 if pa.types.is_list(values.type) else 1))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
