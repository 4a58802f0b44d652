"""Columns of lists as flat NumPy arrays and back; no row is turned into an object of its own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def row_numbers(lists: pa.Array) -> np.ndarray:
    """For each value of all rows end to end, the number of its row."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))


def end_to_end(lists: pa.Array) -> np.ndarray:
    """The values of all rows; a null is NaN."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float)


def lists_of(rows: np.ndarray) -> pa.Array:
    """One list for each row of a matrix."""
    count, size = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * size, pa.int32()), pa.array(rows.ravel()))
