"""Vector columns as matrices inside Arrow functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, dims: int, dtype: type = np.float32) -> tuple[np.ndarray, np.ndarray]:
    """(usable, rows of the usable): those of `dims` finite numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, dtype=bool), np.zeros((0, dims), dtype=dtype)
    offsets = column.offsets.to_numpy()
    values = column.values
    flat = values.to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    if values.null_count:
        flat = np.where(values.is_null().to_numpy(zero_copy_only=False), np.nan, flat)
    usable = (np.diff(offsets) == dims) & ~column.is_null().to_numpy(zero_copy_only=False)
    rows = flat[offsets[:-1][usable][:, None] + np.arange(dims)]
    good = np.isfinite(rows).all(axis=1)
    usable[np.nonzero(usable)[0][~good]] = False
    return usable, np.ascontiguousarray(rows[good])


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows brought to length 1 in double precision; zero rows stay zero."""
    wide = rows.astype(np.float64)
    top = np.abs(wide).max(axis=1, keepdims=True) if wide.size else np.ones((len(wide), 1))
    wide /= np.where(top > 0, top, 1.0)  # no overflow or underflow in the squares
    length = np.sqrt((wide * wide).sum(axis=1, keepdims=True))
    return wide / np.where(length > 0, length, 1.0)
