"""Columns of vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rows, flat values, first value of each row and one end)``: only rows that are not empty or null and hold finite numbers."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten().cast(pa.float64())
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    fine = (sizes > 0) & (bad[ends] == bad[ends - sizes])
    rows = np.flatnonzero(fine)
    return rows, values, np.append(ends - sizes, len(values))


def by_width(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(rows, matrix)`` for each width of vector."""
    rows, values, first = matrix(column)
    sizes = np.asarray(column.value_lengths().fill_null(0))[rows]
    out = []
    for width in np.unique(sizes):
        own = rows[sizes == width]
        out.append((own, values[first[own][:, None] + np.arange(width)]))
    return out
