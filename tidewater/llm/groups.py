"""Whole groups of sorted rows, read as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def edges(part: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups of following rows that agree in the keys begin, and the end."""
    new = np.zeros(part.num_rows + 1, bool)
    new[[0, -1]] = True
    for k in keys:
        x = part[k].to_numpy()
        new[1:-1] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int, size=lambda b: b.num_rows) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, cut as soon as they reach `least` by the given measure, and their edges."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(size, held)) >= least:
            part = pa.Table.from_batches(held)
            at = edges(part, keys)
            if len(at) > 2:
                yield part.slice(0, at[-2]), at[:-1]
                held = part.slice(at[-2]).combine_chunks().to_batches()
    if sum(b.num_rows for b in held):
        part = pa.Table.from_batches(held)
        yield part, edges(part, keys)
