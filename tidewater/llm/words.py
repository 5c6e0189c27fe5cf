"""Words of whole Arrow columns as numpy arrays: places in the UTF-8 bytes, and 64-bit hashes.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. UTF-8 never
uses these bytes inside a character, so the bytes can be cut without decoding them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S30, _S27, _S31 = (np.uint64(x) for x in (30, 27, 31))


def mix(x: np.ndarray) -> np.ndarray:
    """A well-known bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _S30)) * _B
    x = (x ^ (x >> _S27)) * _C
    return x ^ (x >> _S31)


def as_bytes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column one after another, and each row's offsets; nulls are empty texts."""
    column = column.fill_null("") if column.null_count else column
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width, len(column) + 1, column.offset * np.dtype(width).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]) if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return (_LOWER[raw] if lower else raw), at - at[0]


def slices(batch: pa.RecordBatch, text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes of text (one row at least), to bound the arrays made of them."""
    if not batch.num_rows:
        return
    _, at = as_bytes(batch.column(text))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def spans(raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _BREAK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each row (one more entry than rows). breaks: of each byte, whether it lies between words."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = ~breaks[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = np.zeros(len(raw) + 1, bool)
    end[1:] = inside[:-1] & ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    cut = edge[inside[edge] & inside[edge - 1]]
    start[cut] = end[cut] = True
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end), np.searchsorted(starts, offsets).astype(np.int64)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the given byte ranges, eight bytes at a time."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    left = ends - starts
    out = mix((eight[starts] & _KEEP[np.minimum(left, 8)]) + _A * (left.astype(np.uint64) + np.uint64(seed)))
    at, more = 8, np.flatnonzero(left > 8)
    while len(more):
        out[more] = mix((out[more] * _A) ^ (eight[starts[more] + at] & _KEEP[np.minimum(left[more] - at, 8)]))
        at += 8
        more = more[left[more] > at]
    return out


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` consecutive words at each word, and whether such a window lies inside one row."""
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out[: n - k] = mix(out[: n - k] * _A + hashes[k:])
    rest = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return out, rest >= size
