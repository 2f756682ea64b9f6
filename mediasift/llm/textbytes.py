"""Texts of an Arrow batch as one byte array with offsets, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20
A, Z, SPACE = 65, 90, 32

LOWER = np.arange(256, dtype=np.uint8)
LOWER[A : Z + 1] += 32


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    n = len(column)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole texts of about ``size`` bytes; a longer text stands alone."""
    data, ends = raw(column)
    first, n = 0, len(ends) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + size, "right")) - 1)
        yield first, last, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def parts(data: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut one very long text into (start, end) of about ``size`` bytes, at blanks if there are any near."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + size)
        if end < n:
            blanks = np.flatnonzero(data[max(at, end - 4096) : end] <= SPACE)
            if len(blanks):
                end = max(at, end - 4096) + int(blanks[-1]) + 1
            else:
                while end > at + 1 and 0x80 <= data[end] < 0xC0:
                    end -= 1
        yield at, end
        at = end


def row_of(offsets: np.ndarray) -> np.ndarray:
    """Row of each byte."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
