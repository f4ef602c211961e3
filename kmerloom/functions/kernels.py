"""NumPy kernels over Arrow batches of encoded sequences (one byte per symbol)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


#: Symbols worked on at once; a longer row is worked on alone.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of rows with at most `limit` bytes in a binary column, so that memory does not follow the rows' length."""
    for b in batches:
        sizes = np.diff(binary_parts(b.column(column))[1])
        if sizes.sum() <= limit:
            yield b
            continue
        a, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > a and held + n > limit:
                yield b.slice(a, i - a)
                a, held = i, 0
            held += n
        yield b.slice(a)


def binary_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, row offsets) of a binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    large = pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def window_codes(data: np.ndarray, offsets: np.ndarray, k: int, num_states: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(row, k-mer index) of each window of k canonical codes that lies inside one row, in reading order."""
    if k < 1:
        raise ValueError("k must be at least 1")
    n = len(data) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = np.int32 if num_states**k < 1 << 31 else np.int64
    bad = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
    np.cumsum(data >= num_states, out=bad[1:])
    sizes = np.diff(offsets)
    keep = bad[k:] == bad[:n]
    # windows that begin in the last k - 1 places of a row reach into the next
    keep &= np.arange(n) <= np.repeat(offsets[1:] - k, sizes)[:n]
    return np.repeat(np.arange(len(sizes)), sizes)[:n][keep], _numbers(data.astype(kind), k, num_states)[keep].astype(np.int64)


def _numbers(code: np.ndarray, k: int, base: int) -> np.ndarray:
    """Number of the k codes from each place on, put together from runs of doubled lengths."""
    whole, held, width = None, 0, 1
    while True:
        if k & 1:
            whole, held = (code, width) if whole is None else (whole[: len(code) - held] * base**width + code[held:], held + width)
        k >>= 1
        if not k:
            return whole
        code, width = code[:-width] * base**width + code[width:], 2 * width


def row_sets(row: np.ndarray, code: np.ndarray, rows: int, space: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, code) pairs ascending: codes, their counts, and the offsets of the rows."""
    key, count = np.unique(row * space + code, return_counts=True)
    offsets = np.searchsorted(key, np.arange(rows + 1, dtype=np.int64) * space)
    return key % space, count, offsets


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of the slices of values."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
