"""Sets of distinct k-mers of encoded records: digests, positional signatures and exact similarity.

A record's signature has `positions` places; each holds the smallest value of the record's k-mers under that place's
hash, four bytes. Two records agree in a place with a probability that equals the Jaccard similarity of their sets.
Keys of the inverted index are the bytes of ROWS neighbouring places together with the place: single bytes would give
each key a fixed share of all records, and lists that grow with the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from kmerloom.functions.kernels import binary_parts, lists, row_sets, slices, window_codes

K = 12
#: Similarity threshold as a fraction: a pair is found if DEN * |A and B| >= NUM * |A or B|.
NUM, DEN = 9, 20
ROWS, BANDS = 2, 64
#: Pairs of similarity 0.45 share fewer than LEAST of the 64 keys with probability 9e-6, more similar pairs less.
LEAST = 2


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 32-bit values."""
    x = x.astype(np.uint32)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint64).astype(np.uint32)


def signatures(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, positions) uint32; every row must have an element. Worked in blocks that stay in cache."""
    rows = len(offsets) - 1
    out = np.empty((rows, ROWS * BANDS), np.uint32)
    mixed, a = _mix(codes), 0
    while a < rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + 16384, "right")) - 1)
        x, starts = mixed[offsets[a] : offsets[b]], offsets[a:b] - offsets[a]
        h = np.empty_like(x)
        for j in range(ROWS * BANDS):
            np.multiply(x, _FACTORS[j], out=h)
            np.add(h, _SHIFTS[j], out=h)
            out[a:b, j] = np.minimum.reduceat(h, starts)
        a = b
    return out


def keys(signature: np.ndarray) -> np.ndarray:
    """(rows, BANDS) int64 keys of the inverted index: place and bytes, scrambled to 64 bits."""
    s = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        h = (h ^ s[:, :, r]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, data, ...): id, n (distinct k-mers), digest of the set, keys, further columns. Rows without a k-mer are left out."""
    for b in slices(batches):
        ids = b.column(0).to_numpy(zero_copy_only=False)
        data, offsets = binary_parts(b.column(1))
        row, code = window_codes(data, offsets, K)
        codes, _, o = row_sets(row, code, len(ids), 4**K)
        n = np.diff(o)
        kept = np.flatnonzero(n)
        codes = codes.astype(np.int32)
        digests = [hashlib.blake2b(codes[o[i] : o[i + 1]].tobytes(), digest_size=16).digest() for i in kept]
        own = keys(signatures(codes, np.append(o[kept], len(codes)))) if len(kept) else np.empty((0, BANDS), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[kept], pa.int64()), pa.array(n[kept], pa.int32()), pa.array(digests, pa.binary()), lists(own.ravel(), np.arange(len(kept) + 1) * BANDS, pa.int64()), *[b.column(i).take(pa.array(kept)) for i in range(2, b.num_columns)]],
            ["id", "n", "digest", "keys", *b.schema.names[2:]],
        )


DESCRIBED = "id bigint, n int, digest binary, keys array<bigint>"


def one_set(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return np.unique(window_codes(raw, np.array([0, len(raw)]), K)[1])


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (a, b, data_a, data_b): the pairs (a, b) at or above the threshold, exactly, and whether their sets are equal."""
    for batch in batches:
        first, first_set, kept, same = None, None, [], []
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for i, (x, y) in enumerate(zip(left, right)):
            if x is not first and x != first:
                first, first_set = x, one_set(x)
            other = one_set(y)
            both = len(np.intersect1d(first_set, other, assume_unique=True))
            if DEN * both >= NUM * (len(first_set) + len(other) - both) > 0:
                kept.append(i)
                same.append(len(first_set) == len(other) == both)
        chosen = batch.select([0, 1]).take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(same, pa.bool_())], ["a", "b", "same"])
