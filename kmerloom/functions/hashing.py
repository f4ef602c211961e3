"""The 32-bit k-mer hash, and sketch measures as column functions.

The hash is the public Murmur3 mixing applied with each one-byte code as a block of its own; the seed takes the length
at the start, and the finaliser does not.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public hash.
C1, C2, M5, N5 = 0xCC9E2D51, 0x1B873593, 5, 0xE6546B64
F1, F2 = 0x85EBCA6B, 0xC2B2AE35
DEFAULT_SEED = 0x9747B28C
MASK = 0xFFFFFFFF


def hash_codes(symbols: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the rows of a (rows, k) matrix of codes; seed 0 is the default seed."""
    return _hash((symbols[:, j] for j in range(symbols.shape[1])), *symbols.shape, seed)


def hash_numbers(code: np.ndarray, k: int, num_states: int = 4, seed: int = 0) -> np.ndarray:
    """Hashes of k-mer numbers, one symbol at a time."""
    return _hash((code // num_states**j % num_states for j in range(k - 1, -1, -1)), len(code), k, seed)


def _hash(columns: Iterable[np.ndarray], rows: int, k: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(rows, (seed or DEFAULT_SEED) ^ k, np.uint32)
        for symbol in columns:
            x = symbol.astype(np.uint32) * np.uint32(C1)
            x = ((x << np.uint32(15)) | (x >> np.uint32(17))) * np.uint32(C2)
            h ^= x
            h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(M5) + np.uint32(N5)
        h ^= h >> np.uint32(16)
        h *= np.uint32(F1)
        h ^= h >> np.uint32(13)
        h *= np.uint32(F2)
        h ^= h >> np.uint32(16)
    return h


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; null if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def mash_distance(a: Column, b: Column, k: int, sketch_size: int) -> Column:
    """Mash distance of two ascending sketches: Jaccard of the sketch_size smallest hashes of both, as a mutation rate.

    Equal unions give 0, no common hash gives 1. Two empty sketches have no distance: null.
    """
    low = F.slice(F.array_sort(F.array_union(a, b)), 1, min(sketch_size, (1 << 31) - 1))
    both = F.size(F.array_intersect(low, F.array_intersect(a, b)))
    union = F.size(low)
    j = both / union
    return F.when(union == 0, None).when(both == union, 0.0).when(both == 0, 1.0).otherwise(F.least(F.lit(1.0), -F.log(2 * j / (1 + j)) / k))
