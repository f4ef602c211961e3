"""k-mer counts, frequencies and entropies of encoded records.

A record is one row, so its counts need no shuffle: they are made in Arrow batches where the row lies, as one sparse
row (idx, cnt). Long form comes from exploding it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.hashing import hash_numbers
from kmerloom.functions.kernels import binary_parts, lists, row_sets, slices, window_codes
from kmerloom.operators.jsd import g
from kmerloom.session import spread


#: Elements of dense vectors that are made at once.
DENSE = 1 << 22


def _reverse(code: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the reverse complements."""
    out, rest = np.zeros_like(code), code.copy()
    for _ in range(k):
        out = out * 4 + (rest + 2) % 4
        rest //= 4
    return out


def _vectors(batches: Iterator[pa.RecordBatch], k: int, num_states: int, canonical: bool) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        data, offsets = binary_parts(b.column(1))
        row, code = window_codes(data, offsets, k, num_states)
        if canonical:
            code = np.minimum(code, _reverse(code, k))
        idx, cnt, o = row_sets(row, code, len(b), num_states**k)
        total = np.bincount(row, minlength=len(b))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), lists(idx, o, pa.int64()), lists(cnt, o, pa.int64())], ["key", "total", "idx", "cnt"])


def kmer_vectors(df: DataFrame, k: int, key: str = "record_id", data: str = "data", num_states: int = 4, canonical: bool = False) -> DataFrame:
    """key, total (valid windows), idx (ascending k-mer numbers) and cnt of each row; null data has no windows."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if num_states**k >= 1 << 40:
        raise ValueError("k-mer numbers of this k do not fit")
    if canonical and num_states != 4:
        raise ValueError("canonical k-mers need the four nucleotide states")
    kind = df.schema[key].dataType.simpleString()
    rows = spread(df.select(F.col(key).alias("key"), F.col(data).alias("data")))
    return rows.mapInArrow(lambda b: _vectors(b, k, num_states, canonical), f"key {kind}, total bigint, idx array<bigint>, cnt array<bigint>").withColumnRenamed("key", key)


def kmer_counts(vectors: DataFrame, key: str = "record_id") -> DataFrame:
    """key, kmer, n of kmer_vectors(); rows without valid windows are absent."""
    return vectors.select(key, F.inline(F.arrays_zip(F.col("idx").alias("kmer"), F.col("cnt").alias("n"))))


def kmer_freqs(vectors: DataFrame, key: str = "record_id") -> DataFrame:
    """key, kmer, freq: counts over valid windows."""
    return vectors.select(key, "total", F.inline(F.arrays_zip(F.col("idx").alias("kmer"), F.col("cnt").alias("n")))).select(key, "kmer", (F.col("n") / F.col("total")).alias("freq"))


def record_entropy(vectors: DataFrame, key: str = "record_id") -> DataFrame:
    """key, entropy in bits, in the row itself; rows without valid windows are absent."""
    h = F.aggregate("cnt", F.lit(0.0).cast("double"), lambda a, n: a + g(n / F.col("total")))
    return vectors.where("total > 0").select(key, h.alias("entropy"))


def dense(vectors: DataFrame, size: int, key: str = "record_id", column: str = "kfreqs") -> DataFrame:
    """key and the frequencies as a dense array of `size`; for small k only."""
    return vectors.where("total > 0").mapInArrow(lambda b: _dense(b, size), f"key {vectors.schema[key].dataType.simpleString()}, v array<double>").select(F.col("key").alias(key), F.col("v").alias(column))


def _dense(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, DENSE // size)
    for b in (x.slice(i, rows) for x in batches for i in range(0, len(x), rows)):
        sizes = b.column(2).value_lengths().to_numpy()
        x = np.zeros((len(b), size))
        row = np.repeat(np.arange(len(b)), sizes)
        x[row, b.column(2).flatten().to_numpy()] = b.column(3).flatten().to_numpy()
        x /= b.column(1).to_numpy()[:, None]
        yield pa.RecordBatch.from_arrays([b.column(0), lists(x.ravel(), np.arange(len(b) + 1) * size, pa.float64())], ["key", "v"])


def _sketches(batches: Iterator[pa.RecordBatch], k: int, size: int | None, num_states: int, canonical: bool) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        data, offsets = binary_parts(b.column(1))
        row, code = window_codes(data, offsets, k, num_states)
        if canonical:
            code = np.minimum(code, _reverse(code, k))
        distinct, _, o = row_sets(row, code, len(b), num_states**k)
        h = hash_numbers(distinct, k, num_states).astype(np.int64)
        hashes, _, o = row_sets(np.repeat(np.arange(len(b)), np.diff(o)), h, len(b), 1 << 32)
        if size is not None:
            sizes = np.minimum(np.diff(o), size)
            hashes = hashes[np.arange(len(hashes)) - np.repeat(o[:-1], np.diff(o)) < size]
            o = np.concatenate([[0], np.cumsum(sizes)])
        yield pa.RecordBatch.from_arrays([b.column(0), lists(hashes, o, pa.int64())], ["key", "sketch"])


def sketches(df: DataFrame, k: int, size: int | None, key: str = "record_id", data: str = "data", num_states: int = 4, canonical: bool = False) -> DataFrame:
    """key and the `size` smallest distinct k-mer hashes, ascending (all of them if size is None), in the row itself."""
    if size is not None and size < 1:
        raise ValueError("the sketch size must be at least 1")
    if canonical and num_states != 4:
        raise ValueError("canonical k-mers need the four nucleotide states")
    kind = df.schema[key].dataType.simpleString()
    rows = spread(df.select(F.col(key).alias("key"), F.col(data).alias("data")))
    return rows.mapInArrow(lambda b: _sketches(b, k, size, num_states, canonical), f"key {kind}, sketch array<bigint>").withColumnRenamed("key", key)
