"""Pairs of records that share keys of the inverted index, from an index kept in bundles.

An entry of the index is a key (32 bits), an id and a size. Entries are kept compressed, a bundle for each bucket of keys
and Arrow batch, about 9 bytes each; a row an entry would take five times as much. A task takes a bucket after the other,
sorts its entries and pairs those of equal keys. Different keys that are equal in 32 bits only add to the tally of a pair,
and all that reaches the minimum is verified, so they cost a little work and no row.

Pairs that share one key by chance grow with the square of the table. They are made and tallied in as many passes, by the
pair's lesser id, as keep the pairs of a pass under A_PASS, so that disk does not grow with the square. The lists of keys
with more than `hot` entries are cut into that many on one side, which are spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.kernels import binary_parts
from kmerloom.llm.kmer_sets import BANDS, DEN, NUM, describe
from kmerloom.session import cut

#: Pairs made in a pass, about 1.5 GB of shuffle; pairs made at once by a task.
A_PASS, AT_ONCE = 1 << 27, 1 << 18
#: Entries of a partition of the index, about, and buckets of it.
ENTRIES, BUCKETS = 1 << 21, 8
PACKED = "id bigint, n int, digest binary, keys binary"
_KINDS = (np.dtype("<u4"), np.dtype("<i8"), np.dtype("<i4"))
#: Of entries of a history: also their first batch and whether they were there before.
_DATED = (*_KINDS, np.dtype("<i8"), np.dtype("u1"))


def describe_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As describe, with the low 32 bits of a row's keys as one binary."""
    for b in describe(batches):
        low = b.column(3).flatten().to_numpy().view(np.uint64).astype("<u4").tobytes()
        offsets = (np.arange(b.num_rows + 1) * BANDS * 4).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(low)])], ["id", "n", "digest", "keys"])


def _pack(*columns: np.ndarray) -> bytes:
    """Columns by planes of bytes, of which the high ones are nearly constant, compressed."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes() for x in columns]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpack(packed: bytes, count: int, kinds: tuple[np.dtype, ...]) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(pa.decompress(packed, count * sum(k.itemsize for k in kinds), "zstd"), np.uint8), [], 0
    for k in kinds:
        out.append(np.ascontiguousarray(raw[at : at + count * k.itemsize].reshape(k.itemsize, count).T).view(k).ravel())
        at += count * k.itemsize
    return out


def _bundled(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, count, packed) of rows (id, n, keys)."""
    for b in batches:
        if not len(b):
            continue
        keys = binary_parts(b.column(2))[0].view("<u4")
        ids, n = (np.repeat(b.column(i).to_numpy().astype(k), BANDS) for i, k in ((0, "<i8"), (1, "<i4")))
        bucket = keys % np.uint32(buckets)
        order = np.argsort(bucket, kind="stable")
        own, starts = np.unique(bucket[order], return_index=True)
        parts = np.split(order, starts[1:])
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([len(o) for o in parts], pa.int32()), pa.array([_pack(keys[o], ids[o], n[o]) for o in parts], pa.binary())], ["bucket", "count", "packed"])


def bundles(rows: DataFrame, count: int) -> DataFrame:
    """The index of `count` rows (id, n, keys), materialised: a bucket's bundles lie side by side in one partition."""
    parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-count * BANDS // ENTRIES))
    packed = rows.select("id", "n", "keys").mapInArrow(lambda b: _bundled(b, parts * BUCKETS), "bucket int, count int, packed binary")
    return cut(packed.repartition(parts, "bucket").sortWithinPartitions("bucket"))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, sizes, ends, list sizes) of the entries of each bucket whose key has others, by key and id; ends: where their key's list ends."""
    bucket, held = None, []

    def lists() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        key, ids, n = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((ids, key))
        key, ids, n = key[order], ids[order], n[order]
        sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)])
        several = np.repeat(sizes > 1, sizes)
        sizes = sizes[sizes > 1]
        return ids[several], n[several], np.repeat(np.cumsum(sizes), sizes), np.repeat(sizes, sizes)

    for b in batches:
        for at, count, packed in zip(*(b.column(i).to_pylist() for i in range(3))):
            if held and at != bucket:
                yield lists()
                held = []
            bucket = at
            held.append(_unpack(packed, count, _KINDS))
    if held:
        yield lists()


def _in_pass(ids: np.ndarray, passes: int, p: int) -> np.ndarray:
    return (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(passes) == p


def _pairs(a: np.ndarray, n_a: np.ndarray, first: np.ndarray, end: np.ndarray, ids: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(a, b) of each of a with ids from its first to its end, where sizes fit."""
    m = end - first
    upto = np.concatenate([[0], np.cumsum(m)])
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + AT_ONCE, "right")) - 1)
        left = np.repeat(np.arange(i, j), m[i:j])
        right = np.arange(len(left)) - np.repeat(upto[i:j] - upto[i], m[i:j]) + np.repeat(first[i:j], m[i:j])
        x, y = n_a[left].astype(np.int64), n[right].astype(np.int64)
        # an id that stands twice in a list, by keys equal in 32 bits, is no pair
        fits = (np.minimum(x, y) * DEN >= np.maximum(x, y) * NUM) & (a[left] != ids[right])
        yield pa.RecordBatch.from_arrays([pa.array(a[left[fits]]), pa.array(ids[right[fits]])], ["a", "b"])
        i = j


def _met(batches: Iterator[pa.RecordBatch], hot: int, passes: int, p: int) -> Iterator[pa.RecordBatch]:
    for ids, n, ends, sizes in _buckets(batches):
        at = np.flatnonzero((sizes <= hot) & _in_pass(ids, passes, p))
        yield from _pairs(ids[at], n[at], at + 1, ends[at], ids, n)


def _sums(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    pairs = hottest = 0
    for ids, _, ends, sizes in _buckets(batches):
        pairs += int((ends - 1 - np.arange(len(ids))).sum())
        hottest = max(hottest, int((sizes > hot).sum()))
    yield pa.RecordBatch.from_arrays([pa.array([pairs], pa.int64()), pa.array([hottest], pa.int64())], ["pairs", "hot"])


def _hot_lists(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """(start, count, packed): the list of a hot key from the start of one of its parts on, a row a part."""
    for ids, n, ends, sizes in _buckets(batches):
        for end in np.unique(ends[sizes > hot]).tolist():
            for i in range(end - int(sizes[end - 1]), end, hot):
                yield pa.RecordBatch.from_arrays([pa.array([end - i], pa.int32()), pa.array([_pack(ids[i:end], n[i:end])], pa.binary())], ["count", "packed"])


def _met_hot(batches: Iterator[pa.RecordBatch], hot: int, passes: int, p: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for count, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids, n = _unpack(packed, count, _KINDS[1:])
            at = np.flatnonzero(_in_pass(ids[:hot], passes, p))
            yield from _pairs(ids[at], n[at], at + 1, np.full(len(at), count), ids, n)


def shared_pairs(index: DataFrame, least: int, hot: int) -> DataFrame:
    """(a, b), a < b, of ids that share `least` keys or more in bundles(), materialised."""
    total, hottest = index.mapInArrow(lambda b: _sums(b, hot), "pairs bigint, hot bigint").agg(F.sum("pairs"), F.max("hot")).first()
    passes = max(1, -(-(total or 0) // A_PASS))
    lists = None
    if hottest:
        lists = index.mapInArrow(lambda b: _hot_lists(b, hot), "count int, packed binary")
        lists = cut(lists.repartition(index.rdd.getNumPartitions()))
    out = None
    for p in range(passes):
        met = index.mapInArrow(lambda b, p=p: _met(b, hot, passes, p), "a bigint, b bigint")
        if lists is not None:
            met = met.unionByName(lists.mapInArrow(lambda b, p=p: _met_hot(b, hot, passes, p), "a bigint, b bigint"))
        some = cut(met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least).select("a", "b"))
        out = some if out is None else out.unionByName(some)
    return out


def _bundled_dated(batches: Iterator[pa.RecordBatch], buckets: int, old: bool) -> Iterator[pa.RecordBatch]:
    """(bucket, count, packed) of rows (id, n, since, keys), or of rows (id, n, since, key) of the cells of a history."""
    for b in batches:
        if not len(b):
            continue
        keys = b.column(3) if old else b.column(3).flatten()
        keys, times = keys.to_numpy().view(np.uint64).astype("<u4"), 1 if old else BANDS
        ids, n, since = (np.repeat(b.column(i).to_numpy().astype(k), times) for i, k in enumerate(("<i8", "<i4", "<i8")))
        known, bucket = np.full(len(ids), old, np.uint8), keys % np.uint32(buckets)
        order = np.argsort(bucket, kind="stable")
        own, starts = np.unique(bucket[order], return_index=True)
        parts = np.split(order, starts[1:])
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([len(o) for o in parts], pa.int32()), pa.array([_pack(keys[o], ids[o], n[o], since[o], known[o]) for o in parts], pa.binary())], ["bucket", "count", "packed"])


def dated_bundles(new: DataFrame, cells: DataFrame | None, count: int) -> DataFrame:
    """The index of new rows (id, n, since, keys) and of cells (id, n, since, key) of a history, materialised."""
    parts = max(2 * new.sparkSession.sparkContext.defaultParallelism, -(-count * BANDS // ENTRIES))
    kind = "bucket int, count int, packed binary"
    packed = new.select("id", "n", "since", "keys").mapInArrow(lambda b: _bundled_dated(b, parts * BUCKETS, False), kind)
    if cells is not None:
        packed = packed.unionByName(cells.select("id", "n", "since", "key").mapInArrow(lambda b: _bundled_dated(b, parts * BUCKETS, True), kind))
    return cut(packed.repartition(parts, "bucket").sortWithinPartitions("bucket"))


def _dated_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """([ids, sizes of sets, since, old], ends, list sizes) of the entries of each bucket, by key, new ones first, and id."""
    bucket, held = None, []

    def lists() -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        key, ids, n, since, old = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((ids, old, key))
        key = key[order]
        sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)])
        several = np.repeat(sizes > 1, sizes)
        sizes = sizes[sizes > 1]
        return [x[order][several] for x in (ids, n, since, old)], np.repeat(np.cumsum(sizes), sizes), np.repeat(sizes, sizes)

    for b in batches:
        for at, count, packed in zip(*(b.column(i).to_pylist() for i in range(3))):
            if held and at != bucket:
                yield lists()
                held = []
            bucket = at
            held.append(_unpack(packed, count, _DATED))
    if held:
        yield lists()


def _dated_pairs(at: np.ndarray, ends: np.ndarray, entries: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(a, b): new entries at the given places with what follows in their lists, the later first; sizes must fit."""
    ids, n, since, old = entries
    first, m = at + 1, ends - at - 1
    upto = np.concatenate([[0], np.cumsum(m)])
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + AT_ONCE, "right")) - 1)
        left = np.repeat(at[i:j], m[i:j])
        right = np.arange(len(left)) - np.repeat(upto[i:j] - upto[i], m[i:j]) + np.repeat(first[i:j], m[i:j])
        x, y = n[left].astype(np.int64), n[right].astype(np.int64)
        later = since[left] > since[right]
        fits = (np.minimum(x, y) * DEN >= np.maximum(x, y) * NUM) & (later | ((since[left] < since[right]) & (old[right] == 0)))
        a, b, later = ids[left[fits]], ids[right[fits]], later[fits]
        yield pa.RecordBatch.from_arrays([pa.array(np.where(later, a, b)), pa.array(np.where(later, b, a))], ["a", "b"])
        i = j


def _dated_met(batches: Iterator[pa.RecordBatch], hot: int, passes: int, p: int) -> Iterator[pa.RecordBatch]:
    for entries, ends, sizes in _dated_lists(batches):
        at = np.flatnonzero((sizes <= hot) & (entries[3] == 0) & _in_pass(entries[0], passes, p))
        yield from _dated_pairs(at, ends[at], entries)


def _dated_sums(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    pairs = hottest = 0
    for (ids, _, _, old), ends, sizes in _dated_lists(batches):
        pairs += int((ends - 1 - np.arange(len(ids)))[old == 0].sum())
        hottest = max(hottest, int(((sizes > hot) & (old == 0)).sum()))
    yield pa.RecordBatch.from_arrays([pa.array([pairs], pa.int64()), pa.array([hottest], pa.int64())], ["pairs", "hot"])


def _dated_hot(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """(count, packed): the list of a hot key from the start of each part that has a new entry on."""
    for entries, ends, sizes in _dated_lists(batches):
        for end in np.unique(ends[sizes > hot]).tolist():
            for i in range(end - int(sizes[end - 1]), end, hot):
                if entries[3][i] == 0:
                    yield pa.RecordBatch.from_arrays([pa.array([end - i], pa.int32()), pa.array([_pack(*(x[i:end] for x in entries))], pa.binary())], ["count", "packed"])


def _dated_met_hot(batches: Iterator[pa.RecordBatch], hot: int, passes: int, p: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for count, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            entries = _unpack(packed, count, _DATED[1:])
            at = np.flatnonzero((entries[3][:hot] == 0) & _in_pass(entries[0][:hot], passes, p))
            yield from _dated_pairs(at, np.full(len(at), count), entries)


def earlier_pairs(index: DataFrame, least: int, hot: int) -> DataFrame:
    """(a, b) of new ids a and ids b, new or old, of an earlier batch that share `least` keys or more in dated_bundles(), materialised."""
    total, hottest = index.mapInArrow(lambda b: _dated_sums(b, hot), "pairs bigint, hot bigint").agg(F.sum("pairs"), F.max("hot")).first()
    passes = max(1, -(-(total or 0) // A_PASS))
    lists = None
    if hottest:
        lists = index.mapInArrow(lambda b: _dated_hot(b, hot), "count int, packed binary")
        lists = cut(lists.repartition(index.rdd.getNumPartitions()))
    out = None
    for p in range(passes):
        met = index.mapInArrow(lambda b, p=p: _dated_met(b, hot, passes, p), "a bigint, b bigint")
        if lists is not None:
            met = met.unionByName(lists.mapInArrow(lambda b, p=p: _dated_met_hot(b, hot, passes, p), "a bigint, b bigint"))
        some = cut(met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least).select("a", "b"))
        out = some if out is None else out.unionByName(some)
    return out
