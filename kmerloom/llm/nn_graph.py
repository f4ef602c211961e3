"""Nearest-neighbour graph of numeric vectors by neighbour descent, and greedy search in it (problems 1 and 5).

Method. Rows with equal vectors form one node. A forest of random hyperplane trees, fitted on a bounded sample and
applied to all nodes, gives each node its first neighbours: each leaf is compared with itself in one task. Rounds of
neighbour descent follow: nodes that are neighbours (either way) of the same node are compared with each other and
better neighbours are kept, until a round brings few (ENOUGH), however many rounds that takes. A round is a Spark join of neighbour lists with vectors. It is
done in blocks of nearby nodes, so that a vector which many nodes of a block refer to is sent to the block once.
Queries walk the graph greedily from their own node: the best nodes seen so far are expanded until none of them is new.

Memory of a task is bounded by the leaf and block sizes, whatever the table's: where the trees have no more leaves than
they may be fitted with, leaves are cut into slices by rank along a direction, until a slice is about as large as a leaf
of a smaller table. Leaves that are larger by chance are halved in the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions.kernels import binary_parts
from kmerloom.session import collect_garbage, cut, small_side

NEIGHBOURS = 16
TREES = 4
LEAF = 1000
#: Trees are fitted with at most 2 ** MAX_DEPTH leaves (their hyperplanes are broadcast) on about SAMPLE_A_LEAF vectors a
#: leaf, MAX_SAMPLE in all; what a larger table needs beyond is cut by rank.
MAX_DEPTH, SAMPLE_A_LEAF, MAX_SAMPLE = 14, 48, 1 << 19
#: Nodes of a block of neighbour descent.
BLOCK = 4000
ENOUGH = 0.005
BEAM = 64

LIST = "array<struct<d: double, v: bigint>>"
_LIST = pa.list_(pa.struct([("d", pa.float64()), ("v", pa.int64())]))


def _pack(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(name, packed vector, its digest) of rows without null or NaN elements."""
    for b in batches:
        x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length) + 0.0
        kept = np.flatnonzero(np.isfinite(x).all(1))
        raw = [x[i].tobytes() for i in kept]
        digests = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept)), pa.array(raw, pa.binary()), pa.array(digests, pa.binary())], ["name", "vec", "h"])


def usable_vectors(df: DataFrame, length: int, record: str = "seqid", vector: str = "kfreqs") -> DataFrame:
    """(name, vec, h), one row a name: vectors of that length, neither null nor with null or NaN elements; of several the least digest."""
    rows = df.select(F.col(record).alias("name"), F.col(vector).alias("v")).where((F.size("v") == length) & F.col("name").isNotNull())
    packed = rows.mapInArrow(lambda x: _pack(x, length), "name string, vec binary, h binary")
    return packed.groupBy("name").agg(F.min(F.struct("h", "vec")).alias("m")).select("name", "m.vec", "m.h")


def matrix(column: pa.Array | pa.ChunkedArray, kind: type, length: int) -> np.ndarray:
    return binary_parts(column)[0].view(kind).reshape(-1, length)


def vectors_of(binaries: np.ndarray) -> pa.Array:
    """Rows of a matrix as binaries."""
    x = np.ascontiguousarray(binaries)
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])


def neighbour_lists(sizes: np.ndarray, d: np.ndarray, v: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(d, pa.float64()), pa.array(v, pa.int64())], ["d", "v"]))


def best(lists: F.Column, k: int) -> F.Column:
    """The k nearest distinct entries of an array of neighbours."""
    return F.slice(F.array_sort(F.array_distinct(lists)), 1, k)


@dataclass
class Forest:
    depth: int
    directions: np.ndarray  # (trees, 2 ** depth - 1, length)
    cuts: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int, trees: int) -> Forest:
        """Each inner node halves its part of the sample at the median along the difference of two of its vectors."""
        inner, length = (1 << depth) - 1, sample.shape[1]
        directions, cuts = np.zeros((trees, max(inner, 1), length), np.float32), np.zeros((trees, max(inner, 1)), np.float32)
        for t in range(trees):
            rng = np.random.default_rng(t)
            parts = {0: np.arange(len(sample))}
            for node in range(inner):
                own = parts.pop(node)
                w = rng.standard_normal(length).astype(np.float32)
                if len(own) > 1:
                    a, b = rng.choice(own, 2, replace=False)
                    w = sample[a] - sample[b]
                p = sample[own] @ w
                directions[t, node], cuts[t, node] = w, np.median(p) if len(own) else 0
                parts[2 * node + 1], parts[2 * node + 2] = own[p < cuts[t, node]], own[p >= cuts[t, node]]
        return cls(depth, directions, cuts)

    def leaves(self, x: np.ndarray, trees: int) -> np.ndarray:
        """(trees, rows) leaf numbers; numbers with a common prefix are leaves of a common subtree."""
        out = np.empty((trees, len(x)), np.int64)
        for t in range(trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", x, self.directions[t][node]) >= self.cuts[t][node]
                node = 2 * node + 1 + right
            out[t] = node - ((1 << self.depth) - 1)
        return out


def _fit(batches: Iterator[pa.RecordBatch], length: int, depth: int, trees: int) -> Iterator[pa.RecordBatch]:
    """(t, directions, cuts), a row a tree, of a forest fitted on all rows (h, vec) of the partition, in the order of h."""
    order, parts = [], []
    for b in batches:
        if len(b):
            order += b.column(0).to_pylist()
            parts.append(matrix(b.column(1), np.float64, length).astype(np.float32))
    if parts:
        f = Forest.fit(np.concatenate(parts)[np.array(sorted(range(len(order)), key=order.__getitem__))], depth, trees)
        raw = lambda x: pa.array([y.tobytes() for y in x], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(range(trees), pa.int32()), raw(f.directions), raw(f.cuts)], ["t", "directions", "cuts"])


def fitted_forest(vectors: DataFrame, length: int, count: int, depth: int, trees: int) -> Forest:
    """A forest fitted in a task on a sample of vectors (h, vec); the driver sees its hyperplanes only, 17 MB at most."""
    # a sample by hash of about that many: a sorted limit would bring as many rows of every partition to one place
    share = int((1 << 30) * min(1.0, min(SAMPLE_A_LEAF << depth, MAX_SAMPLE) / max(count, 1)))
    picked = vectors.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < share).select("h", "vec").repartition(1) if depth else None
    rows = picked.mapInArrow(lambda b: _fit(b, length, depth, trees), "t int, directions binary, cuts binary").collect() if depth else []
    if not rows:
        return Forest.fit(np.empty((0, length), np.float32), depth, trees)
    rows.sort(key=lambda r: r.t)
    return Forest(depth, np.stack([np.frombuffer(r.directions, np.float32).reshape(-1, length) for r in rows]), np.stack([np.frombuffer(r.cuts, np.float32) for r in rows]))


def exact(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, the same for the same pair in every task."""
    out = np.empty(len(a))
    for i in range(0, len(a), 1 << 15):
        diff = x[np.maximum(a[i : i + (1 << 15)], b[i : i + (1 << 15)])].astype(np.float64) - x[np.minimum(a[i : i + (1 << 15)], b[i : i + (1 << 15)])]
        out[i : i + (1 << 15)] = np.sqrt((diff * diff).sum(1))
    return np.round(out, 12)


def _assign(batches: Iterator[pa.RecordBatch], forest: Forest, length: int, trees: int) -> Iterator[pa.RecordBatch]:
    """(g: tree and leaf, p: place along the tree's direction for slices, id, x), a row for each of the first `trees` trees."""
    along = np.random.default_rng(length).standard_normal((trees, length))
    for b in batches:
        x = matrix(b.column(1), np.float64, length).astype(np.float32)
        leaves = forest.leaves(x, trees)
        packed = vectors_of(x)
        for t in range(trees):
            yield pa.RecordBatch.from_arrays([pa.array((t << forest.depth) + leaves[t], pa.int64()), pa.array(x @ along[t]), b.column(0), packed], ["g", "p", "id", "x"])


_ASSIGNED = "g bigint, p double, id bigint, x binary"


def sliced(leaves: DataFrame, bits: int) -> DataFrame:
    """Leaves cut into 2 ** bits equal slices by rank along their direction; numbers keep the leaf as their prefix.

    Ranks are made by a window, which sorts and spills, so a leaf need not fit in a task.
    """
    if not bits:
        return leaves
    return leaves.withColumn("g", F.shiftleft("g", bits) + F.ntile(1 << bits).over(Window.partitionBy("g").orderBy("p", "id")) - 1)


def _leaf(t: pa.Table, length: int, k: int, leaf: int) -> pa.Table:
    """The k nearest of each vector within its leaf; a leaf of more than two leaf sizes is halved along random directions first."""
    ids, x = t.column("id").to_numpy(), matrix(t.column("x"), np.float32, length)
    o = np.argsort(ids)
    ids, x = ids[o], x[o]
    rng = np.random.default_rng(len(ids))
    todo, done = [np.arange(len(ids))], []
    while todo:
        own = todo.pop()
        if len(own) <= 2 * leaf:
            done.append(own)
            continue
        a, b = rng.choice(own, 2, replace=False)
        own = own[np.argsort(x[own] @ (x[a] - x[b]), kind="stable")]
        todo += [own[: len(own) // 2], own[len(own) // 2 :]]
    src, dst = [], []
    for own in done:
        y, n = x[own], min(k, len(own) - 1)
        if n < 1:
            continue
        s = np.einsum("ij,ij->i", y, y)
        for i in range(0, len(own), 512):
            d = s[i : i + 512, None] + s[None] - 2 * (y[i : i + 512] @ y.T)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            near = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(own) else np.argsort(d, axis=1)[:, :n]
            src.append(np.repeat(own[i : i + 512], n))
            dst.append(own[near].ravel())
    if not src:
        return pa.table({"id": pa.array([], pa.int64()), "nbrs": pa.array([], _LIST)})
    return grouped(ids, x, np.concatenate(src), np.concatenate(dst), k)


def grouped(ids: np.ndarray, x: np.ndarray, src: np.ndarray, dst: np.ndarray, k: int) -> pa.Table:
    """(id, its up to k nearest) of pairs of row numbers."""
    d = exact(x, src, dst)
    o = np.lexsort((dst, d, src))
    src, dst, d = src[o], dst[o], d[o]
    rank = np.arange(len(src)) - np.searchsorted(src, src)
    src, dst, d = src[rank < k], dst[rank < k], d[rank < k]
    own, sizes = np.unique(src, return_counts=True)
    return pa.table({"id": pa.array(ids[own], pa.int64()), "nbrs": neighbour_lists(sizes, d, ids[dst])})


def _join_block(nodes: pa.Table, vectors: pa.Table, length: int, k: int) -> pa.Table:
    """One round of a block: all pairs of nodes that are listed together, where they are better than what is known."""
    empty = pa.table({"id": pa.array([], pa.int64()), "nbrs": pa.array([], _LIST)})
    if not len(nodes) or not len(vectors):
        return empty
    ids = vectors.column("v").to_numpy()
    o = np.argsort(ids)
    ids, x = ids[o], matrix(vectors.column("x"), np.float32, length)[o]
    reach = vectors.column("kth").to_numpy()[o]
    known_lists = vectors.column("known").combine_chunks().take(pa.array(o))
    known_src = np.repeat(np.arange(len(ids)), known_lists.value_lengths().to_numpy())
    known_dst = known_lists.flatten().to_numpy()
    # a known neighbour outside the block has no number here and cannot come up
    at = np.minimum(np.searchsorted(ids, known_dst), len(ids) - 1)
    inside = ids[at] == known_dst
    known = known_src[inside] * len(ids) + at[inside]
    lists = nodes.column("b").combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    flat = np.searchsorted(ids, lists.flatten().to_numpy())
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    s = np.einsum("ij,ij->i", x, x)
    limit = np.where(np.isfinite(reach), reach**2, np.inf).astype(np.float32)
    width, pairs = int(sizes.max()), []
    for i in range(0, len(sizes), 256):
        n = min(256, len(sizes) - i)
        place = np.arange(width)[None] < sizes[i : i + n, None]
        idx = np.zeros((n, width), np.int64)
        idx[place] = flat[offsets[i] : offsets[i + n]]
        y = x[idx]
        d = s[idx][:, :, None] + s[idx][:, None, :] - 2 * np.matmul(y, y.transpose(0, 2, 1))
        good = (d < limit[idx][:, :, None] * 1.0001) & place[:, :, None] & place[:, None, :] & (idx[:, :, None] != idx[:, None, :])
        r, a, b = np.nonzero(good)
        pairs.append(np.unique(idx[r, a] * len(ids) + idx[r, b]))
    found = np.setdiff1d(np.unique(np.concatenate(pairs)), known)
    if not len(found):
        return empty
    return grouped(ids, x, found // len(ids), found % len(ids), k)


@dataclass
class Graph:
    """vectors: id, rep (least name), h, vec (float64). members: name, id. nodes: id, home, x (float32), nbrs."""

    length: int
    k: int
    count: int
    depth: int
    vectors: DataFrame
    members: DataFrame
    nodes: DataFrame


def build_graph(rows: DataFrame, length: int, k: int = NEIGHBOURS, trees: int = TREES) -> Graph:
    """The graph of usable_vectors(); empty and single-node tables give nodes with empty lists."""
    rows = cut(rows)
    classes = rows.groupBy("h").agg(F.min("name").alias("rep"), F.first("vec").alias("vec"))
    vectors = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    members = rows.select("name", "h").join(vectors.select("id", "h"), "h").select("name", "id")
    count = vectors.count()
    depth = int(max(0, np.ceil(np.log2(max(count, 1) / LEAF))))
    depth, bits = min(MAX_DEPTH, depth), max(0, depth - MAX_DEPTH)
    trees = trees if depth else 1
    shared = rows.sparkSession.sparkContext.broadcast(fitted_forest(vectors, length, count, depth, trees))
    home = sliced(vectors.select("id", "vec").mapInArrow(lambda b: _assign(b, shared.value, length, 1), _ASSIGNED), bits).select("id", F.col("g").alias("home"), "x")
    leaves = sliced(vectors.select("id", "vec").mapInArrow(lambda b: _assign(b, shared.value, length, trees), _ASSIGNED), bits)
    first = leaves.select("g", "id", "x").groupBy("g").applyInArrow(lambda t: _leaf(t, length, k, LEAF), f"id bigint, nbrs {LIST}")
    merged = first.groupBy("id").agg(best(F.flatten(F.collect_list("nbrs")), k).alias("nbrs"))  # `trees` lists of k
    nodes = cut(home.join(merged, "id", "left").withColumn("nbrs", F.coalesce("nbrs", F.array().cast(LIST))))
    del first, merged, leaves, home
    collect_garbage(rows.sparkSession)
    depth += bits
    fresh = count * k if depth else 0
    # lists only get better, so this ends
    while fresh > ENOUGH * count * k:
        nodes, fresh = descend(nodes, length, k, count, depth)
        collect_garbage(rows.sparkSession)  # a round's shuffles are several times the input, as are those of the leaves
    return Graph(length, k, count, depth, vectors, members, nodes)


def descend(nodes: DataFrame, length: int, k: int, count: int, depth: int) -> tuple[DataFrame, int]:
    """One round of neighbour descent: the better lists and the number of entries that are new."""
    shift = max(0, depth - max(0, int(np.ceil(np.log2(max(1, count / BLOCK))))))
    # a node may be neighbour to any number of nodes: its k nearest of them count, ranked before they are gathered
    back = nodes.select(F.col("id").alias("u"), F.explode("nbrs").alias("e")).select("u", "e.v", "e.d")
    ranked = back.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("d", "u"))).where(F.col("r") <= k)
    reverse = ranked.groupBy("v").agg(F.collect_list("u").alias("back")).withColumnRenamed("v", "id")
    lists = nodes.join(reverse, "id", "left").select(
        F.shiftright("home", shift).alias("blk"), F.array_distinct(F.concat(F.transform("nbrs", lambda e: e.v), F.coalesce("back", F.array().cast("array<bigint>")))).alias("b")
    )
    lists = lists.where(F.size("b") > 1)
    wanted = lists.select(F.col("blk").alias("part"), F.explode("b").alias("v")).distinct()
    known = nodes.select(
        F.col("id").alias("v"), "x", F.when(F.size("nbrs") >= k, F.element_at("nbrs", -1).d).otherwise(F.lit(float("inf"))).alias("kth"), F.transform("nbrs", lambda e: e.v).alias("known")
    )
    vectors = wanted.join(known, "v")
    better = (
        lists.groupBy("blk").cogroup(vectors.groupBy("part")).applyInArrow(lambda a, b: _join_block(a, b, length, k), f"id bigint, nbrs {LIST}")
        .groupBy("id").agg(F.flatten(F.collect_list("nbrs")).alias("more"))
    )
    joined = nodes.join(better, "id", "left").withColumn("new", best(F.concat("nbrs", F.coalesce("more", F.array().cast(LIST))), k))
    done = cut(joined.select("id", "home", "x", F.col("new").alias("nbrs"), F.size(F.array_except("new", "nbrs")).alias("fresh")))
    return done.drop("fresh"), done.agg(F.sum("fresh")).first()[0] or 0


def _distances(batches: Iterator[pa.RecordBatch], length: int, digits: int | None = 9) -> Iterator[pa.RecordBatch]:
    for b in batches:
        q, x = matrix(b.column(2), np.float64, length), matrix(b.column(3), np.float64, length)
        d = np.sqrt(((q - x) ** 2).sum(1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d if digits is None else np.round(d, digits), pa.float64())], ["q", "v", "d"])


def measured(g: Graph, pairs: DataFrame) -> DataFrame:
    """(a, b, d) of pairs of node ids, with the distance of their vectors in double precision."""
    near, length = small_side(pairs, pairs.count(), 16), g.length
    full = near.join(g.vectors.select(F.col("id").alias("a"), F.col("vec").alias("x")), "a")
    full = full.join(g.vectors.select(F.col("id").alias("b"), F.col("vec").alias("y")), "b").select("a", "b", "x", "y")
    return full.mapInArrow(lambda b: _distances(b, length, None), "a bigint, b bigint, d double")


def greedy_search(g: Graph, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """(q, v, d) of the up to `beam` nearest nodes found for each query node q, itself with 0 among them.

    queries has one column q of node ids. In each hop every node of a query's beam that was not yet expanded is, until
    there is none; a node is expanded once, so this ends.
    """
    number, length = queries.count(), g.length
    start = queries.select("q", F.col("q").alias("v")).withColumn("d", F.lit(0.0)).withColumn("open", F.lit(True))
    mine = cut(queries.join(g.vectors.select(F.col("id").alias("q"), F.col("vec").alias("qv")), "q"))
    seen = cut(start)
    # links are walked both ways: a node that is in nobody's list is reached from its own
    out = g.nodes.select("id", F.explode(F.transform("nbrs", lambda e: e.v)).alias("w"))
    links = cut(out.select(F.col("id").alias("v"), F.col("w").alias("next")).unionByName(out.select(F.col("w").alias("v"), F.col("id").alias("next"))))
    while True:
        frontier = seen.where("open")
        size = frontier.count()
        if not size:
            break
        reached = small_side(frontier.select("q", "v"), size, 16).join(links, "v").select("q", F.col("next").alias("v")).distinct()
        new = cut(reached.join(seen.select("q", "v"), ["q", "v"], "left_anti"))
        pairs = small_side(new, new.count(), 16).join(g.vectors.select(F.col("id").alias("v"), "vec"), "v")
        pairs = small_side(mine, number, 8 * length + 8).join(pairs, "q").select("q", "v", "qv", "vec")
        measured = pairs.mapInArrow(lambda b: _distances(b, length), "q bigint, v bigint, d double").withColumn("open", F.lit(True))
        # what leaves the beam is closed for good; it stays known, so that it is not measured again
        every = seen.withColumn("open", F.lit(False)).unionByName(measured)
        rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "v"))
        seen = cut(every.withColumn("r", rank).withColumn("open", F.col("open") & (F.col("r") <= beam)).drop("r"))
        collect_garbage(queries.sparkSession)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "v"))
    return seen.withColumn("r", rank).where(F.col("r") <= beam).select("q", "v", "d")
