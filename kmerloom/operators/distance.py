"""Distances of records within sets, in long form.

All pairs of a set are its result, so a set must be small or the pairs wanted; pairs are made by a join on the set,
never across sets. A large set is parted into blocks and each pair of blocks joined on its own, so that its pairs are
spread over tasks. Each pair comes once, member_a < member_b.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.hashing import mash_distance


def euclidean(a: Column, b: Column) -> Column:
    """L2 norm of the difference of two dense arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0).cast("double"), lambda s, x: s + x))


def pairs_within(members: DataFrame, by: list[str], value: str, blocks: int = 1) -> DataFrame:
    """Both values of each pair of members of each set, as a and b; each set is parted into so many blocks."""
    left = members.select(*by, F.col("member").alias("member_a"), F.col(value).alias("a"))
    right = members.select(*by, F.col("member").alias("member_b"), F.col(value).alias("b"))
    if blocks > 1:
        # a pair of members meets once: in the block of the one and the block of the other
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
        left = left.withColumn("block_a", F.pmod(F.xxhash64("member_a"), F.lit(blocks))).withColumn("block_b", every)
        right = right.withColumn("block_b", F.pmod(F.xxhash64("member_b"), F.lit(blocks))).withColumn("block_a", every)
        return left.join(right, [*by, "block_a", "block_b"]).where("member_a < member_b").drop("block_a", "block_b")
    return left.join(right, by).where("member_a < member_b")


def euclidean_distances(members: DataFrame, by: list[str], vector: str = "kfreqs") -> DataFrame:
    return pairs_within(members, by, vector).select(*by, "member_a", "member_b", euclidean(F.col("a"), F.col("b")).alias("distance"))


def _sparse_euclidean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (member_a, member_b, idx and cnt of both): the distance of their frequencies, over k-mers that occur."""
    for b in batches:
        lists = [b.column(i).to_pylist() for i in range(2, 6)]
        out = np.empty(len(b))
        for i, (ia, ca, ib, cb) in enumerate(zip(*lists)):
            p, q = np.array(ca, float) / sum(ca), np.array(cb, float) / sum(cb)
            _, x, y = np.intersect1d(ia, ib, assume_unique=True, return_indices=True)
            both = ((p[x] - q[y]) ** 2).sum()
            out[i] = np.sqrt(both + (p * p).sum() - (p[x] * p[x]).sum() + (q * q).sum() - (q[y] * q[y]).sum())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], ["member_a", "member_b", "distance"])


def sparse_euclidean_distances(members: DataFrame, blocks: int = 1) -> DataFrame:
    """member_a, member_b, distance of rows (member, idx, cnt) as one set: counts of a k-mer are held only where it occurs."""
    kind = members.schema["member"].dataType.simpleString()
    rows = members.where(F.size("idx") > 0).select(F.lit(1).alias("one"), "member", F.struct("idx", "cnt").alias("v"))
    pairs = pairs_within(rows, ["one"], "v", blocks).select("member_a", "member_b", "a.idx", "a.cnt", F.col("b.idx").alias("idx_b"), F.col("b.cnt").alias("cnt_b"))
    return pairs.mapInArrow(_sparse_euclidean, f"member_a {kind}, member_b {kind}, distance double")


def mash_distances(members: DataFrame, by: list[str], k: int, sketch_size: int, sketch: str = "sketch", blocks: int = 1) -> DataFrame:
    return pairs_within(members, by, sketch, blocks).select(*by, "member_a", "member_b", mash_distance(F.col("a"), F.col("b"), k, sketch_size).alias("distance"))


def nearest(distances: DataFrame, by: list[str]) -> DataFrame:
    """For each member its nearest other member; of equal distances (to 9 decimals) the first."""
    both = distances.select(*by, F.col("member_a").alias("member"), F.col("member_b").alias("other"), "distance").unionByName(
        distances.select(*by, F.col("member_b").alias("member"), F.col("member_a").alias("other"), "distance")
    )
    least = F.min(F.struct(F.round("distance", 9).alias("distance"), "other"))
    return both.groupBy(*by, "member").agg(least.alias("m")).select(*by, "member", F.col("m.other").alias("nearest"), F.col("m.distance").alias("distance"))


def symmetric(distances: DataFrame, by: list[str]) -> DataFrame:
    """The full matrix in long form: both directions and the zero diagonal."""
    back = distances.select(*by, F.col("member_b").alias("member_a"), F.col("member_a").alias("member_b"), "distance")
    names = distances.select(*by, "member_a").unionByName(back.select(*by, "member_a")).distinct()
    return distances.unionByName(back).unionByName(names.select(*by, "member_a", F.col("member_a").alias("member_b"), F.lit(0.0).alias("distance")))
