"""The public operations on a store (rows of seqid, data): selections, divergence of queries, distances, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.operators import cluster, distance, jsd, kmers, selection
from kmerloom.session import cut
from kmerloom.sources.store import seeded_limit, seeded_order, unique_rows

#: Dense vectors of a selection have 4 ** k elements.
MAX_K = 8
#: Without a number of chunks there is one for each so many records.
CHUNK = 100_000
#: Blocks into which a store is parted for its pairs.
BLOCKS = 8


def _ordered(store: DataFrame, k: int, seed: int, limit: int | None) -> DataFrame:
    """seqid, kfreqs (null without valid k-mers), place."""
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be from 1 to {MAX_K}")
    rows = seeded_limit(store, limit, seed) if limit else store
    dense = kmers.dense(kmers.kmer_vectors(rows, k, "seqid"), 4**k, "seqid")
    return rows.select("seqid", seeded_order(seed).alias("place")).join(dense, "seqid", "left")


def _checked(store: DataFrame, least: int) -> int:
    count = store.count()
    if count < least:
        raise ValueError(f"{count} records are fewer than {least}")
    return count


def select_nmost(store: DataFrame, n: int = 10, k: int = 6, include: list[str] | None = None, seed: int = 0, limit: int | None = None, chunks: int | None = None, unique: bool = True) -> DataFrame:
    """seqid and delta_jsd of the n most divergent records and the records to include.

    With records to include, contributions are those in the set of all of them.
    """
    rows = unique_rows(store) if unique else store
    count = _checked(rows, n)
    chosen = selection.select_nmost(_ordered(rows, k, seed, limit), "seqid", ["place", "seqid"], 4**k, n, chunks or -(-count // CHUNK))
    return _included(chosen, store, k, include)


def select_max(store: DataFrame, least: int = 5, most: int | None = 30, stat: str = "stdev", k: int = 6, include: list[str] | None = None, seed: int = 0, limit: int | None = None, chunks: int | None = None, unique: bool = True) -> DataFrame:
    """seqid and delta_jsd of between least and most divergent records and the records to include."""
    rows = unique_rows(store) if unique else store
    count = _checked(rows, least)
    if most is not None and most < least:
        raise ValueError("the greatest size is below the least")
    most = count if most is None else min(most, count)
    chosen = selection.select_max(_ordered(rows, k, seed, limit), "seqid", ["place", "seqid"], 4**k, least, most, stat, chunks or -(-count // CHUNK))
    return _included(chosen, store, k, include)


def _included(chosen: DataFrame, store: DataFrame, k: int, include: list[str] | None) -> DataFrame:
    if not include:
        return chosen.select("seqid", "delta_jsd")
    chosen = cut(chosen)
    few = store.join(F.broadcast(chosen.select("seqid").unionByName(store.where(F.col("seqid").isin(include)).select("seqid")).distinct()), "seqid", "left_semi")
    return selection.with_included(chosen, _ordered(few, k, 0, None), "seqid", include, 4**k).select("seqid", "delta_jsd")


def long_members(store: DataFrame, k: int) -> DataFrame:
    """member, name, kmer, freq of all rows as one set (column one)."""
    freqs = kmers.kmer_freqs(kmers.kmer_vectors(store, k, "seqid"), "seqid")
    return freqs.select(F.lit(1).alias("one"), F.col("seqid").alias("member"), F.col("seqid").alias("name"), "kmer", "freq")


def delta_jsd(reference: DataFrame, queries: DataFrame, k: int = 6, strict: bool = False) -> DataFrame:
    """seqid, delta_jsd: divergence of the reference set after its lowest member is replaced by the query.

    0 for names of the set; NaN for queries without valid k-mers, or an error if strict. A reference record without
    symbols is an error.
    """
    if strict and (bad := kmers.kmer_vectors(queries, k, "seqid").where("total = 0").select("seqid").first()):
        raise ValueError(f"no valid {k}-mers in {bad[0]!r}")
    if reference.where(F.coalesce(F.length("data"), F.lit(0)) == 0).limit(1).count():
        raise ValueError("a reference record has no symbols")
    done = jsd.replaced_divergence(long_members(reference, k), ["one"], long_members(queries, k)).select(F.col("member").alias("seqid"), F.col("replaced_jsd"))
    return queries.select("seqid").join(done, "seqid", "left").select("seqid", F.coalesce("replaced_jsd", F.lit(float("nan"))).alias("delta_jsd"))


def pairwise_distance(store: DataFrame, mode: str = "mash", k: int = 12, sketch_size: int | None = 3000, canonical: bool = False, moltype: str = "dna") -> DataFrame:
    """member_a < member_b and distance of all pairs of the store: the result itself grows with its square."""
    _distance_options(mode, sketch_size, canonical, moltype)
    if mode == "mash":
        s = kmers.sketches(store, k, sketch_size, "seqid", canonical=canonical).select(F.lit(1).alias("one"), F.col("seqid").alias("member"), "sketch")
        return distance.mash_distances(s, ["one"], k, sketch_size, blocks=BLOCKS).drop("one")
    return distance.sparse_euclidean_distances(kmers.kmer_vectors(store, k, "seqid").withColumnRenamed("seqid", "member"), BLOCKS)


def _distance_options(mode: str, sketch_size: int | None, canonical: bool, moltype: str) -> None:
    if mode not in ("mash", "euclidean"):
        raise ValueError(f"unknown distance {mode!r}")
    if canonical and moltype not in ("dna", "rna"):
        raise ValueError("canonical k-mers need nucleotides")
    if mode == "mash" and not sketch_size:
        raise ValueError("mash needs a sketch size")


def cluster_tree(store: DataFrame, mode: str = "mash", k: int = 12, sketch_size: int | None = 3000, canonical: bool = False, moltype: str = "dna", seed: int = 0, limit: int | None = None) -> DataFrame:
    """One row with the average-linkage tree of the store: leaves, newick."""
    rows = seeded_limit(store, limit, seed) if limit else store
    return cluster.trees(pairwise_distance(rows, mode, k, sketch_size, canonical, moltype).withColumn("one", F.lit(1)), "one").drop("one")
