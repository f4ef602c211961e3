"""Registered queries of the sequence operators, each over its whole tables. Their SQL is in plans/oracle.py."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom import api
from kmerloom.functions import alphabet, hashing
from kmerloom.operators import cluster, distance, jsd, kmers, ranking, selection
from kmerloom.plans.inputs import records, set_data, set_members, set_vectors, table, vectors
from kmerloom.plans.oracle import ORACLE_SQL
from kmerloom.session import checkpoint_dir, spread
from kmerloom.sources import files, store

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Sketches of the queries.
SKETCH_K, SKETCH_SIZE = 6, 50
#: Rows whose order an iteration follows are ordered by a digest of their id with this seed.
SEED = "7"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def six(column: str) -> F.Column:
    """Rounded as both engines do alike, without a negative zero."""
    return (F.round(column, 6) + 0.0).alias(column)


def texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(records(spark, d)).select("record_id", alphabet.codes_to_text(F.col("data")).alias("text"))


@query
def decoded_text(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d)


@query
def encoded_text(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("record_id", F.hex(alphabet.text_to_codes(F.col("text"))).alias("codes"))


@query
def cleaned_text(spark: SparkSession, d: str) -> DataFrame:
    """Symbol cleaning over raw texts: upper case, gaps and white space deleted."""
    return table(spark, d, "documents").select("doc_id", F.md5(alphabet.clean(F.col("text"))).alias("cleaned"))


@query
def canonical_length(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("record_id", F.length(F.translate("text", alphabet.UNKNOWN, "")).alias("n"))


@query
def rna_reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("record_id", F.md5(alphabet.to_rna(alphabet.reverse_complement(F.col("text")))).alias("digest"))


@query
def window_totals(spark: SparkSession, d: str) -> DataFrame:
    return kmers.kmer_vectors(records(spark, d), 6).select("record_id", "total")


@query
def valid_records(spark: SparkSession, d: str) -> DataFrame:
    return kmers.kmer_vectors(records(spark, d), 12).where("total > 0").select("record_id")


@query
def monomer_counts(spark: SparkSession, d: str) -> DataFrame:
    return kmers.kmer_counts(kmers.kmer_vectors(records(spark, d), 1))


@query
def kmer_counts_2(spark: SparkSession, d: str) -> DataFrame:
    return kmers.kmer_counts(kmers.kmer_vectors(records(spark, d), 2))


@query
def kmer_counts_3(spark: SparkSession, d: str) -> DataFrame:
    return kmers.kmer_counts(kmers.kmer_vectors(records(spark, d), 3))


@query
def kmer_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Each 4-mer of the table in letters, its number and occurrences."""
    words = texts(spark, d).select(F.explode(alphabet.windows(F.col("text"), 4)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return words.select("kmer", alphabet.kmer_to_index(F.col("kmer")).alias("kmer_index"), "n")


@query
def canonical_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = kmers.kmer_counts(kmers.kmer_vectors(records(spark, d), 5, canonical=True)).groupBy("kmer").agg(F.sum("n").alias("n"))
    return counts.select(alphabet.index_to_kmer(F.col("kmer"), 5).alias("kmer"), "n")


@query
def kmer_freqs(spark: SparkSession, d: str) -> DataFrame:
    return kmers.kmer_freqs(kmers.kmer_vectors(records(spark, d), 3))


@query
def record_entropy(spark: SparkSession, d: str) -> DataFrame:
    return kmers.record_entropy(kmers.kmer_vectors(records(spark, d), 3)).select("record_id", six("entropy"))


@query
def unique_content(spark: SparkSession, d: str) -> DataFrame:
    """Names that share content collapse to the greatest of them."""
    rows = table(spark, d, "seq_array").where("length(data) > 0 and seqid is not null")
    return rows.groupBy(F.md5("data").alias("content")).agg(F.max("seqid").alias("seqid"), F.count(F.lit(1)).alias("n"))


@query
def store_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "seq_array").where("length(data) > 0")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.md5("data")).alias("n_unique"), F.countDistinct("seqid").alias("n_names"))


@query
def chunk_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Equal runs of the ids, the remainder to the first."""
    ranked, total = ranking.global_rank(records(spark, d).select("record_id"), ["record_id"])
    return ranked.groupBy(ranking.chunk_of("rank", total, 7).cast("int").alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_id"))


@query
def seeded_limit(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 records of a seeded order."""
    return records(spark, d).select("record_id", F.md5(F.concat(F.lit(SEED), F.col("record_id").cast("string"))).alias("place")).orderBy("place", "record_id").limit(50)


def long_sets(spark: SparkSession, d: str) -> DataFrame:
    return jsd.long_form(set_vectors(spark, d), ["set_id", "member", "name"])


@query
def set_sums(spark: SparkSession, d: str) -> DataFrame:
    return jsd.set_sums(long_sets(spark, d), ["set_id"]).select("set_id", "kmer", six("total"))


@query
def set_divergence(spark: SparkSession, d: str) -> DataFrame:
    return jsd.set_divergence(long_sets(spark, d), ["set_id"]).select("set_id", "size", six("summed_entropies"), six("total_jsd"), six("mean_jsd"))


@query
def set_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    return jsd.leave_one_out(long_sets(spark, d), ["set_id"]).select("set_id", "member", six("entropy"), six("delta_jsd"), six("total_jsd"))


@query
def set_statistics(spark: SparkSession, d: str) -> DataFrame:
    stats = jsd.set_statistics(jsd.leave_one_out(long_sets(spark, d), ["set_id"]), ["set_id"])
    return stats.select("set_id", "size", "lowest", six("mean_delta_jsd"), six("std_delta_jsd"))


@query
def set_cov(spark: SparkSession, d: str) -> DataFrame:
    stats = jsd.set_statistics(jsd.leave_one_out(long_sets(spark, d), ["set_id"]), ["set_id"])
    return stats.select("set_id", F.round("cov_delta_jsd", 4).alias("cov_delta_jsd"))


def replaced(spark: SparkSession, d: str) -> DataFrame:
    """Members of each set held against the set before it."""
    members = long_sets(spark, d)
    return jsd.replaced_divergence(members, ["set_id"], members.withColumn("set_id", F.col("set_id") - 1))


@query
def replaced_divergence(spark: SparkSession, d: str) -> DataFrame:
    return replaced(spark, d).select("set_id", "member", "name", six("replaced_jsd"))


@query
def increasing_candidates(spark: SparkSession, d: str) -> DataFrame:
    sets = jsd.set_divergence(long_sets(spark, d), ["set_id"])
    return jsd.increases_divergence(replaced(spark, d), sets, ["set_id"]).select("set_id", "member", "name", six("replaced_jsd"))


@query
def pairwise_divergence(spark: SparkSession, d: str) -> DataFrame:
    return jsd.pairwise_divergence(long_sets(spark, d), ["set_id"]).select("set_id", "member_a", "member_b", six("jsd"))


@query
def euclidean_distances(spark: SparkSession, d: str) -> DataFrame:
    return distance.euclidean_distances(set_vectors(spark, d), ["set_id"]).select("set_id", "member_a", "member_b", six("distance"))


@query
def nearest_member(spark: SparkSession, d: str) -> DataFrame:
    near = distance.nearest(distance.euclidean_distances(set_vectors(spark, d), ["set_id"]), ["set_id"])
    return near.select("set_id", "member", "nearest", six("distance"))


@query
def kmer_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct hashes of each record: how many, the least and the greatest."""
    s = kmers.sketches(records(spark, d), SKETCH_K, None)
    return s.where(F.size("sketch") > 0).select("record_id", F.size("sketch").alias("n"), F.element_at("sketch", 1).alias("least"), F.element_at("sketch", -1).alias("greatest"))


@query
def bottom_sketches(spark: SparkSession, d: str) -> DataFrame:
    s = kmers.sketches(records(spark, d), SKETCH_K, SKETCH_SIZE)
    return s.select("record_id", F.posexplode("sketch").alias("place", "hash"))


def set_sketches(spark: SparkSession, d: str, canonical: bool = False, k: int = SKETCH_K, size: int = SKETCH_SIZE) -> DataFrame:
    members = set_data(spark, d).withColumn("key", F.struct("set_id", "member"))
    return kmers.sketches(members, k, size, "key", canonical=canonical).select("key.set_id", "key.member", "sketch").where(F.size("sketch") > 0)


@query
def sketch_jaccard(spark: SparkSession, d: str) -> DataFrame:
    pairs = distance.pairs_within(set_sketches(spark, d), ["set_id"], "sketch")
    return pairs.select("set_id", "member_a", "member_b", hashing.jaccard(F.col("a"), F.col("b")).alias("jaccard")).select("set_id", "member_a", "member_b", six("jaccard"))


@query
def mash_distances(spark: SparkSession, d: str) -> DataFrame:
    return distance.mash_distances(set_sketches(spark, d), ["set_id"], SKETCH_K, SKETCH_SIZE).select("set_id", "member_a", "member_b", six("distance"))


@query
def canonical_mash_distances(spark: SparkSession, d: str) -> DataFrame:
    return distance.mash_distances(set_sketches(spark, d, True), ["set_id"], SKETCH_K, SKETCH_SIZE).select("set_id", "member_a", "member_b", six("distance"))


@query
def default_mash_distances(spark: SparkSession, d: str) -> DataFrame:
    """With the k and the sketch size that distances have by default."""
    return distance.mash_distances(set_sketches(spark, d, k=12, size=3000), ["set_id"], 12, 3000).select("set_id", "member_a", "member_b", six("distance"))


def ordered_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).withColumn("place", F.md5(F.concat(F.lit(SEED), "seqid")))


@query
def nmost(spark: SparkSession, d: str) -> DataFrame:
    return selection.select_nmost(ordered_vectors(spark, d), "seqid", ["place", "seqid"], 64, 10).select("seqid", six("delta_jsd"), six("total_jsd"))


@query
def nmost_chunked(spark: SparkSession, d: str) -> DataFrame:
    return selection.select_nmost(ordered_vectors(spark, d), "seqid", ["place", "seqid"], 64, 10, chunks=8).select("seqid", six("delta_jsd"), six("total_jsd"))


@query
def max_stdev(spark: SparkSession, d: str) -> DataFrame:
    return selection.select_max(ordered_vectors(spark, d), "seqid", ["place", "seqid"], 64, 5, 30, "stdev", chunks=8).select("seqid", six("delta_jsd"), six("total_jsd"))


@query
def max_cov(spark: SparkSession, d: str) -> DataFrame:
    return selection.select_max(ordered_vectors(spark, d), "seqid", ["place", "seqid"], 64, 5, 30, "cov", chunks=8).select("seqid", six("delta_jsd"), six("total_jsd"))


@query
def nmost_with_included(spark: SparkSession, d: str) -> DataFrame:
    """The selection and the least seqid, which is to be included."""
    rows = ordered_vectors(spark, d)
    least = rows.agg(F.min("seqid")).first()[0]
    chosen = selection.select_nmost(rows, "seqid", ["place", "seqid"], 64, 10, chunks=8)
    return selection.with_included(chosen, rows, "seqid", [least] if least else [], 64).select("seqid", six("delta_jsd"), six("total_jsd"))


def named_texts(spark: SparkSession, d: str) -> DataFrame:
    """record_id, batch_id and letters of records with symbols."""
    return table(spark, d, "seq_array").where("length(data) > 0").select("record_id", "batch_id", alphabet.codes_to_text(F.col("data")).alias("seq"))


def scratch(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"


@query
def fasta_records(spark: SparkSession, d: str) -> DataFrame:
    """Records written as FASTA, lines of 60 symbols, and read again."""
    path = scratch(spark)
    lines = F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n")
    named_texts(spark, d).select(F.concat(F.lit(">"), F.col("record_id").cast("string"), F.lit(" a record\n"), lines)).write.text(path)
    return files.read_fasta(spark, path).select("name", F.md5("seq").alias("seq"))


@query
def genbank_records(spark: SparkSession, d: str) -> DataFrame:
    """Records written in the GenBank format and read again."""
    path = scratch(spark)
    text = F.concat(F.lit("LOCUS       R"), F.col("record_id").cast("string"), F.lit(" DNA\nORIGIN\n        1 "), F.regexp_replace(F.lower("seq"), "(.{10})", "$1 "), F.lit("\n//"))
    named_texts(spark, d).select(text).write.text(path)
    return files.read_genbank(spark, path).select("name", F.md5("seq").alias("seq"))


@query
def whole_file_records(spark: SparkSession, d: str) -> DataFrame:
    """A file for each batch, whose records are joined by the barrier when it is read."""
    path = scratch(spark)
    rows = named_texts(spark, d).select("batch_id", "record_id", F.concat(F.lit(">"), F.col("record_id").cast("string"), F.lit("\n"), F.col("seq")).alias("value"))
    rows.repartition(9, "batch_id").sortWithinPartitions("batch_id", "record_id").drop("record_id").write.partitionBy("batch_id").text(path)
    return files.one_row_a_file(files.read_fasta(spark, f"{path}/*")).select(F.md5("seq").alias("seq"), F.length("seq").alias("n"))


@query
def last_named_records(spark: SparkSession, d: str) -> DataFrame:
    """One file of records under their seqids, in order: of a name that comes again the last record counts."""
    path = scratch(spark)
    rows = table(spark, d, "seq_array").where("length(data) > 0 and seqid is not null").orderBy("record_id").coalesce(1)
    rows.select(F.concat(F.lit(">"), F.col("seqid"), F.lit("\n"), alphabet.codes_to_text(F.col("data")))).write.text(path)
    return files.last_of_name(files.read_fasta(spark, path)).select("name", F.md5("seq").alias("seq"))


@query
def stored_contents(spark: SparkSession, d: str) -> DataFrame:
    """Records encoded, put into a store, and read from it by name: digest of the content, and metadata."""
    path = scratch(spark)
    rows = table(spark, d, "seq_array").where("length(data) > 0 and seqid is not null").select(F.col("seqid").alias("name"), alphabet.codes_to_text(F.col("data")).alias("seq"))
    store.put(store.encoded(rows, source="t"), path)
    return store.get_store(spark, path).select("seqid", F.md5("data").alias("content"), F.col("metadata")["source"].alias("source"))


@query
def written_selection(spark: SparkSession, d: str) -> DataFrame:
    """The selection as it is read from the tab-separated file it was written to."""
    path = scratch(spark)
    files.write_selection(nmost(spark, d), path)
    return spark.read.option("sep", "\t").option("header", True).schema("names string, delta_jsd double").csv(path)


@query
def written_trees(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    files.write_newick(euclidean_trees(spark, d), path)
    return spark.read.text(path).withColumnRenamed("value", "newick")


@query
def probe_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances of all pairs of the probes' records, by the public operation."""
    probes = table(spark, d, "knn_probe").select("seqid").distinct()
    first = table(spark, d, "seq_array").join(F.broadcast(probes), "seqid", "left_semi").groupBy("seqid").agg(F.min_by("data", "record_id").alias("data"))
    return api.pairwise_distance(first, "euclidean", 3).select("member_a", "member_b", six("distance"))


@query
def degapped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(alphabet.degap(F.col("text"))).alias("text"))


@query
def euclidean_trees(spark: SparkSession, d: str) -> DataFrame:
    return cluster.trees(distance.euclidean_distances(set_vectors(spark, d), ["set_id"]), "set_id")


@query
def mash_trees(spark: SparkSession, d: str) -> DataFrame:
    return cluster.trees(distance.mash_distances(set_sketches(spark, d), ["set_id"], SKETCH_K, SKETCH_SIZE), "set_id")


@query
def tree_merges(spark: SparkSession, d: str) -> DataFrame:
    return cluster.tree_merges(distance.euclidean_distances(set_vectors(spark, d), ["set_id"]), "set_id").select("set_id", "step", "left_members", "right_members", six("height"))


@query
def set_names(spark: SparkSession, d: str) -> DataFrame:
    """Members of stored sets by name: how often each is a member, and in how many sets."""
    return set_members(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("set_id").alias("sets"))


@query
def stored_sets(spark: SparkSession, d: str) -> DataFrame:
    """Stored statistics of past selections against those made anew from the vectors: equal to 6 decimals or not."""
    stats = jsd.set_statistics(jsd.leave_one_out(long_sets(spark, d), ["set_id"]), ["set_id"])
    old = table(spark, d, "summed_records").select("set_id", F.col("total_jsd").alias("old_total"), F.col("lowest_index").alias("old_lowest"), F.col("mean_delta_jsd").alias("old_mean"), F.col("std_delta_jsd").alias("old_std"))

    def close(a: str, b: str) -> F.Column:
        return F.abs(F.col(a) - F.col(b)) < 1e-6

    same = old.join(stats, "set_id", "left")
    return same.select("set_id", close("old_total", "total_jsd").alias("total"), (F.col("old_lowest") == F.col("lowest")).alias("lowest"), close("old_mean", "mean_delta_jsd").alias("mean"), close("old_std", "std_delta_jsd").alias("std"))


@query
def store_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Stored entries by source and moltype, written alike: entries and distinct digests."""
    rows = table(spark, d, "zarr_store").select(F.lower(F.col("metadata")["source"]).alias("source"), F.lower(F.col("metadata")["moltype"]).alias("moltype"), F.lower("seqid_to_hash").alias("digest"))
    return rows.groupBy("source", "moltype").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("digest").alias("n_unique"))


@query
def stored_records(spark: SparkSession, d: str) -> DataFrame:
    """Records whose content the store holds, under whichever name."""
    held = table(spark, d, "zarr_store").select(F.lower("seqid_to_hash").alias("digest")).where("digest is not null").distinct()
    return table(spark, d, "seq_array").select("record_id", F.substring(F.md5("data"), 1, 16).alias("digest")).join(held, "digest", "left_semi").select("record_id", "digest")
