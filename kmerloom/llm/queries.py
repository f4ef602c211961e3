"""The registered queries of problems 1 to 9, each over its whole tables; their SQL is in llm/oracle.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import bpe, clusters, history, leaks, near_duplicates, neighbours, nn_graph, term_counts, varied, visual_form
from kmerloom.llm.oracle import ORACLE_SQL
from kmerloom.session import spread

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def graph(spark: SparkSession, d: str) -> nn_graph.Graph:
    """The neighbour graph of the usable k=3 vectors."""
    return nn_graph.build_graph(nn_graph.usable_vectors(spread(table(spark, d, "kmer_seq").select("seqid", "kfreqs")), 64), 64)


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.cluster_of_names(graph(spark, d)).withColumnRenamed("name", "seqid")


@query
def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical seqids of each cluster."""
    return clusters.descriptions(graph(spark, d))


@query
def p1_communities(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical seqids of each community of the clusters."""
    return clusters.descriptions(graph(spark, d), by="community")


@query
def p2_chosen(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "kmer_seq").select("seqid", "source", "kfreqs", "delta_jsd"))
    return varied.choose_varied(rows, table(spark, d, "selection_request"), 64)


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(table(spark, d, "seq_array"))


@query
def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, d, "seq_array"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return history.not_new(table(spark, d, "seq_array"), table(spark, d, "zarr_store"))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    probes = table(spark, d, "knn_probe").select(F.col("seqid").alias("name"))
    found = neighbours.probe_neighbours(graph(spark, d), probes)
    return found.select(F.least("name", "other").alias("seqid_a"), F.greatest("name", "other").alias("seqid_b")).distinct()


@query
def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.all_neighbours(graph(spark, d)).withColumnRenamed("name", "seqid")


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.term_counts(spread(table(spark, d, "kmer_seq").select("seqid", "kfreqs")), 4096).where("mark is not null").select("kmer_index", "mark")


@query
def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.term_counts(spread(table(spark, d, "kmer_seq").select("seqid", "kfreqs")), 4096)


@query
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(spread(table(spark, d, "documents").select("doc_id", "text")))


@query
def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Decoded ids against the text: rows of each outcome, over all documents."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    back = bpe.decode_ids(bpe.encode_texts(docs)).withColumnRenamed("text", "back")
    return back.join(docs, "doc_id").groupBy((F.coalesce("text", F.lit("")) == F.col("back")).alias("equal")).agg(F.count(F.lit(1)).alias("documents"))


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


@query
def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items"))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return visual_form.lookalike_pairs(spread(table(spark, d, "documents").select("doc_id", "text")))


@query
def p9_form(spark: SparkSession, d: str) -> DataFrame:
    return visual_form.visual_forms(spread(table(spark, d, "documents").select("doc_id", "text"))).select("doc_id", "form")
