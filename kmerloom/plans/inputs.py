"""The tables as inputs of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "seq_array").select("record_id", "data")


def vectors(spark: SparkSession, folder: str, length: int = 64) -> DataFrame:
    """seqid, kfreqs: one row for each seqid with a usable vector of that length."""
    rows = table(spark, folder, "kmer_seq").select("seqid", "kfreqs").where((F.size("kfreqs") == length) & ~F.isnan(F.col("kfreqs")[0]) & F.col("seqid").isNotNull())
    return rows.groupBy("seqid").agg(F.min("kfreqs").alias("kfreqs"))


def set_members(spark: SparkSession, folder: str) -> DataFrame:
    """set_id, member (place in the set, from 0), name of each member of the stored sets."""
    return table(spark, folder, "summed_records").select("set_id", F.posexplode("seqids").alias("member", "name"))


def set_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """set_id, member, name, kfreqs of each member with a usable vector."""
    return set_members(spark, folder).join(vectors(spark, folder).withColumnRenamed("seqid", "name"), "name").select("set_id", "member", "name", "kfreqs")


def set_data(spark: SparkSession, folder: str) -> DataFrame:
    """set_id, member, data of each member: the first record of its name."""
    named = set_members(spark, folder)
    first = table(spark, folder, "seq_array").where("seqid is not null").join(named.select(F.col("name").alias("seqid")).distinct(), "seqid", "left_semi").groupBy("seqid").agg(F.min(F.struct("record_id", "data")).getField("data").alias("data"))
    return named.join(first.withColumnRenamed("seqid", "name"), "name").select("set_id", "member", "data")
