"""Near-duplicate records with small edits (problem 3).

Method: inverted index of positional signature bytes with count filtering. Records with the same set of k-mers form a
class, of which only the smallest record is indexed, so copies cost nothing. Each class has BANDS index keys (place and
bytes, see kmer_sets). Pairs of classes are tallied by the keys they share; a pair of the threshold's similarity shares
LEAST or more but for a chance of 9e-6, and pairs whose sizes alone exclude the threshold are not tallied. What reaches
the minimum is verified exactly on the records themselves. The index is kept in bundles and paired in tasks (see
shared_keys); the list of a key that many classes share is cut, so that no task pairs more than HOT entries of it at once.

The plain index of all k-mers, with the minimum number of shared k-mers that the threshold guarantees, is exact but
grows with the square of the table: at 1,206 records 16 % of all pairs already share a k-mer.

Defined cases: null and empty data and records without a k-mer of canonical codes are in no pair; null ids are left
out; records of equal content are pairs with each other; repeated rows of one id count once; no other column is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.components import connected_components
from kmerloom.llm.kmer_sets import DESCRIBED, LEAST, describe, verify
from kmerloom.llm.shared_keys import PACKED, bundles, describe_packed, shared_pairs
from kmerloom.session import collect_garbage, cut, spread

#: Rows of a class with many members are spread over so many salts.
SALTS = 16
#: Entries of one key that are taken at once on one side of its pairs.
HOT = 1000


def salts() -> F.Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))


def salt(column: str) -> F.Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS).cast("bigint"))


def described(df: DataFrame, key: str = "record_id", data: str = "data", more: list[str] | None = None) -> DataFrame:
    """id, n, digest and keys of rows with a k-mer, and further columns as they are."""
    more = more or []
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(data).alias("data"), *more).where("id is not null and length(data) > 0")
    return spread(rows).mapInArrow(describe, DESCRIBED + "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in more))


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, same: whether the sets are equal) of the pairs (a, b) at or above the threshold; left and right have (id, data)."""
    full = (
        pairs.join(right.select(F.col("id").alias("b"), F.col("data").alias("data_b")), "b")
        .join(left.select(F.col("id").alias("a"), F.col("data").alias("data_a")), "a")
        .select("a", "b", "data_a", "data_b")
    )
    return full.mapInArrow(verify, "a bigint, b bigint, same boolean")


def class_pairs(df: DataFrame, key: str = "record_id", data: str = "data") -> tuple[DataFrame, DataFrame]:
    """(members: id, rep), (pairs of representatives: a < b), both materialised."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(data).alias("data")).where("id is not null and length(data) > 0")
    full = cut(spread(rows).mapInArrow(describe_packed, PACKED))
    reps = full.groupBy("digest").agg(F.min("id").alias("rep"))
    members = cut(full.select("id", "digest").distinct().join(reps, "digest").select("id", "rep"))
    own = members.where("id = rep").select("id").distinct()
    index = bundles(full.join(own, "id", "left_semi").dropDuplicates(["id"]), own.count())
    del full, reps, rows
    collect_garbage(df.sparkSession)  # the descriptions are in the index
    tally = shared_pairs(index, LEAST, HOT)
    del index
    collect_garbage(df.sparkSession)
    source = df.select(F.col(key).cast("bigint").alias("id"), F.col(data).alias("data")).where("id is not null")
    needed = tally.select(F.col("a").alias("id")).unionByName(tally.select(F.col("b").alias("id"))).distinct()
    source = source.join(needed, "id", "left_semi").dropDuplicates(["id"])
    return members, cut(verified(tally, source, source).select("a", "b"))


def near_duplicate_pairs(df: DataFrame, key: str = "record_id", data: str = "data") -> DataFrame:
    """All pairs key_a < key_b at or above the threshold, copies included."""
    members, pairs = class_pairs(df, key, data)
    # a class with itself (its copies) and with each similar class; both orders of members come from least and greatest
    several = members.groupBy("rep").count().where("count > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    left = members.select(F.col("rep").alias("a"), F.col("id").alias("x"), salt("id").alias("s"))
    right = members.select(F.col("rep").alias("b"), F.col("id").alias("y"), salt("id").alias("s"))
    return (
        pairs.unionByName(several)
        .withColumn("s", salts())
        .join(left, ["a", "s"])
        .drop("s")
        .withColumn("s", salts())
        .join(right, ["b", "s"])
        .where((F.col("a") < F.col("b")) | (F.col("x") < F.col("y")))
        .select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))
    )


def near_duplicate_groups(df: DataFrame, key: str = "record_id", data: str = "data") -> DataFrame:
    """One row for each record in a group: its key, group_id (smallest key of the group) and number of links to other texts."""
    members, pairs = class_pairs(df, key, data)
    roots = connected_components(pairs)
    degree = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    several = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    named = several.join(roots.withColumnRenamed("id", "rep"), "rep", "left").join(degree, "rep", "left").where("root is not null or copies > 1")
    return members.join(named, "rep").select(F.col("id").alias(key), F.coalesce("root", "rep").alias("group_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))
