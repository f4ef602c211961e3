"""Most similar vectors for every vector, and for chosen ones (problem 5). See nn_graph for the method.

Neighbours are ordered by Euclidean distance rounded to 9 decimals, then by name; names with the same vector are
neighbours at distance 0. Only the `k` + 1 least names of a node can be among k neighbours, so never more are joined.

Defined cases: null, NaN and wrongly long vectors and null names take no part; repeated rows count once; ties are
broken by name; a table of fewer than k + 1 names gives as many neighbours as there are; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.llm.nn_graph import Graph, greedy_search


def least_members(g: Graph, k: int) -> DataFrame:
    """(id, name) of the k + 1 least names of each node."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy("name"))
    return g.members.withColumn("r", rank).where(F.col("r") <= k + 1).select("id", "name")


def probe_neighbours(g: Graph, probes: DataFrame, k: int = 10) -> DataFrame:
    """(name, other, d): the k nearest other names of each name in probes (column name), by greedy search."""
    named = probes.select("name").distinct().join(g.members, "name").select("name", F.col("id").alias("q"))
    found = greedy_search(g, named.select("q").distinct())
    rank = F.row_number().over(Window.partitionBy("name").orderBy("d", "other"))
    others = found.join(least_members(g, k).select(F.col("id").alias("v"), F.col("name").alias("other")), "v")
    return named.join(others, "q").where("name <> other").withColumn("r", rank).where(F.col("r") <= k).select("name", "other", "d")


def all_neighbours(g: Graph, k: int = 10) -> DataFrame:
    """(name, neighbours: array of other names, nearest first) of every name, from the lists of the graph."""
    lists = g.nodes.select("id", F.explode(F.concat(F.array(F.struct(F.lit(0.0).alias("d"), F.col("id").alias("v"))), "nbrs")).alias("e")).select("id", F.round("e.d", 9).alias("d"), F.col("e.v").alias("v"))
    others = lists.join(least_members(g, k).select(F.col("id").alias("v"), F.col("name").alias("other")), "v")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))
    # k + 1 for a node: a name leaves itself out
    nearest = others.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "other"))), lambda e: e.other).alias("near"))
    return g.members.join(nearest, "id").select("name", F.slice(F.array_remove("near", F.col("name")), 1, k).alias("neighbours"))
