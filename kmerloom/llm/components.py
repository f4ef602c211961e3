"""Connected components by repeated joins: smallest label of the neighbourhood, then pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) of every end of an edge; root is the smallest id of its component.

    Each round every node takes the smallest root among its neighbours' and hands it to its own root, then roots jump
    to their roots; a component of diameter d is done in about log2 d rounds. Rounds are cut by checkpoints.
    """
    both = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).where("x <> y").distinct())
    labels = cut(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("root")).withColumnRenamed("x", "id"))

    def roots() -> object:
        # roots never rise, so an equal sum is an equal labelling
        return labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]

    total = roots()
    while True:
        near = both.join(labels.withColumnRenamed("id", "y"), "y").groupBy("x").agg(F.min("root").alias("near"))
        seen = labels.join(near, labels.id == near.x, "left").select("id", "root", F.least("root", F.coalesce("near", "root")).alias("new"))
        # a node's old root learns the smaller root its members saw
        offered = seen.select(F.col("id").alias("id"), "new").unionByName(seen.select(F.col("root").alias("id"), "new")).groupBy("id").agg(F.min("new").alias("root"))
        up = offered.select(F.col("id").alias("p"), F.col("root").alias("up"))
        jumped = offered.join(up, offered.root == up.p, "left").select("id", F.least("root", F.coalesce("up", "root")).alias("root"))
        labels = cut(jumped)
        before, total = total, roots()
        if total == before:
            return labels
