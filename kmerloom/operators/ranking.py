"""Global ranks and equal chunks without passing all rows through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.session import cut


def global_rank(df: DataFrame, keys: list[str], rank: str = "rank") -> tuple[DataFrame, int]:
    """df with the 0-based rank of each row by keys (which must be unique together), and the number of rows.

    Rows are range-partitioned and ranked within their partition; only the sizes of the partitions, one number each,
    come to the driver, to be added as offsets.
    """
    parts = max(8, df.sparkSession.sparkContext.defaultParallelism)
    ranged = cut(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    sizes = {r._part: r.n for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    offset = df.sparkSession.createDataFrame(offsets, "_part int, _offset bigint")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return ranged.join(F.broadcast(offset), "_part").withColumn(rank, F.col("_offset") + place).drop("_part", "_offset"), total


def chunk_of(rank: str, total: int, chunks: int) -> F.Column:
    """1-based chunk of a 0-based rank: sizes differ by at most one, the remainder goes to the first chunks."""
    size, more = divmod(total, chunks)
    head = more * (size + 1)
    r = F.col(rank)
    return F.when(r < head, F.floor(r / (size + 1)) + 1).otherwise(more + F.floor((r - head) / max(size, 1)) + 1).cast("bigint")
