"""Divergence of a growing set, kept up to date by a stream.

The total divergence of a set needs the sums of its frequencies, the sum of its entropies and its size only; a stream
keeps these as sums by k-mer, so its state does not grow with the records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kmerloom.operators.jsd import g
from kmerloom.operators.kmers import _vectors


def record_stream(stream: DataFrame, k: int, key: str = "seqid", data: str = "data") -> DataFrame:
    """key, kmer (null for the row of the record itself), value: frequencies and entropy of each record of a stream."""
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(F.col(key).alias("key"), F.col(data).alias("data"))
    v = rows.mapInArrow(lambda b: _vectors(b, k, 4, False), f"key {kind}, total bigint, idx array<bigint>, cnt array<bigint>").where("total > 0")
    entropy = F.aggregate("cnt", F.lit(0.0).cast("double"), lambda a, n: a + g(n / F.col("total")))
    freqs = F.transform(F.arrays_zip(F.col("idx"), F.col("cnt")), lambda z: F.struct(z.idx.alias("kmer"), (z.cnt / F.col("total")).alias("value")))
    own = F.array(F.struct(F.lit(None).cast("bigint").alias("kmer"), entropy.alias("value")))
    return v.select(F.col("key").alias(key), F.inline(F.concat(own, freqs)))


def running_sums(stream: DataFrame, k: int, key: str = "seqid", data: str = "data") -> DataFrame:
    """kmer, total, records: the state of the set so far; kmer null has the sum of entropies and the number of records."""
    return record_stream(stream, k, key, data).groupBy("kmer").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("records"))


def divergence_of_sums(sums: DataFrame) -> DataFrame:
    """size, summed_entropies, total_jsd of running_sums() as they stand."""
    whole = sums.where("kmer is null").select(F.col("records").alias("size"), F.col("total").alias("summed_entropies"))
    # one row against the k-mers of the state
    h = sums.where("kmer is not null").join(F.broadcast(whole)).groupBy("size", "summed_entropies").agg(F.sum(g(F.col("total") / F.col("size"))).alias("h"))
    return h.select("size", "summed_entropies", (F.col("h") - F.col("summed_entropies") / F.col("size")).alias("total_jsd"))


def start_running(stream: DataFrame, k: int, out: str, checkpoint: str, key: str = "seqid", data: str = "data") -> StreamingQuery:
    """Writes size, summed_entropies and total_jsd after each micro-batch to out/batch=N; a batch that is repeated replaces its own row."""

    def write(sums: DataFrame, batch: int) -> None:
        divergence_of_sums(sums).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return running_sums(stream, k, key, data).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
