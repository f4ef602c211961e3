"""The sequence store: a folder of two Parquet tables, names with their metadata, and each distinct content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions.alphabet import degap, text_to_codes, to_dna
from kmerloom.session import cut
from kmerloom.sources import files

#: Fewer inputs than this are not worth a selection.
LEAST_INPUTS = 5


def encoded(rows: DataFrame, name: str = "name", seq: str = "seq", moltype: str = "dna", source: str = "unknown") -> DataFrame:
    """seqid, data (encoded, without gaps), content (digest), metadata: rows with no symbol are an error of the put."""
    if moltype not in ("dna", "rna"):
        raise ValueError(f"unknown moltype {moltype!r}")
    text = degap(F.col(seq))
    data = text_to_codes(to_dna(text) if moltype == "rna" else text)
    return rows.select(F.col(name).alias("seqid"), data.alias("data")).select(
        "seqid", "data", F.md5("data").alias("content"), F.create_map(F.lit("moltype"), F.lit(moltype), F.lit("source"), F.concat(F.lit(f"{source}:"), "seqid")).alias("metadata")
    )


def put(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write encoded() rows, one a name (the least content of a name that comes twice, with its metadata).

    Content that several names share is stored once. A name that is there already keeps what it has when rows are
    appended. Empty data is an error.
    """
    if mode not in ("errorifexists", "overwrite", "append"):
        raise ValueError(f"unknown mode {mode!r}")
    if rows.where(F.coalesce(F.length("data"), F.lit(0)) == 0).limit(1).count():
        raise ValueError("records without symbols cannot be stored")
    names = rows.groupBy("seqid").agg(F.min_by(F.struct("content", "metadata"), F.struct("content", F.to_json("metadata"))).alias("m")).select("seqid", "m.*")
    if mode == "append":
        names = names.join(rows.sparkSession.read.parquet(f"{path}/names").select("seqid"), "seqid", "left_anti")
    names = cut(names)
    data = rows.select("content", "data").join(names.select("content"), "content", "left_semi").dropDuplicates(["content"])
    if mode == "append":
        data = data.join(rows.sparkSession.read.parquet(f"{path}/data").select("content"), "content", "left_anti")
    # content first: names never point to what is not there
    cut(data).write.mode(mode).option("compression", "zstd").parquet(f"{path}/data")
    names.write.mode(mode).parquet(f"{path}/names")


def get_store(spark: SparkSession, path: str) -> DataFrame:
    """seqid, data, content, metadata of the store, read when they are used; a folder without a store is an error."""
    return spark.read.parquet(f"{path}/names").join(spark.read.parquet(f"{path}/data"), "content").select("seqid", "data", "content", "metadata")


def contains(store: DataFrame, seqid: str) -> bool:
    return bool(store.where(F.col("seqid") == seqid).limit(1).count())


def size(store: DataFrame) -> int:
    return store.count()


def num_unique(store: DataFrame) -> int:
    """Number of distinct contents."""
    return store.select("content").distinct().count()


def seqids(store: DataFrame) -> DataFrame:
    return store.select("seqid")


def unique_seqids(store: DataFrame) -> DataFrame:
    """content, seqid: of names that share content the greatest."""
    return store.groupBy("content").agg(F.max("seqid").alias("seqid"))


def unique_rows(store: DataFrame) -> DataFrame:
    return store.join(unique_seqids(store).select("seqid"), "seqid", "left_semi")


def get(store: DataFrame, seqid: str) -> DataFrame:
    """The row of a name; a name that is not there is an error."""
    row = store.where(F.col("seqid") == seqid)
    if not row.limit(1).count():
        raise KeyError(seqid)
    return row


def seeded_order(seed: int | str) -> F.Column:
    """A place for each seqid that depends on the seed only."""
    return F.md5(F.concat(F.lit(str(seed)), F.col("seqid")))


def seeded_limit(store: DataFrame, limit: int, seed: int | str = 0) -> DataFrame:
    """The first `limit` names of the seeded order; only names are ordered."""
    kept = store.select("seqid", seeded_order(seed).alias("place")).orderBy("place", "seqid").limit(limit).select("seqid")
    return store.join(F.broadcast(kept) if limit <= 100_000 else kept, "seqid", "left_semi")


def prep(spark: SparkSession, source: str, path: str, kind: str, moltype: str = "dna", whole_files: bool = False, limit: int | None = None, seed: int = 0, overwrite: bool = False) -> DataFrame:
    """Read sequence files, clean, encode and write the store; at least LEAST_INPUTS names, else an error."""
    rows = files.read_sequences(spark, source, kind)
    named = files.one_row_a_file(rows) if whole_files else files.last_of_name(rows)
    ready = encoded(named, moltype=moltype, source=source.rstrip("/").rpartition("/")[2])
    if ready.select("seqid").limit(LEAST_INPUTS).count() < LEAST_INPUTS:
        raise ValueError(f"at least {LEAST_INPUTS} sequences are needed")
    if limit:
        ready = seeded_limit(ready, limit, seed)
    put(ready, path, "overwrite" if overwrite else "errorifexists")
    return get_store(spark, path)
