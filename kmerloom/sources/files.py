"""Sequence files as DataFrames, and result sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions.alphabet import clean

# File suffixes of the two formats.
SUFFIXES = {"fasta": ("fasta", "mfa", "faa", "fna", "fa"), "genbank": ("genbank", "gbk", "gb", "gbff")}
COMPRESSED = ("gz", "bz2", "zip", "xz", "lzma")
#: Joins the records of a file; it is no canonical symbol, so no k-mer spans two records.
BARRIER = "-"


def sequence_format(suffix: str) -> str | None:
    """'fasta' or 'genbank' of a suffix, with or without dot and a further compression suffix; None for others."""
    parts = suffix.lower().lstrip(".").split(".")
    if len(parts) > 1 and parts[-1] in COMPRESSED:
        parts.pop()
    return next((f for f, known in SUFFIXES.items() if len(parts) == 1 and parts[0] in known), None)


def stem(path: Column) -> Column:
    """File name without folder and suffixes of formats and compression."""
    known = "|".join([*SUFFIXES["fasta"], *SUFFIXES["genbank"]])
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), rf"(?i)\.({known})(\.({'|'.join(COMPRESSED)}))?$", "")


def place() -> Column:
    """Place of a record in its file: start of the split, then the order in it."""
    return F.struct(F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("row")).alias("at")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """path, at (place in the file), name (first word of the header), seq (cleaned): one row a record, split where a line starts with '>'.

    A file is read in splits, each record by the task in whose split it begins, so large files are parallel unless compressed.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("path"), place(), F.regexp_replace("value", "^>", "").alias("value"))
    header, body = F.substring_index("value", "\n", 1), F.regexp_replace("value", r"^[^\n]*\n?", "")
    rows = raw.where(F.length(F.trim("value")) > 0)
    return rows.select("path", "at", F.regexp_extract(header, r"^\s*(\S*)", 1).alias("name"), F.regexp_replace(clean(body), ">", "").alias("seq"))


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """path, at (place in the file), name (of LOCUS), seq (of ORIGIN, cleaned): one row a record, split at the lines '//'."""
    raw = spark.read.option("lineSep", "\n//").text(path).select(F.input_file_name().alias("path"), place(), "value")
    rows = raw.where(F.col("value").rlike(r"(?m)^LOCUS\s"))
    return rows.select("path", "at", F.regexp_extract("value", r"(?m)^LOCUS\s+(\S+)", 1).alias("name"), clean(F.regexp_extract("value", r"(?s)\nORIGIN[^\n]*\n(.*)", 1), digits=True).alias("seq"))


def read_sequences(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind not in SUFFIXES:
        raise ValueError(f"unknown sequence format {kind!r}")
    return (read_fasta if kind == "fasta" else read_genbank)(spark, path)


def one_row_a_file(rows: DataFrame) -> DataFrame:
    """name (of the file), seq: all records of a file, in the order they are read, joined by BARRIER.

    A file becomes one value here, so this is for files of one genome each.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "seq"))), lambda x: x.seq), BARRIER)
    return rows.groupBy("path").agg(joined.alias("seq")).select(stem(F.col("path")).alias("name"), "seq")


def last_of_name(rows: DataFrame) -> DataFrame:
    """name, seq: of records with the same name the last one of the last file, by path."""
    return rows.groupBy("name").agg(F.max_by("seq", F.struct("path", "at")).alias("seq"))


def derived_id(rows: DataFrame) -> Column:
    """The id of a row: the first of its columns unique_id, seqid, name and source with a value, without folder and suffix."""
    known = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("unique_id", "seqid", "name", "source") if c in rows.columns]
    if not known:
        raise ValueError("rows without a column unique_id, seqid, name or source have no id")
    return F.regexp_replace(F.regexp_extract(F.coalesce(*known), r"([^/]*)/*$", 1), r"(?<=.)\.[^.]+$", "")


def names_option(text: str | None) -> list[str]:
    """Names of a comma-separated list, or of the lines of a file."""
    if not text:
        return []
    try:
        with open(text) as f:
            return [x.strip() for x in f if x.strip()]
    except OSError:
        return [x.strip() for x in re.split(r",", text) if x.strip()]


def write_selection(selected: DataFrame, path: str, name: str = "seqid") -> None:
    """A folder with one tab-separated file of names and delta_jsd; a selection is small."""
    selected.select(F.col(name).alias("names"), "delta_jsd").orderBy("names").coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_newick(trees: DataFrame, path: str) -> None:
    trees.select("newick").coalesce(1).write.mode("overwrite").text(path)
