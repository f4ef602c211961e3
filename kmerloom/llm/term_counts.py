"""Occurrences and record counts of every term of dense frequency vectors (problem 6).

Method: last-seen counters. Tokens (term, record, occurrences) are hash-partitioned and ordered by record; each
partition keeps for each term its occurrences, its number of records and the last record seen, so a record that is
repeated adds nothing and no set of records is held. Partitions are by record, which spreads every term, however
common, over all partitions; a partition's counters are summed by term afterwards, which moves one row a term and
partition. Rows of one record that stand in one batch are dropped before the shuffle, so a record with very many
repeated rows does not make a large partition.

The number of occurrences in a record is its frequency times the smallest total for which all frequencies of the
record are whole multiples: a few totals are tried, for the others the ratios to the least frequency are written as
fractions (continued fractions), whose least common denominator is the least count. Frequencies of no such total (their
least count would be over MOST) count by their ratios to the least, rounded.

Defined cases: null and NaN vectors, null record names and vectors of another length are not counted; an empty table
gives no rows; a term that occurs nowhere gives no row; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Totals up to so many times 1 / (smallest frequency) are tried before fractions are made.
MULTIPLES = 64
#: Least count of a record up to which double precision tells fractions apart.
MOST = 1_000_000
#: A term in less than RARE of the records is rare, in more than COMMON of them common (parts of 100).
RARE, COMMON = 3, 28


def whole_counts(f: np.ndarray) -> np.ndarray:
    """Occurrences of the non-zero frequencies f of one record."""
    if len(f) == 0:
        return np.empty(0, np.int64)
    unit = 1.0 / f.min()
    for m in range(1, MULTIPLES + 1):
        c = f * (unit * m)
        r = np.rint(c)
        if np.abs(c - r).max() < 1e-6 * max(1.0, r.max()):
            return r.astype(np.int64)
    m = 1
    for ratio in np.unique(f * unit):
        m = math.lcm(m, Fraction(float(ratio)).limit_denominator(MOST).denominator)
        if m > MOST:
            break
    else:
        c = f * (unit * m)
        r = np.rint(c)
        if np.abs(c - r).max() < 1e-6 * max(1.0, r.max()):
            return r.astype(np.int64)
    return np.rint(f * unit).astype(np.int64)


def _sparse(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(record, terms, occurrences) of usable vectors, once a batch for each record."""
    for b in batches:
        seen, names, terms, counts = set(), [], [], []
        vectors = b.column(1)
        values = vectors.flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        for i, name in enumerate(b.column(0).to_pylist()):
            v = values[ends[i] : ends[i + 1]]
            if name in seen or len(v) != length or np.isnan(v).any():
                continue
            seen.add(name)
            at = np.flatnonzero(v)
            names.append(name)
            terms.append(at.astype(np.int32))
            counts.append(whole_counts(v[at]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["record", "terms", "counts"])


def _count(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Last-seen counters over tokens ordered by record; the row of term -1 counts the records themselves."""
    occurrences, records, last = np.zeros(length + 1, np.int64), np.zeros(length + 1, np.int64), np.full(length + 1, -1, np.int64)
    number, name = -1, None
    for b in batches:
        terms, counts = b.column(1), b.column(2)
        ends = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))])
        all_terms, all_counts = terms.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False)
        for i, record in enumerate(b.column(0).to_pylist()):
            if record != name:
                number, name = number + 1, record
            at, n = all_terms[ends[i] : ends[i + 1]], all_counts[ends[i] : ends[i + 1]]
            new = last[at] != number
            occurrences[at[new]] += n[new]
            records[at[new]] += 1
            last[at] = number
            if last[length] != number:
                records[length], last[length] = records[length] + 1, number
    found = np.flatnonzero(records)
    yield pa.RecordBatch.from_arrays([pa.array(np.where(found == length, -1, found), pa.int32()), pa.array(occurrences[found], pa.int64()), pa.array(records[found], pa.int64())], ["term", "occurrences", "records"])


def term_counts(df: DataFrame, length: int, record: str = "seqid", vector: str = "kfreqs", rare: int = RARE, common: int = COMMON) -> DataFrame:
    """kmer_index, occurrences, records and mark ('rare', 'common' or null) of every term that occurs."""
    usable = df.select(F.col(record).alias("record"), F.col(vector).alias("v")).where((F.size("v") == length) & F.col("record").isNotNull())
    tokens = usable.mapInArrow(lambda x: _sparse(x, length), "record string, terms array<int>, counts array<int>")
    n = max(8, df.sparkSession.sparkContext.defaultParallelism)
    partial = tokens.repartition(n, "record").sortWithinPartitions("record").mapInArrow(lambda x: _count(x, length), "term int, occurrences bigint, records bigint")
    # at most `length` + 1 rows from here on
    counted = partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    whole = counted.groupBy().agg(F.max(F.when(F.col("term") == -1, F.col("records"))).alias("total"), F.collect_list(F.when(F.col("term") >= 0, F.struct("term", "occurrences", "records"))).alias("rows"))
    return whole.select("total", F.inline("rows")).select(
        F.col("term").alias("kmer_index"),
        "occurrences",
        "records",
        F.when(100 * F.col("records") < rare * F.col("total"), "rare").when(100 * F.col("records") > common * F.col("total"), "common").alias("mark"),
    )
