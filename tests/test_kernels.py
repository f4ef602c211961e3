"""Kernels, alphabet, k-mers, entropy and hashing against literal answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.functions import alphabet, hashing
from kmerloom.functions.kernels import window_codes
from kmerloom.operators import jsd, kmers

SEQ = [2, 5, 1, 5, 0, 0, 2, 1, 0, 0, 3, 0, 0, 3, 1, 0, 2, 1, 1, 5, 1]


def frame(spark, rows):
    return spark.createDataFrame([(n, None if s is None else bytearray(s)) for n, s in rows], "record_id string, data binary")


def dense(spark, s, k):
    got = {r.kmer: r.n for r in kmers.kmer_counts(kmers.kmer_vectors(frame(spark, [("a", s)]), k)).collect()}
    return [got.get(i, 0) for i in range(4**k)]


def test_counts(spark):
    assert dense(spark, SEQ, 2) == [3, 0, 2, 2, 2, 1, 0, 0, 0, 2, 0, 0, 1, 1, 0, 0]
    assert dense(spark, [0, 1, 2, 0, 0, 1], 1) == [3, 2, 1, 0]


def test_freqs(spark):
    got = {r.kmer: r.freq for r in kmers.kmer_freqs(kmers.kmer_vectors(frame(spark, [("a", [0, 1, 2, 0, 0, 1])]), 2)).collect()}
    assert got == {0: 0.2, 1: 0.4, 6: 0.2, 8: 0.2}


def test_rows_do_not_mix(spark):
    rows = [("a", [0, 1]), ("b", None), ("c", []), ("d", [2]), ("e", [4, 4, 4, 4]), ("f", [3, 3, 3])]
    got = {r.record_id: (r.total, list(r.idx), list(r.cnt)) for r in kmers.kmer_vectors(frame(spark, rows), 2).collect()}
    assert got == {"a": (1, [1], [1]), "b": (0, [], []), "c": (0, [], []), "d": (0, [], []), "e": (0, [], []), "f": (2, [15], [2])}


def test_k_zero(spark):
    with pytest.raises(ValueError):
        kmers.kmer_vectors(frame(spark, [("a", SEQ)]), 0)
    with pytest.raises(ValueError):
        window_codes(np.array([0], np.uint8), np.array([0, 1]), 0)


def test_long_row(spark):
    rng = np.random.default_rng(1)
    s = rng.integers(0, 4, 2_000_000, dtype=np.uint8)
    got = kmers.kmer_vectors(frame(spark, [("a", s.tobytes())]), 3).first()
    assert got.total == len(s) - 2 and sum(got.cnt) == got.total and len(got.idx) == 64


def test_index_and_complement(spark):
    rows = spark.createDataFrame([("AC",), ("TT",), ("GG",), ("NG",), ("NN",)], "k string")
    assert [r[0] for r in rows.select(alphabet.kmer_to_index(F.col("k"))).collect()] == [9, 0, 15, 16, 16]
    assert spark.range(1).select(alphabet.reverse_complement(F.lit("TCAG"))).first()[0] == "CTGA"
    assert spark.range(1).select(alphabet.index_to_kmer(F.lit(9), 3)).first()[0] == "TAC"
    assert spark.range(1).select(alphabet.canonical_kmer(F.lit("GGA"))).first()[0] == "TCC"


def test_text_codes(spark):
    rows = spark.createDataFrame([("TCAG-NX",), ("",), (None,)], "t string")
    got = [r[0] if r[0] is None else bytes(r[0]) for r in rows.select(alphabet.text_to_codes(F.col("t"))).collect()]
    assert got == [bytes([0, 1, 2, 3, 4, 5, 5]), b"", None]
    back = rows.select(alphabet.codes_to_text(alphabet.text_to_codes(F.col("t")))).collect()
    assert [r[0] for r in back] == ["TCAGNNN", "", None]
    assert spark.range(1).select(alphabet.clean(F.lit("ac g-T\r\n1"), digits=True)).first()[0] == "ACGT"


def test_entropy(spark):
    rows = spark.createDataFrame([([0.25, 0.0, 0.25, 0.25, 0.25],)], "v array<double>")
    assert rows.select(jsd.checked_entropy_of(F.col("v"))).first()[0] == 2.0
    for bad in ([0.0, 0.0], [], [0.9, 0.9], [1.9, 0.0]):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad,)], "v array<double>").select(jsd.checked_entropy_of(F.col("v"))).collect()


def test_hash():
    assert hashing.hash_codes(np.array([[0, 1, 2, 3]]))[0] == 1791335831
    assert hashing.hash_codes(np.array([[3] * 12]))[0] == 4240428463
    assert hashing.hash_codes(np.array([[0]]))[0] == 4262010598


def mash(spark, a, b, k, s):
    rows = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    return rows.select(hashing.mash_distance(F.col("a"), F.col("b"), k, s)).first()[0]


def test_mash(spark):
    assert mash(spark, [1, 2, 3], [1, 2, 3], 5, 3) == 0.0
    assert mash(spark, [1, 2, 3], [4, 5, 6], 5, 3) == 1.0
    assert mash(spark, [], [4], 5, 3) == 1.0
    assert mash(spark, [], [], 5, 3) is None
    j = 2 / 4
    assert abs(mash(spark, [1, 2, 3], [2, 3, 4], 5, 4) + np.log(2 * j / (1 + j)) / 5) < 1e-12


def test_canonical_counts_are_strand_free(spark):
    s = [0, 1, 2, 3, 3, 1, 0]
    back = [(x + 2) % 4 for x in s[::-1]]
    got = [(list(r.idx), list(r.cnt)) for r in kmers.kmer_vectors(frame(spark, [("a", s), ("b", back)]), 3, canonical=True).collect()]
    assert got[0] == got[1]


def test_slices_give_the_same(spark, monkeypatch):
    import pyarrow as pa

    from kmerloom.functions import kernels

    rng = np.random.default_rng(3)
    data = [None if n == 7 else rng.integers(0, 5, n, dtype=np.uint8).tobytes() for n in rng.integers(0, 40, 200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(data, pa.binary())], ["id", "data"])
    parts = list(kernels.slices(iter([batch]), limit=60))
    assert len(parts) > 50 and pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict()
    whole = pa.Table.from_batches(kmers._vectors(iter([batch]), 3, 4, False)).to_pydict()
    assert pa.Table.from_batches(kmers._vectors(iter(parts), 3, 4, False)).to_pydict() == whole


def test_hash_of_numbers():
    codes = np.random.default_rng(1).integers(0, 4, (50, 9))
    numbers = (codes * 4 ** np.arange(8, -1, -1)).sum(1)
    assert (hashing.hash_numbers(numbers, 9) == hashing.hash_codes(codes)).all()


def test_linkage_against_all_pairs():
    from kmerloom.operators.cluster import average_linkage

    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 12, 30):
        for kind in range(3):
            d = rng.random((n, n)) if kind else rng.integers(1, 4, (n, n)).astype(float)
            d = (d + d.T) / 2
            held, want = {i: [i] for i in range(n)}, []
            while len(held) > 1:
                h, a, b = min((round(float(np.mean([d[x, y] for x in held[a] for y in held[b]])), 10), a, b) for a in held for b in held if a < b)
                want.append((a, b, h, len(held[a]) + len(held[b])))
                held[n + len(want) - 1] = held.pop(a) + held.pop(b)
            got = average_linkage(d)
            assert [(a, b, s) for a, b, _, s in got] == [(a, b, s) for a, b, _, s in want] and np.allclose([m[2] for m in got], [m[2] for m in want], atol=1e-9)


def test_lengths_and_slices_of_dense_vectors(spark, monkeypatch):
    from kmerloom.operators import kmers

    df = spark.createDataFrame([(i, bytes([i % 4, 1, 2, 3, 0, i % 3])) for i in range(20)], "record_id int, data binary")
    assert df.select(alphabet.codes_to_text(F.col("data"), max_length=3)).first()[0] == "TCA"
    assert bytes(df.select(alphabet.text_to_codes(F.lit("CATG"), max_length=2)).first()[0]) == bytes([1, 2])
    v = kmers.kmer_vectors(df, 2)
    whole = {r.record_id: r.kfreqs for r in kmers.dense(v, 16).collect()}
    monkeypatch.setattr(kmers, "DENSE", 40)
    assert {r.record_id: r.kfreqs for r in kmers.dense(v, 16).collect()} == whole and len(whole) == 20
