"""Files, the store, the public operations, the command line and the stream."""

import random

import pytest
from pyspark.sql import functions as F

from kmerloom import api, cli
from kmerloom.operators import jsd, kmers
from kmerloom.sources import files, store
from kmerloom.streaming import running


def write_fasta(path, rows):
    path.write_text("".join(f">{n} some words\n{s[:60]}\n{s[60:]}\n" for n, s in rows))
    return str(path)


def sequences(n=8, size=200, seed=1):
    rng = random.Random(seed)
    return [(f"seq{i}", "".join(rng.choices("ACGT", weights=[1 + i, 2, 3, 1], k=size))) for i in range(n)]


@pytest.mark.parametrize(("suffix", "kind"), [("fa", "fasta"), (".fasta.gz", "fasta"), ("GBK", "genbank"), ("gbff.bz2", "genbank"), ("txt", None), ("gz", None), ("", None)])
def test_format(suffix, kind):
    assert files.sequence_format(suffix) == kind


def test_fasta(spark, tmp_path):
    path = write_fasta(tmp_path / "x.fa", [("a", "ac-gT nn"), ("b|1", "TTTT")])
    assert {(r.name, r.seq) for r in files.read_fasta(spark, path).collect()} == {("a", "ACGTNN"), ("b|1", "TTTT")}
    (tmp_path / "empty.fa").write_text("")
    assert files.read_fasta(spark, str(tmp_path / "empty.fa")).collect() == []


def test_genbank(spark, tmp_path):
    text = "LOCUS       AB123 12 bp DNA\nDEFINITION  x\nORIGIN\n        1 acgtac gtacgt\n//\nLOCUS       CD456 4 bp\nORIGIN\n        1 tttt\n//\n"
    (tmp_path / "x.gb").write_text(text)
    assert {(r.name, r.seq) for r in files.read_genbank(spark, str(tmp_path / "x.gb")).collect()} == {("AB123", "ACGTACGTACGT"), ("CD456", "TTTT")}
    with pytest.raises(ValueError):
        files.read_sequences(spark, "x", "embl")


def test_whole_files(spark, tmp_path):
    write_fasta(tmp_path / "one.fasta", [("a", "AACC"), ("b", "GGTT")])
    rows = files.one_row_a_file(files.read_fasta(spark, str(tmp_path))).collect()
    assert [(r.name, r.seq) for r in rows] == [("one", "AACC-GGTT")]
    codes = store.encoded(spark.createDataFrame([("a", "AC-GT")], "name string, seq string"))
    assert bytes(codes.first().data) == bytes([2, 1, 3, 0])


def test_names_option(tmp_path):
    (tmp_path / "names.txt").write_text("a\nb\n\nc\n")
    assert files.names_option("a,b,c") == files.names_option(str(tmp_path / "names.txt")) == ["a", "b", "c"] and files.names_option(None) == []


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("s3", "TGAT"), ("s4", "TGAT"), ("s5", "AC")], "name string, seq string")
    store.put(store.encoded(rows), path)
    s = store.get_store(spark, path)
    assert {r.seqid for r in store.seqids(s).collect()} == {"s3", "s4", "s5"}
    assert {r.seqid for r in store.unique_seqids(s).collect()} == {"s4", "s5"} and store.unique_rows(s).count() == 2
    assert bytes(store.get(s, "s3").first().data) == bytes([0, 3, 2, 0])
    with pytest.raises(KeyError):
        store.get(s, "zz")
    with pytest.raises(Exception, match="exist"):
        store.put(store.encoded(rows), path)
    store.put(store.encoded(rows), path, "append")
    assert store.get_store(spark, path).count() == 3
    with pytest.raises(ValueError):
        store.put(store.encoded(spark.createDataFrame([("x", "---")], "name string, seq string")), str(tmp_path / "y"))
    with pytest.raises(Exception):
        store.get_store(spark, str(tmp_path / "missing"))
    with pytest.raises(ValueError):
        store.encoded(rows, moltype="protein")
    rna = store.encoded(spark.createDataFrame([("x", "UGAU")], "name string, seq string"), moltype="rna").first()
    assert bytes(rna.data) == bytes([0, 3, 2, 0]) and rna.metadata["moltype"] == "rna"


def test_store_keeps_a_content_once(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("s3", "TGAT"), ("s4", "TGAT"), ("s5", "AC"), ("s5", "GG")], "name string, seq string")
    store.put(store.encoded(rows, source="one"), path)
    store.put(store.encoded(spark.createDataFrame([("s3", "CCC"), ("s6", "AC"), ("s7", "TTT")], "name string, seq string"), source="two"), path, "append")
    s = store.get_store(spark, path)
    got = {r.seqid: (bytes(r.data), r.metadata["source"]) for r in s.collect()}
    kept = min((b"\x02\x01", b"\x03\x03"), key=lambda d: __import__("hashlib").md5(d).hexdigest())
    assert got == {"s3": (b"\x00\x03\x02\x00", "one:s3"), "s4": (b"\x00\x03\x02\x00", "one:s4"), "s5": (kept, "one:s5"), "s6": (b"\x02\x01", "two:s6"), "s7": (b"\0\0\0", "two:s7")}
    assert spark.read.parquet(path + "/data").count() == store.num_unique(s) and store.size(s) == 5
    assert store.contains(s, "s6") and not store.contains(s, "zz")


def test_ids_and_last_of_name(spark, tmp_path):
    rows = spark.createDataFrame([(None, "a/b/c.fa", "n"), ("", None, "x.y.gz"), ("u.1", "s", "n"), (None, None, None)], "unique_id string, name string, source string")
    assert [r[0] for r in rows.select(files.derived_id(rows)).collect()] == ["c", "x.y", "u", None]
    with pytest.raises(ValueError):
        files.derived_id(spark.createDataFrame([(1,)], "z int"))
    write_fasta(tmp_path / "a.fa", [("x", "A"), ("y", "CC"), ("x", "G")])
    write_fasta(tmp_path / "b.fa", [("y", "TT")])
    assert {(r.name, r.seq) for r in files.last_of_name(files.read_fasta(spark, str(tmp_path))).collect()} == {("x", "G"), ("y", "TT")}


def rows_of(spark, seqs):
    return store.encoded(spark.createDataFrame(seqs, "name string, seq string"))


def test_api(spark):
    seqs = sequences(12)
    s = rows_of(spark, seqs).cache()
    chosen = {r.seqid for r in api.select_nmost(s, 4, 2, seed=5).collect()}
    assert len(chosen) == 4 and chosen == {r.seqid for r in api.select_nmost(s, 4, 2, seed=5).collect()}
    more = {r.seqid for r in api.select_nmost(s, 4, 2, include=["seq0"], seed=5).collect()}
    assert more == chosen | {"seq0"}
    assert 3 <= api.select_max(s, 3, 6, k=2).count() <= 6
    assert api.select_nmost(s, 4, 2, limit=6).count() == 4
    for bad in (lambda: api.select_nmost(s, 13, 2), lambda: api.select_max(s, 5, 3), lambda: api.select_nmost(s, 4, 0), lambda: api.select_nmost(s, 4, 2, include=["zz"]), lambda: api.pairwise_distance(s, "other"), lambda: api.pairwise_distance(s, "mash", sketch_size=None), lambda: api.pairwise_distance(s, canonical=True, moltype="text")):
        with pytest.raises(ValueError):
            bad()


def test_delta_jsd(spark):
    s = rows_of(spark, sequences(5))
    queries = rows_of(spark, [*sequences(7)[4:], ("short", "A")])
    got = {r.seqid: r.delta_jsd for r in api.delta_jsd(s, queries, 3).collect()}
    assert got["seq4"] == 0.0 and got["seq5"] > 0 and got["short"] != got["short"]
    with pytest.raises(ValueError):
        api.delta_jsd(rows_of(spark, [("a", "ACGT"), ("b", "---")]), queries, 3)


def test_included_records_have_contributions_in_the_whole_set(spark):
    s = rows_of(spark, [*sequences(12), ("none", "A")]).cache()
    got = {r.seqid: r.delta_jsd for r in api.select_nmost(s, 4, 2, include=["seq0", "none"], seed=5).collect()}
    assert got.pop("none") is None and 4 <= len(got) <= 5
    long = api.long_members(s.where(F.col("seqid").isin(list(got))), 2)
    whole = {r.member: r.delta_jsd for r in jsd.leave_one_out(long, ["one"]).collect()}
    assert set(whole) == set(got) and all(abs(whole[k] - v) < 1e-12 for k, v in got.items())
    with pytest.raises(Exception, match="fewer than"):
        api.select_nmost(rows_of(spark, [*sequences(3), *[(f"e{i}", "A") for i in range(9)]]), 5, 2, chunks=2).collect()
    with pytest.raises(ValueError):
        api.delta_jsd(s, rows_of(spark, [("short", "A")]), 3, strict=True)


def test_pairs_in_blocks(spark):
    from kmerloom.operators import distance

    s = rows_of(spark, [*sequences(20), ("none", "A")]).cache()
    v = kmers.kmer_vectors(s, 3, "seqid")
    dense = kmers.dense(v, 64, "seqid").select(F.lit(1).alias("one"), F.col("seqid").alias("member"), "kfreqs")
    want = {(r.member_a, r.member_b): r.distance for r in distance.euclidean_distances(dense, ["one"]).collect()}
    got = {(r.member_a, r.member_b): r.distance for r in distance.sparse_euclidean_distances(v.withColumnRenamed("seqid", "member"), 4).collect()}
    assert len(want) == 190 and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_tree_of_families(spark):
    rng = random.Random(2)
    one, two = ("".join(rng.choices("ACGT", k=1500)) for _ in range(2))
    change = lambda s, n: "".join(rng.choice("ACGT") if rng.random() < n else c for c in s)
    s = rows_of(spark, [("a", one), ("b", change(one, 0.01)), ("c", change(one, 0.08)), ("d", two), ("e", change(two, 0.02))]).cache()
    for options in ({"k": 10, "sketch_size": 400}, {"k": 10, "sketch_size": 4_000_000_000}, {"k": 10, "sketch_size": 400, "canonical": True}, {"mode": "euclidean", "k": 5}):
        assert api.cluster_tree(s, **options).first().newick in ("(((a,b),c),(d,e));", "((d,e),((a,b),c));", "((d,e),(c,(a,b)));", "((c,(a,b)),(d,e));")


def test_command_line(spark, tmp_path):
    source = write_fasta(tmp_path / "x.fasta", sequences(9))
    out = str(tmp_path / "store")
    assert cli.main(["prep", source, out]) == 0
    assert cli.main(["nmost", out, str(tmp_path / "n"), "-n", "3", "-k", "2", "--include", "seq1"]) == 0
    names = [r.names for r in spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "n")).collect()]
    assert 3 <= len(names) <= 4 and "seq1" in names
    assert cli.main(["max", out, str(tmp_path / "m"), "--least", "3", "--most", "5", "-k", "2"]) == 0
    assert cli.main(["ctree", out, str(tmp_path / "t"), "--sketch-size", "100"]) == 0
    assert spark.read.text(str(tmp_path / "t")).first()[0].count("seq") == 9
    assert cli.main(["ctree", out, str(tmp_path / "u")]) == 1
    few = write_fasta(tmp_path / "few.fasta", sequences(3))
    assert cli.main(["prep", few, str(tmp_path / "s2")]) == 1


def test_running_divergence(spark, tmp_path):
    seqs = sequences(10)
    parts = tmp_path / "in"
    parts.mkdir()
    for i in range(2):
        rows_of(spark, seqs[i * 5 : i * 5 + 5]).select("seqid", "data").coalesce(1).write.mode("append").parquet(str(parts))
    stream = spark.readStream.schema("seqid string, data binary").option("maxFilesPerTrigger", 1).parquet(str(parts))
    running.start_running(stream, 2, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    rows = {r["size"]: r.total_jsd for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = kmers.kmer_freqs(kmers.kmer_vectors(rows_of(spark, seqs), 2, "seqid"), "seqid").select(F.lit(1).alias("one"), F.col("seqid").alias("member"), "kmer", "freq")
    assert set(rows) == {5, 10} and abs(rows[10] - jsd.set_divergence(whole, ["one"]).first().total_jsd) < 1e-12
