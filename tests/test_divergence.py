"""Sets: divergence, contributions, selection, distances and trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.operators import cluster, distance, jsd, selection

MEMBERS = [[0, 1, 2, 3], [0, 1, 2, 2, 3], [3, 0, 0]]


def freqs(s):
    return [s.count(i) / len(s) for i in range(4)]


def members(spark, seqs=MEMBERS, first=0):
    rows = [(1, first + i, f"n{first + i}", freqs(s)) for i, s in enumerate(seqs)]
    return jsd.long_form(spark.createDataFrame(rows, "set_id int, member int, name string, kfreqs array<double>"), ["set_id", "member", "name"])


def test_literals(spark):
    total = jsd.set_divergence(members(spark), ["set_id"]).first()
    assert abs(total.total_jsd - 0.31174344844038515) < 1e-12 and total["size"] == 3
    rows = {r.member: r for r in jsd.leave_one_out(members(spark), ["set_id"]).collect()}
    assert np.allclose([rows[i].entropy for i in range(3)], [2.0, 1.9219280948873623, 0.9182958340544896])
    assert np.allclose([rows[i].delta_jsd for i in range(3)], [-0.09602255461972087, -0.013445832597674734, 0.2931216853661194])
    stats = jsd.set_statistics(jsd.leave_one_out(members(spark), ["set_id"]), ["set_id"]).first()
    assert stats.lowest == 0 and abs(stats.mean_delta_jsd - 0.061217766049574594) < 1e-12 and abs(stats.std_delta_jsd - 0.20503487410866827) < 1e-12


def test_replaced(spark):
    queries = members(spark, [[0, 1, 2, 1]], 7).unionByName(members(spark, [MEMBERS[0]]))
    got = {r.name: r.replaced_jsd for r in jsd.replaced_divergence(members(spark), ["set_id"], queries).collect()}
    x = np.array([freqs([0, 1, 2, 1]), freqs(MEMBERS[1]), freqs(MEMBERS[2])])
    h = lambda v: -(v * np.log2(np.where(v > 0, v, 1))).sum(-1)
    assert abs(got["n7"] - (h(x.mean(0)) - h(x).mean())) < 1e-12 and got["n0"] == 0.0
    up = jsd.increases_divergence(jsd.replaced_divergence(members(spark), ["set_id"], queries), jsd.set_divergence(members(spark), ["set_id"]), ["set_id"])
    assert [r.name for r in up.collect()] == ["n7"]


def test_one_member(spark):
    row = jsd.leave_one_out(members(spark, MEMBERS[:1]), ["set_id"]).first()
    assert row.delta_jsd is None and abs(row.total_jsd) < 1e-12


def test_pairwise_divergence(spark):
    rows = jsd.pairwise_divergence(members(spark, [[0], [1], [0, 1]]), ["set_id"]).collect()
    assert {(r.member_a, r.member_b): round(r.jsd, 9) for r in rows} == {(0, 1): 1.0, (0, 2): 0.311278124, (1, 2): 0.311278124}


def vector_rows(n=60, seed=3):
    x = np.random.default_rng(seed).dirichlet(np.full(8, 0.3), n)
    return [(f"r{i:03d}", i, row.tolist()) for i, row in enumerate(x)]


def plain_fold(rows, least, most, stat):
    """The selection by full recomputation in every step."""
    h = lambda v: -(v * np.log2(np.where(v > 0, v, 1))).sum(-1)
    total = lambda m: h(np.mean([v for _, v in m], 0)) - np.mean([h(v) for _, v in m])
    deltas = lambda m: np.array([total(m) - total(m[:i] + m[i + 1 :]) for i in range(len(m))])
    value = lambda m: deltas(m).std(ddof=1) / (1 if stat == "stdev" else deltas(m).mean())
    m = [(n, np.array(v)) for n, _, v in rows[:least]]
    for n, _, v in rows[least:]:
        low = int(deltas(m).round(12).argmin())
        swapped = m[:low] + m[low + 1 :] + [(n, np.array(v))]
        if total(swapped) > total(m) + 2.3e-16:
            if most is not None and len(m) >= most:
                m = swapped
            elif value(m + [(n, np.array(v))]) > value(m):
                m = m + [(n, np.array(v))]
    return {n for n, _ in m}


@pytest.mark.parametrize(("least", "most", "stat"), [(5, 5, "stdev"), (4, 9, "stdev"), (4, 9, "cov"), (3, None, "stdev")])
def test_fold(spark, least, most, stat):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "name string, ord int, kfreqs array<double>")
    got = selection.select(df, "name", ["ord"], 8, least, most, stat).collect()
    assert {r.name for r in got} == plain_fold(rows, least, most, stat)


def test_chunks(spark):
    rows = vector_rows(41)
    df = spark.createDataFrame(rows, "name string, ord int, kfreqs array<double>")
    parts = [rows[:11], rows[11:21], rows[21:31], rows[31:]]  # the remainder goes to the first
    done = []
    for p in parts:
        keep = selection.fold(iter([(n, np.array(v)) for n, _, v in p]), 5, 5, "stdev")
        done += [(n, 0, v) for n, v in zip(keep.ids, keep.x)]
    final = selection.fold(iter([(n, np.array(v)) for n, _, v in done]), 5, 5, "stdev")
    got = selection.select_nmost(df, "name", ["ord"], 8, 5, chunks=4).collect()
    assert {r.name for r in got} == set(final.ids)
    assert selection.select_nmost(df, "name", ["ord"], 8, 5, chunks=100).count() <= 5


def test_selection_edges(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 2, None), ("c", 3, [0.0, 1.0]), ("a", 4, [0.5, 0.5])], "name string, ord int, kfreqs array<double>")
    assert {r.name for r in selection.select_nmost(df, "name", ["ord"], 2, 3).collect()} == {"a", "c"}
    assert selection.select_nmost(df.limit(0), "name", ["ord"], 2, 3).collect() == []
    for bad in (lambda: selection.select_nmost(df, "name", ["ord"], 2, 1), lambda: selection.select_max(df, "name", ["ord"], 2, 5, 3), lambda: selection.select_max(df, "name", ["ord"], 2, 2, 3, "mad")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        selection.with_included(df, df, "name", ["zz"], 2)


def test_total_never_falls():
    rows = [(n, np.array(v)) for n, _, v in vector_rows(80, 5)]
    last = -1.0
    for i in range(5, 80):
        total = selection.fold(iter(rows[:i]), 5, 5, "stdev").total
        assert total >= last - 1e-12
        last = total


def test_distances_and_tree(spark):
    rows = [(1, n, v) for n, v in zip("abcd", ([0.0, 0.0], [0.0, 1.0], [5.0, 5.0], [5.0, 6.5]))]
    df = spark.createDataFrame(rows, "set_id int, member string, kfreqs array<double>")
    d = distance.euclidean_distances(df, ["set_id"])
    assert d.count() == 6 and cluster.trees(d, "set_id").first().newick == "((a,b),(c,d));"
    assert {(r.member, r.nearest) for r in distance.nearest(d, ["set_id"]).collect()} == {("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")}
    heights = [r.height for r in cluster.tree_merges(d, "set_id").orderBy("step").collect()]
    assert heights[:2] == [1.0, 1.5] and abs(heights[2] - np.mean([np.hypot(5, 5), np.hypot(5, 6.5), np.hypot(5, 4), np.hypot(5, 5.5)])) < 1e-9
    full = distance.symmetric(d, ["set_id"])
    assert full.count() == 16 and full.where("member_a = member_b and distance = 0").count() == 4


def test_average_linkage_against_plain():
    rng = np.random.default_rng(2)
    x = rng.random((30, 4))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    groups = {i: [i] for i in range(30)}
    for step, (a, b, height, size) in enumerate(cluster.average_linkage(d)):
        best = min(((np.mean(d[np.ix_(groups[p], groups[q])]), p, q) for p in groups for q in groups if p < q))
        assert abs(best[0] - height) < 1e-9 and {a, b} == {best[1], best[2]}
        groups[30 + step] = groups.pop(a) + groups.pop(b)
        assert size == len(groups[30 + step])


def test_chunks_have_equal_sizes(spark):
    from kmerloom.operators.ranking import chunk_of, global_rank

    df = spark.range(10).select(((F.col("id") * 7) % 10).alias("k"))
    ranked, total = global_rank(df, ["k"])
    assert total == 10 and {(r.k, r["rank"]) for r in ranked.collect()} == {(i, i) for i in range(10)}
    sizes = [r["count"] for r in ranked.groupBy(chunk_of("rank", 10, 3).alias("c")).count().orderBy("c").collect()]
    assert sizes == [4, 3, 3]
    assert ranked.select(chunk_of("rank", 10, 25)).distinct().count() == 10
