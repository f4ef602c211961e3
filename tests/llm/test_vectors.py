"""Clusters, selection, neighbours and counts (problems 1, 2, 5 and 6) against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerloom.llm import clusters, components, neighbours, nn_graph, term_counts, varied

NAN = float("nan")


def blobs(seed=1, sizes=(300, 120, 40, 6, 4), noise=30, length=16):
    rng = np.random.default_rng(seed)
    centres = rng.dirichlet(np.full(length, 0.5), len(sizes))
    x = [np.abs(c + rng.normal(0, 0.008, (n, length))) for c, n in zip(centres, sizes)]
    x = np.concatenate([*x, rng.dirichlet(np.full(length, 0.4), noise)])
    x /= x.sum(1, keepdims=True)
    x = np.concatenate([x, x[:40], x[:1].repeat(25, 0)])  # copies
    return [f"s{i:04d}" for i in rng.permutation(len(x))], x


def table(spark, names, x):
    rows = [(n, v.tolist(), "a", 0.5) for n, v in zip(names, x)]
    rows += [(names[0], x[0].tolist(), "b", None)] * 3  # repeated rows
    rows += [("null", None, "a", 0.1), ("nan", [NAN] * x.shape[1], "a", 0.1), ("short", [1.0], "a", 0.1), (None, x[1].tolist(), "a", 0.1)]
    return spark.createDataFrame(rows, "seqid string, kfreqs array<double>, source string, delta_jsd double")


@pytest.fixture(scope="module")
def data(spark):
    names, x = blobs()
    return names, x, table(spark, names, x).cache()


@pytest.fixture(scope="module")
def small_leaves():
    """Leaves and blocks small enough that several are made."""
    m = pytest.MonkeyPatch()
    m.setattr(nn_graph, "LEAF", 60)
    m.setattr(nn_graph, "BLOCK", 120)
    m.setattr(clusters, "SPARSE_BALL", 16)
    yield
    m.undo()


@pytest.fixture(scope="module")
def graph(data, small_leaves):
    return nn_graph.build_graph(nn_graph.usable_vectors(data[2], 16), 16)


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def chains(names, x, reach, least):
    near, left, out = distances(x) <= reach, set(range(len(x))), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            i = todo.pop()
            group.append(i)
            new = [j for j in np.flatnonzero(near[i]) if j in left]
            left -= set(new)
            todo += new
        if len(group) >= least:
            out |= {names[i]: min(names[j] for j in group) for i in group}
    return out


def test_graph_has_several_leaves(graph):
    assert graph.depth >= 3 and graph.count == 500


def test_clusters(data, graph):
    for reach in (0.04, 0.08, 0.3):
        got = {r.name: r.cluster_key for r in clusters.cluster_of_names(graph, reach).collect()}
        assert got == chains(data[0], data[1], reach, 5)


def test_links_that_the_graph_lacks_are_found(data, graph):
    """Without any link of the graph the check alone gives the clusters."""
    labels = graph.nodes.select("id", F.col("id").alias("comp"))
    roots = components.connected_components(clusters.missing_links(graph, labels, 0.08))
    named = graph.members.join(roots, "id", "left").select("name", F.coalesce("root", "id").alias("c")).collect()
    groups = {}
    for r in named:
        groups.setdefault(r.c, []).append(r.name)
    assert {n: min(g) for g in groups.values() if len(g) >= 5 for n in g} == chains(data[0], data[1], 0.08, 5)


@pytest.mark.parametrize("by", [0.0, 2e-9, -2e-9])
def test_reach_is_told_in_double_precision(spark, by):
    """Two groups of copies that only a distance of reach, more or less, would make a cluster."""
    a = np.full(16, 1 / 16)
    step = np.zeros(16)
    step[3], step[9] = 1, -1
    b = a + step * (0.08 + by) / np.sqrt(2)
    rows = [(f"{n}{i}", v.tolist(), "x", 0.0) for n, v in (("a", a), ("b", b)) for i in range(3)]
    g = nn_graph.build_graph(nn_graph.usable_vectors(spark.createDataFrame(rows, "seqid string, kfreqs array<double>, source string, delta_jsd double"), 16), 16)
    joined = bool(np.sqrt(((a - b) ** 2).sum()) <= 0.08)
    assert len(clusters.cluster_of_names(g).collect()) == (6 if joined else 0)
    labels = g.nodes.select("id", F.col("id").alias("comp"))
    assert bool(clusters.missing_links(g, labels).count()) == joined


def test_leaves_beyond_what_trees_are_fitted_with(data, small_leaves, monkeypatch):
    """Slices by rank take the place of deeper trees."""
    monkeypatch.setattr(nn_graph, "MAX_DEPTH", 1)
    g = nn_graph.build_graph(nn_graph.usable_vectors(data[2], 16), 16)
    assert g.depth >= 3 and g.nodes.select("home").distinct().count() == 1 << g.depth
    sizes = [r["count"] for r in g.nodes.groupBy("home").count().collect()]
    assert max(sizes) <= 2 * nn_graph.LEAF
    got = {r.name: r.cluster_key for r in clusters.cluster_of_names(g).collect()}
    assert got == chains(data[0], data[1], 0.08, 5)


def test_descriptions(data, graph):
    got = {r.cluster_key: r for r in clusters.descriptions(graph).collect()}
    truth = chains(data[0], data[1], 0.08, 5)
    assert {k: r["size"] for k, r in got.items()} == {k: list(truth.values()).count(k) for k in set(truth.values())}
    assert all(truth[n] == k for k, r in got.items() for n in r.typical) and all(1 <= len(r.typical) <= 3 for r in got.values())
    parts = clusters.descriptions(graph, by="community", least=1).collect()
    assert sum(r["size"] for r in parts) == len(data[0])


def test_communities_are_settled(graph):
    """No two communities are left whose union would raise modularity, nor on the first level a node whose move would."""
    pairs = clusters.links(graph).cache()
    of = {r.id: r.community for r in clusters.communities(graph, pairs).collect()}
    assert len(of) == graph.count
    links = [(r.a, r.b, 1 - 0.5 * r.d / 0.08) for r in pairs.where(F.col("rank") < clusters.LINKS).collect()]
    links += [(b, a, w) for a, b, w in links]
    degree = {}
    for a, _, w in links:
        degree[a] = degree.get(a, 0) + w
    whole = sum(degree.values())

    def sums(of):
        total, between = {}, {}
        for a, w in degree.items():
            total[of[a]] = total.get(of[a], 0) + w
        for a, b, w in links:
            between[of[a], of[b]] = between.get((of[a], of[b]), 0) + w
        return total, between

    total, between = sums(of)
    assert all(w <= total[a] * total[b] / whole + 1e-6 for (a, b), w in between.items() if a != b)
    edges = pairs.sparkSession.createDataFrame(links, "x bigint, y bigint, w double")
    of = {r.id: r.c for r in clusters.local_moving(edges).collect()}
    total, to = sums(of)[0], {}
    for a, b, w in links:
        to[a, of[b]] = to.get((a, of[b]), 0) + w
    stays = {a: to.get((a, of[a]), 0) - degree[a] * (total[of[a]] - degree[a]) / whole for a in degree}
    assert not [a for (a, c), w in to.items() if c != of[a] and w - degree[a] * total[c] / whole > stays[a] + 1e-6]


def test_local_moving_by_joins_and_in_a_task(spark, monkeypatch):
    """A ring of cliques: each is one community, whichever way the level is moved."""
    links = [(7 * q + i, 7 * q + j, 1.0) for q in range(6) for i in range(7) for j in range(i)] + [(7 * q, (7 * q + 8) % 42, 0.5) for q in range(6)]
    edges = spark.createDataFrame(links + [(b, a, w) for a, b, w in links] + [(3, 3, 0.25)], "x bigint, y bigint, w double").cache()
    held = {r.id: r.c for r in clusters.local_moving(edges).collect()}
    monkeypatch.setattr(clusters, "HELD_EDGES", 0)
    joined = {r.id: r.c for r in clusters.local_moving(edges).collect()}
    assert held == joined
    assert len({(i // 7, c) for i, c in held.items()}) == len(set(held.values())) == 6


def test_clusters_keep_the_driver_small(data, small_leaves, monkeypatch):
    """The forest is fitted in a task, clusters need no passes of joins over a large graph, balls come part by part."""

    def at_the_driver(*_):
        raise AssertionError

    monkeypatch.setattr(nn_graph.Forest, "fit", at_the_driver)
    monkeypatch.setattr(clusters, "local_moving", at_the_driver)
    monkeypatch.setattr(clusters, "HELD_EDGES", 2048)
    monkeypatch.setattr(clusters, "MAX_BALLS", 20)
    g = nn_graph.build_graph(nn_graph.usable_vectors(data[2], 16), 16)
    for reach in (0.04, 0.08):
        got = {r.name: r.cluster_key for r in clusters.cluster_of_names(g, reach).collect()}
        assert got == chains(data[0], data[1], reach, 5)


def test_rounds_of_descent_leave_no_files(data, small_leaves, monkeypatch):
    """Garbage is collected after the leaves and after each round, however many there are."""
    done = []
    descend, collect = nn_graph.descend, nn_graph.collect_garbage
    monkeypatch.setattr(nn_graph, "descend", lambda *x: done.append("round") or descend(*x))
    monkeypatch.setattr(nn_graph, "collect_garbage", lambda s: done.append("collected") or collect(s))
    nn_graph.build_graph(nn_graph.usable_vectors(data[2], 16), 16)
    assert done[0] == "collected" and done[1:] == ["round", "collected"] * (len(done) // 2) and len(done) > 2


@pytest.mark.parametrize("n", [1, 9, 400])
def test_chains_of_a_block(n):
    rng = np.random.default_rng(n)
    ids = np.sort(rng.choice(10**6, n + 1, replace=False))
    links = {(int(min(p)), int(max(p))) for p in rng.choice(ids, (n, 2)) if p[0] != p[1]} | {(int(ids[0]), int(ids[-1]))}
    links |= set(zip(ids[n // 2 :].tolist(), ids[n // 2 + 1 :].tolist()))  # a long chain
    least = {i: i for ij in links for i in ij}
    for _ in least:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    t = clusters._chained(pa.table({"a": [a for a, _ in links], "b": [b for _, b in links]}))
    assert dict(zip(t.column("id").to_pylist(), t.column("community").to_pylist())) == least


def nearest(names, x, i, k):
    d = np.round(distances(x)[i] if len(x) < 2000 else np.sqrt(((x - x[i]) ** 2).sum(1)), 9)
    return [names[j] for j in sorted(range(len(x)), key=lambda j: (d[j], names[j])) if j != i][:k]


def test_probe_neighbours(spark, data, graph):
    names, x, _ = data
    wanted = [(names[i],) for i in range(0, len(names), 7)] + [(names[0],), ("nobody",), (None,)]
    got = {}
    for r in neighbours.probe_neighbours(graph, spark.createDataFrame(wanted, "name string")).collect():
        got.setdefault(r.name, set()).add(r.other)
    truth = {names[i]: set(nearest(names, x, i, 10)) for i in range(0, len(names), 7)}
    assert set(got) == set(truth)
    assert np.mean([len(got[n] & truth[n]) / 10 for n in truth]) >= 0.98


def test_all_neighbours(data, graph):
    names, x, _ = data
    got = {r.name: r.neighbours for r in neighbours.all_neighbours(graph).collect()}
    assert set(got) == set(names) and all(len(set(v)) == 10 and k not in v for k, v in got.items())
    hits = [len(set(got[n]) & set(nearest(names, x, i, 10))) / 10 for i, n in enumerate(names)]
    assert np.mean(hits) >= 0.95
    # a node of 25 copies and more: its least names, in order
    copies = sorted(n for n, v in zip(names, x) if np.array_equal(v, x[0]))
    assert got[copies[-1]] == copies[:10] and got[copies[0]] == copies[1:11]


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    names, x = blobs()
    df = table(spark, names, x)
    few = df.where(F.col("seqid").isin(names[1 : n + 1])) if n else df.limit(0)
    g = nn_graph.build_graph(nn_graph.usable_vectors(few, 16), 16)
    assert len(neighbours.all_neighbours(g).collect()) == n
    assert clusters.cluster_of_names(g).collect() == [] and clusters.descriptions(g).collect() == []
    assert len(neighbours.probe_neighbours(g, spark.createDataFrame([(names[1],)], "name string")).collect()) == max(0, n - 1)


def requests(spark, rows):
    return spark.createDataFrame(rows, "request_id int, n_wanted int, source string")


def test_varied(spark, data):
    names, x, df = data
    asked = [(1, 10, None), (2, 4, "a"), (3, 10_000, None), (4, 5, "nowhere"), (5, 0, None), (6, None, None), (7, 1, None), (8, 2, "b")]
    rows = varied.choose_varied(df, requests(spark, asked), 16).collect()
    by = {}
    for r in rows:
        by.setdefault(r.request_id, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {1: 10, 2: 4, 3: len(names), 7: 1}
    assert all(len({r.seqid for r in v}) == len(v) for v in by.values())
    at = dict(zip(names, x))
    h = lambda v: -(v * np.log2(np.where(v > 0, v, 1))).sum(-1)
    chosen = np.array([at[r.seqid] for r in by[1]])
    total = h(chosen.mean(0)) - h(chosen).mean()
    assert all(abs(r.total_jsd - total) < 1e-8 for r in by[1])
    assert len(np.unique(chosen.round(12), axis=0)) == 10
    rng = np.random.default_rng(0)
    assert total > np.mean([h(x[i].mean(0)) - h(x[i]).mean() for i in (rng.choice(len(x), 10, replace=False) for _ in range(50))])
    rest = np.delete(chosen, 0, 0)
    assert abs(by[1][0].delta_jsd - (total - (h(rest.mean(0)) - h(rest).mean()))) < 1e-9


def test_varied_is_the_same_however_rows_are_stored(spark, data, monkeypatch):
    df, asked = data[2], [(1, 5, None), (2, 40, "a"), (3, 12, "a")]
    monkeypatch.setattr(varied, "PART", 64)
    got = [sorted((r.request_id, r.seqid) for r in varied.choose_varied(x, requests(spark, asked), 16).collect()) for x in (df.coalesce(1), df.repartition(3, "seqid"), df.orderBy(F.desc("seqid")).repartition(17))]
    assert got[0] == got[1] == got[2] and len(got[0]) == 57


def test_varied_is_nearly_as_divergent_as_the_fold(spark, data):
    from kmerloom.operators.selection import fold

    x = np.unique(data[1], axis=0)
    for n in (5, 20):
        best = fold(iter(enumerate(np.random.default_rng(1).permutation(x))), n, n, "stdev").total
        assert varied.choose_varied(data[2], requests(spark, [(1, n, None)]), 16).first().total_jsd > 0.85 * best


def test_varied_edges(spark, data):
    _, _, df = data
    assert varied.choose_varied(df, requests(spark, []), 16).collect() == []
    assert varied.choose_varied(df.limit(0), requests(spark, [(1, 5, None)]), 16).collect() == []


def test_quotas_are_a_cheapest_flow():
    import itertools

    capacity = {(0, 0): 5, (0, 1): 3, (1, 0): 1, (2, 1): 2}

    def cost(room, share, wanted):
        part, out = max(1, (share or wanted) // 4), []
        return [0] * min(room, share) + [1 + i // part for i in range(max(0, room - share))] if room else out

    def price(q, wanted):
        total = 0
        for at, names in ((0, {0, 1, 2}), (1, {0, 1})):
            for name in names:
                share = wanted * name if at else -(-wanted // len(names))
                used, room = sum(v for k, v in q.items() if k[at] == name), min(wanted, sum(v for k, v in capacity.items() if k[at] == name))
                total += sum(cost(room, share, wanted)[:used])
        return total

    for wanted in range(1, 12):
        got = varied.quotas(capacity, wanted)
        assert sum(got.values()) == min(wanted, 11) and all(v <= capacity[k] for k, v in got.items())
        every = [dict(zip(capacity, q)) for q in itertools.product(*(range(c + 1) for c in capacity.values())) if sum(q) == min(wanted, 11)]
        assert price(got, wanted) == min(price(q, wanted) for q in every)


def test_term_counts(spark):
    rng = np.random.default_rng(5)
    counts = {f"r{i}": rng.poisson(0.4 if i % 3 else 2, 32) for i in range(90)}
    counts = {k: c if c.sum() else c + 1 for k, c in counts.items()}
    rows = [(k, (c / c.sum()).tolist(), i) for i, (k, c) in enumerate(counts.items())]
    rows += [rows[3]] * 5 + [("nul", None, 0), ("nan", [NAN] * 32, 0), ("len", [1.0] * 31, 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "seqid string, kfreqs array<double>, term int").repartition(5)
    got = {r.kmer_index: r for r in term_counts.term_counts(df, 32, rare=30, common=60).collect()}
    for t in range(32):
        n = sum(c[t] > 0 for c in counts.values())
        total = sum(int(c[t] // np.gcd.reduce(c)) for c in counts.values())
        if not n:
            assert t not in got
            continue
        mark = "rare" if 100 * n < 30 * 90 else "common" if 100 * n > 60 * 90 else None
        assert (got[t].records, got[t].occurrences, got[t].mark) == (n, total, mark)
    assert term_counts.term_counts(df.limit(0), 32).collect() == []


def test_whole_counts_of_large_least_counts():
    rng = np.random.default_rng(9)
    made = [np.array([332, 332, 331]), np.array([65, 66]), np.array([9973, 10007, 19979])] + [rng.integers(65, 3000, n) for n in (2, 5, 40, 300) for _ in range(20)]
    for c in made:
        assert term_counts.whole_counts(c / c.sum()).tolist() == (c // np.gcd.reduce(c)).tolist()
    # no total of moderate size
    assert term_counts.whole_counts(np.array([1, np.pi, np.e]) / (1 + np.pi + np.e)).tolist() == [1, 3, 3]


def test_components(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000)]
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.id: r.root for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {a: root(a) for e in edges for a in e if e[0] != e[1]}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
