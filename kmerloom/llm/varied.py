"""Choosing a varied subset (problem 2).

Method: quotas by minimum-cost flow. The distinct vectors of a request's pool are aggregated into combinations of two
categories: the kind (the nearest of as many centres as vectors are wanted, which lie far apart) and the band (whether
its divergence from the pool's mean is below the pool's median). A flow of the wanted size runs from kinds through
combinations, whose capacity is their number of distinct vectors, to bands. Every kind has an equal share as its target,
free of cost, and so has the upper band the whole; each further part of a share, and each part of the lower band, costs
more than the one before, so large groups and vectors near the mean are used only where variety runs out. The flow's
amounts are quotas, which are filled by rank: the kind's centre, then divergence from the pool's mean, past delta_jsd,
seqid. A pool with fewer distinct vectors than wanted is taken whole, then filled with copies by seqid.

Centres are found by farthest-first traversal, beginning with the greatest divergence from the mean, in steps: vectors
are parted by their digest into parts of about PART, each part picks its own centres, and picks are parted and traversed
again until one part is left, so rare kinds are seen wherever they lie and the choice does not depend on how rows are
stored. Means and medians are of all distinct vectors of the pool. More than MAX_KINDS wanted share MAX_KINDS kinds,
whose quotas are then of several vectors.

Defined cases: requests for none or a null number choose nothing; a request for more than its pool has gets the pool;
null sources in requests mean all records, requests for unknown sources choose nothing; records with null sources are
in pools of all records only; a seqid with several sources has the least; null, NaN and wrongly long vectors and null
seqids are not chosen; repeated rows count once, with their greatest past delta_jsd; further columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.llm.nn_graph import matrix, usable_vectors, vectors_of
from kmerloom.operators.jsd import leave_one_out
from kmerloom.session import cut

MAX_KINDS = 1024
#: Bound of the bands, as a quantile of the divergence from the mean, which is told to BINS-th parts of a bit.
MEDIAN, BINS = 0.5, 256
#: Vectors that are traversed together, or four times the number of kinds if that is more.
PART = 8192
#: More requests are refused.
MAX_REQUESTS = 1000


def quotas(capacity: dict[tuple[int, int], int], wanted: int) -> dict[tuple[int, int], int]:
    """Amounts of the combinations (kind, band): the minimum-cost flow of the wanted size, or of all there is.

    Successive shortest paths with potentials. The k-th part beyond a category's target costs k, so costs are convex.
    The target of the band 1 is the whole, that of the band 0 nothing, those of the kinds are equal.
    """
    kinds, bands = sorted({a for a, _ in capacity}), sorted({b for _, b in capacity})
    node = {("kind", a): i + 2 for i, a in enumerate(kinds)} | {("band", b): i + 2 + len(kinds) for i, b in enumerate(bands)}
    graph: list[list[list[int]]] = [[] for _ in range(len(node) + 2)]  # arcs: to, capacity, cost, place of the reverse

    def arc(u: int, v: int, room: int, cost: int) -> list[int]:
        graph[u].append([v, room, cost, len(graph[v])])
        graph[v].append([u, 0, -cost, len(graph[u]) - 1])
        return graph[u][-1]

    def category(u: int, v: int, room: int, share: int) -> None:
        arc(u, v, min(room, share), 0)
        part, cost, room = max(1, (share or wanted) // 4), 1, room - share
        while room > 0:
            arc(u, v, min(part, room), cost)
            room, cost = room - part, cost + 1

    for kind, names, at in (("kind", kinds, 0), ("band", bands, 1)):
        for x in names:
            share = -(-wanted // max(1, len(names))) if at == 0 else wanted * x
            room = min(wanted, sum(c for k, c in capacity.items() if k[at] == x))
            category(*((0, node[kind, x]) if at == 0 else (node[kind, x], 1)), room, share)
    middle = {(a, b): arc(node["kind", a], node["band", b], min(c, wanted), 0) for (a, b), c in sorted(capacity.items())}
    price, left = [0] * len(graph), min(wanted, sum(capacity.values()))
    while left > 0:
        dist, via = [1 << 60] * len(graph), [None] * len(graph)
        dist[0], heap = 0, [(0, 0)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in graph[u]:
                if e[1] > 0 and (n := d + e[2] + price[u] - price[e[0]]) < dist[e[0]]:
                    dist[e[0]], via[e[0]] = n, (u, e)
                    heapq.heappush(heap, (n, e[0]))
        if via[1] is None:
            break
        price = [p + min(d, dist[1]) for p, d in zip(price, dist)]
        step, v = left, 1
        while v:
            step, v = min(step, via[v][1][1]), via[v][0]
        v = 1
        while v:
            u, e = via[v]
            e[1] -= step
            graph[v][e[3]][1] += step
            v = u
        left -= step
    return {k: graph[e[0]][e[3]][1] for k, e in middle.items() if graph[e[0]][e[3]][1]}


def divergence(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return np.round((x * np.log2(np.where(x > 0, x, 1) / np.where(mean > 0, mean, 1))).sum(1), 9)


def far_centres(x: np.ndarray, count: int, mean: np.ndarray) -> np.ndarray:
    """Farthest-first traversal from the vector of the greatest divergence; all vectors if they are no more than count."""
    if len(x) <= count:
        return x
    chosen = [int(divergence(x, mean).argmax())]
    d = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < count and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _per_request(b: pa.RecordBatch, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(request, its rows, their vectors) of a batch of (h, vec, requests)."""
    x, wanted = matrix(b.column(1), np.float64, length), b.column(2)
    row, request = np.repeat(np.arange(len(x)), wanted.value_lengths().to_numpy()), wanted.flatten().to_numpy()
    for r in np.unique(request):
        own = row[request == r]
        yield int(r), own, x[own]


def _moments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(request, key, value) to be summed: keys from 0 the vector elements, key `length` the number of vectors."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for r, _, y in _per_request(b, length):
            s = sums.setdefault(r, np.zeros(length + 1))
            s[:length] += y.sum(0)
            s[-1] += len(y)
    for r, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), r), pa.int64()), pa.array(range(len(s)), pa.int32()), pa.array(s)], ["request", "key", "value"])


def _picks(t: pa.Table, kinds: dict[int, int], means: dict[int, np.ndarray], length: int) -> pa.Table:
    """(h, vec, rs) of the far centres of a part, by request; the order of rows does not matter."""
    t = t.sort_by("h").combine_chunks()
    wanted: dict[int, list[int]] = {}
    for b in t.to_batches():
        for r, own, y in _per_request(b, length):
            at = {v.tobytes(): i for i, v in zip(own, y)}
            for v in far_centres(y, kinds[r], means[r]):
                wanted.setdefault(int(at[v.tobytes()]), []).append(r)
    rows = sorted(wanted)
    return pa.table({"h": t.column("h").take(pa.array(rows, pa.int64())), "vec": t.column("vec").take(pa.array(rows, pa.int64())), "rs": pa.array([wanted[i] for i in rows], pa.list_(pa.int64()))})


def describe_pools(distinct: DataFrame, kinds: dict[int, int], length: int) -> dict[int, dict]:
    """Centres and mean of each request's pool; as many centres as `kinds` says."""
    picks = distinct.select("h", "vec", "rs")
    sums: dict[int, dict[int, float]] = {}
    for x in picks.mapInArrow(lambda b: _moments(b, length), "request bigint, key int, value double").groupBy("request", "key").agg(F.sum("value").alias("value")).collect():
        sums.setdefault(x.request, {})[x.key] = x.value
    # sums differ in their last digits by the order of rows
    means = {r: np.round(np.array([s[i] for i in range(length)]) / s[length], 12) for r, s in sums.items()}
    number, most = distinct.count(), max(kinds.values(), default=1)
    while True:
        parts = -(-number // max(PART, 4 * most * len(kinds)))
        picks = picks.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(max(1, parts)))).groupBy("part").applyInArrow(lambda t: _picks(t.drop(["part"]), kinds, means, length), "h binary, vec binary, rs array<bigint>")
        if parts <= 1:
            break
        number = parts * most * len(kinds)
    centres: dict[int, list[bytes]] = {}
    for x in picks.collect():  # at most `kinds` a request
        for r in x.rs:
            centres.setdefault(r, []).append(bytes(x.vec))
    return {r: {"centres": np.array([np.frombuffer(v, np.float64) for v in sorted(centres[r])]), "mean": m} for r, m in means.items()}


def _categories(batches: Iterator[pa.RecordBatch], pools: dict[int, dict], length: int) -> Iterator[pa.RecordBatch]:
    """(request, h, kind, gain: divergence from the mean, away: distance from the kind's centre) from (h, vec, requests)."""
    for b in batches:
        for r, own, x in _per_request(b, length):
            c = pools[r]["centres"]
            for i in range(0, len(own), 1024):
                y = x[i : i + 1024]
                d = np.round((y * y).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (y @ c.T), 9)
                kind = d.argmin(1)
                away = np.round(np.sqrt(((y - c[kind]) ** 2).sum(1)), 9)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(y), r), pa.int64()), b.column(0).take(pa.array(own[i : i + 1024])), pa.array(kind, pa.int32()), pa.array(divergence(y, pools[r]["mean"])), pa.array(away)],
                    ["request", "h", "kind", "gain", "away"],
                )


def choose_varied(rows: DataFrame, requests: DataFrame, length: int, record: str = "seqid", vector: str = "kfreqs") -> DataFrame:
    """request_id, seqid, delta_jsd (leave-one-out in the chosen set) and total_jsd of the chosen set.

    rows has record, vector, source and delta_jsd; requests has request_id, n_wanted and source. A chosen set of one has
    total_jsd 0 and a null delta_jsd.
    """
    asked = requests.select(F.col("request_id").cast("bigint").alias("r"), F.col("n_wanted").cast("bigint").alias("n"), "source").where("r is not null and n > 0").limit(MAX_REQUESTS + 1).collect()
    if len(asked) > MAX_REQUESTS:
        raise ValueError(f"more than {MAX_REQUESTS} requests")
    spark = rows.sparkSession
    # of the finite vectors only: a seqid's source and past delta_jsd come from all of its rows of this length
    about = rows.where((F.size(vector) == length) & F.col(record).isNotNull()).groupBy(F.col(record).alias("name")).agg(F.min("source").alias("source"), F.max(F.when(~F.isnan("delta_jsd"), F.col("delta_jsd"))).alias("past"))
    people = cut(usable_vectors(rows, length, record, vector).join(about, "name"))
    match = F.array(*[F.when(F.lit(True) if q.source is None else F.col("source") == q.source, F.lit(q.r).cast("bigint")) for q in asked]) if asked else F.array().cast("array<bigint>")
    pooled = people.select("name", "h", F.array_compact(match).alias("rs")).where(F.size("rs") > 0).select("name", "h", F.explode("rs").alias("request"))
    past = people.groupBy("h").agg(F.max("past").alias("past"), F.first("vec").alias("vec"))
    heads = cut(pooled.groupBy("request", "h").agg(F.min("name").alias("name")))
    distinct = cut(heads.groupBy("h").agg(F.collect_set("request").alias("rs")).join(past, "h"))  # at most MAX_REQUESTS in a set
    pools = describe_pools(distinct, {q.r: int(min(MAX_KINDS, max(2, q.n))) for q in asked}, length)
    shared = spark.sparkContext.broadcast(pools)
    scored = cut(distinct.select("h", "vec", "rs").mapInArrow(lambda b: _categories(b, shared.value, length), "request bigint, h binary, kind int, gain double, away double"))
    bounds = spark.createDataFrame(_medians(scored), "request bigint, bound int")  # a row a request
    categories = scored.join(F.broadcast(bounds), "request").withColumn("band", (F.floor(F.col("gain") * BINS) > F.col("bound")).cast("int")).drop("bound")
    # at most kinds x bands combinations a request
    counts: dict[int, dict[tuple[int, int], int]] = {}
    for c in categories.groupBy("request", "kind", "band").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(c.request, {})[c.kind, c.band] = c.n
    amounts = [(q.r, a, b, n) for q in asked for (a, b), n in quotas(counts.get(q.r, {}), q.n).items()]
    quota = spark.createDataFrame(amounts, "request bigint, kind int, band int, quota bigint")
    rank = F.row_number().over(Window.partitionBy("request", "kind", "band").orderBy(F.col("away") > 0, F.desc("gain"), F.desc_nulls_last("past"), "name"))
    ranked = categories.join(F.broadcast(quota), ["request", "kind", "band"]).join(distinct.select("h", "past"), "h").join(heads, ["request", "h"])
    # the greatest quota, as a number, lets Spark cut the ranks before it shuffles a large combination
    most = max([n for *_, n in amounts], default=0)
    picked = ranked.withColumn("place", rank).where((F.col("place") <= most) & (F.col("place") <= F.col("quota"))).select("request", "name")
    # copies fill only pools whose distinct vectors do not suffice
    short = [(q.r, q.n - sum(counts.get(q.r, {}).values())) for q in asked if sum(counts.get(q.r, {}).values()) < q.n]
    if short:
        copies = pooled.join(F.broadcast(spark.createDataFrame(short, "request bigint, missing bigint")), "request").join(heads.select("request", "name"), ["request", "name"], "left_anti")
        more = copies.withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy("name"))).where(F.col("place") <= F.col("missing"))
        picked = picked.unionByName(more.select("request", "name"))
    chosen = cut(picked.join(people.select("name", "vec"), "name").select("request", F.col("name").alias("member"), "vec"))
    members = chosen.mapInArrow(lambda b: _long(b, length), "request bigint, member string, kmer int, freq double")
    return leave_one_out(members, ["request"]).select(F.col("request").alias("request_id"), F.col("member").alias(record), "delta_jsd", F.round("total_jsd", 9).alias("total_jsd"))


def _medians(scored: DataFrame) -> list[tuple[int, int]]:
    """The greatest bin of each request up to which at most the share MEDIAN of its vectors lies; bins are few."""
    bins: dict[int, dict[int, int]] = {}
    for x in scored.groupBy("request", F.floor(F.col("gain") * BINS).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect():
        bins.setdefault(x.request, {})[x.bin] = x.n
    out = []
    for r, own in bins.items():
        whole, below, bound = sum(own.values()), 0, min(own) - 1
        for b in sorted(own):
            below += own[b]
            if below > MEDIAN * whole:
                break
            bound = b
        out.append((r, bound))
    return out


def _long(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = matrix(b.column(2), np.float64, length)
        row, kmer = np.nonzero(x)
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(kmer, pa.int32()), pa.array(x[row, kmer])], ["request", "member", "kmer", "freq"])
