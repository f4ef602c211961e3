"""Average-linkage trees of distance matrices, one task a set; a set's matrix must fit in a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MAX_LEAVES = 5000


def average_linkage(d: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (left, right, height, size): numbers below n are leaves, n + i the i-th merge.

    Of equal distances (to 12 decimals) the pair with the least numbers is merged first; the lesser number is left.
    """
    n = len(d)
    work = np.round(np.asarray(d, float), 12)
    np.fill_diagonal(work, np.inf)
    # a merge takes the place of its left part; number says which leaf or merge a place holds, least its nearest distance
    number, size, live, merges = np.arange(n), np.ones(n), np.ones(n, bool), []
    least = work.min(1, initial=np.inf)
    for new in range(n, 2 * n - 1):
        at = np.flatnonzero(live & (least == least[live].min()))
        a = at[number[at].argmin()]
        at = np.flatnonzero(live & (work[a] == least[a]) & (np.arange(n) != a))
        b = at[number[at].argmin()]
        height, whole = work[a, b], size[a] + size[b]
        merges.append((int(number[a]), int(number[b]), float(height), int(whole)))
        live[b] = False
        rest = np.flatnonzero(live & (np.arange(n) != a))
        stale = rest[(work[rest, a] == least[rest]) | (work[rest, b] == least[rest])]
        work[a, rest] = work[rest, a] = np.round((work[a, rest] * size[a] + work[b, rest] * size[b]) / whole, 12)
        work[b], work[:, b] = np.inf, np.inf
        number[a], size[a] = new, whole
        least[rest] = np.minimum(least[rest], work[rest, a])
        least[stale] = work[stale].min(1, initial=np.inf)
        least[a], least[b] = work[a].min(initial=np.inf), np.inf
    return merges


def newick(names: list[str], merges: list[tuple[int, int, float, int]]) -> str:
    """The tree without branch lengths; a single leaf is its name."""
    parts = [f"'{x}'" if any(c in x for c in " ()[]:;,'") else x for x in names]
    for a, b, _, _ in merges:
        parts.append(f"({parts[a]},{parts[b]})")
        parts[a] = parts[b] = ""
    return parts[-1] + ";" if parts else ";"


def _matrix(t: pa.Table) -> tuple[list, np.ndarray]:
    a, b = t.column("member_a").to_pylist(), t.column("member_b").to_pylist()
    names = sorted(set(a) | set(b))
    if len(names) > MAX_LEAVES:
        raise ValueError(f"a tree of more than {MAX_LEAVES} leaves; make sets smaller")
    at = {x: i for i, x in enumerate(names)}
    # a pair without a distance is as far apart as can be
    d = np.full((len(names), len(names)), np.inf)
    for x, y, z in zip(a, b, t.column("distance").to_pylist()):
        d[at[x], at[y]] = d[at[y], at[x]] = np.inf if z is None else z
    return names, d


def tree_merges(distances: DataFrame, by: str) -> DataFrame:
    """by, step, left_members, right_members (sorted), height of each merge of each set."""
    kind, name = distances.schema[by].dataType.simpleString(), distances.schema["member_a"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        names, d = _matrix(t)
        merges, held = average_linkage(d), [[x] for x in names]
        left, right = [], []
        for a, b, _, _ in merges:
            left.append(sorted(held[a]))
            right.append(sorted(held[b]))
            held.append(held[a] + held[b])
        values = t.schema.field("member_a").type
        return pa.table(
            {"set": t.column(by).slice(0, 1).take(pa.array([0] * len(merges), pa.int32())), "step": pa.array(range(1, len(merges) + 1), pa.int32()), "left_members": pa.array(left, pa.list_(values)), "right_members": pa.array(right, pa.list_(values)), "height": pa.array([m[2] for m in merges], pa.float64())}
        )

    return distances.groupBy(by).applyInArrow(run, f"set {kind}, step int, left_members array<{name}>, right_members array<{name}>, height double").withColumnRenamed("set", by)


def trees(distances: DataFrame, by: str) -> DataFrame:
    """by, leaves and newick of each set."""
    kind = distances.schema[by].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        names, d = _matrix(t)
        return pa.table({"set": t.column(by).slice(0, 1), "leaves": pa.array([len(names)], pa.int32()), "newick": [newick([str(x) for x in names], average_linkage(d))]})

    return distances.groupBy(by).applyInArrow(run, f"set {kind}, leaves int, newick string").withColumnRenamed("set", by)
