"""Order-dependent selection of divergent records: a fold over records in a fixed order, in chunks that are merged.

The fold keeps a set of members with the sums of their frequencies and entropies. For a candidate, the total divergence
after the member of the lowest contribution is replaced by it follows from the sums in one pass over the k-mers; a
candidate that raises the total enters. Records come by an order column, chunks are equal runs of that order (the
remainder goes to the first), and the chunks' results are folded again in chunk order, so results do not depend on
scheduling. A chunk holds the set only: candidates are streamed through it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.operators.ranking import chunk_of, global_rank
from kmerloom.session import cut

EPS = 2.220446049250313e-16


def _h(x: np.ndarray) -> np.ndarray:
    """Entropies along the last axis."""
    return -(x * np.log2(np.where(x > EPS, x, 1.0))).sum(-1)


class DivergentSet:
    """Members, sums, total divergence, contributions of the members and the lowest of them."""

    def __init__(self, ids: list, vectors: np.ndarray) -> None:
        if len(ids) < 2:
            raise ValueError("a set needs more than one record with valid k-mers")
        self.ids, self.x, self.h = list(ids), np.asarray(vectors, float), _h(np.asarray(vectors, float))
        self._settle()

    def _settle(self) -> None:
        n, self.s, self.sh = len(self.ids), self.x.sum(0), self.h.sum()
        self.total = _h(self.s / n) - self.sh / n
        rest = self.s - self.x
        rest[rest <= EPS] = 0
        self.delta = self.total - (_h(rest / (n - 1)) - (self.sh - self.h) / (n - 1))
        self.low = int(np.round(self.delta, 12).argmin())

    def replaced(self, x: np.ndarray) -> float:
        """Total divergence with x in the lowest member's place."""
        n, rest = len(self.ids), self.s - self.x[self.low]
        rest[rest <= EPS] = 0
        return float(_h((rest + x) / n) - (self.sh - self.h[self.low] + _h(x)) / n)

    def rises(self, name, x: np.ndarray) -> bool:
        return name not in self.ids and self.replaced(x) > self.total + EPS

    def replace(self, name, x: np.ndarray) -> None:
        """The lowest goes, the new member comes last."""
        self.ids = [*self.ids[: self.low], *self.ids[self.low + 1 :], name]
        self.x = np.concatenate([np.delete(self.x, self.low, 0), x[None]])
        self.h = np.append(np.delete(self.h, self.low), _h(x))
        self._settle()

    def pushed(self, name, x: np.ndarray) -> DivergentSet:
        return DivergentSet([*self.ids, name], np.concatenate([self.x, x[None]]))

    def statistic(self, name: str) -> float:
        std = self.delta.std(ddof=1)
        if name == "stdev":
            return float(std)
        with np.errstate(divide="ignore", invalid="ignore"):
            return float(std / self.delta.mean())


def fold(rows: Iterator[tuple[object, np.ndarray]], least: int, most: int | None, stat: str) -> DivergentSet | None:
    """The selected set: `least` seeds, then whoever raises the total; up to `most` while the statistic rises too.

    With most equal to least the size is fixed. A record without valid k-mers (None) among the seeds uses up a place,
    and so does a name that is there already. None if fewer than two records came.
    """
    seeds: dict[object, np.ndarray] = {}
    state, places = None, 0
    for name, x in rows:
        if state is None and places < least:
            places += 1
            if x is not None:
                seeds.setdefault(name, x)
            if places == least:
                state = DivergentSet(list(seeds), np.array(list(seeds.values())))
            continue
        if x is None:
            continue
        if not state.rises(name, x):
            continue
        if most is not None and len(state.ids) >= most:
            state.replace(name, x)
        else:
            grown = state.pushed(name, x)
            if grown.statistic(stat) > state.statistic(stat):
                state = grown
    if state is None and len(seeds) > 1:
        state = DivergentSet(list(seeds), np.array(list(seeds.values())))
    return state


def _fold_partition(batches: Iterator[pa.RecordBatch], least: int, most: int | None, stat: str, size: int, final: bool = False) -> Iterator[pa.RecordBatch]:
    """One chunk after another of a partition sorted by (chunk, ord); fewer than `least` members of a final set are an error."""

    def rows() -> Iterator[tuple[int, object, np.ndarray]]:
        for b in batches:
            x = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            there = b.column(3).is_valid().to_numpy(zero_copy_only=False)
            place = np.cumsum(there) - 1
            for i, (chunk, name) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                yield chunk, name, x[place[i]].copy() if there[i] else None

    stream = rows()
    head = next(stream, None)
    while head is not None:
        chunk, nxt = head[0], []

        def own(first=head, nxt=nxt):
            yield first[1], first[2]
            for r in stream:
                if r[0] != first[0]:
                    nxt.append(r)
                    return
                yield r[1], r[2]

        state = fold(own(), least, most, stat)
        head = nxt[0] if nxt else None
        if final and (state is None or len(state.ids) < least):
            raise ValueError(f"the chunks have fewer than {least} members in all")
        if state is not None:
            n = len(state.ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(state.ids), pa.array(list(state.x), pa.list_(pa.float64())), pa.array(state.delta), pa.array([state.total] * n)],
                ["chunk", "ord", "name", "v", "delta_jsd", "total_jsd"],
            )


def select(vectors: DataFrame, name: str, order: list, size: int, least: int, most: int | None, stat: str = "stdev", chunks: int = 1, vector: str = "kfreqs") -> DataFrame:
    """name, delta_jsd and total_jsd of the selected records of dense frequency vectors of length `size`.

    order are the columns that fix the order of records; rows with null vectors are never members.
    """
    if least < 2:
        raise ValueError("a set needs more than one record")
    if most is not None and most < least:
        raise ValueError("the greatest size is below the least")
    if stat not in ("stdev", "cov"):
        raise ValueError("the statistic must be stdev or cov")
    kind = vectors.schema[name].dataType.simpleString()
    schema = f"chunk bigint, ord bigint, name {kind}, v array<double>, delta_jsd double, total_jsd double"
    rows = vectors.select(F.col(name).alias("name"), F.col(vector).alias("v"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    keys = [f"o{i}" for i in range(len(order))]
    if chunks > 1:
        # ranks are made on names alone, without the vectors
        ranked, total = global_rank(rows.select("name", *keys), keys)
        rows = rows.join(ranked.select("name", *keys, chunk_of("rank", total, chunks).alias("chunk")), ["name", *keys])
    else:
        rows = rows.withColumn("chunk", F.lit(1).cast("bigint"))
    part = rows.select("chunk", F.lit(0).cast("bigint").alias("ord"), "name", "v", *keys).repartition(chunks, "chunk").sortWithinPartitions("chunk", *keys)
    done = part.select("chunk", "ord", "name", "v").mapInArrow(lambda b: _fold_partition(b, least, most, stat, size), schema)
    if chunks > 1:
        again = done.select("chunk", "ord", "name", "v").repartition(1).sortWithinPartitions("chunk", "ord")
        again = again.select(F.lit(1).cast("bigint").alias("chunk"), "ord", "name", "v")
        done = again.mapInArrow(lambda b: _fold_partition(b, least, most, stat, size, True), schema)
    return done.select(F.col("name").alias(name), "delta_jsd", "total_jsd")


def select_nmost(vectors: DataFrame, name: str, order: list, size: int, n: int = 10, chunks: int = 1, vector: str = "kfreqs") -> DataFrame:
    """The n records that the fold keeps; fewer if fewer have valid k-mers."""
    return select(vectors, name, order, size, n, n, chunks=chunks, vector=vector)


def select_max(vectors: DataFrame, name: str, order: list, size: int, least: int = 5, most: int | None = 30, stat: str = "stdev", chunks: int = 1, vector: str = "kfreqs") -> DataFrame:
    """Between least and most records, growing while the statistic of the contributions rises."""
    return select(vectors, name, order, size, least, most, stat, chunks, vector)


def with_included(selected: DataFrame, vectors: DataFrame, name: str, include: list, size: int, vector: str = "kfreqs") -> DataFrame:
    """name, delta_jsd and total_jsd of the set of the names selected and those asked for.

    Contributions are those in the whole set, not in the selected one; names without valid k-mers have none (null).
    Names to include that the rows do not have are an error.
    """
    asked = vectors.where(F.col(name).isin(include)).select(name).distinct()
    missing = set(include) - {r[0] for r in asked.collect()}
    if missing:
        raise ValueError(f"not among the records: {sorted(missing)}")
    # a selection and a list of names: both are small
    chosen = cut(selected.select(name).unionByName(asked).distinct())
    n = chosen.count()
    rows = vectors.join(F.broadcast(chosen), name, "left_semi")
    return chosen.join(select(rows, name, [name], size, n, n, vector=vector), name, "left")
