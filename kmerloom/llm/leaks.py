"""Evaluation texts in a corpus (problem 8).

Method: one Aho-Corasick automaton over the normalised evaluation items; each text is scanned once, and the places
of the matches are mapped back to offsets of the text as stored.

Words are runs of letters and digits of the consistent form, without case; tags in <> or [], entities, line breaks,
quote marks and punctuation only separate them. The patterns are all runs of `words` words of an item, so a document
matches an item if and only if it has at least so many consecutive words of it. The automaton's symbols are numbers of
words, which keeps it at one node a word of a pattern (about 100 MB for 250,000 words of items).

Items of more than MAX_ITEM_CHARS in all are spread by their id over several automata of at most about that size, each
of which scans the texts, so that no worker holds more than one; an item stands in one of them, so rows are the same.

Defined cases: null, empty and blank texts, on either side, and items of fewer than `words` words match nothing;
a passage that several items share leaks each of them; repeated documents rows are scanned each, and one row comes
out for each pair of ids; rows with a null id are left out; columns beyond the two named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.visual_form import original_offset, visual_form, visual_form_spans

WORDS = 8
#: Characters of items that one automaton takes.
MAX_ITEM_CHARS = 1 << 20
TOKEN = re.compile(r"<[^<>\n]*>|\[[^\[\]\n]*\]|&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);|([^\W_]+)")


def words_of(text: str) -> list[str]:
    """Words without case (no character's case folding has a space)."""
    return " ".join(filter(None, TOKEN.findall(visual_form(text)))).casefold().split()


class Automaton:
    """All runs of n words of the items, as numbers of words; a pattern knows its items."""

    def __init__(self, items: list[tuple[int, str]], n: int) -> None:
        self.n, self.numbers, owners = n, {}, {}
        for item, text in items:
            w = tuple(self.numbers.setdefault(x, len(self.numbers) + 1) for x in words_of(text))
            for i in range(len(w) - n + 1):
                owners.setdefault(w[i : i + n], set()).add(item)
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, ids in owners.items():
            self.trie.add_word(pattern, sorted(ids))
        if owners:
            self.trie.make_automaton()
        self.empty = not owners

    def scan(self, text: str | None) -> dict[int, tuple[int, int, int]]:
        """By item: offsets in the text of the first matched run's start and the last one's end, and the number of runs."""
        if self.empty or not text:
            return {}
        symbols = tuple(map(self.numbers.get, words_of(text), repeat(0)))
        hits: dict[int, list[int]] = {}
        for end, ids in self.trie.iter(symbols):
            for item in ids:
                h = hits.setdefault(item, [end - self.n + 1, end, 0])
                h[1], h[2] = end, h[2] + 1
        if not hits:
            return {}
        # most texts leak nothing: places are made only for those that do
        form, spans = visual_form_spans(text)
        places = [m.span() for m in TOKEN.finditer(form) if m.lastindex]
        return {k: (original_offset(spans, places[a][0]), original_offset(spans, places[b][1], True), c) for k, (a, b, c) in hits.items()}


_built: dict[tuple[int, int], Automaton] = {}  # of this worker process

SCHEMA = "doc_id bigint, item_id bigint, start int, stop int, runs int"


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, item_id of each leak, with the code point offsets (start, stop) of the leaked stretch and its number of runs.

    start is the start of the first matched run of words, stop the end of the last one; offsets count the text as stored.
    """
    spark = docs.sparkSession
    chosen = items.select(F.col(item).cast("bigint").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").distinct()
    source = docs.select(F.col(key).cast("bigint").alias("i"), F.col(text).alias("t")).where("i is not null and length(t) > 0")
    shards = max(1, -(-(chosen.agg(F.sum(F.length("t"))).first()[0] or 0) // MAX_ITEM_CHARS))
    found = None
    for shard in range(shards):
        # about MAX_ITEM_CHARS characters, whatever the number of items
        held = chosen.where(F.pmod(F.xxhash64("i"), F.lit(shards)) == shard).collect()
        shared = spark.sparkContext.broadcast([(r.i, r.t) for r in held])
        part = source.mapInArrow(lambda batches, b=shared: _scan(batches, b.value, words), SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found


def _scan(batches: Iterator[pa.RecordBatch], items: list[tuple[int, str]], words: int) -> Iterator[pa.RecordBatch]:
    k = (hash(tuple(items)), words)
    if k not in _built:
        _built.clear()
        _built[k] = Automaton(items, words)
    automaton = _built[k]
    for b in batches:
        rows = [(d, i, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, x in automaton.scan(t).items()]
        yield _table(rows, ("doc_id", "item_id", "start", "stop", "runs"), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))


def _table(rows: list[tuple], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names)
