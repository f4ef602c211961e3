"""Byte-level BPE of a public vocabulary as a lazily determinised transducer (problem 7).

Method. The last token of the encoding of each prefix of a piece is unique: it is the one token that ends there and
is compatible with the last token before it (the merges applied to the bytes of both give back exactly the two). The
encodings of all prefixes therefore form a tree. While bytes come in, only the prefixes from which some vocabulary
token could still reach beyond the current byte matter; what the paths to all of these have in common is settled and
is emitted. So the transducer's state is: for each live prefix, the trie node of the bytes since it and the tokens of
its path that are not yet emitted, the lookahead of which is bounded by the longest token. States and transitions are
made when first needed and kept, so a byte costs one dictionary lookup afterwards.

Pieces are cut by the vocabulary's public pattern. Decoding is streamed: tokens are turned to bytes, and a UTF-8 state
machine emits each character as soon as it is complete, and U+FFFD for ill-formed bytes.

Defined cases: null and empty texts give an empty list; text of any script or length is encoded whole; strings that
look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The vocabulary file is broadcast; larger files are refused.
MAX_VOCABULARY_BYTES = 64 << 20
# Fixed value: the public pattern that cuts a text into pieces for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces with their ids, states, and answers about pairs of tokens that a worker keeps; beyond, it forgets and makes them anew.
KEPT_PIECES, KEPT_STATES, KEPT_PAIRS = 400_000, 200_000, 500_000


class Transducer:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        # trie over token bytes: edges by (node, byte); a node's token or -1; whether a longer token goes on
        self.edge: dict[tuple[int, int], int] = {}
        self.token = [-1]
        self.inner = [True]
        for word, i in ranks.items():
            node = 0
            for b in word:
                self.inner[node] = True
                nxt = self.edge.get((node, b))
                if nxt is None:
                    nxt = self.edge[(node, b)] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = nxt
            self.token[node] = i
        self._fits: dict[tuple[int, int], bool] = {}
        # a state: ((node, last token, pending tokens) of each live prefix, longest first), the last being the whole
        self.states: list[tuple] = [((0, -1, ()),)]
        self.numbers: dict[tuple, int] = {self.states[0]: 0}
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def merge(self, data: bytes) -> list[int]:
        """Merges by rank, as defined; used for pairs only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            pair = parts[best], parts[best + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        if left < 0:
            return True
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= KEPT_PAIRS:
                self._fits.clear()
            known = self._fits[(left, right)] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Determinise one transition: the next state and the tokens it emits."""
        live, whole = [], None
        for node, last, pending in self.states[state]:
            nxt = self.edge.get((node, byte))
            if nxt is None:
                continue
            t = self.token[nxt]
            if whole is None and t >= 0 and self.fits(last, t):
                whole = (0, t, (*pending, t))
            if self.inner[nxt]:
                live.append((nxt, last, pending))
        if whole is None:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        live.append(whole)
        common = 0
        while all(len(p) > common for _, _, p in live) and len({p[common] for _, _, p in live}) == 1:
            common += 1
        emitted = whole[2][:common]
        made = tuple((n, last, p[common:]) for n, last, p in live)
        number = self.numbers.get(made)
        if number is None:
            number = self.numbers[made] = len(self.states)
            self.states.append(made)
            self.steps.append({})
        self.steps[state][byte] = (number, emitted)
        return number, emitted

    def encode_piece(self, data: bytes) -> list[int]:
        state, out, steps = 0, [], self.steps
        for byte in data:
            state, emitted = steps[state].get(byte) or self.step(state, byte)
            if emitted:
                out += emitted
        out += self.states[state][-1][2]
        if len(self.states) > KEPT_STATES:
            self.states, self.numbers, self.steps = self.states[:1], {self.states[0]: 0}, [{}]
        return out


class Tokenizer:
    def __init__(self, vocabulary: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.transducer = Transducer(ranks)
        self.cut = regex.compile(PATTERN)
        self.pieces: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out, kept = [], self.pieces
        for piece in self.cut.findall(text):
            ids = kept.get(piece)
            if ids is None:
                # surrogates cannot be stored in UTF-8 and are replaced
                ids = self.transducer.encode_piece(piece.encode("utf-8", "replace"))
                if len(piece) <= 64:
                    if len(kept) >= KEPT_PIECES:
                        kept.clear()
                    kept[piece] = ids
            out += ids
        return out

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Characters as soon as their bytes are complete."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if part := machine.decode(self.transducer.tokens[i]):
                yield part
        if part := machine.decode(b"", True):
            yield part

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


@cache
def tokenizer(vocabulary: bytes) -> Tokenizer:
    """One per worker process and vocabulary."""
    return Tokenizer(vocabulary)


def read_vocabulary(folder: str = TOKENIZERS, name: str = VOCABULARY) -> bytes:
    path = Path(folder, name)
    if path.stat().st_size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return path.read_bytes()


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: bytes) -> Iterator[pa.RecordBatch]:
    t = tokenizer(vocabulary)
    for b in batches:
        ids = pa.array([t.encode(x) for x in b.column(1).to_pylist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column(0), ids], ["key", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], vocabulary: bytes) -> Iterator[pa.RecordBatch]:
    t = tokenizer(vocabulary)
    for b in batches:
        texts = pa.array([None if x is None else t.decode(x) for x in b.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), texts], ["key", "text"])


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """key and ids of each row: one row out for each row in, also for null keys and repeated rows."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(folder, name))
    kind = df.schema[key].dataType.simpleString()
    picked = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return picked.mapInArrow(lambda x: _encode(x, shared.value), f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """key and text of each row; null ids give a null text, an empty list an empty one."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(folder, name))
    kind = df.schema[key].dataType.simpleString()
    picked = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return picked.mapInArrow(lambda x: _decode(x, shared.value), f"key {kind}, text string").select(F.col("key").alias(key), "text")
