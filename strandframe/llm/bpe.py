"""Byte-level BPE: encode texts to ids of a fixed vocabulary and decode ids to bytes.

A pre-token is first looked up whole by a minimal perfect hash of the vocabulary. Where that misses, its bytes
form a linked list and a heap holds the ranks of neighbouring pairs; the lowest rank merges first, the leftmost
among equals. Nothing is shuffled: each text is encoded where it is read.

Null text counts as empty: zero ids, zero bytes. Texts of any length are encoded whole; an empty table gives no rows. Columns
pass by only when named in `keep`; a name that is also the output raises.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, check_keep, tidy

#: Most pre-tokens whose ids one worker remembers, and the longest of them in characters.
MEMO_ENTRIES, MEMO_CHARS = 450_000, 64


@dataclass
class Vocabulary:
    """Tokens in a minimal perfect hash table: `slots[i]` is the token in slot i and `ids[i]` its id."""

    pattern: str
    slots: list[bytes]
    ids: list[int]
    moves: list[int] = field(repr=False, default_factory=list)

    @classmethod
    def build(cls, ranks: dict[bytes, int], pattern: str) -> Vocabulary:
        """Hash and displace: buckets by size, the largest first; each takes the first displacement that is free for all its keys.
        A bucket of one key takes any free slot, kept as a negative number."""
        n = max(1, len(ranks))
        buckets: list[list[tuple[int, bytes]]] = [[] for _ in range(max(1, n // 4))]
        for token in ranks:
            h = xxhash.xxh3_64_intdigest(token)
            buckets[h % len(buckets)].append((h, token))
        slots: list[bytes | None] = [None] * n
        moves, free = [0] * len(buckets), n - 1
        for b in sorted(range(len(buckets)), key=lambda i: -len(buckets[i])):
            keys = buckets[b]
            if len(keys) > 1:
                move = 1
                while True:
                    places = {_slot(h, move, n) for h, _ in keys}
                    if len(places) == len(keys) and all(slots[p] is None for p in places):
                        break
                    move += 1
                moves[b] = move
                for h, token in keys:
                    slots[_slot(h, move, n)] = token
            elif keys:
                while slots[free] is not None:
                    free -= 1
                slots[free], moves[b] = keys[0][1], -1 - free
        whole = [x if x is not None else b"" for x in slots]
        return cls(pattern, whole, [ranks.get(x, -1) for x in whole], moves)

    def find(self, token: bytes) -> int:
        """Id of a whole token, or -1."""
        h = xxhash.xxh3_64_intdigest(token)
        move = self.moves[h % len(self.moves)]
        place = -1 - move if move < 0 else _slot(h, move, len(self.slots))
        return self.ids[place] if self.slots[place] == token else -1


def _slot(h: int, move: int, n: int) -> int:
    x = (h ^ (h >> 29)) + move * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 32)) % n


_read: dict[tuple[str, float], dict[bytes, int]] = {}
_built: dict[tuple[int, str], tuple[dict[bytes, int], Vocabulary]] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a local file with a base64 token and its id in each line; read once by each process."""
    key = (path, os.path.getmtime(path))
    if key not in _read:
        with open(path, "rb") as lines:
            _read[key] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return _read[key]


def vocabulary_of(ranks: dict[bytes, int], pattern: str) -> Vocabulary:
    """The hashed vocabulary; built once for the same ranks object."""
    key = (id(ranks), pattern)
    if key not in _built or _built[key][0] is not ranks:
        _built[key] = (ranks, Vocabulary.build(ranks, pattern))
    return _built[key][1]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.find = vocabulary.find
        self.split = regex.compile(vocabulary.pattern).findall
        self.ranks = {token: i for token, i in zip(vocabulary.slots, vocabulary.ids, strict=True) if i >= 0}
        self.tokens = {i: token for token, i in self.ranks.items()}
        self.memo: dict[str, bytes] = {}

    def merge(self, token: bytes) -> list[int]:
        """Ids of a pre-token that is not in the vocabulary as a whole."""
        rank_of, n = self.ranks.get, len(token)
        after = list(range(1, n + 1))  # where the part that starts here ends; -1 once it is merged into another
        before = list(range(-1, n - 1))
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := rank_of(token[i : i + 2])) is not None]
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            _, start, end = pop(heap)
            middle = after[start]
            if middle < 0 or middle >= n or after[middle] != end:
                continue
            after[start], after[middle] = end, -1
            if end < n:
                before[end] = start
                beyond = after[end]
                if (rank := rank_of(token[start:beyond])) is not None:
                    push(heap, (rank, start, beyond))
            left = before[start]
            if left >= 0 and (rank := rank_of(token[left:end])) is not None:
                push(heap, (rank, left, end))
        ids, at = [], 0
        while at < n:
            ids.append(self.ranks[token[at : after[at]]])
            at = after[at]
        return ids

    def packed(self, piece: str) -> bytes:
        token = piece.encode()
        whole = self.find(token)
        ids = [whole] if whole >= 0 else self.merge(token)
        out = np.array(ids, "<u4").tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        memo, packed = self.memo.get, self.packed
        return b"".join([memo(piece) or packed(piece) for piece in self.split(text)])


def decode(packed: bytes | None, token_of: Callable[[int], bytes]) -> bytes:
    """The bytes that packed ids stand for; none for null or no ids."""
    return b"".join(map(token_of, np.frombuffer(packed, "<u4").tolist())) if packed else b""


def bpe_encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "token_ids", round_trip: str | None = None) -> DataFrame:
    """The columns of `keep` and `out`: the ids of the whole text as little-endian unsigned 32-bit integers in one binary value.
    round_trip names a further column: whether decoding the ids, in the same worker, gives the text's bytes back.

    The vocabulary is sent to all executors; its size is fixed by the tokenizer and does not grow with the data.
    `unpack_ids` makes an array of `out`. Null and empty text give an empty value; repeated rows stay repeated.
    """
    outputs = [out, *([round_trip] if round_trip else [])]
    check_keep(keep, tuple(outputs))
    shared = Shared(df.sparkSession, vocabulary_of(ranks, pattern))
    source = df.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*(f for f in source.schema if f.name != "__text"), T.StructField(out, T.BinaryType(), False), *(T.StructField(c, T.BooleanType(), False) for c in outputs[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.once(Encoder)
        for batch in batches:
            whole = batch.column("__text")
            for start in range(0, batch.num_rows, 512):
                part = whole.slice(start, 512)
                texts = part.to_pylist()
                packed = [encoder.encode(x) if x else b"" for x in texts]
                columns = [pa.array(packed, pa.binary())]
                if round_trip:
                    columns.append(pa.array([decode(ids, encoder.tokens.__getitem__) == (x or "").encode() for x, ids in zip(texts, packed, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, 512) for c in keep), *columns], [*keep, *outputs])

    return source.mapInArrow(tidy(run), schema)


def bpe_decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids", keep: tuple[str, ...] = ("doc_id",), out: str = "decoded") -> DataFrame:
    """The columns of `keep` and `out`: the bytes that packed ids stand for. Null ids give empty bytes; an unknown id raises."""
    check_keep(keep, (out,))
    shared = Shared(df.sparkSession, {i: token for token, i in ranks.items()})
    source = df.select(*keep, F.col(ids).alias("__ids"))
    schema = T.StructType([*(f for f in source.schema if f.name != "__ids"), T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_of = shared.once().__getitem__
        for batch in batches:
            whole = batch.column("__ids")
            for start in range(0, batch.num_rows, 512):
                part = whole.slice(start, 512)
                texts = pa.array([decode(x, token_of) for x in part.to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, 512) for c in keep), texts], [*keep, out])

    return source.mapInArrow(tidy(run), schema)


def unpack_ids(packed: str):
    """Array of ids of a packed column, by SQL functions alone."""
    count = F.expr(f"octet_length(`{packed}`) div 4")
    return F.when(count == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), count.cast("int") - 1),
            lambda i: F.conv(
                F.concat(*[F.hex(F.col(packed).substr(i * 4 + F.lit(k), F.lit(1))) for k in (4, 3, 2, 1)]), 16, 10
            ).cast("bigint"),
        )
    )
