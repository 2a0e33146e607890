"""Ranked lexical search: the k documents of highest score for each item, exactly, without scoring every document.

Two passes over the texts, no exchange of texts or postings. The first counts documents and occurrences of the items' terms
(a row for each term and task is exchanged). The second cuts each task's documents into blocks; a block has a posting list
for each term, and over every list a sparse table that answers where the greatest impact of any stretch stands. For an item,
the sum of those answers bounds every document of an interval. Intervals wait in a heap, greatest bound first: the first is
split at the document of its greatest single impact, which is scored in full, and both sides go back with their own
bounds, or has all its documents scored once few postings are left. The block is done when no interval can reach the item's k-th document so far, which is carried from block to block.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased. Scores are
integers: sum over the item's terms, once each, of w * ((1000000000 * tf) div (1000 * tf + 20 * m)), with
m = 50 + ((50 * n * N) div L) and w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))).

Null and empty texts, and items without terms, find nothing. Rows of one item_id ask together, with all their terms. Repeated
documents are ranked each for itself. Equal scores are ranked by id, a null id first. Empty tables give no rows.
Items are sent to the tasks in parts of at most `part_bytes` of text; each further part is two further passes.
A task holds at most a block: 16,384 documents or 1.5 million postings (one document's more).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import LOWER, Batches, Shared, best_of, in_steps, span_hashes, tidy, utf8, word_spans

#: Documents and postings of a block.
BLOCK_DOCUMENTS, BLOCK_POSTINGS = 1 << 14, 1_500_000
#: An interval with so few postings of the item's terms is not split further: all its documents are scored.
LEAF_POSTINGS = 2048

_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return word_spans(data, offsets, _OUTSIDE)


def terms_of(text: str | None) -> list[bytes]:
    """The terms of one text, in order."""
    data, offsets = utf8(pa.array([text], pa.string()))
    low = LOWER[data].tobytes()
    starts, ends, _ = _spans(data, offsets)
    return [low[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


class Vocabulary:
    """Terms to numbers 0, 1, ..., for many spans at once: by hash, then byte by byte."""

    def __init__(self, terms: list[bytes]):
        self.terms = sorted(terms)
        lengths = np.array([len(t) for t in self.terms], np.int64)
        self.bytes = np.frombuffer(b"".join(self.terms), np.uint8)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        hashes = span_hashes(self.bytes, self.starts, self.ends)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        if len(self.hashes) and (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms of the items have one hash")

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span's term, -1 for a term that is not among these."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.hashes) or not len(starts):
            return out
        hashes = span_hashes(data, starts, ends, LOWER)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        number = self.order[at]
        known = np.flatnonzero((self.hashes[at] == hashes) & (self.ends[number] - self.starts[number] == ends - starts))
        lengths, number = (ends - starts)[known], number[known]
        begin = np.cumsum(lengths) - lengths
        within = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
        differ = LOWER[data[np.repeat(starts[known], lengths) + within]] != self.bytes[np.repeat(self.starts[number], lengths) + within]
        if len(known):
            same = np.add.reduceat(differ, begin) == 0
            out[known[same]] = number[same]
        return out


def _counted(part: pa.RecordBatch, text: str, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text with repeats, and for each text and known term: text, term, occurrences)."""
    data, offsets = utf8(part.column(text))
    starts, ends, owner = _spans(data, offsets)
    lengths = np.bincount(owner, minlength=part.num_rows)
    number = vocabulary.find(data, starts, ends)
    known = number >= 0
    keys, tf = np.unique(owner[known] * max(1, len(vocabulary.terms)) + number[known], return_counts=True)
    return lengths, keys // max(1, len(vocabulary.terms)), keys % max(1, len(vocabulary.terms)), tf


class Block:
    """Posting lists of one block of documents, which are numbered in the order of their ids, with sparse tables of impacts."""

    def __init__(self, documents: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        size = np.bincount(term, minlength=terms)
        by_size = np.argsort(-size, kind="stable")  # long lists first: a level of the table needs the first lists only
        self.place = np.empty(terms, np.int64)
        self.place[by_size] = np.arange(terms)
        self.documents = documents
        keys = self.place[term] * documents + doc
        order = np.argsort(keys, kind="stable")
        self.keys, self.doc, self.impact = keys[order], doc[order], impact[order]
        self.end = np.cumsum(size[by_size])
        self.start = self.end - size[by_size]
        levels, half = [np.arange(len(doc), dtype=np.int32)], 1
        while len(size) and 2 * half <= size[by_size[0]]:
            n, last = int(self.end[np.flatnonzero(size[by_size] >= 2 * half)[-1]]), levels[-1]
            left, right = last[:n], last[np.minimum(np.arange(n) + half, len(last) - 1)]
            levels.append(np.where(self.impact[left] >= self.impact[right], left, right))
            half *= 2
        self.level = np.concatenate([[0], np.cumsum([len(x) for x in levels])])
        self.table = np.concatenate(levels)

    def greatest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where the greatest impact of each stretch [lo, hi) of a list stands; no stretch is empty."""
        k = np.frexp(hi - lo)[1] - 1
        base = self.level[k]
        left, right = self.table[base + lo], self.table[base + hi - (1 << k)]
        return np.where(self.impact[left] >= self.impact[right], left, right)


def search(block: Block, terms: np.ndarray, weights: np.ndarray, k: int, beats, leaf: int = LEAF_POSTINGS) -> list[tuple[int, int]]:
    """(score, document) of the block's best k for an item that score over 0, best first. beats(score, document): may a document
    from there on, of that score, be among the item's best of earlier blocks?"""
    if not len(terms) or not len(block.doc):
        return []
    place = block.place[terms]
    found: list[tuple[int, int]] = []  # a heap whose root is the worst: (score, -document)
    heap: list[tuple] = []
    ticket = 0

    def wanted(score: int, document: int) -> bool:
        return (len(found) < k or (score, -document) > found[0]) and beats(score, document)

    def keep(score: int, document: int) -> None:
        if wanted(score, document):
            (heapq.heappush if len(found) < k else heapq.heapreplace)(found, (score, -document))

    def push(firsts: tuple[int, ...], bases: np.ndarray, w: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Intervals from firsts on; lo and hi have a row for each."""
        nonlocal ticket
        some = hi > lo
        top = block.greatest(np.where(some, lo, 0), np.where(some, hi, 1))
        impacts = np.where(some, w * block.impact[top], 0)
        for i, (first, bound, best) in enumerate(zip(firsts, impacts.sum(axis=1).tolist(), impacts.argmax(axis=1).tolist())):
            if bound > 0 and wanted(bound, first):
                ticket += 1
                in_it = some[i]
                heapq.heappush(heap, (-bound, first, ticket, int(block.doc[top[i, best]]), bases[in_it], w[in_it], lo[i, in_it], hi[i, in_it]))

    push((0,), place * block.documents, weights, block.start[place][None], block.end[place][None])
    while heap:
        bound, first, _, at, bases, w, lo, hi = heapq.heappop(heap)
        if not wanted(-bound, first):
            if not wanted(-bound, 0):
                break
            continue
        lengths = hi - lo
        total = int(lengths.sum())
        if total <= leaf:
            position = np.repeat(lo - np.cumsum(lengths) + lengths, lengths) + np.arange(total)
            document, impact = block.doc[position], np.repeat(w, lengths) * block.impact[position]
            order = np.argsort(document, kind="stable")
            begin = np.flatnonzero(np.diff(document[order], prepend=-1))
            scores = np.add.reduceat(impact[order], begin)
            worth = np.flatnonzero(scores >= (found[0][0] if len(found) == k else 1))
            for score, d in zip(scores[worth].tolist(), document[order][begin[worth]].tolist()):
                keep(score, d)
            continue
        cut = np.searchsorted(block.keys, bases + at)
        here = cut < hi
        here[here] = block.doc[cut[here]] == at
        keep(int((w[here] * block.impact[cut[here]]).sum()), at)
        push((first, at + 1), bases, w, np.stack([lo, cut + here]), np.stack([cut, hi]))
    return [(s, -d) for s, d in sorted(found, reverse=True)]


class _Best:
    """An item's best k so far."""

    def __init__(self, k: int):
        self.k, self.rows = k, []  # (-score, id is there, id)

    def add(self, rows: list[tuple[int, object]]) -> None:
        self.rows = sorted([*self.rows, *((-s, i is not None, i if i is not None else 0) for s, i in rows)])[: self.k]

    def beats(self, score: int, id_: object) -> bool:
        return len(self.rows) < self.k or (-score, id_ is not None, id_ if id_ is not None else 0) < self.rows[-1]


def _saturation(tf: np.ndarray, n: np.ndarray, documents: int, occurrences: int) -> np.ndarray:
    wide = object if 50 * int(n.max(initial=0)) * documents >= 1 << 63 else np.int64
    m = (50 + (50 * n.astype(wide) * documents) // occurrences).astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _search_part(documents: DataFrame, wanted: dict[object, set[bytes]], id_: str, text: str, item_type: T.DataType, k: int, block: tuple[int, int, int]) -> DataFrame:
    spark = documents.sparkSession
    source = documents.select(F.col(id_).alias("__id"), F.col(text).alias("__text"))
    vocabulary = Vocabulary(list(set().union(*wanted.values())))
    shared = Shared(spark, vocabulary)

    def count(batches: Batches) -> Iterator[pa.RecordBatch]:
        known = shared.once()
        df, documents, occurrences = np.zeros(len(known.terms), np.int64), 0, 0
        for part in in_steps(batches, "__text"):
            lengths, _, term, _ = _counted(part, "__text", known)
            df += np.bincount(term, minlength=len(df))
            documents, occurrences = documents + int((lengths > 0).sum()), occurrences + int(lengths.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *held.tolist()], pa.int64()), pa.array([documents, *df[held].tolist()], pa.int64()), pa.array([occurrences, *[0] * len(held)], pa.int64())], ["term", "documents", "occurrences"])

    counts = {r.term: (r.d, r.o) for r in source.select("__text").mapInArrow(tidy(count), "term long, documents long, occurrences long").groupBy("term").agg(F.sum("documents").alias("d"), F.sum("occurrences").alias("o")).collect()}
    n_documents, n_occurrences = counts.get(-1, (0, 0))
    weight = np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * counts[t][0] + 1))) if t in counts else 0 for t in range(len(vocabulary.terms))], np.int64)
    number = {t: i for i, t in enumerate(vocabulary.terms)}
    items = [(item, np.array(sorted(number[t] for t in terms if weight[number[t]] > 0), np.int64)) for item, terms in wanted.items()]
    sent = Shared(spark, (vocabulary, weight, items))
    schema = T.StructType([T.StructField("item_id", item_type), T.StructField("doc_id", source.schema["__id"].dataType), T.StructField("score", T.LongType())])

    def find(batches: Batches) -> Iterator[pa.RecordBatch]:
        known, weight, items = sent.once()
        best = [_Best(k) for _ in items]
        ids: list[pa.Array] = []
        rows: list[tuple[np.ndarray, ...]] = []  # text, term, occurrences
        lengths: list[np.ndarray] = []
        kind = None

        def close() -> None:
            names = pa.chunked_array(ids, kind).combine_chunks()
            order = pc.array_sort_indices(names, null_placement="at_start").to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            names = names.take(pa.array(order)).to_pylist()
            doc, term, tf = (np.concatenate(x) for x in zip(*rows))
            index = Block(len(names), rank[doc], term, _saturation(tf, np.concatenate(lengths)[doc], n_documents, n_occurrences), len(known.terms))
            for (_, terms), own in zip(items, best):
                own.add([(s, names[d]) for s, d in search(index, terms, weight[terms], k, lambda s, d, own=own: d < len(names) and own.beats(s, names[d]), block[2])])
            ids.clear(), rows.clear(), lengths.clear()

        held = postings = 0
        for part in in_steps(batches, "__text"):
            n, doc, term, tf = _counted(part, "__text", known)
            kind = part.column("__id").type
            ids.append(part.column("__id")), lengths.append(n), rows.append((doc + held, term, tf))
            held, postings = held + part.num_rows, postings + len(doc)
            if held >= block[0] or postings >= block[1]:
                close()
                held = postings = 0
        if held:
            close()
        flat = [(item, i if there else None, -s) for (item, _), own in zip(items, best) for s, there, i in own.rows]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], item_kind), pa.array([x[1] for x in flat], kind), pa.array([x[2] for x in flat], pa.int64())], ["item_id", "doc_id", "score"])

    item_kind = to_arrow_type(item_type)
    return source.mapInArrow(tidy(find), schema) if n_occurrences else spark.createDataFrame([], schema)


def rank_documents(documents: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", part_bytes: int = 16 << 20, block: tuple[int, int, int] = (BLOCK_DOCUMENTS, BLOCK_POSTINGS, LEAF_POSTINGS)) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of highest score over 0 (all, if fewer). block: documents and postings
    of a block, and postings of an interval that is not split."""
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    found = None
    for part in range(parts):
        wanted: dict[object, set[bytes]] = {}
        for row in (asked if parts == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)).collect():
            wanted.setdefault(row.item_id, set()).update(terms_of(row.text))
        wanted = {i: t for i, t in wanted.items() if t}
        if wanted:
            one = _search_part(documents, wanted, doc_id, text, asked.schema["item_id"].dataType, k, block)
            found = one if found is None else found.unionByName(one)
    if found is None:
        return documents.sparkSession.createDataFrame([], T.StructType([asked.schema["item_id"], T.StructField("rank", T.IntegerType()), T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("score", T.LongType())]))
    ranked = best_of(found, ("item_id",), [F.desc("score"), F.asc_nulls_first("doc_id")], k, salt=F.spark_partition_id() % 256)
    return ranked.select("item_id", "rank", "doc_id", "score")
