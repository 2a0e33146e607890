"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised benchmark texts.

Texts are lower-cased (A-Z) and read as words of digits, ASCII letters and anything beyond ASCII. An item of at least
`window` words gives all its runs of that many words, a shorter one itself. The automaton runs over word numbers, so a
match ends at a word index, which maps to the original text's offsets. Documents are scanned once, where they are read. A
benchmark of more than `max_words` words would make an automaton that outgrows a worker: its items are dealt into parts, and
each part's automaton passes over the texts in turn, adding to what the parts before have found.

Null and empty texts have no words and are never contaminated; items without words never occur; repeated items with one
id count once. An empty benchmark finds nothing, an empty table gives no rows. Repeated rows each get their own result. Columns
pass by only when named in `keep`; a name that is also an output raises. A text is held whole as a list of its words (about 100
bytes of memory for each word of the longest).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, check_keep, durable, tidy

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def _word_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text.translate(_LOWER))]


class Automaton:
    """The automaton of some items' windows; `items[i]` are the ids of the items that have window i."""

    def __init__(self, table: tuple[list, int]):
        items, window = table
        windows: dict[tuple[bytes, ...], set] = {}
        for item, text in items:
            words = tuple(normal_words(text))
            for i in range(max(1, len(words) - window + 1) if words else 0):
                windows.setdefault(words[i : i + window], set()).add(item)
        self.numbers: dict[bytes, int] = {}
        self.sizes, self.items = [], []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for words, owners in windows.items():
            self.automaton.add_word(tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words), len(self.items))
            self.sizes.append(len(words))
            self.items.append(owners)
        self.automaton.make_automaton()

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(first word, end, window) of each occurrence of a window."""
        if not words or not self.items:
            return []
        number = self.numbers.get
        return [(end + 1 - self.sizes[i], end + 1, i) for end, i in self.automaton.iter(tuple([number(w, 0) for w in words]))]


def _ranges(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of the occurrences as maximal runs of words."""
    out: list[list[int]] = []
    for start, end in sorted(found):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def find_contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = 13, max_words: int = 150_000) -> DataFrame:
    """The columns of `keep`, n_words, n_hit (words inside an occurrence), items (sorted distinct ids as strings) and spans
    (start, end in characters of the original text)."""
    check_keep(keep, ("n_words", "n_hit", "items", "spans"))
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    n_words = items.agg(F.sum(F.size(F.split("t", r"\s+"))).alias("n")).first().n or 0
    parts = max(1, -(-n_words // max_words))
    source = df.select(*[F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)], F.col(text).alias("__text"), F.lit(b"").alias("__runs"), F.array().cast("array<string>").alias("__items"))
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == part).collect()  # at most about max_words words
        shared = Shared(df.sparkSession, (sorted((r.i, r.t) for r in own), window))
        if part < parts - 1:
            source = durable(_pass(source, shared, keep, df.select(*keep).schema, False))
    return _pass(source, shared, keep, df.select(*keep).schema, True)


def _pass(source: DataFrame, shared: Shared, keep: tuple[str, ...], kinds: T.StructType, last: bool) -> DataFrame:
    """What one automaton finds, added to __runs (packed word ranges) and __items; the last pass makes the result."""
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*kinds, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", spans)]) if last else source.schema
    span_type, columns = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.once(Automaton)
        for batch in batches:
            n_words, n_hit, items, places, packed = [], [], [], [], []
            for value, runs, known in zip(batch.column("__text"), batch.column("__runs"), batch.column("__items"), strict=True):
                t = value.as_py()
                words = normal_words(t)
                n_words.append(len(words))
                found = automaton.matches(words)
                runs = np.frombuffer(runs.as_py(), np.int64).reshape(-1, 2).tolist()
                if found:
                    runs = _ranges([(a, b) for a, b, _ in found] + [(a, b) for a, b in runs])
                items.append(sorted({*known.as_py(), *(x for i in {i for *_, i in found} for x in automaton.items[i])}))
                n_hit.append(sum(b - a for a, b in runs))
                packed.append(np.array(runs, np.int64).tobytes())
                at = _word_spans(t) if last and runs else []
                places.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs] if last else [])
            passing = [batch.column(f"__keep_{i}") for i in range(len(keep))]
            if last:
                new = [pa.array(np.array(n_words, np.int64)), pa.array(np.array(n_hit, np.int64)), pa.array(items, pa.list_(pa.string())), pa.array(places, span_type)]
                yield pa.RecordBatch.from_arrays([*passing, *new], [*keep, "n_words", "n_hit", "items", "spans"])
            else:
                yield pa.RecordBatch.from_arrays([*passing, batch.column("__text"), pa.array(packed, pa.binary()), pa.array(items, pa.list_(pa.string()))], columns)

    return source.mapInArrow(tidy(run), schema)


def contaminated(percent: int = 5):
    """A document is contaminated when at least this share of its words, and one at least, is hit."""
    return (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))
