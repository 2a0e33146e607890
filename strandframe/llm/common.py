"""Shared helpers: text as numpy arrays, hashing of spans, durable intermediate results."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes at a time (a longer text is taken whole, alone).
STEP_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the cluster's own setting, or a temporary one where none is set and all runs in one
    local process. On a cluster a folder of one machine would be of no use to the others, so a missing setting raises."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    folder = folder or tempfile.mkdtemp(prefix="strandframe-checkpoints-")
    context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Compute df once into the shared checkpoint folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Return freed memory to the system; a worker that waits for its next task would hold on to it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, giving back memory when its task ends."""

    def whole(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


class Shared:
    """A broadcast value of bounded size, and what each worker builds of it once."""

    _built: dict[str, object] = {}

    def __init__(self, spark: SparkSession, value):
        self.key = uuid.uuid4().hex
        self.broadcast = spark.sparkContext.broadcast(value)

    def once(self, make=lambda value: value):
        if self.key not in Shared._built:
            Shared._built.clear()
            Shared._built[self.key] = make(self.broadcast.value)
        return Shared._built[self.key]


def check_keep(keep: tuple[str, ...], outputs: tuple[str, ...]) -> None:
    """Columns that pass by must not bear the name of an output, nor occur twice."""
    clash = sorted({c for c in keep if c in outputs or list(keep).count(c) > 1})
    if clash:
        raise ValueError(f"columns to keep clash with the result's: {', '.join(clash)}; rename them first")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate files, wherever Spark can write."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of each text) of a string column; null counts as empty."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def in_steps(batches: Iterator[pa.RecordBatch], text: str, step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about step_bytes of text each; a text is never split."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + step_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < n:
        size = max(n, STEP_BYTES + (1 << 17))
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        table = np.multiply.accumulate(steps)
        _powers[name] = table
    return table[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class SpanHasher:
    """64-bit hashes of any byte spans of one array, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        codes = _BYTE_CODES[data]
        codes *= _power_table("up", _BASE, len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes, out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        down = _power_table("down", _BASE_INVERSE, len(self.sums))
        raw = (self.sums[ends] - self.sums[starts]) * down[starts]
        return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def pieces(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, stop) of runs of ascending spans that cover about STEP_BYTES; a span that is longer stands alone."""
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + STEP_BYTES, side="right")))
        yield at, stop
        at = stop


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of ascending spans, of data[...] as table translates it; a piece at a time, so memory stays that of a piece.
    A span of more than STEP_BYTES is hashed by itself, in place."""
    out = np.empty(len(starts), np.uint64)
    for i, j in pieces(starts, ends):
        begin, end = int(starts[i]), int(ends[j - 1])
        part = data[begin:end] if table is None else table[data[begin:end]]
        if end - begin > STEP_BYTES:
            out[i] = xxhash.xxh3_64_intdigest(np.ascontiguousarray(part))
        else:
            out[i:j] = SpanHasher(part).hash(starts[i:j] - begin, ends[i:j] - begin)
    return out


def span_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """How many bytes of each of ascending spans have table[byte], a piece at a time."""
    out = np.zeros(len(starts), np.int64)
    for i, j in pieces(starts, ends):
        begin = int(starts[i])
        sums = np.zeros(int(ends[j - 1]) - begin + 1, np.int64)
        np.cumsum(table[data[begin : int(ends[j - 1])]], out=sums[1:])
        out[i:j] = sums[ends[i:j] - begin] - sums[starts[i:j] - begin]
    return out


#: Bytes that begin a character.
BEGINS = np.arange(256) & 0xC0 != 0x80

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, index of the text) of the words, which bytes of `outside` (white space) and text ends separate."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~outside[data]
    start = inside[1:-1] & ~inside[:-2]
    first = offsets[:-1][offsets[:-1] < len(data)]
    start[first] = inside[1:-1][first]
    starts = np.flatnonzero(start)
    end = inside[1:-1] & ~inside[2:]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = inside[1:-1][last]
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the lines, which line feeds and text ends separate."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.union1d(offsets[:-1], breaks + 1)
    starts = starts[starts < len(data)]
    next_break = np.append(breaks, len(data))[np.searchsorted(breaks, starts)]
    return starts, np.minimum(next_break, offsets[np.searchsorted(offsets, starts, side="right")])


def combine(hashes: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of k consecutive entries, one for each start."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + hashes[j : j + n]
    return mix64(out)


def best_of(df: DataFrame, keys: tuple[str, ...], order: list, k: int, salt=None) -> DataFrame:
    """The first k rows of each key, with their rank from 1. With salt (a column) rows of a key are first reduced in the salt's
    groups, so that a key to which very many tasks have sent rows is not sorted by one."""
    ranked = lambda d, by: d.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    if salt is not None:
        df = ranked(df.withColumn("__salt", salt), [*keys, "__salt"]).drop("rank", "__salt")
    return ranked(df, keys)
