"""Integer vectors, and searches of many query rows against all rows.

Vectors become 64-bit integers, floor(scale * x), packed into a binary column. Rows without an id, without a vector, or with a
null, NaN or infinite component take no part. A vector that is shorter than another counts as padded with zeros, an empty one
has the product 0 with all. Components beyond 2**53 after scaling raise.

A search deals queries and rows into groups of bounded size; every pair of groups meets in one task, which returns the best few
of its rows for each of its queries. So neither side is ever in one place, and a hot vector, label or id is dealt like any other
row: groups are chosen by a running number, not by content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Batches, durable, give_back, tidy

#: Rows of a group of queries and of a group of rows, at most about these; and least rows worth a task of their own.
QUERY_GROUP, ROW_GROUP, LEAST_GROUP = 4_096, 65_536, 2_048
_EXACT = 1 << 53


def matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Packed vectors as rows of one matrix of 64-bit integers, padded with zeros to the widest (or to width)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros((0, width or 0), np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].copy().view(np.int64)
    lengths = np.diff(offsets) // 8
    width = max(int(lengths.max()), width or 0)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def exact_floats(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether every partial sum of products of rows of a and b is an integer that a double holds exactly."""
    return int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[-1]) < _EXACT


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers; a sum that could pass 64 bits raises."""
    if exact_floats(rows, query):
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if int(np.abs(rows).max(initial=0)) * int(np.abs(query).max(initial=0)) * max(1, rows.shape[-1]) >= 1 << 63:
        raise ValueError("inner products of these vectors pass 64 bits")
    return rows @ query


def integer_vectors(df: DataFrame, id_: str, vector: str, scale: float = 256.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, vec (packed), and the columns of keep, of the rows that take part; computed once, into the shared folder, with a running
    number `no` that stays the same whenever the rows are read again."""
    source = df.select(F.col(id_).alias("id"), *keep, F.col(vector).cast("array<double>").alias("__vector")).where("id IS NOT NULL AND __vector IS NOT NULL")
    schema = T.StructType([*[f for f in source.schema if f.name != "__vector"], T.StructField("vec", T.BinaryType())])

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("__vector")
            values = lists.flatten()
            x = values.to_numpy(zero_copy_only=False) if len(values) else np.zeros(0)
            lengths = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            owner = np.repeat(np.arange(len(lists)), lengths)
            fine = np.ones(len(lists), bool)
            fine[owner[~np.isfinite(x)]] = False  # a null component has become NaN
            x, lengths = x[fine[owner]], lengths[fine]
            scaled = np.floor(scale * x)
            if not (np.abs(scaled) <= _EXACT).all():
                raise ValueError("a component is beyond 2**53 after scaling")
            ends = np.concatenate([[0], np.cumsum(lengths)]) * 8
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(scaled.astype("<i8").tobytes())]).cast(pa.binary())
            kept = batch.filter(pa.array(fine))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("id", *keep)), packed], ["id", *keep, "vec"])

    return durable(source.mapInArrow(tidy(run), schema)).withColumn("no", F.monotonically_increasing_id())


def groups_of(n: int, most: int, parallelism: int = 1) -> int:
    """Groups for n rows: of `most` rows at most, or smaller where that leaves cores idle."""
    return max(1, -(-n // most), min(parallelism, n // LEAST_GROUP))


def search_in_groups(queries: DataFrame, rows: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType, query_groups: int, row_groups: int, only: range | None = None) -> DataFrame:
    """search(queries, rows) for every pair of a group of queries and a group of rows (of the row groups `only`, where given).
    Both tables have a column `no`; their other columns are prefixed q_ and r_ inside the exchange."""
    group = lambda n: F.pmod(F.xxhash64("no"), F.lit(n)).cast("int")
    only = range(row_groups) if only is None else only
    one = queries.select(group(query_groups).alias("__q"), *[F.col(c).alias(f"q_{c}") for c in queries.columns if c != "no"])
    one = one.withColumn("__r", F.explode(F.sequence(F.lit(only.start), F.lit(only.stop - 1))))
    two = rows.select(group(row_groups).alias("__r"), *[F.col(c).alias(f"r_{c}") for c in rows.columns if c != "no"]).where(F.col("__r").between(only.start, only.stop - 1))
    two = two.withColumn("__q", F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1))))
    asked = [c for c in one.columns if c.startswith("q_")]
    met = [c for c in two.columns if c.startswith("r_")]
    both = one.withColumn("__asks", F.lit(True)).unionByName(two.withColumn("__asks", F.lit(False)), allowMissingColumns=True)

    empty = to_arrow_schema(schema).empty_table()

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("__asks")
        q = table.filter(asks).select(asked).rename_columns([c[2:] for c in asked])
        r = table.filter(pc.invert(asks)).select(met).rename_columns([c[2:] for c in met])
        out = search(q, r) if q.num_rows and r.num_rows else empty
        give_back()
        return out

    # More partitions than pairs of groups, so that few pairs share one.
    dealt = both.repartition(3 * query_groups * len(only), "__q", "__r")
    return dealt.groupBy("__q", "__r").applyInArrow(run, schema)
