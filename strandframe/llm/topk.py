"""Exact top-k search by aggregation of sorted lists, without random access.

A group of rows has a sorted list for every component of the vectors. A query reads its lists from its own best end, all to the
same depth, and adds up what it has seen of each row. What a list shows at that depth bounds what a row not yet seen there can
still add, and the list's other end what it must add at least. So every row has an upper and a lower bound, and the query's k-th
score so far (of rows settled before, or the k-th lower bound) is a floor: rows whose upper bound is under it are out for good.
Reading stops when the outsiders cannot qualify and few rows are left, whose final scores are then resolved exactly.

The first group of rows is searched before the others and gives each query its floor; inside a group, blocks grow, and
the floor rises from block to block. The k best of each group are merged with a ranked window.

Queries of one id are one: the least vector by its bytes asks. Every row with the query's id is its own. Repeated rows are
candidates each for itself. Equal scores are ranked by id. Nulls, widths and sizes of vectors: see `vectors`. Empty tables give
no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import best_of, durable
from .vectors import QUERY_GROUP, ROW_GROUP, exact_floats, groups_of, integer_vectors, matrix, products, search_in_groups

#: Shares of the lists that are read before the bounds are compared.
DEPTHS = (0.5, 0.625, 0.75, 0.875)
#: Rows of the first and of the largest block.
FIRST_BLOCK, BLOCK = 2_048, 8_192
#: A block's reading ends when a share of its rows of at most one in this many is left.
LEFT = 8


class SortedLists:
    """The lists of one block: for each component the rows in order of its value, forwards and backwards."""

    def __init__(self, vectors: np.ndarray):
        order = np.argsort(vectors, axis=0, kind="stable").T
        self.n, d = len(vectors), vectors.shape[1]
        rank = np.empty(order.shape, np.int32)
        np.put_along_axis(rank, order, np.arange(self.n, dtype=np.int32)[None], 1)
        values = np.take_along_axis(vectors.T, order, 1).astype(np.float64)
        # Lists 0 to d - 1 have the greatest first, lists d to 2 d - 1 the least first.
        self.rank = np.concatenate([self.n - 1 - rank, rank])
        rows, values = np.concatenate([order[:, ::-1], order]), np.concatenate([values[:, ::-1], values])
        ends = sorted({int(self.n * share) for share in DEPTHS} - {0})
        self.parts = [(end, np.ascontiguousarray(rows[:, begin:end]), np.ascontiguousarray(values[:, begin:end])) for begin, end in zip([0, *ends], ends)]
        self.least = values[:, -1].copy() if self.n else np.zeros(2 * d)
        # Room that every query uses again.
        self.read = [(np.empty((d, r.shape[1]), r.dtype), np.empty((d, r.shape[1]))) for _, r, _ in self.parts]
        self.ranks, self.unseen = np.empty((d, self.n), np.int32), np.empty((d, self.n), np.float32)

    def candidates(self, query: np.ndarray, k: int, floor: float, out: np.ndarray) -> np.ndarray:
        """Rows that may be among the query's best k with a score of floor at least; `out` marks rows that are not asked about."""
        q = query.astype(np.float64)
        lists = np.arange(len(q)) + len(q) * (q < 0)
        least, total, alive = q * self.least[lists], np.zeros(self.n), ~out
        np.take(self.rank, lists, axis=0, out=self.ranks, mode="clip")
        for (depth, rows, values), (at, seen) in zip(self.parts, self.read):
            if np.count_nonzero(alive) <= k:
                break
            np.take(rows, lists, axis=0, out=at, mode="clip")
            np.take(values, lists, axis=0, out=seen, mode="clip")
            next_best = q * seen[:, -1]
            seen *= q[:, None]
            total += np.bincount(at.ravel(), weights=seen.ravel(), minlength=self.n)
            np.greater_equal(self.ranks, depth, out=self.unseen, casting="unsafe")
            bounds = np.stack([least, next_best])
            slack = 1e-5 * np.abs(bounds).sum(axis=1)  # single precision
            rest_least, rest_most = bounds.astype(np.float32) @ self.unseen
            lower = (total + rest_least - slack[0])[alive]
            if len(lower) >= k:
                floor = max(floor, np.partition(lower, len(lower) - k)[len(lower) - k])
            alive &= total + rest_most + slack[1] >= floor
            if np.count_nonzero(alive) * LEFT <= self.n:
                break
        return np.flatnonzero(alive)


def nearest_rows(queries: pa.Table, rows: pa.Table, k: int, blocks: tuple[int, int] = (FIRST_BLOCK, BLOCK)) -> pa.Table:
    """query_id, id and score of the k best of the rows for each query that reach the query's floor; ties by id."""
    rows = rows.take(pc.sort_indices(rows, [("id", "ascending"), ("vec", "ascending")]))
    x = matrix(rows.column("vec"))
    q = matrix(queries.column("vec"), x.shape[1])
    x = x if x.shape[1] == q.shape[1] else matrix(rows.column("vec"), q.shape[1])
    exact = exact_floats(x, q)
    numbers = {i: n for n, i in enumerate(dict.fromkeys(rows.column("id").to_pylist()))}
    row_id = np.array([numbers[i] for i in rows.column("id").to_pylist()], np.int64)
    query_id = np.array([numbers.get(i, -1) for i in queries.column("id").to_pylist()], np.int64)
    floors = queries.column("floor").to_pylist()
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q]
    deal = np.random.default_rng(0).permutation(len(x))  # a block must not be a stretch of ids
    start, size = 0, blocks[0]
    while start < len(x):
        block = np.sort(deal[start : start + size])
        start, size = start + size, min(2 * size, blocks[1])
        lists = SortedLists(x[block]) if exact else None
        for i in range(len(q)):
            scores, found = best[i]
            floor = max(-np.inf if floors[i] is None else floors[i], scores[-1] if len(scores) == k else -np.inf)
            own = row_id[block] == query_id[i]
            # Sums that doubles do not hold exactly are not bounded: such rows are all resolved.
            left = block[lists.candidates(q[i], k, floor, own) if exact else np.flatnonzero(~own)]
            new = products(x[left], q[i])
            left, new = left[new >= floor], new[new >= floor]
            scores, found = np.concatenate([scores, new]), np.concatenate([found, left])
            order = np.lexsort((found, -scores))[:k]
            best[i] = scores[order], found[order]
    counts = [len(s) for s, _ in best]
    take = lambda column, at: column.take(pa.array(at)).combine_chunks()
    asked, met, scores = np.repeat(np.arange(len(q)), counts), np.concatenate([f for _, f in best]), np.concatenate([s for s, _ in best])
    return pa.table({"query_id": take(queries.column("id"), asked), "id": take(rows.column("id"), met), "score": pa.array(scores, pa.int64())})


def top_k(df: DataFrame, queries: Column, k: int = 5, id_: str = "vec_id", vector: str = "embedding", scale: float = 256.0, blocks: tuple[int, int] = (FIRST_BLOCK, BLOCK)) -> DataFrame:
    """query_id, rank, the id and score of the k greatest inner products with every row of df that `queries` (a condition) chooses.
    blocks: rows of the first and of the largest block."""
    spark = df.sparkSession
    rows = integer_vectors(df.withColumn("__asks", F.coalesce(queries, F.lit(False))), id_, vector, scale, ("__asks",))
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("id", kind), T.StructField("score", T.LongType())])
    asking = rows.where("__asks").groupBy("id").agg(F.min(F.struct("vec", "no")).alias("v")).select("id", "v.vec", "v.no")
    n = rows.agg(F.count("*").alias("rows"), F.count_if("__asks").alias("queries")).first()
    row_groups, query_groups = groups_of(n.rows, ROW_GROUP, 2 * spark.sparkContext.defaultParallelism), groups_of(n.queries, QUERY_GROUP)
    candidates = rows.select("id", "vec", "no")
    find = lambda q, r: nearest_rows(q, r, k, blocks)
    first = durable(search_in_groups(asking.withColumn("floor", F.lit(None).cast("long")), candidates, find, schema, query_groups, row_groups, range(1)))
    found = first
    if row_groups > 1:
        floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor")).withColumnRenamed("query_id", "id")
        found = first.unionByName(search_in_groups(asking.join(floors, "id", "left"), candidates, find, schema, query_groups, row_groups, range(1, row_groups)))
    ranked = best_of(found, ("query_id",), [F.desc("score"), F.asc("id")], k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_), "score")
