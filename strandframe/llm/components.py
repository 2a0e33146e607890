"""Connected components of an edge table: local contraction, then alternating large-star and small-star steps.

Groups of about `local_edges` edges are first contracted by union-find, each in one task; a table that fits one group is
then done. Otherwise star steps join what the groups left apart.

Every step keeps the number of edges at most the same and moves them to smaller ids; the edges end as stars around each
component's least id. Minimums are pre-aggregated before each exchange, and the joins can be split where a vertex has
many edges. Nothing is collected: only a count and a checksum of the edges reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, tidy


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex sends its greater neighbours to its least neighbour, itself included."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex sends its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (u, least v) with the same components as the edges of the partition."""
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    ids, places = np.unique(np.concatenate([x for part in zip(*parts, strict=True) for x in part]), return_inverse=True)
    parent = list(range(len(ids)))
    half = len(places) // 2
    for a, b in zip(places[:half].tolist(), places[half:].tolist(), strict=True):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)
    root = np.arange(len(ids))
    for i, p in enumerate(parent):  # a parent is never greater, so it is settled before
        root[i] = root[p]
    own = root != np.arange(len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], ["u", "v"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", local_edges: int = 1_000_000) -> DataFrame:
    """id and component (the least id it is connected to) of every id that occurs in an edge. Nulls and loops are left out."""
    now = durable(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v"))
    groups = -(-now.count() // local_edges)
    if groups:
        now = durable(now.coalesce(groups).mapInArrow(tidy(_contract), "u long, v long"))
    if groups > 1:
        mark = None
        while True:  # every round but the last joins vertices, so it ends; rounds grow with the logarithm of the longest path
            now = durable(_small_star(_large_star(now)))
            mark, before = _mark(now), mark
            if mark == before:
                break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
