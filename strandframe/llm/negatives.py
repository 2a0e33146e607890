"""Hard-negative mining through an inverted multi-index.

Vectors are cut in two halves, and each half has a codebook of centres, fitted on a bounded sample; a row's pair of nearest
centres is its cell. Every row is indexed. A group of rows keeps its cells' rows together, and for each half-centre the radius of
the rows around it. For a query, half the bound of a cell is the centre's product plus the query half's length times the
radius; the two halves' bounds, each in descending order, span a grid that a heap walks in order of their sum (multi-sequence
search), so cells come greatest bound first and no row of a later cell scores more than the next bound.

The first search gives each anchor its positives, the best rows of its label: it stops when the next bound is under the last of
them. The second gives each anchor and positive its negatives: rows of other labels whose score lies in the window that the
positive's score sets; it stops when every window has its number of rows over the next bound, or the bound is under the window.
Both results are therefore exact within a group, at any fit of the codebooks, and so are the merged ones (recall 1).

Rows without label take no part, nor those named in `vectors`. Anchors of one id are one: the least (label, vector) asks. Every
row with the anchor's id is its own, neither positive nor negative. Repeated rows stand each for itself, but positives equal in id and score ask once. Ties are ranked by id.
Where no window can be met (a positive's score under 0) there are no rows. Empty tables give none; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, Shared, best_of, durable, tidy
from .vectors import QUERY_GROUP, ROW_GROUP, groups_of, integer_vectors, matrix, products, search_in_groups

#: Rows on which the codebooks are fitted at most (those of least hash), centres of a half, and rounds of fitting.
SAMPLE, CENTRES, ROUNDS = 16_384, 12, 8
#: Rows that are gathered from cells before they are scored together.
TOGETHER = 2_048


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1), 0)


def fit_codebooks(sample: np.ndarray, centres: int = CENTRES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Centres of the first and of the second half, by Lloyd's rounds from rows of the sample."""
    half, out, draw = sample.shape[1] // 2, [], np.random.default_rng(0)
    for x in (sample[:, :half].astype(np.float64), sample[:, half:].astype(np.float64)):
        c = x[np.sort(draw.permutation(len(x))[:centres])]
        for _ in range(rounds):
            nearest = _distances(x, c).argmin(1)
            size = np.bincount(nearest, minlength=len(c))
            sums = np.stack([np.bincount(nearest, weights=column, minlength=len(c)) for column in x.T], axis=1) if x.shape[1] else np.zeros_like(c)
            c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
        out.append(c)
    return out[0], out[1]


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


class MultiIndex:
    """The cells of some rows, and for each half-centre the radius of the rows around it."""

    def __init__(self, vectors: np.ndarray, codes: np.ndarray, books: tuple[np.ndarray, np.ndarray], members: np.ndarray):
        self.books, self.half = books, books[0].shape[1]
        n = len(books[0])
        order = members[np.argsort(codes[members], kind="stable")]
        self.rows, self.vectors = order, vectors[order]
        self.ends = np.searchsorted(codes[order], np.arange(1, n * len(books[1]) + 1))
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.radius = []
        self.floats, self.largest = self.vectors.astype(np.float64), float(np.abs(self.vectors).max(initial=0))
        x = self.floats
        for part, book, code in ((x[:, : self.half], books[0], codes[order] // len(books[1])), (x[:, self.half :], books[1], codes[order] % len(books[1]))):
            radius = np.full(len(book), -np.inf)  # without rows: no bound reaches it
            np.maximum.at(radius, code, np.sqrt(((part - _wide(book, part.shape[1])[code]) ** 2).sum(1)))
            self.radius.append(radius)

    def cells(self, query: np.ndarray) -> Iterator[tuple[float, int]]:
        """(bound, cell) in descending order of the bound, of cells whose halves both have rows."""
        ordered = []
        for part, book, radius in ((query[: self.half], self.books[0], self.radius[0]), (query[self.half :], self.books[1], self.radius[1])):
            held = np.flatnonzero(radius >= 0)
            bound = _wide(book, len(part))[held] @ part + np.linalg.norm(part) * radius[held]
            best = np.argsort(-bound, kind="stable")
            ordered.append((bound[best].tolist(), held[best].tolist()))
        (first, i_of), (second, j_of) = ordered
        # The grid's rows are descending streams: the next of a row enters when one is taken, the next row with its first.
        heap = [(-first[0] - second[0], 0, 0)] if first and second else []
        while heap:
            bound, i, j = heapq.heappop(heap)
            yield -bound, i_of[i] * len(self.books[1]) + j_of[j]
            if j + 1 < len(second):
                heapq.heappush(heap, (-first[i] - second[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(first):
                heapq.heappush(heap, (-first[i + 1] - second[0], i + 1, 0))

    def batches(self, query: np.ndarray, certain) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their scores), cells in order of their bounds, until certain(bound): no row scoring that or less is wanted."""
        q = query.astype(np.float64)
        reach = float(np.abs(q).sum()) * self.largest
        slack = 1e-3 + 1e-9 * reach  # bounds are rounded, scores are not
        exact = reach < 1 << 53
        held: list[tuple[int, int]] = []
        waiting = 0

        def scored() -> tuple[np.ndarray, np.ndarray]:
            at = np.concatenate([np.arange(a, b) for a, b in held])
            return self.rows[at], (self.floats[at] @ q).astype(np.int64) if exact else products(self.vectors[at], query)

        for bound, cell in self.cells(q):
            if certain(bound + slack):
                break
            if self.ends[cell] > self.starts[cell]:
                held.append((self.starts[cell], self.ends[cell]))
                waiting += self.ends[cell] - self.starts[cell]
            if waiting >= TOGETHER:
                yield scored()
                held, waiting = [], 0
        if held:
            yield scored()


class _Group:
    """Anchors and rows of one task. Rows are in order of their ids, so that a lower number wins a tie."""

    def __init__(self, anchors: pa.Table, rows: pa.Table):
        self.table = rows.take(pc.sort_indices(rows, [("id", "ascending"), ("vec", "ascending")]))
        x, q = matrix(self.table.column("vec")), matrix(anchors.column("vec"))
        width = max(x.shape[1], q.shape[1])
        self.x, self.q = _wide(x, width), _wide(q, width)
        self.codes = self.table.column("code").to_numpy().astype(np.int64)
        labels: dict[object, int] = {}
        self.label = np.array([labels.setdefault(v, len(labels)) for v in self.table.column("label").to_pylist()], np.int64)
        self.q_label = np.array([labels.get(v, -1) for v in anchors.column("label").to_pylist()], np.int64)
        ids = {v: n for n, v in enumerate(dict.fromkeys(self.table.column("id").to_pylist()))}
        self.id = np.array([ids[v] for v in self.table.column("id").to_pylist()], np.int64)
        self.q_id = np.array([ids.get(v, -1) for v in anchors.column("id").to_pylist()], np.int64)

    def ids(self, at: list[int]) -> pa.Array:
        return self.table.column("id").take(pa.array(at, pa.int64())).combine_chunks()


def _first(rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((rows, -scores))[:k]
    return rows[order], scores[order]


def positives_in_group(anchors: pa.Table, rows: pa.Table, books: tuple[np.ndarray, np.ndarray], k: int) -> pa.Table:
    """anchor_id, id and score of each anchor's first k other rows of its label."""
    group = _Group(anchors, rows)
    of_label: dict[int, MultiIndex] = {}
    asked, met, reached = [], [], []
    for a in range(len(group.q)):
        label = int(group.q_label[a])
        if label < 0:
            continue
        if label not in of_label:
            of_label[label] = MultiIndex(group.x, group.codes, books, np.flatnonzero(group.label == label))
        best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for new, got in of_label[label].batches(group.q[a], lambda bound: len(scores) == k and bound < scores[-1]):  # noqa: B023
            other = group.id[new] != group.q_id[a]
            best, scores = _first(np.concatenate([best, new[other]]), np.concatenate([scores, got[other]]), k)
        asked += [a] * len(best)
        met += best.tolist()
        reached += scores.tolist()
    return pa.table({"anchor_id": anchors.column("id").take(pa.array(asked, pa.int64())).combine_chunks(), "id": group.ids(met), "score": pa.array(reached, pa.int64())})


def negatives_in_group(anchors: pa.Table, rows: pa.Table, books: tuple[np.ndarray, np.ndarray], k: int, window: tuple[int, int]) -> pa.Table:
    """anchor_id, positive_id, positive_score, id and score: for each positive the first k rows of other labels in its window."""
    group = _Group(anchors, rows)
    index = MultiIndex(group.x, group.codes, books, np.arange(len(group.x)))
    asked, positive, positive_score, met, reached = [], [], [], [], []
    for a, positives in enumerate(anchors.column("positives").to_pylist()):
        low = np.array([-(-window[0] * p["score"] // 100) for p in positives], np.int64)
        high = np.array([window[1] * p["score"] // 100 for p in positives], np.int64)
        open_ = np.flatnonzero(low <= high)
        if not len(open_):
            continue
        best = {w: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for w in open_.tolist()}
        needed = int(low[open_].min())
        for new, got in index.batches(group.q[a], lambda bound: bound < needed):  # noqa: B023
            wanted = (group.id[new] != group.q_id[a]) & (group.label[new] != group.q_label[a]) & (got >= needed) & (got <= high[open_].max())
            if not wanted.any():
                continue
            new, got = new[wanted], got[wanted]
            for w, (held, scores) in best.items():
                inside = (got >= low[w]) & (got <= high[w])
                if inside.any():
                    best[w] = _first(np.concatenate([held, new[inside]]), np.concatenate([scores, got[inside]]), k)
            needed = min(int(s[-1]) if len(s) == k else int(low[w]) for w, (_, s) in best.items())
        for w, (held, scores) in best.items():
            asked += [a] * len(held)
            positive += [positives[w]["id"]] * len(held)
            positive_score += [positives[w]["score"]] * len(held)
            met += held.tolist()
            reached += scores.tolist()
    names = anchors.column("id")
    return pa.table({
        "anchor_id": names.take(pa.array(asked, pa.int64())).combine_chunks(), "positive_id": pa.array(positive, names.type),
        "positive_score": pa.array(positive_score, pa.int64()), "id": group.ids(met), "score": pa.array(reached, pa.int64()),
    })


def coded(rows: DataFrame, books: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """rows with the number of their cell."""
    sent = Shared(rows.sparkSession, books)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        first, second = sent.once()
        for batch in batches:
            width = first.shape[1] + second.shape[1]
            x = _wide(matrix(batch.column("vec"), width), width).astype(np.float64)
            code = _distances(x[:, : first.shape[1]], first).argmin(1) * len(second) + _distances(x[:, first.shape[1] :], second).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.int32())], [*batch.schema.names, "code"])

    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields, T.StructField("code", T.IntegerType())]))


def hard_negatives(
    df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95),
    id_: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0, sample: int = SAMPLE, centres: int = CENTRES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row that `anchors` (a condition) chooses and
    each of its first `positives` rows of the same label, the first `negatives` rows of other labels whose score is at least
    window[0] and at most window[1] per cent of the positive's."""
    spark = df.sparkSession
    chosen = df.withColumns({"__label": F.col(label), "__asks": F.coalesce(anchors, F.lit(False))}).where("__label IS NOT NULL").select(F.col(id_).alias("__i"), F.col(vector).alias("__v"), F.col("__label").alias("label"), "__asks")
    rows = integer_vectors(chosen, "__i", "__v", scale, ("label", "__asks"))
    kind = rows.schema["id"].dataType
    n = rows.agg(F.count("*").alias("rows"), F.count_if("__asks").alias("anchors")).first()
    fitted = rows.orderBy(F.xxhash64("id", "vec"), "no").limit(sample).select("vec").toArrow()
    books = fit_codebooks(matrix(fitted.column("vec")).astype(np.float64), centres) if fitted.num_rows else (np.zeros((1, 0)), np.zeros((1, 0)))
    row_groups, anchor_groups = groups_of(n.rows, ROW_GROUP, 2 * spark.sparkContext.defaultParallelism), groups_of(n.anchors, QUERY_GROUP)
    indexed = durable(coded(rows.drop("no"), books)).withColumn("no", F.monotonically_increasing_id())
    candidates = indexed.select("id", "label", "vec", "code", "no")
    asking = indexed.where("__asks").groupBy("id").agg(F.min(F.struct("label", "vec", "no")).alias("a")).select("id", "a.label", "a.vec", "a.no")
    sent = Shared(spark, books)
    field = lambda name, t: T.StructField(name, t)
    near = search_in_groups(
        asking, candidates, lambda a, r: positives_in_group(a, r, sent.once(), positives),
        T.StructType([field("anchor_id", kind), field("id", kind), field("score", T.LongType())]), anchor_groups, row_groups,
    )
    best = best_of(near, ("anchor_id",), [F.desc("score"), F.asc("id")], positives).groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_set(F.struct("score", "id"))).alias("positives"))
    with_positives = durable(asking.join(best, "id"))
    far = search_in_groups(
        with_positives, candidates, lambda a, r: negatives_in_group(a, r, sent.once(), negatives, window),
        T.StructType([field("anchor_id", kind), field("positive_id", kind), field("positive_score", T.LongType()), field("id", kind), field("score", T.LongType())]), anchor_groups, row_groups,
    )
    ranked = best_of(far, ("anchor_id", "positive_id", "positive_score"), [F.desc("score"), F.asc("id")], negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
