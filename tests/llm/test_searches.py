"""The three searches against plain versions: given tables, difficult rows (nulls, ties, repeated rows, ragged vectors), empty tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.llm import lexical, negatives, queries, topk, vectors

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_ranks(documents, items, k=50):
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in documents]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def _ranked(spark, documents, items, **options):
    d = spark.createDataFrame(documents, "doc_id long, text string").withColumns({"score": F.lit(1), "rank": F.lit("x"), "item_id": F.lit(2)})
    return sorted((tuple(r) for r in lexical.rank_documents(d, spark.createDataFrame(items, "item_id string, text string"), **options).collect()), key=str)


def test_ranks_of_difficult_rows(spark):
    r = random.Random(3)
    words = ["Über", "straße", "a", "B", "b", "x9", "日本", "don't", "naïve", "the", "rare", "K"]
    text = lambda n: " ".join(r.choices(words, [1, 2, 9, 5, 5, 1, 1, 2, 1, 9, 0.2, 1], k=n))
    documents = [(i, text(r.randint(1, 40))) for i in range(300)] + [(1000 + i, "the same rare text") for i in range(90)]
    documents += [(5, None), (6, ""), (7, "!!! ..."), (None, "rare rare"), (8, "rare " * 20_000), (9, "y" * 70_000), documents[0], documents[0]]
    items = [("q1", "The RARE same"), ("q2", "don't über naïve"), ("q1", "b"), ("q3", None), ("q4", "--"), ("q5", "nowhere"), (None, "x9 日本"), ("q6", text(60))]
    want = plain_ranks(documents, items)
    assert want and _ranked(spark, documents, items) == want
    # Blocks and leaves of a few rows, several parts of items: the same.
    assert _ranked(spark, documents, items, part_bytes=40, block=(17, 200, 3)) == want
    assert _ranked(spark, documents, items, k=3) == plain_ranks(documents, items, 3)
    assert _ranked(spark, [], items) == [] and _ranked(spark, documents, []) == [] and _ranked(spark, [(1, None)], items) == []


def test_random_blocks_are_searched_exactly():
    draw = np.random.default_rng(1)
    for trial in range(60):
        n_docs, n_terms, n = int(draw.integers(1, 400)), int(draw.integers(1, 12)), int(draw.integers(1, 3000))
        keys = np.unique(draw.integers(0, n_docs * n_terms, n))
        doc, term = keys % n_docs, keys // n_docs
        impact = draw.integers(0, 4 if trial % 2 else 10**6, len(keys))
        block = lexical.Block(n_docs, doc, term, impact, n_terms)
        terms, weights = np.arange(0, n_terms, 1 + trial % 2), draw.integers(0, 5, n_terms)
        total = np.zeros(n_docs, np.int64)
        for t in terms:
            np.add.at(total, doc[term == t], weights[t] * impact[term == t])
        want = [(int(total[d]), int(d)) for d in np.lexsort((np.arange(n_docs), -total)) if total[d] > 0][:7]
        for leaf in (0, 10**9):
            assert lexical.search(block, terms, weights[terms], 7, lambda s, d: True, leaf) == want


def _rows(n, seed, dims=(8,), labels=4):
    draw = np.random.default_rng(seed)
    out = []
    for i in range(n):
        d = int(draw.choice(dims))
        out.append((i, [float(x) for x in draw.normal(size=d) * (0 if i % 41 == 0 else 1)], int(draw.integers(labels))))
    out += [(n + i, out[3][1], int(i % labels)) for i in range(n // 4)]  # one vector on a fifth of the rows
    out += [out[10], out[10], out[11]]  # repeated rows
    out += [(9001, None, 1), (9002, [1.0, None], 1), (9003, [float("nan")] * 8, 1), (9004, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (9005, [], 2), (9006, [1.0] * 8, None)]
    return out


def _whole(rows, labelled):
    fine = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (label is not None or not labelled)]
    return sorted(fine, key=lambda r: (r[0], np.array(r[1], "<i8").tobytes()))


def _asking(rows, every, key):
    first = {}
    for r in rows:
        if r[0] % every == 0 and (r[0] not in first or key(r) < key(first[r[0]])):
            first[r[0]] = r
    return first.values()


def _dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def plain_top(rows, every, k):
    rows = _whole(rows, False)
    out = []
    for q in _asking(rows, every, lambda r: np.array(r[1], "<i8").tobytes()):
        best = sorted((-_dot(q[1], r[1]), r[0]) for r in rows if r[0] != q[0])[:k]
        out += [(q[0], n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def plain_negatives(rows, every, n_positive=5, n_negative=3):
    rows, out = _whole(rows, True), []
    for q in _asking(rows, every, lambda r: (r[2], np.array(r[1], "<i8").tobytes())):
        ranked = sorted((-_dot(q[1], r[1]), r[0], r[2]) for r in rows if r[0] != q[0])
        positives = [(i, -s) for s, i, label in ranked if label == q[2]][:n_positive]
        for positive, ps in positives:
            inside = [(i, -s) for s, i, label in ranked if label != q[2] and 50 * ps <= -100 * s <= 95 * ps][:n_negative]
            out += [(q[0], positive, n, i, ps, s) for n, (i, s) in enumerate(inside, 1)]
    return sorted(out)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"no": F.lit(1), "vec": F.lit("v"), "code": F.lit(2), "floor": F.lit(3), "id": F.lit("i"), "score": F.lit(0)})


@pytest.mark.parametrize("dims", [(8,), (0, 1, 5, 8), (1,)])
def test_vectors_of_difficult_rows(spark, monkeypatch, dims):
    rows = _rows(400, 5, dims)
    want, want_negatives = plain_top(rows, 3, 4), plain_negatives(rows, 3)
    for least in (2_048, 50):  # one group, several groups
        monkeypatch.setattr(vectors, "LEAST_GROUP", least)
        assert sorted(tuple(r) for r in topk.top_k(_frame(spark, rows), F.col("vec_id") % 3 == 0, 4, blocks=(32, 64)).collect()) == want
        got = negatives.hard_negatives(_frame(spark, rows), F.col("vec_id") % 3 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        # Repeated positives ask the same question: each row of an id and score is one.
        assert sorted(tuple(r) for r in got.collect()) == sorted(set(want_negatives))


def test_no_rows_and_no_queries(spark):
    for rows in ([], [(1, [1.0], 1)], [(3, None, 1)]):
        assert topk.top_k(_frame(spark, rows), F.col("vec_id") % 3 == 0).count() == 0
        assert negatives.hard_negatives(_frame(spark, rows), F.col("vec_id") % 3 == 0).count() == 0


def test_products_of_large_components(spark):
    rows = [(0, [2.0**20, 3.0], 1), (1, [2.0**22, -1.0], 1), (2, [2.0**23, 7.0], 2), (3, [-1.0, 2.0**20], 2)]
    assert sorted(tuple(r) for r in topk.top_k(_frame(spark, rows), F.col("vec_id") == 0, 2).collect()) == plain_top(rows, 4, 2)


def test_given_tables(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op13_top_k(spark, folder).collect()) == plain_top(rows, 50, 5)
    noisy = [(i, v, (label + 1) % 10 if label is not None and i % 7 == 0 else label) for i, v, label in rows]
    assert sorted(tuple(r) for r in queries.op11_hard_negatives(spark, folder).collect()) == plain_negatives(noisy, 50)
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op12_ranked_search(spark, folder).collect()), key=str) == plain_ranks(documents, items)


def test_lists_are_not_read_to_their_ends():
    """With the floor of a first block, the next block's rows are mostly out before their lists end."""
    x = np.floor(256 * np.random.default_rng(2).normal(size=(6000, 16)) / 4).astype(np.int64)
    query = x[0]
    floor = np.sort(x @ query)[-5]
    left = topk.SortedLists(x[1:]).candidates(query, 5, floor, np.zeros(5999, bool))
    assert len(left) < 5999 / 8 and set(np.argsort(-(x[1:] @ query))[:4]) <= set(left)


def test_cells_come_in_order_and_hold_every_row():
    x = np.floor(256 * np.random.default_rng(4).normal(size=(3000, 10))).astype(np.int64)
    books = negatives.fit_codebooks(x[:500], 6)
    first = negatives._distances(x[:, :5].astype(float), books[0]).argmin(1)
    second = negatives._distances(x[:, 5:].astype(float), books[1]).argmin(1)
    index = negatives.MultiIndex(x, first * 6 + second, books, np.arange(len(x)))
    query = x[7].astype(float)
    cells = list(index.cells(query))
    assert [b for b, _ in cells] == sorted((b for b, _ in cells), reverse=True) and len({c for _, c in cells}) == 36
    for bound, cell in cells:
        rows = index.vectors[index.starts[cell] : index.ends[cell]]
        assert not len(rows) or (rows @ x[7]).max() <= bound + 1e-6
    assert sum(index.ends - index.starts) == len(x)
