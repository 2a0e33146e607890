"""The bootstrap queries take every name at its full length and all replicates."""

import random
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandframe.plans import composites, queries
from strandframe.sources import formats

DATA = Path(__file__).resolve().parent / "data"

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain(spark):
    """{(replicate, a, b): distance} of all names, from the same draws."""
    names = sorted(set(pq.read_table(f"{FOLDER}/part.parquet", columns=["p_name"])["p_name"].to_pylist()))
    n = max(map(len, names))

    def draw(r, i):
        x = (15_485_863 + 7_919 * r + 104_729 * i) % (2**31 - 1)
        for _ in range(3):
            x = (x * x + 12_345) % (2**31 - 1)
        return x % n

    places = {r: [draw(r, i) for i in range(1, n + 1)] for r in range(1, 101)}
    full = {x: x.ljust(n, "-") for x in names}
    return names, {(r, a, b): sum(full[a][p] != full[b][p] for p in own) / n for r, own in places.items() for a, b in combinations(names, 2)}


def test_distances_of_all_names(spark, plain):
    names, want = plain
    got = {(x.replicate, x.id_a, x.id_b): x.distance for x in queries.QUERIES["bootstrap_distance"](spark, FOLDER).collect()}
    assert {r for r, _, _ in got} == set(range(1, 101)) and {x for _, a, b in got for x in (a, b)} == set(names)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def plain_tree(distances, names):
    """Splits of a neighbour-joining tree, pairs of names compared one by one."""
    d = {n: {} for n in names}
    for (a, b), x in distances.items():
        d[a][b] = d[b][a] = x
    leaves, live, splits = {n: frozenset([n]) for n in names}, list(names), set()
    while len(live) > 2:
        total, n = {a: sum(d[a][b] for b in live if b != a) for a in live}, len(live)
        _, i, j = min((round((n - 2) * d[live[i]][live[j]] - total[live[i]] - total[live[j]], 9), i, j) for i in range(n) for j in range(i + 1, n))
        a, b, new = live[i], live[j], f"{live[i]}|{live[j]}"
        leaves[new], d[new] = leaves[a] | leaves[b], {}
        live = [c for c in live if c not in (a, b)]
        for c in live:
            d[new][c] = d[c][new] = (d[a][c] + d[b][c] - d[a][b]) / 2
        live.append(new)
        side = leaves[new] if names[0] not in leaves[new] else frozenset(names) - leaves[new]
        if 1 < len(side) < len(names) - 1:
            splits.add(side)
    return splits


def test_trees_of_random_distances():
    r = random.Random(3)
    for n in (2, 3, 4, 5, 8, 13, 21):
        names = [f"t{i:02d}" for i in range(n)]
        distances = {(a, b): r.random() for a, b in combinations(names, 2)}
        d = np.zeros((n, n))
        for (a, b), x in distances.items():
            i, j = names.index(a), names.index(b)
            d[i, j] = d[j, i] = x
        tree, splits = composites._tree_of(names, d)
        assert {frozenset(s.split(",")) for s in splits} == plain_tree(distances, names)
        assert tree.endswith(";") and all(tree.count(x) == 1 for x in names) and tree.count("(") == tree.count(")") == max(1, n - 1)


def test_additive_distances_give_their_tree():
    """Distances along ((a,b),(c,d),e): both splits, and the branches' lengths."""
    names = list("abcde")
    far = {"ab": 3, "ac": 8, "ad": 9, "ae": 7, "bc": 9, "bd": 10, "be": 8, "cd": 5, "ce": 7, "de": 8}
    d = np.array([[0 if x == y else far["".join(sorted(x + y))] for y in names] for x in names], float)
    tree, splits = composites._tree_of(names, d)
    assert splits == ["c,d", "c,d,e"] and "(a:1.000000,b:2.000000)" in tree and "(c:2.000000,d:3.000000)" in tree


def test_support_of_all_trees(spark, plain):
    """Every replicate's tree is that of its distances, and support counts them."""
    names, distances = plain
    rows = [(k, a, b, x) for (k, a, b), x in distances.items() if k <= 12]
    trees = composites.neighbour_joining(spark.createDataFrame(rows, "replicate int, id_a string, id_b string, distance double")).collect()
    number, counts = {n: i for i, n in enumerate(names)}, {}
    for t in trees:
        d = np.zeros((len(names), len(names)))
        for k, a, b, x in rows:
            if k == t.replicate:
                d[number[a], number[b]] = d[number[b], number[a]] = x
        assert (t.tree, t.splits) == composites._tree_of(names, d)
    for t in composites.neighbour_joining(queries.QUERIES["bootstrap_distance"](spark, FOLDER)).collect():
        for split in t.splits:
            counts[split] = counts.get(split, 0) + 1
    got = {x.split: x.support for x in queries.QUERIES["nj_tree"](spark, FOLDER).collect()}
    assert got == pytest.approx(counts)
    kept = {x.split: (x.support, x.size, x.parent) for x in queries.QUERIES["consensus_splits"](spark, FOLDER).collect()}
    assert kept == plain_consensus(counts, 100)


def plain_consensus(counts, n):
    kept = {s: c * 100.0 / n for s, c in counts.items() if c * 100.0 / n > 50}
    sets = {s: frozenset(s.split(",")) for s in kept}
    around = lambda s: min(((len(sets[o]), o) for o in kept if sets[s] < sets[o]), default=(0, None))[1]
    return {s: (kept[s], len(sets[s]), around(s)) for s in kept}


def test_consensus_of_trees(spark):
    trees = spark.createDataFrame([(1, "", ["b,c", "b,c,d", "e,f"]), (2, "", ["b,c", "b,c,d"]), (3, "", ["b,d", "e,f"]), (4, "", ["b,c", "e,f"])], "replicate int, tree string, splits array<string>")
    got = {r.split: (r.support, r.size, r.parent) for r in composites.consensus_splits(trees).collect()}
    assert got == {"b,c": (75.0, 2, None), "e,f": (75.0, 2, None)}  # half of the trees is no majority
    trees = spark.createDataFrame([(i, "", ["b,c", "b,c,d", "e,f"] if i else ["e,f"]) for i in range(4)], "replicate int, tree string, splits array<string>")
    names = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    assert composites.consensus_tree(trees, names) == "(a,((b,c)75,d)75,(e,f)100);"
    assert composites.consensus_tree(trees.limit(0), names) == "(a,b,c,d,e,f);"
    with pytest.raises(ValueError, match="half"):
        composites.consensus_splits(trees, 40)


def test_consensus_of_the_alignment(spark):
    """Majority splits of the sample alignment are nested or disjoint, each within its parent."""
    alignment = formats.scan_alignment(spark, str(DATA / "alignment.sto"))
    trees = composites.neighbour_joining(composites.bootstrap_distances(alignment, 20)).cache()
    rows = composites.consensus_splits(trees).collect()
    counts = {}
    for t in trees.collect():
        for s in t.splits:
            counts[s] = counts.get(s, 0) + 1
    assert len(rows) > 10 and {r.split: (r.support, r.size, r.parent) for r in rows} == plain_consensus(counts, 20)
    text = composites.consensus_tree(trees, alignment)
    assert text.count("(") == text.count(")") == len(rows) + 1


def test_draws_are_even_and_independent(spark):
    """Places come up alike, and neighbouring places and replicates do not follow each other."""
    n, rows = 20, spark.range(1, 401).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("i"))
    draws = {(x.r, x.i): x.p for x in rows.select("r", "i", composites.drawn_place(F.col("r"), F.col("i"), F.lit(n), 1).alias("p")).collect()}
    expected = len(draws) / n
    assert sum((sum(p == k for p in draws.values()) - expected) ** 2 / expected for k in range(n)) < 45
    for step in ((0, 1), (1, 0), (1, 1), (2, 0)):
        pairs = [(p, draws[r + step[0], i + step[1]]) for (r, i), p in draws.items() if (r + step[0], i + step[1]) in draws]
        assert abs(sum(a == b for a, b in pairs) / len(pairs) - 1 / n) < 0.015
    distinct = sum(len({draws[r, i] for i in range(1, n + 1)}) for r in range(1, 401)) / 400
    assert abs(distinct - n * (1 - (1 - 1 / n) ** n)) < 0.35
