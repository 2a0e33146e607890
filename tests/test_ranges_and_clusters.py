"""Overlap joins, nearest partners on hot keys, and clusters, against plain programs."""

import math
import random
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from strandframe.operators import clustering, joins
from strandframe.plans import queries


@pytest.mark.parametrize("longest, finest, levels", [(6, 2, 5), (400, 3, 12), (100_000, 4, 3), (10**9, 10, 22)])
def test_overlaps_are_those_of_all_pairs(spark, longest, finest, levels):
    r = random.Random(longest)
    ranges = lambda n: [(r.choice("pq"), i, s := r.randrange(-50, 2 * longest), s + r.choice([0, 1, 2, r.randrange(longest)])) for i in range(n)]
    one, two = ranges(120) + [("p", 900, None, 5), (None, 901, 0, 10)], ranges(120) + [("p", 900, 5, None), (None, 901, 0, 10)]
    a, b = spark.createDataFrame(one, "k string, i int, s long, e long"), spark.createDataFrame(two, "k string, j int, s2 long, e2 long")
    got = [(x.i, x.j) for x in joins.overlap_join(a, b, ["k"], ("s", "e"), ("s2", "e2"), finest, levels).collect()]
    fine = lambda rows: [x for x in rows if None not in x and x[2] < x[3]]
    want = {(x[1], y[1]) for x in fine(one) for y in fine(two) if x[0] == y[0] and x[2] < y[3] and y[2] < x[3]}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_bins_keep_a_key_apart(spark):
    """Short ranges of one key meet their neighbours, not each other all."""
    rows = spark.range(4000).select(F.lit("k").alias("k"), F.col("id").alias("i"), (F.col("id") * 100).alias("s"), (F.col("id") * 100 + 50).alias("e"))
    other = rows.withColumnsRenamed({"i": "j", "s": "s2", "e": "e2"})
    met = joins.overlap_join(rows, other, ["k"], ("s", "e"), ("s2", "e2"), finest=7)
    assert met.count() == 4000 and met.where("i <> j").count() == 0


def test_copies_in_bins_are_not_broadcast(spark):
    """A row is copied for each size of bin, which Spark's estimate leaves out."""
    rows = spark.range(100).select(F.lit("k").alias("k"), F.col("id").alias("i"), F.col("id").alias("s"), (F.col("id") + 2).alias("e"))
    met = joins.overlap_join(rows, rows.withColumnsRenamed({"i": "j", "s": "s2", "e": "e2"}), ["k"], ("s", "e"), ("s2", "e2"))
    assert met.count() == 298 and "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("longest, pairs_a_task", [(1, 50), (3, 1 << 24), (256, 1 << 24)])
def test_pairs_by_class_are_all_pairs(spark, longest, pairs_a_task):
    r = random.Random(longest)
    rows = [(r.choice("pq"), i // 2 if i < 20 else i, r.choice([1, 2, 30, None])) for i in range(120)] + [(None, 900, 1), (None, 901, 1), ("p", None, 1), ("p", None, 2)]
    df = spark.createDataFrame(rows, "k string, i int, s int")
    values = {"d": F.col("s_b") - F.col("s_a")}
    got = joins.pairs_by_class(df, "i", ["k"], ["s"], values, longest=longest, pairs_a_task=pairs_a_task)
    whole = [x for x in rows if x[0] and x[1] is not None]
    want = [(x[1], y[1], None if None in (x[2], y[2]) else y[2] - x[2]) for x in whole for y in whole if x[0] == y[0] and x[1] < y[1]]
    some = lambda rows: sorted(rows, key=str)
    assert some(map(tuple, got.collect())) == some(want) and got.columns == ["i_a", "i_b", "d"]
    near = joins.pairs_by_class(df, "i", ["k"], ["s"], values, lambda x, y: x.join(y, ["k"]).where("abs(s_a - s_b) < 5"), longest)
    assert some(map(tuple, near.collect())) == some(x for x in want if x[2] is not None and abs(x[2]) < 5)


def test_values_are_found_once_for_two_classes(spark):
    """1,000 rows of two classes: as many values as pairs of classes, and tasks by the number of pairs."""
    df = spark.range(1000).select(F.lit("k").alias("k"), "id", (F.col("id") % 2).alias("s"))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x, y):
        seen.add(1)
        return x + y

    pairs = joins.pairs_by_class(df, "id", ["k"], ["s"], {"v": counted("s_a", "s_b")}, longest=1000, pairs_a_task=100_000)
    assert pairs.count() == 1000 * 999 // 2 and pairs.groupBy("v").count().count() == 3 and seen.value <= 2 * 4
    assert pairs.rdd.getNumPartitions() == 10


@pytest.mark.parametrize("name", ["overlap_pct", "signed_gap"])
def test_pairs_of_a_large_block_go_to_all_tasks(spark, tmp_path, name):
    """A block of 2,000 rows is a few KB in one file; its two million pairs are more than one task's."""
    sizes = F.when(F.col("id") % 90 == 0, None).otherwise(F.col("id") % 50 + 1).cast("int")
    block = lambda n, brand: spark.range(n).select(F.col("id").alias("p_partkey"), F.lit(brand).alias("p_brand"), F.lit("t").alias("p_type"), sizes.alias("p_size"))
    block(2000, "x").unionByName(block(30, None)).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    got.write.parquet(f"{tmp_path}/got")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'; CREATE VIEW got AS SELECT * FROM '{tmp_path}/got/*.parquet'; CREATE TABLE want AS {queries.ORACLE_SQL[name]}")
    differ = "SELECT (SELECT count(*) FROM (FROM got EXCEPT ALL FROM want)), (SELECT count(*) FROM (FROM want EXCEPT ALL FROM got)), (SELECT count(*) FROM got)"
    assert con.execute(differ).fetchone() == (0, 0, 2000 * 1999 // 2)


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_nearest_over_ranges_of_a_hot_key(spark, ranges):
    """Nine tenths of the rows have one key; partners lie in other ranges."""
    r = random.Random(ranges)
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        key = lambda: r.choice(["hot"] * 18 + ["a", "b"])
        left = [(key(), i, r.randrange(1000)) for i in range(300)] + [("none", 900, 5), (None, 901, 5), ("hot", 902, None)]
        right = [(key(), i, r.randrange(1000) // 7 * 7) for i in range(25)] + [("hot", 990, None), (None, 991, 5)]
        a, b = spark.createDataFrame(left, "k string, i int, at int"), spark.createDataFrame(right, "k string, j int, there int")
        got = {x.i: (x.distance, x.j) for x in joins.nearest_sorted(a, b, ["k"], "at", "there", "j").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = {}
    for k, i, at in left:
        options = [(abs(at - there), j) for k2, j, there in right if k and k == k2 and None not in (at, there)]
        if options:
            want[i] = min(options)
    assert got == want


def plain_linkage(distances):
    """One merge after another: always the nearest two clusters, by all pairs of their rows."""
    clusters = {x: [x] for p in distances for x in p}
    far = lambda x, y: distances.get((x, y), distances.get((y, x)))
    out = []
    while len(clusters) > 1:
        apart = lambda a, b: round(sum(far(x, y) for x in clusters[a] for y in clusters[b]) / len(clusters[a]) / len(clusters[b]), 12)
        d, a, b = min((apart(a, b), a, b) for a, b in combinations(sorted(clusters), 2))
        clusters[a] += clusters.pop(b)
        out.append((a, b, d, len(clusters[a])))
    return sorted(out)


def _linked(spark, distances):
    df = spark.createDataFrame([(a, b, float(d)) for (a, b), d in distances.items()], "id_a string, id_b string, distance double")
    return clustering.average_linkage(df)


@pytest.mark.parametrize("n", [2, 3, 9, 24])
def test_merges_are_those_of_one_after_another(spark, n):
    r = random.Random(n)
    points = {f"r{i:02d}": (r.random(), r.random(), r.choice([0, 5])) for i in range(n)}
    distances = {(a, b): math.dist(points[a], points[b]) for a, b in combinations(points, 2)}
    rows = _linked(spark, distances).collect()
    got, want = sorted((x.a, x.b, x.height, x.size) for x in rows), plain_linkage(distances)
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])
    assert max(x.round for x in rows) < n or n == 2
    order = clustering.leaf_order([(x.a, x.b, x.height) for x in rows])
    assert sorted(order) == sorted(points)


def test_clusters_of_nothing_and_of_equal_rows(spark):
    assert _linked(spark, {("a", "b"): 1.0}).where("a = 'x'").count() == 0
    empty = spark.createDataFrame([], "id_a string, id_b string, distance double")
    assert clustering.average_linkage(empty).count() == 0
    same = {p: 0.0 for p in combinations("abcd", 2)}
    assert sorted(x.height for x in _linked(spark, same).collect()) == [0.0] * 3


def test_clusters_of_brands(spark):
    folder = "/root/testdata/sf0.001"
    cells = {}
    for x in spark.read.parquet(f"{folder}/part.parquet").collect():
        cells[x.p_brand, x.p_type] = cells.get((x.p_brand, x.p_type), 0) + x.p_retailprice
    logs = {k: math.log10(v + 1e-6) for k, v in cells.items()}
    types, brands = sorted({t for _, t in logs}), sorted({b for b, _ in logs})
    ends = {t: (min(v for (_, u), v in logs.items() if u == t), max(v for (_, u), v in logs.items() if u == t)) for t in types}
    rows = {b: [(logs[b, t] - ends[t][0]) / (ends[t][1] - ends[t][0]) if (b, t) in logs and ends[t][1] > ends[t][0] else 0.0 for t in types] for b in brands}
    want = plain_linkage({(a, b): math.dist(rows[a], rows[b]) for a, b in combinations(brands, 2)})
    got = sorted((x.a, x.b, x.height, x.size) for x in queries.heat_clusters(spark, folder).collect())
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-7)
