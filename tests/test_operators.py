"""Operators on small frames: ties, nulls, empty input, degenerate scales, and values worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.functions import scalars as S
from strandframe.operators import aggregates, filters, joins, nested, sinks
from strandframe.plans import composites
from strandframe.streaming.incremental import append_new


def _one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_scalars(spark):
    h = _one(spark, S.header_parse(F.col("h")), h="MAIN | abc | 10-25 | NZ_1")
    assert (h.kind, h.start, h.end, h.contig, h.reject) == ("MAIN", 10, 25, "NZ_1", None)
    assert _one(spark, S.header_parse(F.col("h")), h="MAIN | abc | NZ_1").reject == "MAIN | abc | NZ_1"
    assert _one(spark, S.prefix_join(F.col("s")), s="a_b_c_d") == "a_b_c" and _one(spark, S.prefix_join(F.col("s")), s="a_b_c") is None
    assert _one(spark, S.rename_header(F.col("h"), F.lit("base"), F.lit(3)), h="id1|x rest") == "base_3_id1"
    assert _one(spark, S.regex_extract(F.col("s"), r"^(\d+)_"), s="N/A") is None
    assert _one(spark, S.map_replace(F.col("s"), composites.GROUP_LABELS), s="1_") == "Group I" and _one(spark, S.map_replace(F.col("s"), composites.GROUP_LABELS), s="x") == "x"
    assert _one(spark, S.first_token(F.col("s")), s="TetR/AcrR family") == "TetR"
    assert _one(spark, S.strip_extension(F.col("s")), s="a.b.sto") == "a.b"
    assert tuple(_one(spark, S.filename_to_dims(F.col("s")), s="102_RO_7.csv")) == ("102", "RO") and _one(spark, S.filename_to_dims(F.col("s")), s="a_b.csv") is None
    assert _one(spark, S.header_compose(F.lit("REG"), F.lit(None).cast("string"), F.col("a"), F.col("b"), F.lit("c")), a=1, b=5) == "REG | unknown | 1-5 | c"
    assert _one(spark, S.keyword_classify(F.col("s"), composites.PRODUCT_RULES, F.col("s")), s="Ferredoxin reductase") == "G_Reductase"
    assert _one(spark, S.keyword_classify(F.col("s"), composites.PRODUCT_RULES, F.col("s")), s="transposon") == "transposon"
    assert _one(spark, S.any_keyword(F.lit(None).cast("string"), ["a"]), a=1) is False
    assert _one(spark, S.overlap_percent(F.lit(0), F.lit(10), F.lit(2), F.lit(10)), a=1) == 80.0
    assert _one(spark, S.overlap_percent(F.lit(3), F.lit(3), F.lit(3), F.lit(3)), a=1) == 0.0
    assert _one(spark, S.p_distance(F.col("a"), F.col("b")), a="AC-T", b="AG-TTT") == 0.25 and _one(spark, S.p_distance(F.col("a"), F.col("b")), a="", b="A") == 0.0
    assert [_one(spark, c, s="Bacteria; Proteobacteria") for c in S.lineage_levels(F.col("s"))] == ["Bacteria", "Proteobacteria", ""]


def test_filters(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, None), (3, None, "b")], "k int, v double, s string")
    keys = lambda d: [r.k for r in d.orderBy("k").collect()]
    assert keys(filters.threshold(df, "v", 2.0, False)) == [1] and keys(filters.threshold(df, "v", 2.0, True)) == [1, 2]
    assert keys(filters.not_in(df, "s", ["a"])) == [2, 3] and keys(filters.not_in(df, "s", [])) == [1, 2, 3]
    yes, no = filters.route(df, F.col("s") == "a")
    assert (keys(yes), keys(no)) == ([1], [2, 3])
    assert keys(filters.conjunctive(df, {"k": 1}, {"v": 1.0}, ["s"])) == [1]


def test_best_hit_breaks_ties(spark):
    df = spark.createDataFrame([("p", 1e-9, 5.0, "b"), ("p", 1e-9, 7.0, "c"), ("p", 1e-9, 7.0, "a"), ("q", 1.0, 1.0, "z")], "t string, e double, s double, q string")
    assert [(r.t, r.q) for r in aggregates.best_hit(df, ["t"], [F.col("e"), -F.col("s"), F.col("q")]).orderBy("t").collect()] == [("p", "a"), ("q", "z")]


FLANKS = [
    ("ABC transporter substrate-binding protein", 4133), ("SDR family NAD(P)-dependent oxidoreductase", 3112), ("SDR family oxidoreductase", 2284),
    ("dihydrodipicolinate reductase", -3), ("TetR/AcrR family transcriptional regulator", 6160), ("mycofactocin-coupled SDR family oxidoreductase", 7054),
    ("ABC transporter permease", 8112), ("ABC transporter permease", 8939), ("SDR family NAD(P)-dependent oxidoreductase", 8385),
    ("thiamine pyrophosphate-binding protein", 5820), ("ketopantoate reductase family protein", 4726), ("TetR/AcrR family transcriptional regulator", 2517),
    ("SDR family NAD(P)-dependent oxidoreductase", 1062), ("LLM class flavin-dependent oxidoreductase", 2439), ("IS30 family transposase", 3626), ("NAD(P)/FAD-dependent oxidoreductase", 7598),
]


def test_enrichment_of_sixteen_flanks(spark):
    df = spark.createDataFrame([("102", p, r, i) for i, (p, r) in enumerate(FLANKS)], "cluster string, product string, relative int, position int")
    got = {r.group: (r.total_gene, r.total_r, round(r.average_r, 6), round(r.score, 9)) for r in composites.enrichment(df).collect()}
    assert got == {
        "G_Reductase": (9, 36657.0, 4073.0, 127.936248292), "G_Transporter": (3, 21184.0, 7061.333333, 0.026831940), "G_Regulator": (2, 8677.0, 4338.5, 0.013986298),
        "G_Transposase": (1, 3626.0, 3626.0, 0.001723187), "thiamine pyrophosphate-binding protein": (1, 5820.0, 5820.0, 0.001073699),
    }


def test_proximity_and_shares(spark):
    empty = spark.createDataFrame([], "g string, r int")
    assert aggregates.proximity_score(empty, "g", "r").count() == 0
    df = spark.createDataFrame([("a", 96), ("b", 3), ("c", 1)], "l string, v long")
    assert {r.l: r.v for r in aggregates.share_bucket(df, [], "l", "v", 0.03).collect()} == {"a": 96, "b": 3, "Other": 1}
    one = spark.createDataFrame([("f", 2.0), ("g", 1.0), ("g", 3.0)], "f string, v double")
    assert sorted(r.x for r in aggregates.minmax_scale(one, ["f"], F.col("v"), "x").collect()) == [0.0, 0.0, 1.0]
    flags = aggregates.document_flags(spark.createDataFrame([(["x", "y"],), ([],), (None,)], "a array<string>"), "a", {"x": lambda v: v == "x"}).first()
    assert (flags.documents, flags.non_empty, flags.x_documents, flags.x_items) == (3, 1, 1, 1)


def test_nearest_takes_the_first_of_equals(spark):
    left = spark.createDataFrame([("c", 1, 100), ("c", 2, 5000), ("d", 3, 1)], "k string, l int, lp int")
    right = spark.createDataFrame([("c", 8, 90), ("c", 7, 110), ("c", 9, 6001)], "k string, r int, rp int")
    for band in (None, ("lp", "rp", 1000)):
        got = joins.nearest_join(left, right, ["k"], ["l", "lp"], F.abs(F.col("lp") - F.col("rp")), ["r"], 1000, band).collect()
        assert [(r.l, r.r, r.distance) for r in got] == [(1, 7, 10)]


@pytest.mark.parametrize("reach", [5, 40, 1000])
def test_window_proximity_is_that_of_all_pairs(spark, reach):
    r = random.Random(reach)
    span = lambda: (lambda a: (a, a + r.randrange(1, 60)))(r.randrange(0, 400))
    targets, features = [(i, *span()) for i in range(12)], [(i, *span()) for i in range(40)]
    got = joins.window_proximity(
        spark.createDataFrame([("k", *t) for t in targets], "k string, t int, ts int, te int"), spark.createDataFrame([("k", *f) for f in features], "k string, f int, fs int, fe int"),
        ["k"], ("ts", "te"), ("fs", "fe"), reach, max_overlap=80.0,
    ).collect()
    want = set()
    for t, ts, te in targets:
        for f, fs, fe in features:
            if fs >= max(0, ts - reach) and fe <= te + reach:
                inner, hull = max(0, min(te, fe) - max(ts, fs)), max(te, fe) - min(ts, fs)
                if inner * 100 / hull <= 80:
                    want.add((t, f, ts - fe if fs < ts else fs - te))
    assert {(x.t, x.f, x.gap) for x in got} == want and len(got) == len(want)


def test_nested(spark):
    df = spark.createDataFrame([("r", "x", 1, 1.0), ("r", "x", 2, 5.0), ("s", "y", 1, 2.0)], "a string, b string, o int, v double")
    assert [tuple(r) for r in nested.map_group_last(df, ["a", "b"], "v", [F.col("o")]).orderBy("a").collect()] == [("r", "x", 5.0), ("s", "y", 2.0)]
    assert [tuple(r) for r in nested.pivot_matrix(df, "a", "b", F.max("v"), ["y", "x"]).orderBy("a").collect()] == [("r", 5.0, 0.0), ("s", 0.0, 2.0)]


def test_incremental(spark, tmp_path):
    new = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (None, "n")], "k int, v string")
    got = sinks.insert_if_absent(new, spark.createDataFrame([(2,)], "k int"), "k", [F.col("v")]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(None, "n"), (1, "a")]
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in ([(1, "a"), (2, "b")], [(2, "x"), (3, "c")]):
        spark.createDataFrame(batch, "k int, v string").write.mode("append").parquet(source)
        append_new(spark.readStream.schema("k int, v string").parquet(source), target, "k", str(tmp_path / "state")).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_merge_and_upsert(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert [tuple(r) for r in joins.merge_structs(a, b, ["k"]).orderBy("k").collect()] == [(1, "a"), (2, None)]
    assert [tuple(r) for r in sinks.upsert(a, b, "k", ["v"]).orderBy("k").collect()] == [(1, "a"), (2, "b"), (3, "c")]


def test_trees(spark):
    alignment = spark.createDataFrame([("a", "AAAAAAAATT"), ("b", "AAAAAAAATA"), ("c", "CCCCAAAATT"), ("d", "CCCCAAAAGG"), ("e", "CCCCAAAAGC")], "id string, aligned string")
    distances = composites.alignment_distances(alignment).withColumn("replicate", F.lit(1))
    tree = composites.neighbour_joining(distances).first()
    assert set(tree.splits) == {"c,d,e", "d,e"} and tree.tree.endswith(";")
    again = lambda: sorted(map(tuple, composites.bootstrap_distances(alignment, 5).collect()))
    assert again() == again()
    support = composites.split_support(composites.neighbour_joining(composites.bootstrap_distances(alignment, 20))).collect()
    assert all(0 < r.support <= 100 for r in support)


def test_fuzzy_groups_of_rows_at_one_position(spark):
    rows = [("c", "abcdefghij", 1), ("c", "abcdefghix", 1), ("c", "zzz", None), ("c", "zzy", None), ("c", "abcdefghiy", None)]
    got = {x.n: x.group for x in composites.fuzzy_group(spark.createDataFrame(rows, "c string, n string, i int"), ["c"], "n", "i", threshold=0.6).collect()}
    assert got == {"abcdefghij": "abcdefghij", "abcdefghix": "abcdefghij", "abcdefghiy": "abcdefghij", "zzy": "zzy", "zzz": "zzy"}


def test_null_keys_are_all_appended(spark):
    new = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c"), (1, "d"), (2, "e")], "k int, v string")
    got = sinks.insert_if_absent(new, spark.createDataFrame([(2,), (None,)], "k int"), "k", [F.col("v")]).collect()
    assert sorted((r.k or 0, r.v) for r in got) == [(0, "a"), (0, "b"), (1, "c")]


def test_several_files_are_kept_apart(spark, tmp_path):
    from strandframe.sources import formats

    row = " ".join(["1.5"] * 20)
    for n in (1, 2):
        (tmp_path / f"m{n}.hmm").write_text(f"x\n {row}\n {row}\n")
        (tmp_path / f"g{n}.fasta").write_text(f">MAIN_GENE | a{n} | 10-20 | c\nAA\n>REGULATOR | b{n} | 3{n}-50 | c\nTT\n")
    assert sorted((r.file[-6:], r.position) for r in formats.scan_profile(spark, f"{tmp_path}/*.hmm").collect()) == [("m1.hmm", 1), ("m1.hmm", 2), ("m2.hmm", 1), ("m2.hmm", 2)]
    pairs = composites.pair_regulators(formats.scan_gene_fasta(spark, f"{tmp_path}/*.fasta")).collect()
    assert [(r.file[-8:], r.m_ordinal, r.r_ordinal, r.distance) for r in pairs] == [("g1.fasta", 0, 1, 25), ("g2.fasta", 0, 1, 26)]


def test_crowded_genes_are_not_paired(spark):
    """Main genes and regulators of one contig on a few midpoints: every join makes fewer rows than pairs."""
    r = random.Random(5)
    rows = [("f", r.choice(["c", "c", "c", "d", None]), i, r.choice(["MAIN_GENE", "REGULATOR"]), 2 * r.randrange(8), None if r.random() < 0.9 else "bad") for i in range(600)]
    genes = spark.createDataFrame(rows, "file string, contig string, ordinal int, kind string, start int, reject string").withColumns({"end": F.col("start") + 3, "seq": F.concat(F.lit("S"), "ordinal")})
    pairs = composites.pair_regulators(genes, 2)
    fine = [x for x in rows if x[1] and not x[5]]
    want = []
    for m in (x for x in fine if x[3] == "MAIN_GENE"):
        near = [(abs(m[4] - x[4]), x[2]) for x in fine if x[3] == "REGULATOR" and x[1] == m[1] and abs(m[4] - x[4]) <= 2]
        want += [(m[2], f"S{m[2]}", *min(near), f"S{min(near)[1]}")] if near else []
    assert [(x.m_ordinal, x.m_seq, x.distance, x.r_ordinal, x.r_seq) for x in pairs.collect()] == want and len(want) > 100
    assert "__band" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_totals_join_null_scopes_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "f string, v double")
    assert sorted((r.f or "", r.x) for r in aggregates.minmax_scale(df, ["f"], F.col("v"), "x").collect()) == [("", 0.0), ("", 1.0), ("a", 0.0)]
    assert sorted(r.x for r in aggregates.minmax_scale(df, [], F.col("v"), "x").collect()) == [0.0, 0.5, 1.0]
    assert aggregates.minmax_scale(df.limit(0), [], F.col("v"), "x").count() == 0
    plan = aggregates.minmax_scale(df, ["f"], F.col("v"), "x")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "HashAggregate" in plan


def test_mean_distance_without_pairs(spark):
    r = random.Random(7)
    texts = ["".join(r.choice("ab-") for _ in range(r.choice([0, 3, 3, 5]))) for _ in range(30)]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)] + [(None, 99)], "t string, i int")
    pairs = [(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :]]
    far = [sum(x != y for x, y in zip(a, b)) / min(len(a), len(b)) if a and b else 0.0 for a, b in pairs]
    got = aggregates.mean_p_distance(df, "t").first()
    assert got.pairs == len(pairs) and got.mean_distance == pytest.approx(sum(far) / len(far))
    assert tuple(aggregates.mean_p_distance(df.limit(0), "t").first()) == (0.0, 0)


def test_nearest_of_sorted_neighbours(spark):
    r = random.Random(11)
    left = [(r.choice("ab"), i, r.randrange(60)) for i in range(40)] + [("c", 99, 1), ("a", 98, None)]
    right = [(r.choice("ab"), i, r.randrange(60)) for i in range(25)] + [("b", 77, None)]
    got = joins.nearest_sorted(spark.createDataFrame(left, "k string, l int, lp int"), spark.createDataFrame(right, "k string, r int, rp int"), ["k"], "lp", "rp", "r").collect()
    want = {}
    for k, i, at in left:
        near = [(abs(at - x), j) for kk, j, x in right if kk == k and at is not None and x is not None]
        if near:
            want[i] = min(near)
    assert {x.l: (x.distance, x.r) for x in got} == want and len(got) == len(want)


def test_rows_come_in_order(spark):
    df = spark.createDataFrame([(i % 5, i) for i in range(40)] + [(9, 1)], "k int, v int").repartition(7)
    assert [(r.k, r.n) for r in aggregates.frequency_desc(df, F.col("k"), "k").collect()] == [(0, 8), (1, 8), (2, 8), (3, 8), (4, 8), (9, 1)]
    assert [(r.k, r.v) for r in filters.first_rows(df, [F.desc("k"), F.asc("v")], 3).collect()] == [(9, 1), (4, 4), (4, 9)]


def test_missing_keys_of_a_lookup(spark):
    df, t = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert [r.k for r in joins.missing_keys(df, t, ["k"]).collect()] == [2]
