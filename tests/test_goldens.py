"""Readers and analyses on real files, against values found by other means."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandframe.functions import scalars as S
from strandframe.operators import aggregates, joins
from strandframe.plans import composites
from strandframe.session import ship
from strandframe.sources import formats

DATA = Path(__file__).resolve().parent / "data"


def _table(name):
    return [tuple(x.split("\t")) for x in (DATA / name).read_text().splitlines()]


@pytest.fixture(scope="module")
def genes(spark):
    return formats.scan_gene_fasta(spark, str(DATA / "genes.fasta")).cache()


def test_gene_records(genes):
    assert {r.kind: r["count"] for r in genes.groupBy("kind").count().collect()} == {"MAIN_GENE": 358, "REGULATOR": 358}
    assert genes.select("contig").distinct().count() == 354 and genes.where("reject IS NOT NULL").count() == 0


def test_pairs_within_a_thousand_bases(genes):
    pairs = composites.pair_regulators(genes, 1000).collect()
    assert [(r.m_seq, r.r_seq) for r in pairs] == _table("nearest_pairs.tsv") and len(pairs) == 23


def test_names_of_regulators(genes):
    names = genes.where("kind = 'REGULATOR'")
    top = [tuple(r) for r in aggregates.frequency_desc(names, F.lower("name"), "name").limit(5).collect()]
    assert top == [
        ("laci family dna-binding transcriptional regulator", 169), ("dna-binding transcriptional regulator hcar", 33), ("tetr/acrr family transcriptional regulator", 32),
        ("iclr family transcriptional regulator", 29), ("suf system fe-s cluster assembly regulator", 26),
    ]
    first = aggregates.frequency_desc(names, S.first_token(F.col("name")), "t").collect()
    assert [tuple(r) for r in first[:6]] == [("LacI", 169), ("DNA", 33), ("TetR", 32), ("IclR", 29), ("SUF", 26), ("GntR", 15)] and len(first) == 22
    words = {r.word: r.n for r in aggregates.word_frequency(names, F.lower("name")).collect()}
    assert [words[w] for w in ("regulator", "transcriptional", "family", "dna-binding", "laci", "hcar")] == [348, 316, 288, 202, 169, 33]


def test_alignment(spark):
    alignment = formats.scan_alignment(spark, str(DATA / "alignment.sto")).cache()
    rows = {r.id: r.aligned for r in alignment.collect()}
    assert len(rows) == 73 and {len(x) for x in rows.values()} == {1056}
    whole = {i: (int(n), s) for i, n, s in _table("alignment_ungapped.tsv")}
    bare = {i: x.replace("-", "").replace(".", "") for i, x in rows.items()}
    assert {i: (len(x), x[:24].upper()) for i, x in bare.items()} == whole and (min(n for n, _ in whole.values()), max(n for n, _ in whole.values())) == (334, 588)
    assert Counter(i.split("_")[0] for i in rows) == {"1": 16, "2": 18, "3": 20, "4": 11, "5": 8}
    pairs = composites.alignment_distances(alignment).agg(F.avg("distance").alias("m"), F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")).first()
    assert (pairs.n, pairs.low) == (2628, 0) and pairs.m == pytest.approx(0.4104371339, abs=1e-9) and pairs.high == pytest.approx(0.7329545455, abs=1e-9)
    linear = aggregates.mean_p_distance(alignment, "aligned").first()
    assert linear.pairs == 2628 and linear.mean_distance == pytest.approx(0.4104371339, abs=1e-9)
    other = alignment.where("id < '3'")
    verdict = composites.divergence(alignment, other).first()
    assert verdict.first_mean == pytest.approx(0.4104371339, abs=1e-9) and verdict.verdict == ("first" if verdict.first_mean > verdict.second_mean else "second")


def test_profile(spark):
    profile = formats.scan_profile(spark, str(DATA / "profile.hmm"))
    assert profile.count() == 413 and formats.scan_profile(spark, str(DATA / "profile.hmm"), "match").count() == 412
    centred = profile.select(*S.row_max_center(formats.AMINO_ACIDS))
    assert centred.where(F.greatest(*formats.AMINO_ACIDS) != 0).count() == 0


NEAR = {
    (162873, 163907): [
        ("ABC transporter substrate-binding protein", 157615, 158740, 4133, "left"), ("SDR family NAD(P)-dependent oxidoreductase", 158828, 159761, 3112, "left"),
        ("SDR family oxidoreductase", 159815, 160589, 2284, "left"), ("dihydrodipicolinate reductase", 161790, 162876, -3, "left"),
        ("TetR/AcrR family transcriptional regulator", 170067, 170616, 6160, "right"), ("mycofactocin-coupled SDR family oxidoreductase", 170961, 171819, 7054, "right"),
        ("ABC transporter permease", 172019, 172847, 8112, "right"), ("ABC transporter permease", 172846, 173716, 8939, "right"),
    ],
    (229507, 229923): [
        ("SDR family NAD(P)-dependent oxidoreductase", 220216, 221122, 8385, "left"), ("thiamine pyrophosphate-binding protein", 221917, 223687, 5820, "left"),
        ("ketopantoate reductase family protein", 223701, 224781, 4726, "left"), ("TetR/AcrR family transcriptional regulator", 226357, 226990, 2517, "left"),
        ("SDR family NAD(P)-dependent oxidoreductase", 230985, 231798, 1062, "right"), ("LLM class flavin-dependent oxidoreductase", 232362, 233349, 2439, "right"),
        ("IS30 family transposase", 233549, 234799, 3626, "right"), ("NAD(P)/FAD-dependent oxidoreductase", 237521, 239186, 7598, "right"),
    ],
}


def test_contig_and_neighbours(spark):
    ship(spark)
    features = formats.scan_genbank(spark, str(DATA / "record.gbk")).cache()
    kinds = {r.type: r["count"] for r in features.groupBy("type").count().collect()}
    assert [kinds[k] for k in ("gene", "CDS", "rRNA", "tRNA", "source")] == [228, 223, 3, 2, 1]
    assert [r.seq_type for r in composites.replicon_type(features, "file").collect()] == ["Genome"]
    record = features.first().record_id
    targets = spark.createDataFrame([(str(a), record, a, b) for a, b in NEAR], "target_id string, record_id string, target_start int, target_end int")
    found = composites.neighbour_features(targets, features).orderBy("target_id", "start").collect()
    for a, b in NEAR:
        assert [(r["product"], r.start, r.end, r.relative, r.type) for r in found if r.target_id == str(a)] == NEAR[a, b]


def test_nearest_by_start_with_its_header(spark, genes):
    targets = genes.where("kind = 'MAIN_GENE'").select("contig", F.col("ordinal").alias("target_id"), F.col("start").alias("target_start"))
    flanks = genes.where("kind = 'REGULATOR'").select("contig", "start", "end", F.col("name").alias("product"), "ordinal")
    got = {r.target_id: (r.ordinal, r.distance, r.header) for r in composites.nearest_flanks(targets, flanks).collect()}
    plain = flanks.collect()
    for t in targets.collect():
        near = min((abs(f.start - t.target_start), f.ordinal, f) for f in plain if f.contig == t.contig)
        assert got[t.target_id] == (near[1], near[0], f"REGULATOR | {near[2]['product']} | {near[2].start}-{near[2].end} | {t.contig}")


def test_a_band_may_not_be_narrower_than_the_reach(spark):
    left, right = spark.createDataFrame([("k", 1, 0)], "k string, l int, lp int"), spark.createDataFrame([("k", 2, 5000)], "k string, r int, rp int")
    far = F.abs(F.col("lp") - F.col("rp"))
    for reach in (10_000, None):
        with pytest.raises(ValueError, match="band"):
            joins.nearest_join(left, right, ["k"], ["l", "lp"], far, ["r"], reach, ("lp", "rp", 1000))
    assert joins.nearest_join(left, right, ["k"], ["l", "lp"], far, ["r"], 10_000, ("lp", "rp", 10_000)).count() == 1
