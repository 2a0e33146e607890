"""Large files are read by many tasks: whatever the cuts, each record is there once, with its number in the file."""

import json

import pytest
from pyspark.sql import functions as F

from strandframe.operators import sinks
from strandframe.session import ship
from strandframe.sources import formats

RECORD = """LOCUS       CTG{i}    900 bp    DNA     linear   CON 01-JAN-2020
DEFINITION  Some text {i}.
VERSION     CTG{i}.1
FEATURES             Location/Qualifiers
     source          1..900
                     /mol_type="genomic DNA"
     CDS             {i}..600
                     /product="protein // of {i}"
//
"""


@pytest.fixture(params=[64, 301, 1 << 20])
def cut(spark, request):
    """Bytes of a split."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_records_of_a_genbank_file(spark, tmp_path, cut):
    ship(spark)
    (tmp_path / "a.gbk").write_text("".join(RECORD.format(i=i) for i in range(1, 41)))
    (tmp_path / "b.gbk").write_text(RECORD.format(i=77))
    if cut == 64:
        assert formats.read_records(spark, str(tmp_path), "\n//").rdd.getNumPartitions() > 50
    rows = formats.scan_genbank(spark, str(tmp_path)).where("type = 'CDS'").collect()
    got = sorted((r.file[-5:], r.record_no, r.record_id, r.start, r.qualifiers["product"][0]) for r in rows)
    assert got == [("a.gbk", i - 1, f"CTG{i}.1", i - 1, f"protein // of {i}") for i in range(1, 41)] + [("b.gbk", 0, "CTG77.1", 76, "protein // of 77")]


def test_genes_lines_and_profiles(spark, tmp_path, cut):
    (tmp_path / "g.fasta").write_text("\n" + "".join(f">MAIN | n{i} | {i}-{i + 5} | c\r\nAC\r\nGT{'A' * (i % 7)}\r\n" for i in range(60)))
    genes = formats.scan_gene_fasta(spark, str(tmp_path / "g.fasta")).collect()
    assert sorted((r.ordinal, r.name, r.start, r.seq) for r in genes) == [(i, f"n{i}", i, "ACGT" + "A" * (i % 7)) for i in range(60)]
    text = [f"line {i} " + "x" * (i % 9) for i in range(200)]
    (tmp_path / "t.txt").write_text("\n".join(text) + "\n")
    assert sorted((r.line, r.value) for r in formats.numbered_lines(spark, str(tmp_path / "t.txt")).collect()) == list(enumerate(text))
    numbers = lambda i: " ".join([str(i)] * 20)
    (tmp_path / "m.hmm").write_text("HMM A C\n" + "".join(f" {i} {numbers(i)} {i} x - - -\n {numbers(i)}\n" for i in range(1, 31)) + "//\n")
    for mode in ("compat", "match"):
        assert sorted((r.position, r.A) for r in formats.scan_profile(spark, str(tmp_path / "m.hmm"), mode).collect()) == [(i, float(i)) for i in range(1, 31)]
    (tmp_path / "h.csv").write_text("q,s,a,e,l\n" + "".join(f"q{i},s,a,0.0,{i}{',more' if i % 5 == 0 else ''}\n" for i in range(1, 1200)))
    hits = formats.scan_hit_csv(spark, str(tmp_path / "h.csv")).collect()
    assert sorted((r.line, r.Alignment_Length) for r in hits) == [(i, i) for i in range(1, 900) if i % 5]


def test_alignments_and_result_files(spark, tmp_path, cut):
    block = lambda letter: "".join(f"id{i}  {letter * 10}{i % 10}\n" for i in range(30)) + "\n"
    (tmp_path / "a.sto").write_text("# STOCKHOLM 1.0\n\n" + "".join(block(x) for x in "ACG") + "//\n")
    got = {r.id: r.aligned for r in formats.scan_alignment(spark, str(tmp_path / "a.sto")).collect()}
    assert got == {f"id{i}": "".join(x * 10 + str(i % 10) for x in "ACG") for i in range(30)}
    segment = "<Hsp><Hsp_evalue>0.5</Hsp_evalue><Hsp_hit-from>{i}</Hsp_hit-from><Hsp_hit-to>9</Hsp_hit-to><Hsp_align-len>8</Hsp_align-len></Hsp>"
    query = "<Iteration>\n<Iteration_query-ID>q{i}</Iteration_query-ID><Iteration_hits><Hit><Hit_id>h</Hit_id><Hit_accession>a &amp; b</Hit_accession><Hit_hsps>" + segment + "</Hit_hsps></Hit></Iteration_hits></Iteration>\n"
    (tmp_path / "r.xml").write_text("<?xml version='1.0'?>\n<BlastOutput><BlastOutput_iterations>\n" + "".join(query.format(i=i) for i in range(40)) + "<Iteration><Iteration_query-ID>none</Iteration_query-ID></Iteration></BlastOutput_iterations></BlastOutput>\n")
    rows = formats.scan_blast_xml(spark, str(tmp_path / "r.xml")).collect()
    assert sorted((r.query_no, r.query, r.accession, r.start) for r in rows) == [(i, f"q{i}", "a & b", i) for i in range(40)]


def test_a_folder_of_parts_is_one_file(spark, tmp_path, cut):
    df = spark.range(500).select(F.col("id"), F.concat(F.lit("v"), "id").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sinks.write_ordered(df.repartition(7), str(tmp_path / "parts"), ["id"], "v")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "parts").glob("part-*"))) > 1
    assert sorted((r.line, r.value) for r in formats.numbered_lines(spark, str(tmp_path / "parts"), of="folder").collect()) == [(i, f"v{i}") for i in range(500)]


def _pages(spark, tmp_path, links):
    for name, (link, names) in links.items():
        (tmp_path / name).write_text(json.dumps({"next": link, "results": [{"metadata": {"accession": n}} for n in names]}))
    return formats.scan_json_pages(spark, str(tmp_path / "*.json"))


def test_pages_that_links_lead_to(spark, tmp_path):
    links = {f"{i}.json": (f"{i + 1}.json" if i < 12 else None, [f"x{i}", f"y{i}"]) for i in range(13)} | {"lost.json": ("3.json", ["z"])}
    rows = formats.followed_pages(_pages(spark, tmp_path, links), "0.json").collect()
    assert sorted((r.step, r.place, r.accession, r.name) for r in rows) == [(i, p, f"{n}{i}", "unknown") for i in range(13) for p, n in enumerate("xy")]


@pytest.mark.parametrize("links, want", [
    ({"a.json": ("b.json", ["1"]), "b.json": ("c.json", ["2"]), "c.json": ("b.json", ["3"])}, [(0, "1"), (1, "2"), (2, "3")]),
    ({"a.json": ("a.json", ["1"])}, [(0, "1")]),
    ({"a.json": ("gone.json", ["1"]), "b.json": (None, ["2"])}, [(0, "1")]),
    ({"a.json": ("b.json", []), "b.json": (None, ["2"])}, [(0, None), (1, "2")]),
    ({"b.json": (None, ["2"])}, []),
])
def test_walks_end(spark, tmp_path, links, want):
    rows = formats.followed_pages(_pages(spark, tmp_path, links), "a.json").collect()
    assert sorted((r.step, r.accession) for r in rows) == want
