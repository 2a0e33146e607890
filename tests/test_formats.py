"""Readers on small files, with the odd lines of each format."""

from pyspark.sql import functions as F

from strandframe.operators import sinks
from strandframe.plans import composites
from strandframe.session import ship
from strandframe.sources import formats

GENBANK = """LOCUS       CTG1                     900 bp    DNA     linear   CON 01-JAN-2020
DEFINITION  Some bacterium plasmid,
            whole genome shotgun sequence.
VERSION     CTG1.1
FEATURES             Location/Qualifiers
     source          1..900
                     /mol_type="genomic DNA"
     gene            complement(<100..>250)
                     /gene="x"
     CDS             join(300..350,
                     400..450)
                     /product="ABC transporter
                     permease"
                     /pseudo
     CDS             500..600
                     /product="hypothetical protein"
//
"""


def _write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_fasta(spark, tmp_path):
    path = _write(tmp_path, "a.fasta", ">MAIN | n1 | 10-20 | c1\nACGT\nAC\n>REG | n2 | 30-50 | c1\nTTTT\n>REG | bad | c1\nGG\n")
    assert [(r.header, r.seq) for r in formats.scan_fasta(spark, path).collect()] == [("MAIN | n1 | 10-20 | c1", "ACGTAC"), ("REG | n2 | 30-50 | c1", "TTTT"), ("REG | bad | c1", "GG")]
    genes = formats.scan_gene_fasta(spark, path)
    assert [(r.ordinal, r.kind, r.start, r.reject is None) for r in genes.orderBy("ordinal").collect()] == [(0, "MAIN", 10, True), (1, "REG", 30, True), (2, None, None, False)]
    pair = composites.pair_regulators(genes, 1000, "MAIN", "REG").collect()
    assert [(r.m_seq, r.r_seq, r.distance) for r in pair] == [("ACGTAC", "TTTT", 25)]
    sinks.write_fasta(genes.where("reject IS NULL"), str(tmp_path / "out"), "name", "seq", ["ordinal"])
    assert formats.scan_fasta(spark, str(tmp_path / "out")).count() == 2


def test_tables(spark, tmp_path):
    hits = _write(tmp_path, "h.tbl", "# comment\n t1  -  q1  acc  1e-20  50.1  0.1 2e-20 50 x\nshort line\n t1 - q2 - 1e-30 60 0 0 0\n")
    assert [(r.query_name, r.e_value) for r in formats.scan_tblout(spark, hits).collect()] == [("q1", 1e-20), ("q2", 1e-30)]
    best = composites.classify_proteins(
        spark.createDataFrame([("t1",), ("t2",)], "_id string"), formats.scan_tblout(spark, hits), spark.createDataFrame([("t1", "org")], "_id string, organism string")
    ).orderBy("_id").collect()
    assert [(r._id, r.PredictedCluster, r.organism) for r in best] == [("t1", "q2", "org"), ("t2", "N/A", None)]
    csv = _write(tmp_path, "hits.csv", "q,s,a,e,l\n" + "q1,s1,a1,0.0,12\nbroken,row\n" * 600)
    assert formats.scan_hit_csv(spark, csv).count() == 450
    assert [tuple(r) for r in formats.scan_counts(spark, _write(tmp_path, "c.txt", "tetr/acrr, 3294\n a, b , 2\nnone\n")).collect()] == [("tetr/acrr", 3294), ("a, b", 2)]
    assert [(r.accession, r.name) for r in formats.scan_json_pages(spark, _write(tmp_path, "p.json", '{"next": null,\n"results": [{"metadata": {"accession": "P1"}}]}')).collect()] == [("P1", "unknown")]
    assert [r.stem for r in formats.list_files(spark, str(tmp_path), ".tbl").collect()] == ["h"]


def test_alignment_and_profile(spark, tmp_path):
    path = _write(tmp_path, "a.sto", "# STOCKHOLM 1.0\n\nx1  AC-\ny1  ACG\n\nx1  TT\ny1  TA\n//\n")
    assert {r.id: r.aligned for r in formats.scan_alignment(spark, path).collect()} == {"x1": "AC-TT", "y1": "ACGTA"}
    assert composites.alignment_distances(formats.scan_alignment(spark, path)).first().distance == 0.4
    row = " ".join(["1.5"] * 20)
    profile = _write(tmp_path, "m.hmm", f"HMMER3/f\nHMM A C\n 1 {row} 1 x - - -\n {row}\n 2 {row} 2 x - - -\n {row}\n {row}\n//\n")
    assert formats.scan_profile(spark, profile).count() == 3 and formats.scan_profile(spark, profile, "match").count() == 2
    merged = composites.merge_stockholm(formats.numbered_lines(spark, path), F.lit("fam")).orderBy("line").collect()
    assert [r.value for r in merged][:4] == ["# STOCKHOLM 1.0", "#=GF ID fam", "", "x1  AC-"]


def test_genbank(spark, tmp_path):
    ship(spark)
    features = formats.scan_genbank(spark, _write(tmp_path, "g.gbk", GENBANK))
    got = [(r.type, r.start, r.end, r.strand) for r in features.orderBy("ordinal").collect()]
    assert got == [("source", 0, 900, 1), ("gene", 99, 250, -1), ("CDS", 299, 450, 1), ("CDS", 499, 600, 1)]
    assert composites.replicon_type(features).collect() == [("CTG1.1", "Plasmid")]
    targets = spark.createDataFrame([("t", "CTG1.1", 500, 600)], "target_id string, record_id string, target_start int, target_end int")
    near = composites.neighbour_features(targets, features).collect()
    assert [(r.product, r.relative, r.type) for r in near] == [("ABC transporter permease", 50, "left")]


def test_blast_xml(spark, tmp_path):
    hit = lambda n, e: f"<Hit><Hit_id>h{n}</Hit_id><Hit_accession>a{n}</Hit_accession><Hit_hsps>" + "".join(f"<Hsp><Hsp_evalue>{x}</Hsp_evalue><Hsp_hit-from>{i + 1}</Hsp_hit-from><Hsp_hit-to>9</Hsp_hit-to><Hsp_align-len>8</Hsp_align-len></Hsp>" for i, x in enumerate(e)) + "</Hit_hsps></Hit>"
    text = f"<BlastOutput><BlastOutput_query-ID>q</BlastOutput_query-ID><BlastOutput_iterations><Iteration><Iteration_query-ID>q1</Iteration_query-ID><Iteration_hits>{hit(1, [0.0, 1e-3])}{hit(2, [0.5])}</Iteration_hits></Iteration></BlastOutput_iterations></BlastOutput>"
    segments = formats.scan_blast_xml(spark, _write(tmp_path, "b.xml", text))
    assert segments.count() == 3 and segments.where("e_value <= 0").count() == 1
    assert [(r.query, r.start, r.nucleotide_id) for r in composites.locate_hits(segments).collect()] == [("q1", 1, "h2")]
