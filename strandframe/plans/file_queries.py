"""Registered queries of the readers and writers: each writes a table in a file format, reads it back through the format's own
reader and gives rows that SQL makes of the table. Files go to the folder that all machines share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import joins, sinks, updates
from ..session import shared_folder, table
from ..sources import appending, formats
from . import composites
from .queries import PART_RULES, _case, _round, query

_TEXT = lambda c: F.col(c).cast("string")


@query("SELECT concat(p_partkey, ' ', p_name) AS header, upper(replace(p_name, ' ', '')) AS seq FROM part")
def scan_fasta(spark, d):
    path = shared_folder(spark)
    records = table(spark, d, "part").select(F.concat_ws(" ", "p_partkey", "p_name").alias("header"), F.upper(F.translate("p_name", " ", "")).alias("seq"))
    sinks.write_fasta(records, path, "header", "seq", ["header"])
    return formats.scan_fasta(spark, path).select("header", "seq")


@query("""SELECT CASE WHEN p_size % 2 = 0 THEN 'MAIN_GENE' ELSE 'REGULATOR' END AS kind, trim(p_name) AS name, p_size AS start, p_size + 20 AS "end", p_brand AS contig, upper(replace(p_name, ' ', '')) AS seq FROM part""")
def scan_gene_records(spark, d):
    return _gene_records(spark, d).select("kind", "name", "start", "end", "contig", "seq")


def _gene_records(spark, d) -> DataFrame:
    path = shared_folder(spark)
    p = table(spark, d, "part").withColumn("kind", F.when(F.col("p_size") % 2 == 0, "MAIN_GENE").otherwise("REGULATOR"))
    header = S.header_compose(F.col("kind"), F.col("p_name"), F.col("p_size"), F.col("p_size") + 20, F.col("p_brand"))
    sinks.write_ordered(p, path, ["p_partkey"], sinks.fasta_lines(header, F.upper(F.translate("p_name", " ", ""))))
    return formats.scan_gene_fasta(spark, path, of="folder")


@query("""WITH g AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ordinal, p_brand AS contig, (2 * p_size + 20) // 2 AS mid, p_size % 2 AS k FROM part),
  q AS (SELECT m.ordinal AS m_ordinal, r.ordinal AS r_ordinal, abs(m.mid - r.mid) AS distance FROM g m JOIN g r ON m.contig = r.contig WHERE m.k = 0 AND r.k = 1 AND abs(m.mid - r.mid) <= 10)
  SELECT m_ordinal::INTEGER AS m_ordinal, r_ordinal::INTEGER AS r_ordinal, distance::BIGINT AS distance FROM (SELECT *, row_number() OVER (PARTITION BY m_ordinal ORDER BY distance, r_ordinal) AS n FROM q) WHERE n = 1""")
def pair_regulators(spark, d):
    return composites.pair_regulators(_gene_records(spark, d), 10).select("m_ordinal", "r_ordinal", "distance")


@query("""SELECT p_partkey::VARCHAR AS target_name, p_brand AS query_name, p_size / 1000.0::DOUBLE AS e_value, p_retailprice AS score FROM part""")
def scan_tblout(spark, d):
    return _tblout(spark, d).select("target_name", "query_name", "e_value", "score")


def _tblout(spark, d) -> DataFrame:
    path = shared_folder(spark)
    fields = [_TEXT("p_partkey"), F.lit("-"), "p_brand", F.lit("acc"), (F.col("p_size") / 1000.0).cast("string"), _TEXT("p_retailprice"), F.lit("0.0"), F.lit("1e-9"), F.lit("9")]
    hits = table(spark, d, "part").select(F.concat_ws("   ", *fields).alias("line"))
    comments = spark.createDataFrame([("# target name  accession",), ("too short",), ("#",)], "line string")
    hits.unionByName(comments).write.text(path)
    return formats.scan_tblout(spark, path)


@query("""SELECT p_partkey::VARCHAR AS _id, coalesce(CASE WHEN p_size / 1000.0 < 0.02 THEN p_brand END, 'N/A') AS cluster, p_name AS name FROM part""")
def classify_proteins(spark, d):
    """Every part as a protein, the hit table's rows under the cut-off as its cluster."""
    p = table(spark, d, "part").select(_TEXT("p_partkey").alias("_id"), "p_name")
    out = composites.classify_proteins(p.select("_id"), _tblout(spark, d), p.withColumnRenamed("p_name", "name"), 0.02)
    return out.select("_id", F.col("PredictedCluster").alias("cluster"), "name")


_ALIGNED = "WITH n AS (SELECT DISTINCT p_name FROM part), l AS (SELECT max(length(p_name))::INTEGER AS l FROM n), a AS (SELECT replace(p_name, ' ', '_') AS id, rpad(replace(p_name, ' ', '.'), l, '-') AS aligned FROM n, l) "


def _write_alignment(spark, d, path: str, head: str) -> None:
    """All part names as an alignment in two blocks of lines."""
    longest = F.max(F.length("p_name"))
    names = A.with_totals(table(spark, d, "part").select("p_name").distinct(), [], [longest.alias("l")])
    rows = names.select(F.translate("p_name", " ", "_").alias("id"), F.rpad(F.translate("p_name", " ", "."), F.col("l"), F.lit("-")).alias("a"), F.floor(F.col("l") / 2).cast("int").alias("h"))
    blocks = rows.select("id", F.explode(F.array(F.struct(F.lit(0).alias("no"), F.substring("a", F.lit(1), F.col("h")).alias("part")), F.struct(F.lit(1).alias("no"), F.substr("a", F.col("h") + 1).alias("part")))).alias("b"))
    head_rows = spark.createDataFrame([(-1, "", head), (0, "", ""), (1, "", "")], "no int, id string, line string")
    lines = blocks.select(F.col("b.no").alias("no"), "id", F.concat_ws("  ", "id", "b.part").alias("line")).unionByName(head_rows)
    sinks.write_ordered(lines, path, ["no", "id"], "line")


@query(_ALIGNED + "SELECT id, aligned FROM a")
def scan_alignment(spark, d):
    path = shared_folder(spark)
    _write_alignment(spark, d, f"{path}/a.sto", "# STOCKHOLM 1.0")
    return formats.scan_alignment(spark, f"{path}/a.sto", of="folder").select("id", "aligned")


@query(_ALIGNED + "SELECT id, aligned FROM a")
def scan_clustal(spark, d):
    path = shared_folder(spark)
    _write_alignment(spark, d, f"{path}/a.aln", "CLUSTAL O(1.2.4) multiple sequence alignment")
    return formats.scan_alignment(spark, f"{path}/a.aln", of="folder").select("id", "aligned")


@query("SELECT '# STOCKHOLM 1.0' AS l1, '#=GF ID family' AS l2, count(DISTINCT p_name) * 2 AS sequence_lines FROM part")
def alignment_merge(spark, d):
    path = shared_folder(spark)
    _write_alignment(spark, d, f"{path}/family.sto", "# STOCKHOLM 1.0")
    lines = composites.merge_stockholm(formats.numbered_lines(spark, f"{path}/family.sto", of="folder"), S.strip_extension(F.element_at(F.split("file", "/"), -1)))
    at = lambda n: F.max(F.when(F.col("line") == n, F.col("value")))
    return lines.agg(at(-2).alias("l1"), at(-1).alias("l2"), F.count_if(F.col("value").rlike(r"^[^#\s]")).alias("sequence_lines"))


@query(_ALIGNED + """, h AS (SELECT DISTINCT substr(id, 1, 1) < 'm' AS one, aligned FROM a), q AS (SELECT x.one, (SELECT count(*) FROM range(1, length(x.aligned) + 1) t(i) WHERE substr(x.aligned, i, 1) <> substr(y.aligned, i, 1)) / length(x.aligned) AS d
  FROM h x JOIN h y ON x.one = y.one AND x.aligned < y.aligned), m AS (SELECT coalesce(avg(d) FILTER (WHERE one), 0) AS a, coalesce(avg(d) FILTER (WHERE NOT one), 0) AS b FROM q)
  SELECT round(a, 6) AS first_mean, round(b, 6) AS second_mean, CASE WHEN a > b THEN 'first' WHEN b > a THEN 'second' ELSE 'equal' END AS verdict FROM m""")
def divergence(spark, d):
    a = scan_alignment(spark, d)
    one = F.substring("id", 1, 1) < "m"
    return composites.divergence(a.where(one), a.where(~one)).select(_round(F.col("first_mean"), 6).alias("first_mean"), _round(F.col("second_mean"), 6).alias("second_mean"), "verdict")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def scan_csv(spark, d):
    path = shared_folder(spark)
    sinks.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return formats.scan_csv(spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def scan_tsv(spark, d):
    path = shared_folder(spark)
    sinks.write_csv(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path, separator="\t")
    return formats.scan_csv(spark, path, "s_suppkey bigint, s_name string, s_nationkey int", separator="\t")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def append_with_header_once(spark, d):
    """Orders in three batches by status; no header becomes a row."""
    path, o = shared_folder(spark), table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for batch in (F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O", ~F.col("o_orderstatus").isin("F", "O")):
        sinks.write_csv(o.where(batch), path, mode="append")
    return formats.scan_csv(spark, path, "o_orderkey bigint, o_orderstatus string")


@query("SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def append_batches_once(spark, d):
    """Customers in two named batches, the first of which is sent twice and then once more with other rows."""
    path, c = shared_folder(spark), table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    building = F.coalesce(F.col("c_mktsegment") == "BUILDING", F.lit(False))
    for rows, batch in ((c.where(building), "building"), (c.where(~building), "others"), (c.where(building), "building"), (c, "building")):
        appending.append_batch(rows, path, batch)
    return appending.read_batches(spark, path, c.schema)


@query("""SELECT o_custkey, first_order FROM (SELECT o_custkey, o_orderkey AS first_order, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderkey) AS n FROM orders) WHERE n = 1""")
def insert_batches_once(spark, d):
    """A row for each customer with orders: the first finished order, for those without any their first order at all. Batches are sent twice."""
    path, o = shared_folder(spark), table(spark, d, "orders")
    rows = o.select("o_custkey", F.col("o_orderkey").alias("first_order"))
    for batch, own in (("finished", o.o_orderstatus == "F"), ("all", F.lit(True))):
        for _ in range(2):
            appending.insert_batch(rows.where(own), path, batch, "o_custkey", [F.col("first_order")])
    return appending.read_batches(spark, path, rows.schema)


@query("""SELECT o_orderkey, CASE WHEN p IS NULL THEN o_totalprice ELSE p END AS o_totalprice, o_orderstatus FROM orders
  LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS p FROM lineitem WHERE l_discount >= 0.1 GROUP BY 1) ON l_orderkey = o_orderkey""")
def upsert_touched_buckets(spark, d):
    """Orders in folders by key; those with lines of high discount get the greatest of these lines as their price."""
    path = shared_folder(spark)
    updates.write_buckets(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, "o_orderkey")
    lines = table(spark, d, "lineitem").where("l_discount >= 0.1")
    changes = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("o_totalprice"))
    updates.upsert_buckets(changes, path, "o_orderkey", ["o_totalprice"])
    return updates.read_buckets(spark, path)


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def skip_known_keys(spark, d):
    """Lines of orders that are not among the finished ones, through a filter of their keys."""
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return updates.skip_known(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), done, ["l_orderkey"])


@query("""SELECT p_partkey::VARCHAR AS "Query_ID", p_brand AS "Subject_ID", p_type AS "Accession", p_retailprice AS e_value, p_size AS "Alignment_Length"
  FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS n FROM part) WHERE n <= 899 AND p_size <> 7""")
def scan_hit_csv(spark, d):
    """One hit file: its first 899 rows count, and of these those of exactly five fields."""
    path = shared_folder(spark)
    extra = F.when(F.col("p_size") == 7, ",more").otherwise("")
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.concat_ws(",", "p_partkey", "p_brand", "p_type", "p_retailprice", "p_size"), extra).alias("line"))
    head = spark.createDataFrame([(-1, "Query_ID,Subject_ID,Accession,E-value,Alignment_Length")], "p_partkey long, line string")
    sinks.write_ordered(rows.unionByName(head), path, ["p_partkey"], "line")
    return formats.scan_hit_csv(spark, path, of="folder").select("Query_ID", "Subject_ID", "Accession", F.col("E-value").alias("e_value"), "Alignment_Length")


def _blast_xml(spark, d) -> DataFrame:
    """A result file: each brand a query, its parts the hits, with two segments each."""
    path = shared_folder(spark)
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c.cast("string"), F.lit(f"</{name}>"))
    segment = lambda e: F.concat(F.lit("<Hsp>"), tag("Hsp_evalue", F.lit(e)), tag("Hsp_hit-from", F.col("p_size")), tag("Hsp_hit-to", F.col("p_size") + 9), tag("Hsp_align-len", F.lit(10)), F.lit("</Hsp>"))
    hit = lambda: F.concat(F.lit("<Hit>"), tag("Hit_id", F.concat(F.lit("nuc"), _TEXT("p_partkey"))), tag("Hit_accession", F.concat(F.lit("A"), _TEXT("p_partkey"))), F.lit("<Hit_hsps>"), segment("0.0"), segment("0.5"), F.lit("</Hit_hsps></Hit>"))
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_size")
    parts = p.select("p_brand", F.lit(1).alias("at"), "p_partkey", hit().alias("line"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("at"), F.concat(F.lit("<Iteration>"), tag("Iteration_query-ID", F.col("p_brand")), F.lit("<Iteration_hits>")).alias("line")), F.struct(F.lit(2).alias("at"), F.lit("</Iteration_hits></Iteration>").alias("line"))))
    around = p.select("p_brand").distinct().select("p_brand", ends.alias("e")).select("p_brand", "e.at", F.lit(0).cast("long").alias("p_partkey"), "e.line")
    sinks.write_ordered(parts.unionByName(around), path, ["p_brand", "at", "p_partkey"], "line", together=["p_brand"])
    return formats.scan_blast_xml(spark, path, of="folder")


@query("""SELECT p_brand AS query, concat('nuc', p_partkey) AS hit, concat('A', p_partkey) AS accession, s AS segment_no, s * 0.5::DOUBLE AS e_value, p_size AS start, p_size + 9 AS "end"
  FROM part, (VALUES (0), (1)) t(s)""")
def scan_blast_xml(spark, d):
    return _blast_xml(spark, d).select("query", "hit", "accession", "segment_no", "e_value", "start", "end")


@query("""SELECT p_brand AS query, p_size AS start, p_size + 9 AS "end", concat('nuc', p_partkey) AS nucleotide_id
  FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS n FROM part) WHERE n = 1""")
def hit_localisation(spark, d):
    return composites.locate_hits(_blast_xml(spark, d)).select("query", "start", "end", "nucleotide_id")


@query("SELECT n_name AS accession, CASE WHEN n_regionkey = 0 THEN 'unknown' ELSE concat('name of ', n_name) END AS name FROM nation")
def scan_json_pages(spark, d):
    """The nations of each region as one saved page, a name absent in one of them."""
    path = shared_folder(spark)
    _write_pages(table(spark, d, "nation").withColumns({"next": F.lit(None).cast("string"), "page": _TEXT("n_regionkey")}), path)
    return formats.scan_json_pages(spark, path, of="folder").select("accession", "name")


def _write_pages(nations: DataFrame, path: str) -> None:
    """A file for each page: its nations and its link. A page holds what a service sends at once."""
    named = F.when(F.col("n_regionkey") != 0, F.concat(F.lit("name of "), "n_name"))
    entry = F.struct("n_nationkey", F.struct(F.struct(F.col("n_name").alias("accession"), named.alias("name")).alias("metadata")).alias("r"))
    pages = nations.groupBy("page").agg(F.first("next").alias("next"), F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["r"]).alias("results"))
    pages.select("page", F.to_json(F.struct("next", "results")).alias("line")).write.partitionBy("page").text(path)


@query("""WITH RECURSIVE walk(key, name, step, path) AS (SELECT n_nationkey, n_name, 0, [n_nationkey] FROM nation WHERE n_nationkey = 0
  UNION ALL SELECT n.n_nationkey, n.n_name, step + 1, list_append(path, n.n_nationkey) FROM walk JOIN nation n ON n.n_nationkey = (walk.key * 3 + 4) % 25 WHERE NOT list_contains(path, n.n_nationkey))
  SELECT step::BIGINT AS step, name AS accession FROM walk""")
def follow_json_pages(spark, d):
    """Each nation as a saved page that links to another: the pages that links from the first one lead to, in order, until they come
    back to one already seen."""
    path = shared_folder(spark)
    name = lambda key: F.concat(F.lit("nation-"), key.cast("string"), F.lit(".json"))
    _write_pages(table(spark, d, "nation").withColumns({"next": name((F.col("n_nationkey") * 3 + 4) % 25), "page": name(F.col("n_nationkey"))}), path)
    pages = formats.scan_json_pages(spark, path, of="folder")
    return formats.followed_pages(pages, "nation-0.json").select("step", "accession")


@query("SELECT lower(p_name) AS word, count(*)::INTEGER AS count FROM part GROUP BY 1")
def scan_kv_literal(spark, d):
    path = shared_folder(spark)
    A.frequency_desc(table(spark, d, "part"), F.lower("p_name"), "word").select(F.concat_ws(", ", "word", _TEXT("n")).alias("line")).write.text(path)
    return formats.scan_counts(spark, path)


@query("SELECT concat(r_regionkey, '.list') AS file, r_regionkey::VARCHAR AS stem FROM region")
def list_dir(spark, d):
    path = shared_folder(spark)
    names = F.explode(F.array(*[F.concat(_TEXT("r_regionkey"), F.lit(e)) for e in (".list", ".other")])).alias("name")
    table(spark, d, "region").select(names, F.col("r_name").alias("value")).write.partitionBy("name").text(path)
    return formats.list_files(spark, path, ".list", of="folder")


@query("""WITH r AS (SELECT p_size, row_number() OVER (ORDER BY p_partkey) AS position FROM part)
  SELECT position::INTEGER AS position, p_size::DOUBLE AS first_value, (p_size + 19)::DOUBLE AS last_value FROM r""")
def scan_hmm(spark, d):
    """A profile file with a line of 20 numbers for each part, between lines of other lengths."""
    path = shared_folder(spark)
    numbers = F.concat_ws(" ", *[(F.col("p_size") + i).cast("string") for i in range(20)])
    match = F.concat_ws(" ", _TEXT("p_partkey"), numbers, _TEXT("p_partkey"), F.lit("x - - -"))
    sinks.write_ordered(table(spark, d, "part"), path, ["p_partkey"], match, F.concat(F.lit("   "), numbers), F.lit("0.1 0.2 *"))
    return formats.scan_profile(spark, path, of="folder").select("position", F.col("A").alias("first_value"), F.col("Y").alias("last_value"))


def _genbank(spark, d) -> DataFrame:
    """Each brand a record with its parts as genes; brands of even number are plasmids by their definition line."""
    path = shared_folder(spark)
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    kind = F.when(number % 2 == 0, "some plasmid, complete sequence").otherwise("some text")
    p = table(spark, d, "part").withColumns({"record": F.translate("p_brand", "# ", "__"), "kind": kind})
    gene = F.concat(F.lit("     CDS             "), _TEXT("p_partkey"), F.lit(".."), (F.col("p_partkey") + F.col("p_size")).cast("string"), F.lit('\n                     /product="'), F.col("p_name"), F.lit('"'))
    head = F.concat(F.lit("LOCUS       "), "record", F.lit("  1000000 bp    DNA     linear\nDEFINITION  "), "kind", F.lit(".\nVERSION     "), "record", F.lit('\nFEATURES             Location/Qualifiers\n     source          1..1000000\n                     /mol_type="genomic DNA"'))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("at"), head.alias("line")), F.struct(F.lit(2).alias("at"), F.lit("//").alias("line"))))
    around = p.select("record", "kind").distinct().select("record", ends.alias("e")).select("record", "e.at", F.lit(0).cast("long").alias("p_partkey"), "e.line")
    whole = p.select("record", F.lit(1).alias("at"), "p_partkey", gene.alias("line")).unionByName(around)
    sinks.write_ordered(whole, path, ["record", "at", "p_partkey"], "line", together=["record"])
    return formats.scan_genbank(spark, path, of="folder")


_RECORD = "translate(p_brand, '# ', '__')"


@query(f"""SELECT {_RECORD} AS record_id, (p_partkey - 1)::INTEGER AS start, (p_partkey + p_size)::INTEGER AS "end", p_name AS product FROM part""")
def scan_genbank(spark, d):
    features = _genbank(spark, d).where("type = 'CDS'")
    return features.select("record_id", "start", "end", F.col("qualifiers")["product"][0].alias("product"))


_SEQ_TYPE = "CASE WHEN regexp_extract(p_brand, '(\\d+)', 1)::INTEGER % 2 = 0 THEN 'Plasmid' ELSE 'Genome' END"


@query(f"SELECT DISTINCT {_RECORD} AS record_id, {_SEQ_TYPE} AS seq_type FROM part")
def replicon_typing(spark, d):
    return composites.replicon_type(_genbank(spark, d))


@query(f"SELECT arg_max({_SEQ_TYPE}, {_RECORD}) AS seq_type FROM part")
def replicon_typing_of_file(spark, d):
    """The last record of the file decides."""
    return composites.replicon_type(_genbank(spark, d), "file").select("seq_type")


@query(f"""WITH t AS (SELECT {_RECORD} AS record_id, min(p_partkey) + 100 AS lo, min(p_partkey) + 101 AS hi FROM part GROUP BY 1),
  f AS (SELECT {_RECORD} AS record_id, p_partkey - 1 AS s, p_partkey + p_size AS e, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'bolt'))
  SELECT record_id, p_name AS product, s::INTEGER AS start, e::INTEGER AS "end", (CASE WHEN s < lo THEN lo - e ELSE s - hi END)::BIGINT AS relative, CASE WHEN s < lo THEN 'left' ELSE 'right' END AS side
  FROM t JOIN f USING (record_id) WHERE s >= greatest(0, lo - 500) AND e <= least(1000000, hi + 500)
  AND greatest(0, least(hi, e) - greatest(lo, s)) * 100.0 / (greatest(hi, e) - least(lo, s)) <= 80""")
def neighbour_extraction(spark, d):
    targets = table(spark, d, "part").groupBy(F.translate("p_brand", "# ", "__").alias("record_id")).agg((F.min("p_partkey") + 100).alias("target_start")).withColumn("target_end", F.col("target_start") + 1)
    found = composites.neighbour_features(targets.withColumn("target_id", F.col("record_id")), _genbank(spark, d), 500, ["Red", "bolt"])
    return found.select("record_id", "product", "start", "end", F.col("relative").cast("long").alias("relative"), F.col("type").alias("side"))


@query("""WITH s AS (SELECT p_type AS v, p_brand AS b, sum(p_retailprice) AS t FROM part WHERE p_size < 40 GROUP BY 1, 2), l AS (SELECT v, concat('G_', b) AS g, log10(t + 1e-6) AS x FROM s),
  m AS (SELECT v, g, coalesce((x - min(x) OVER w) / nullif(max(x) OVER w - min(x) OVER w, 0), 0) AS x FROM l WINDOW w AS (PARTITION BY v))
  SELECT v AS value, round(max(CASE WHEN g = 'G_Brand#2' THEN x ELSE 0 END), 6) AS g2, round(max(CASE WHEN g = 'G_Brand#17' THEN x ELSE 0 END), 6) AS g17, round(max(CASE WHEN g = 'G_Brand#25' THEN x ELSE 0 END), 6) AS g25 FROM m GROUP BY 1""")
def heat_matrix(spark, d):
    """A score table for each part type as a file named by it, read back by file name; rows of other names do not count."""
    path = shared_folder(spark)
    scores = table(spark, d, "part").where("p_size < 40").groupBy("p_type", "p_brand").agg(F.sum("p_retailprice").alias("t"))
    rows = scores.select("p_type", F.concat(F.lit("G_"), "p_brand").alias("g"), "t")
    other = scores.select("p_type", F.lit("single product").alias("g"), F.lit(1e9).alias("t")).distinct()
    named = F.translate("p_type", " ", "-")
    files = rows.unionByName(other).select(F.concat(F.lit("102_"), named, F.lit("_x.csv")).alias("name"), F.col("g").alias("Group"), F.col("t").alias("Score"))
    files.repartition("name").write.partitionBy("name").csv(path, header=True)
    groups = ["G_Brand#2", "G_Brand#17", "G_Brand#25"]
    out = composites.heat_matrix_of_files(spark, path, groups, "102", of="folder")
    types = table(spark, d, "part").select("p_type", named.alias("value")).distinct()
    return out.join(types, "value").select(F.col("p_type").alias("value"), *[_round(F.col(f"`{g}`"), 6).alias(f"g{g.split('#')[1]}") for g in groups])


@query("""WITH p AS (SELECT a.event_id, a.user_id, b.event_id AS near_id, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS d FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_type = 'purchase' AND b.event_type = 'error')
  SELECT user_id, event_id, near_id, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, near_id) AS n FROM p) WHERE n = 1""")
def nearest_by_start(spark, d):
    """The nearest partner of each row at any distance."""
    e = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    left = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("at").alias("p_at"))
    right = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("near_id"), F.col("at").alias("e_at"))
    return joins.nearest_sorted(left, right, ["user_id"], "p_at", "e_at", "near_id").select("user_id", "event_id", "near_id", "distance")


@query("""SELECT CASE p_size % 7 WHEN 1 THEN 'Group I' WHEN 2 THEN 'Group II' WHEN 3 THEN 'Group III' WHEN 4 THEN 'Group IV' WHEN 5 THEN 'Group V' WHEN 0 THEN '0_' ELSE '6_' END AS group_label,
  string_split_regex(p_name, '[-/ ]')[1] AS family, count(*) AS n FROM part GROUP BY 1, 2""")
def group_labels(spark, d):
    """Labels of a file as groups and families: the number before the bar names a group, other numbers stay."""
    path = shared_folder(spark)
    sinks.write_csv(table(spark, d, "part").select(F.concat_ws("_", (F.col("p_size") % 7).cast("string"), F.lit("x")).alias("Cluster"), F.col("p_name").alias("Product")), path)
    labels = formats.scan_csv(spark, path, "Cluster string, Product string")
    group = S.map_replace(S.regex_extract(F.col("Cluster"), r"^(\d+_)"), composites.GROUP_LABELS)
    return A.group_size(labels.select(group.alias("group_label"), S.first_token(F.col("Product")).alias("family")), ["group_label", "family"])


@query(f"""WITH g AS (SELECT p_type AS cluster, coalesce({_case(PART_RULES)} END, p_name) AS "group", p_size AS r FROM part), n AS (SELECT cluster, count(*) AS n FROM g GROUP BY 1)
  SELECT cluster, "group", count(*) AS total_gene, round(sum(1.0 / (abs(r) + 1)) * count(*) * count(*) / any_value(n) * 100, 4) AS score FROM g JOIN n USING (cluster) GROUP BY 1, 2""")
def enrichment_of_rules(spark, d):
    """Enrichment where only the product rules group: every other name stands alone."""
    flanks = table(spark, d, "part").select(F.col("p_type").alias("cluster"), F.col("p_name").alias("product"), F.col("p_size").alias("relative"), F.col("p_partkey").alias("position"))
    return composites.enrichment(flanks, threshold=1.01, rules=PART_RULES).select("cluster", "group", "total_gene", _round(F.col("score")).alias("score"))


@query(f"""SELECT p_type, p_name, {_case(PART_RULES)} ELSE p_name END AS "group" FROM (SELECT DISTINCT p_type, p_name FROM part)""")
def fuzzy_group_of_rules(spark, d):
    """Fuzzy groups with a threshold that no two names meet."""
    return composites.fuzzy_group(table(spark, d, "part").select("p_type", "p_name", "p_partkey"), ["p_type"], "p_name", "p_partkey", PART_RULES, threshold=1.01)


def _positions(spark, d, *order) -> DataFrame:
    """Parts in an order, each with its place: sorted parts are written side by side and their lines numbered."""
    path = shared_folder(spark)
    sinks.write_ordered(table(spark, d, "part"), path, order, _TEXT("p_partkey"))
    return formats.numbered_lines(spark, path, of="folder").select("line", F.col("value").cast("long").alias("p_partkey"))


@query("SELECT (row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1)::INTEGER AS line, p_partkey FROM part")
def sort_asc(spark, d):
    return _positions(spark, d, F.asc("p_retailprice"), F.asc("p_partkey"))


@query("SELECT (row_number() OVER (ORDER BY p_size DESC, p_name DESC, p_partkey) - 1)::INTEGER AS line, p_partkey FROM part")
def sort_desc(spark, d):
    return _positions(spark, d, F.desc("p_size"), F.desc("p_name"), F.asc("p_partkey"))
