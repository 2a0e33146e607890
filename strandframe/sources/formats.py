"""Readers. Every format is read with Spark's text source, so a large file splits: lines, or records that a separator tells apart
(FASTA at `>`, GenBank at `//`, which a parser then takes record by record). Where the order in a file counts, rows are numbered
by their split: within it by their order, and splits by the counts of those before. No task sees more than a split.

With of="folder" the files of a folder, in the order of their names, are one file, as `sinks.write_ordered` makes them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..session import durable


def scan_fasta(spark: SparkSession, path: str) -> DataFrame:
    """header, seq and file of each record. A record starts at a line that begins with `>`."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("r"), F.col("_metadata.file_name").alias("file"))
    head = F.regexp_extract("r", r"^([^\r\n]*)", 1)
    return records.where(F.trim("r") != "").select(F.trim(head).alias("header"), F.regexp_replace(F.expr("substring(r, length(regexp_extract(r, '^([^\\r\\n]*)', 1)) + 1)"), r"\s+", "").alias("seq"), "file")


def read_records(spark: SparkSession, path: str, separator: str | None = None, of: str = "file") -> DataFrame:
    """value, file, and where the row was read: __split and __row, for `numbered`. The separator is a line's end by default."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    at = F.col("_metadata.file_path")
    file = at if of == "file" else F.regexp_replace(at, "/[^/]*$", "")
    split = F.struct(F.length(at).alias("n"), at.alias("path"), F.col("_metadata.file_block_start").alias("start"))
    return reader.text(path).select("value", file.alias("file"), split.alias("__split"), F.monotonically_increasing_id().alias("__row"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows of `read_records`, all or some, with their number in the file from 0. A window holds a split's rows; the counts of
    splits are a row each."""
    inside = rows.withColumn("__n", F.row_number().over(Window.partitionBy("file", "__split").orderBy("__row")))
    counts = rows.groupBy("file", "__split").agg(F.count("*").alias("__c"))
    before = Window.partitionBy("file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "__split", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"))
    return inside.join(offsets, ["file", "__split"]).withColumn(name, (F.col("__before") + F.col("__n") - 1).cast("int")).drop("__n", "__before", "__split", "__row")


def numbered_lines(spark: SparkSession, path: str, of: str = "file") -> DataFrame:
    """value, file and line (from 0) of text files."""
    return numbered(read_records(spark, path, of=of), "line")


def scan_gene_fasta(spark: SparkSession, path: str, of: str = "file") -> DataFrame:
    """FASTA records whose header is `kind | name | start-end | contig`, with their place in the file, and the file."""
    found = read_records(spark, path, "\n>", of).withColumn("r", F.regexp_replace("value", "^>", "")).where(F.trim(F.regexp_replace("r", r"[\r\n]+", "")) != "")
    records = numbered(found.drop("value"), "ordinal")
    parts = F.split("r", r"\r?\n", 2)
    parsed = records.select("file", "ordinal", F.trim(parts[0]).alias("header"), F.regexp_replace(F.coalesce(F.get(parts, 1), F.lit("")), r"\s+", "").alias("seq"))
    fields = S.header_parse(F.col("header"))
    name = F.trim(F.try_element_at(F.split("header", r"\|"), F.lit(2)))
    return parsed.withColumn("f", fields).select("ordinal", "f.kind", name.alias("name"), "f.start", "f.end", "f.contig", "seq", "f.reject", "file")


def scan_tblout(spark: SparkSession, path: str) -> DataFrame:
    """Hits of a whitespace table: comment lines and lines of fewer than nine fields are left out."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") >= 9)
    text = lambda i, name: F.col("f")[i].alias(name)
    return rows.select(text(0, "target_name"), text(1, "accession"), text(2, "query_name"), text(3, "query_accession"), F.col("f")[4].try_cast("double").alias("e_value"), F.col("f")[5].try_cast("double").alias("score"))


def scan_alignment(spark: SparkSession, path: str, of: str = "file") -> DataFrame:
    """id and aligned text of Stockholm or Clustal files, whose blocks are joined in order; first is the line of an id's first block."""
    lines = numbered_lines(spark, path, of).withColumn("value", F.rtrim(F.regexp_replace("value", r"\r$", "")))
    rows = lines.where(F.col("value").rlike(r"^\S+\s+\S+\s*\d*\s*$") & ~F.col("value").rlike(r"^(#|//|CLUSTAL|MUSCLE)"))
    parts = F.split(F.trim("value"), r"\s+")
    chunks = rows.select("file", "line", parts[0].alias("id"), parts[1].alias("chunk"))
    joined = chunks.groupBy("file", "id").agg(F.min("line").alias("first"), F.array_sort(F.collect_list(F.struct("line", "chunk"))).alias("c"))
    return joined.select("file", "first", "id", F.array_join(F.transform("c", lambda x: x["chunk"]), "").alias("aligned"))


#: Amino acids in the order of profile columns.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def scan_profile(spark: SparkSession, path: str, mode: str = "compat", of: str = "file") -> DataFrame:
    """position and 20 emission columns of profile models, and the file; positions begin anew in each file. compat takes the lines
    of exactly 20 fields (insert emissions), match those of a position number, 20 emissions and annotations."""
    lines = read_records(spark, path, of=of)
    fields = F.split(F.trim("value"), r"\s+")
    if mode == "compat":
        rows, shift = lines.where(F.size(fields) == 20), 0
    else:
        rows, shift = lines.where((F.size(fields) == 26) & fields[0].rlike(r"^\d+$")), 1
    values = [F.try_element_at(fields, F.lit(i + 1 + shift)).try_cast("double").alias(a) for i, a in enumerate(AMINO_ACIDS)]
    known = rows.select("file", "__split", "__row", *values).where(F.col("A").isNotNull())
    return numbered(known, "position").select((F.col("position") + 1).alias("position"), *AMINO_ACIDS, "file")


FEATURES = "record_id string, definition string, record_length int, ordinal int, type string, start int, end int, strand int, qualifiers map<string,array<string>>, record_no int, file string"
_FEATURE = re.compile(r"^ {5}(\S+)\s+(\S.*)$")
_QUALIFIER = re.compile(r'^/([^=\s]+)(?:=(.*))?$', re.S)


def parse_genbank(record: str) -> list[dict]:
    """Features of one record: half-open from 0, joined locations from their least start to their greatest end. None without a LOCUS
    line."""
    locus = re.search(r"(?m)^LOCUS\s+(\S+)\s+(\d+) bp", record)
    if not locus:
        return []
    out: list[dict] = []
    version = re.search(r"(?m)^VERSION\s+(\S+)", record)
    definition = re.search(r"(?ms)^DEFINITION\s+(.*?)^\S", record)
    section = re.search(r"(?ms)^FEATURES[^\n]*\n(.*?)(?=^\S|\Z)", record)
    blocks: list[list[str]] = []
    for line in section[1].splitlines() if section else ():
        if _FEATURE.match(line):
            blocks.append([line])
        elif blocks:
            blocks[-1].append(line.strip())
    for ordinal, lines in enumerate(blocks):
        kind, place = _FEATURE.match(lines[0]).groups()
        items: list[str] = []
        for line in lines[1:]:
            if line.startswith("/"):
                items.append(line)
            elif items:
                glue = "" if items[-1].startswith("/translation=") else " "
                items[-1] += glue + line
            else:
                place += line
        qualifiers: dict[str, list[str]] = {}
        for item in items:
            if m := _QUALIFIER.match(item):
                qualifiers.setdefault(m[1], []).append((m[2] or "").strip().strip('"'))
        ends = [int(x) for x in re.findall(r"\d+", re.sub(r"[\w.]+:", "", place))]
        if ends:
            out.append({
                "record_id": version[1] if version else locus[1], "definition": " ".join(definition[1].split()) if definition else None, "record_length": int(locus[2]),
                "ordinal": ordinal, "type": kind, "start": min(ends) - 1, "end": max(ends), "strand": -1 if place.startswith("complement") else 1, "qualifiers": list(qualifiers.items()),
            })
    return out


def scan_genbank(spark: SparkSession, path: str, of: str = "file") -> DataFrame:
    """Features of all records, with the record's number in its file, and the file. A file of many records is read by many tasks."""
    kind = pa.struct([
        ("record_id", pa.string()), ("definition", pa.string()), ("record_length", pa.int32()), ("ordinal", pa.int32()), ("type", pa.string()),
        ("start", pa.int32()), ("end", pa.int32()), ("strand", pa.int32()), ("qualifiers", pa.map_(pa.string(), pa.list_(pa.string()))), ("record_no", pa.int32()), ("file", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, number, file in zip(*(batch.column(c).to_pylist() for c in ("value", "record_no", "file")), strict=True):
                rows = pa.array([x | {"record_no": number, "file": file} for x in parse_genbank(text)], kind)
                yield pa.RecordBatch.from_arrays(rows.flatten(), [f.name for f in kind])

    # A record ends with a line that begins with //; what is left of that line begins the next.
    records = numbered(read_records(spark, path, "\n//", of), "record_no")
    return records.select("value", "record_no", "file").mapInArrow(run, FEATURES)


def scan_csv(spark: SparkSession, path: str, schema: str | T.StructType, separator: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, sep=separator)


HIT_SCHEMA = "Query_ID string, Subject_ID string, Accession string, `E-value` double, Alignment_Length int"


def scan_hit_csv(spark: SparkSession, path: str, limit: int = 899, of: str = "file") -> DataFrame:
    """The first rows of each hit table with exactly five fields, header left out."""
    lines = numbered_lines(spark, path, of).where(f"line > 0 AND line <= {int(limit)}")
    f = F.split(F.regexp_replace("value", r"\s+$", ""), ",")
    return lines.where(F.size(f) == 5).select("file", "line", f[0].alias("Query_ID"), f[1].alias("Subject_ID"), f[2].alias("Accession"), f[3].try_cast("double").alias("E-value"), f[4].try_cast("int").alias("Alignment_Length"))


ITERATION = "`Iteration_query-ID` string, Iteration_hits struct<Hit: array<struct<Hit_id: string, Hit_accession: string, Hit_hsps: struct<Hsp: array<struct<Hsp_evalue: double, `Hsp_hit-from`: int, `Hsp_hit-to`: int, `Hsp_align-len`: int>>>>>>"


def scan_blast_xml(spark: SparkSession, path: str, of: str = "file") -> DataFrame:
    """One row for each segment: query, hit, accession, hit and segment numbers, e_value, start, end, align_len. A query is a row of
    the scan, so a result file splits between queries; query_no counts a file's queries that have hits, from 0."""
    records = read_records(spark, path, "</Iteration>", of).where(F.col("value").contains("<Iteration>"))
    text = F.concat(F.lit("<Iteration>"), F.substring_index("value", "<Iteration>", -1), F.lit("</Iteration>"))
    queries = numbered(records.select("file", "__split", "__row", F.from_xml(text, ITERATION).alias("q")), "query_no")
    hits = queries.select("query_no", F.col("q.`Iteration_query-ID`").alias("query"), F.posexplode("q.Iteration_hits.Hit").alias("hit_no", "h"))
    segments = hits.select("query_no", "query", "hit_no", F.col("h.Hit_id").alias("hit"), F.col("h.Hit_accession").alias("accession"), F.posexplode("h.Hit_hsps.Hsp").alias("segment_no", "s"))
    return segments.select("query_no", "query", "hit_no", "hit", "accession", "segment_no", F.col("s.Hsp_evalue").alias("e_value"), F.col("s.`Hsp_hit-from`").alias("start"), F.col("s.`Hsp_hit-to`").alias("end"), F.col("s.`Hsp_align-len`").alias("align_len"))


PAGE_SCHEMA = "next string, results array<struct<metadata: struct<accession: string, name: string>>>"


def named_by(of: str) -> Column:
    """The name of the file that a row is read from; with of="folder" the value that a writer's partitionBy gave to its folder."""
    path = F.col("_metadata.file_path")
    return F.element_at(F.split(path, "/"), -1) if of == "file" else F.regexp_extract(path, r"/[^/=]+=([^/]*)/[^/]*$", 1)


def scan_json_pages(spark: SparkSession, path: str, of: str = "file") -> DataFrame:
    """page (the file's name, or the folder's), next, accession and name of the results of all saved pages; absent values read unknown. A page without
    results is a row without accession and name."""
    reader = spark.read.schema(PAGE_SCHEMA).option("multiLine", True).option("recursiveFileLookup", of != "file")
    pages = reader.json(path).select(named_by(of).alias("page"), "next", F.posexplode_outer("results").alias("place", "r"))
    named = [F.when(F.col("r").isNotNull(), F.coalesce(F.col(f"r.metadata.{c}"), F.lit("unknown"))).alias(c) for c in ("accession", "name")]
    return pages.select("page", "next", F.coalesce("place", F.lit(0)).alias("place"), *named)


def followed_pages(pages: DataFrame, first: str, page: str = "page", link: str = "next") -> DataFrame:
    """The rows of the pages that links lead to from the first one, with step (0, 1, ...). A link back to a page already seen ends the
    walk, as does one to a page that is not there; a page of several rows has one link.

    Steps double: each page knows the page 2^k links on, so a chain of n pages takes log2(n) joins, not n."""
    links = pages.groupBy(page).agg(F.min(link).alias("to")).where("to IS NOT NULL")
    links = durable(links.select(F.col(page).alias("at"), "to").join(pages.select(F.col(page).alias("to")).distinct(), "to", "left_semi").select("at", "to"))
    seen = durable(pages.where(F.col(page) == first).select(F.lit(first).alias("at"), F.lit(0).cast("long").alias("step")).distinct())
    n, jump = 1, links
    while not seen.isEmpty():
        ahead = seen.join(jump, "at").select(F.col("to").alias("at"), (F.col("step") + n).alias("step"))
        more = durable(seen.unionByName(ahead).groupBy("at").agg(F.min("step").alias("step")))
        if more.count() == seen.count():
            break
        seen, n = more, 2 * n
        jump = durable(jump.join(jump.select(F.col("at").alias("to"), F.col("to").alias("far")), "to").select("at", F.col("far").alias("to")))
    return pages.join(seen.withColumnRenamed("at", page), page)


def scan_counts(spark: SparkSession, path: str) -> DataFrame:
    """word and count of lines `word, count`; the last comma separates."""
    m = lambda i: F.trim(F.regexp_extract("value", r"^(.*),\s*(\d+)\s*$", i))
    return spark.read.text(path).where(F.col("value").rlike(r",\s*\d+\s*$")).select(m(1).alias("word"), m(2).cast("int").alias("count"))


def list_files(spark: SparkSession, path: str, suffix: str, of: str = "file") -> DataFrame:
    """file and stem of the files of a folder with a suffix; contents are not read. With of="folder" the names are those that a
    writer's partitionBy gave to folders."""
    if of == "file":
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", r"/[^/=]+=([^/]*)/[^/]*$", 1).alias("file"))
        files = found.where(F.col("file").endswith(suffix)).distinct()
    return files.withColumn("stem", S.strip_extension(F.col("file")))
