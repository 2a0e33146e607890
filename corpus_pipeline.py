"""The corpus pipeline: five stages, each over all documents that the one before kept.

Language identification, near-duplicate removal, benchmark decontamination, sanitisation of personal data, and
tokenisation. A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Empty tables pass through all stages; rows with null, empty or letterless text go at the first. Further columns of the
table, whatever their names, are left behind at the first stage. Texts of any length pass whole.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import bpe, decontaminate, langid, neardup, pii
from strandframe.llm.common import delete_folder, ensure_checkpoint_dir, read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes where no language is found, or its n-grams of letters are so much less likely in the likeliest one than in
#: that language's texts (in natural logarithms): it is in a language that was not learnt.
MIN_LANGUAGE_FIT = -4.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; `lang` becomes the predicted one. Rows with null, empty or letterless text go; a null lang or
    doc_id is no reason to. Of languages alike in probability the first by name is taken. Repeated rows share their fate."""
    model = langid.train_language_model(docs)
    found = langid.identify_language(docs, model, keep=COLUMNS)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("fit") >= MIN_LANGUAGE_FIT))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least id; of repeated rows one stays. Rows with a null id, or
    without a word, stay. Shingles are of five words here, as for all near-duplicate stages without a contract of their own."""
    found = neardup.near_duplicates(docs, words=5, percent=80)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    if repeated.isEmpty():
        return left
    return left.join(repeated, "doc_id", "left_anti").unionByName(left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages in a twentieth of their words or more. Null and empty texts stay, and without a
    benchmark all do; repeated rows share their fate."""
    found = decontaminate.find_contamination(docs, read_table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.where(~decontaminate.contaminated()).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that reveal it replaced in the text, and n_chars that of the new text. A null
    text stays null; repeated rows are changed alike."""
    clean = pii.sanitize(docs, keep=tuple(c for c in COLUMNS if c not in ("text", "n_chars")))
    return clean.withColumn("text", F.col("sanitized")).withColumn("n_chars", F.length("sanitized").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token_ids (packed), n_tokens and round_trip: whether decoding gives the text back. Null and empty texts
    have no tokens; every row stays."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe.bpe_encode(docs, ranks, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"), round_trip="round_trip")
    return encoded.select("doc_id", "lang", "source", "token_ids", F.expr("octet_length(token_ids) div 4").cast("long").alias("n_tokens"), "round_trip")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; what each returns is written to the shared folder and read again. A stage's files go when the next
    stage's are written; those of the last stay, as the result is read from them."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:
            delete_folder(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs


#: SQL cannot express the language model, the set join or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None
