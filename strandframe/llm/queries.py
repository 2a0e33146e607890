"""One query for each operator, with production parameters, over whole tables; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, lexical, licenses, neardup, negatives, pii, quality_crf, repetition, sharding, substrings, topk
from .common import read_table


def _split(doc_id: str, folds: int):
    return F.crc32(F.col(doc_id).cast("string")) % folds


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe.bpe_encode(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    decoded = bpe.bpe_decode(encoded, ranks, keep=("doc_id", "token_ids"))
    return decoded.select(
        "doc_id",
        F.expr("octet_length(token_ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), words=2, percent=80)


def op3_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_quality(read_table(spark, sf_dir, "documents"))


def op4_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    sized = read_table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.hypergeometric_shuffle(sized, shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitize(read_table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.recognize_licenses(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "license", "license_class")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated")
    )


def op8_line_chain_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    labels = quality_crf.sample_labels(read_table(spark, sf_dir, "labels").where(_split("doc_id", 5) != 0)).select("doc_id", "quality")
    model = quality_crf.train_line_chain(documents.select("doc_id", "text").join(F.broadcast(labels), "doc_id"))
    scored = quality_crf.score_quality(documents, model)
    return scored.select("doc_id", (_split("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    model = langid.train_language_model(documents.where(_split("doc_id", 3) != 1))
    found = langid.identify_language(documents, model)
    return found.select("doc_id", (_split("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op10_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substrings.remove_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return cleaned.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read_table(spark, sf_dir, "embeddings").withColumn("label", noisy), F.col("vec_id") % 50 == 0)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=50)


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_near_duplicates, op3_repetition_rules, op4_hypergeometric_shards, op5_sanitisation,
        op6_license_sentences, op7_decontamination, op8_line_chain_quality, op9_language, op10_repeated_substrings,
        op11_hard_negatives, op12_ranked_search, op13_top_k,
    )
}


def _license_sql() -> str:
    values = ", ".join(f"('{s}', '{i}')" for s, i in licenses.SENTENCES.items())
    rules = ", ".join(f"({n}, '{name}', '{'%'.join(f' {i} ' for i in ids)}', '{kind}')" for n, (name, ids, kind) in enumerate(licenses.RULES))
    return f"""
    WITH known(s, id) AS (VALUES {values}), rules(n, name, wanted, class) AS (VALUES {rules}),
    parts AS (
      SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS part
      FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(coalesce(text, ''), '[.!?;]+(\\s)', '\n\\1', 'g'), '[\\n\\r]+') AS p FROM documents)),
    ids AS (
      SELECT doc_id, string_agg(id, ',' ORDER BY i) AS sentence_ids, ' ' || string_agg(id, '  ' ORDER BY i) || ' ' AS seq
      FROM parts JOIN known ON s = trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) GROUP BY doc_id),
    hits AS (SELECT doc_id, n, name, class FROM ids JOIN rules ON seq LIKE '%' || wanted || '%'),
    firsts AS (SELECT doc_id, name, min(n) AS n FROM hits GROUP BY doc_id, name),
    named AS (SELECT doc_id, string_agg(name, ',' ORDER BY n) AS licenses, arg_min(name, n) AS license FROM firsts GROUP BY doc_id),
    classed AS (SELECT doc_id, arg_min(class, n) AS license_class FROM hits GROUP BY doc_id)
    SELECT d.doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses, license, license_class
    FROM documents d LEFT JOIN ids USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN classed USING (doc_id)
    """


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"

_SEARCH_SQL = f"""
    WITH words AS (SELECT doc_id, {_TERMS} FROM documents),
    tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
    sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
    whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
    asked AS (SELECT DISTINCT item_id, {_TERMS} FROM benchmark),
    weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, whole GROUP BY term),
    scores AS (
      SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
      FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), whole GROUP BY item_id, doc_id),
    ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
    """

ORACLE_SQL: dict[str, str] = {"op6_license_sentences": _license_sql(), "op12_ranked_search": _SEARCH_SQL}
