"""The registered queries of this subpackage: name -> callable, and DuckDB texts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitalake.llm import chat, decontam, divergence, langid, lexical, licenses, mix, nearcopy, sketch, spans, suffix, tokens, warc
from vitalake.session import fresh_path

#: Tokenizer files of the installation; a parameter of the operator.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def _load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_load(spark, sf_dir, "documents"), tokens.read_vocabulary(VOCABULARY))


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_load(spark, sf_dir, "documents"), _load(spark, sf_dir, "benchmark"))


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeated_spans(_load(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix.remove_repeats(_load(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _load(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(langid.remainder() == 1, F.lit(False)))
    model = langid.learn(docs, ~F.col("held_out"))
    return langid.identify(docs, model, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.per_document(mix.mix(_load(spark, sf_dir, "documents")))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _load(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("payload"))
    raw, deduplicated = fresh_path(spark, "warc"), fresh_path(spark, "warc-revisits")
    warc.write_archives(pages, raw)
    warc.deduplicate_archives(spark, raw, deduplicated)
    return warc.read_archives(spark, deduplicated, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.rotate(_load(spark, sf_dir, "conversations")))


def op9_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopy.classes(_load(spark, sf_dir, "documents"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(_load(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_load(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_load(spark, sf_dir, "documents"), _load(spark, sf_dir, "benchmark"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(_load(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_benchmark_leaks, op3_sentence_spans, op4_repeated_strings, op5_language_id, op6_source_mix, op7_warc_revisits, op8_chat_perspectives,
    op9_near_copies, op10_document_fingerprints, op11_source_divergence, op12_lexical_search, op13_license_scan,
)}
OP7_SQL = """
WITH coded AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, unhex(sha1(coalesce(html, ''))) AS d, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (SELECT *, [('0x' || substr(h, 5 * i + 1, 5))::BIGINT FOR i IN range(8)] AS fives FROM coded),
named AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(fives, lambda v: array_to_string(
    [substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INT + 1, 1) FOR s IN [15, 10, 5, 0]], '')), '') AS payload_digest FROM bits),
kept AS (SELECT payload_digest, max(page_id) AS top FROM named GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, n.payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM named n JOIN kept k ON n.payload_digest = k.payload_digest"""
ORACLE_SQL = {
    "op6_source_mix": mix.sql("documents"),
    "op7_warc_revisits": OP7_SQL,
    "op8_chat_perspectives": chat.SQL,
    "op11_source_divergence": divergence.sql("documents"),
    "op12_lexical_search": lexical.sql("documents", "benchmark"),
}
