"""Corpus pipeline: language, near copies, repeated passages, benchmark leaks, source mix.

Each stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents`` and returns them (the last one the
mix by document). A stage's rows are written as Parquet to the shared folder and read again by the next one, so a
lost executor costs one stage at most. Nulls, empty texts, repeated rows and empty tables pass through as each
operator defines; other columns of the same names are not expected here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitalake.llm import decontam, langid, mix, nearcopy, spans
from vitalake.session import fresh_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this share of the best language a text counts as no language.
MIN_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identifiable language. The model is learned from labelled documents outside the held-out
    third; a missing label is filled in. Null texts and texts without a letter go."""
    model = langid.learn(docs, F.coalesce(langid.remainder() != 1, F.lit(True)))
    rated = langid.identify(docs, model, keep=("text", "lang", "source", "n_chars"))
    return rated.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)).withColumn(
        "lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near copies. Rows that repeat an id stay together."""
    others = nearcopy.classes(docs).where(F.col("doc_id") != F.col("class_id")).select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences that an earlier one has; those of which nothing is left go."""
    cleaned = spans.remove_repeated_spans(docs.select(*COLUMNS))
    return cleaned.where((F.col("n_removed") == 0) | (F.col("text") != "")).withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = decontam.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), exact=True).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of each document that the mix takes, with size, source size and target."""
    return mix.per_document(mix.mix(docs))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
]
#: SQL can express neither the samples nor the walks; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
