"""Evidence support of extracted values."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from vitalake.functions import arrays as A

# Texts that stand for no value, and the ends stripped before comparing with them.
NULL_WORDS = ["none", "null", "n/a", "na", "undefined", "[]", "{}"]
EDGE_CHARS = " ,.;:-"


def normalize_text(value: Column) -> Column:
    """Trimmed, single blanks, lower case; null-like words become ''."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    bare = F.btrim(F.lower(text), F.lit(EDGE_CHARS))
    return F.when(bare.isin(NULL_WORDS), "").otherwise(F.lower(F.regexp_replace(text, r"\s+", " ")))


def _pair(label: Column, item: Column) -> Column:
    return F.struct(label, normalize_text(item).alias("value"))


def extracted_values(df: DataFrame, fields: dict[str, str], *, key: str = "cv_id") -> Column:
    """Array of (field_path, value) over scalar and list columns, blank values dropped."""
    types = dict(df.dtypes)
    parts = []
    for path, column in fields.items():
        items = F.col(column) if types[column].startswith("array") else F.array(F.col(column).cast("string"))
        items = F.coalesce(items, F.array().cast("array<string>"))
        label = F.lit(path).alias("field_path")
        parts.append(F.transform(items, partial(_pair, label)))
    return F.filter(F.concat(*parts), lambda s: s["value"] != "")


def traceability(
    df: DataFrame, fields: dict[str, str], evidence: str, *, key: str = "cv_id", evidence_chars: int | None = None
) -> DataFrame:
    """Each extracted value with the first evidence text of the same record that contains it.

    ``evidence`` is an array column of the record, so values meet only their own
    record's texts and nothing is shuffled. Values of one or two characters count as supported. The evidence is
    given whole, or its first ``evidence_chars`` characters.
    """
    corpus = F.filter(F.transform(evidence, normalize_text), lambda t: t != "")
    held = df.select(key, corpus.alias("_corpus"), extracted_values(df, fields, key=key).alias("_values"))
    rows = A.explode_items(held, [key, "_corpus"], F.col("_values"), "f")
    first = F.try_element_at(F.filter("_corpus", lambda t: t.contains(F.col("f.value"))), F.lit(1))
    short = F.length("value") <= 2
    shown = F.col("_first") if evidence_chars is None else F.substring("_first", 1, evidence_chars)
    found = rows.select(key, "f.field_path", "f.value", first.alias("_first"))
    return found.select(
        key, "field_path", "value",
        (short | F.col("_first").isNotNull()).alias("supported"),
        F.when(short, "").otherwise(F.coalesce(shown, F.lit(""))).alias("evidence"),
    )


def expected_fields(df: DataFrame, fields: dict[str, str], *, key: str = "cv_id") -> DataFrame:
    """A10: number of leaf paths present in the record's shape (a list is one path, null is none)."""
    present = [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in fields.values()]
    total = present[0]
    for p in present[1:]:
        total = total + p
    return df.select(key, total.alias("expected_fields"))


def quality_metrics(
    df: DataFrame, fields: dict[str, str], evidence: str, *, validation_pass: Column | None = None, key: str = "cv_id"
) -> DataFrame:
    """Support metrics per record, in one pass over the record's own lists."""
    values = extracted_values(df, fields, key=key)
    corpus = F.filter(F.transform(evidence, normalize_text), lambda t: t != "")
    held = df.withColumns({"_values": values, "_corpus": corpus})
    present = [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in fields.values()]
    expected = present[0]
    for p in present[1:]:
        expected = expected + p
    counted = held.select(
        key,
        F.greatest(F.lit(1), expected).alias("expected_fields"),
        F.size("_values").alias("extracted_fields"),
        A.let(F.col("_corpus"), lambda held: F.size(F.filter(
            "_values", lambda s: (F.length(s["value"]) <= 2) | F.exists(held, lambda t: t.contains(s["value"])),
        ))).alias("supported_fields"),
        (F.lit(False) if validation_pass is None else validation_pass).alias("_pass"),
    )
    got, ok, want = F.col("extracted_fields"), F.col("supported_fields"), F.col("expected_fields")
    precision = F.when(got == 0, 1.0).otherwise(ok / got)
    return counted.select(
        key, "expected_fields", "extracted_fields", "supported_fields",
        F.bround(precision, 4).alias("precision"),
        F.bround(ok / want, 4).alias("recall"),
        F.bround(precision, 4).alias("accuracy"),
        F.bround(F.when(got == 0, 0.0).otherwise((got - ok) / got), 4).alias("hallucination_rate"),
        F.bround(got / want, 4).alias("completeness_score"),
        F.when(F.col("_pass"), 1.0).otherwise(0.0).alias("validation_pass_rate"),
    )


def corpus_quality(metrics: DataFrame) -> DataFrame:
    """A9 over a whole table: mean of each metric."""
    names = ["precision", "recall", "accuracy", "hallucination_rate", "completeness_score", "validation_pass_rate"]
    return metrics.agg(F.count(F.lit(1)).alias("records"), *[F.round(F.avg(n), 6).alias(n) for n in names])
