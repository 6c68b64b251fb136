"""Attributes without a canonical field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitalake.functions.json_rows import flatten_json


def normalize_label(label: Column) -> Column:
    """Trimmed, single blanks, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"\s+", " ")))


def attribute_rows(payloads: DataFrame, json_column: str, *, source: Column, root: str = "legacy") -> DataFrame:
    """Leaves of a nested bucket as attribute sightings (cv_id, source, path, value...)."""
    rows = flatten_json(
        payloads.select("cv_id", source.alias("source"), "seen_at", json_column), json_column,
        ["cv_id", "source", "seen_at"], root=root,
    )
    return rows.select(
        "cv_id", "source", F.col("leaf_label").alias("original_label"),
        normalize_label(F.col("leaf_label")).alias("normalized_label"),
        F.lit(root).alias("source_section"), F.col("path").alias("source_path"), "value", "value_type", "seen_at",
    )


def upsert_attributes(sightings: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """One row per (record, source, path, value) with count and first/last sighting.

    ``prior`` is the stored state (same shape as the result); it is folded in
    by adding counts, so the state is never read row by row. Sightings are first
    counted with the labels among the keys: that is hashed, and combined before
    the shuffle, while ``min_by`` of texts sorts its input.
    """
    keys = ["cv_id", "source", "source_path", "value"]
    labels = ["original_label", "normalized_label", "value_type"]
    rows = sightings.select(
        *keys, *labels, F.lit(1).cast("long").alias("occurrence_count"),
        F.col("seen_at").alias("first_seen_at"), F.col("seen_at").alias("last_seen_at"),
    )
    if prior is not None:
        rows = rows.unionByName(prior.select(*rows.columns))
    counts = [
        F.sum("occurrence_count").alias("occurrence_count"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
    ]
    labelled = rows.groupBy(*keys, *labels).agg(*counts)
    return labelled.groupBy(*keys).agg(*[F.min_by(c, "first_seen_at").alias(c) for c in labels], *counts)


def unmapped_frequency(attributes: DataFrame) -> DataFrame:
    """Sightings per normalised label; a count below one counts as one."""
    return attributes.groupBy("normalized_label").agg(
        F.sum(F.greatest(F.coalesce("occurrence_count", F.lit(1)), F.lit(1))).alias("occurrences")
    )


def unknown_keys(payload: Column, known: list[str]) -> Column:
    """U4: entries of a string map that are not known keys and not blank."""
    return F.map_filter(
        payload, lambda k, v: ~k.isin(known) & F.coalesce(F.trim(v) != "", F.lit(False))
    )


def loss_guard_rows(answers: DataFrame, mapped: DataFrame, unknown: DataFrame) -> dict[str, DataFrame]:
    """What a batch of answers must leave behind.

    ``answers`` (session_id, ordinal, question, answer), ``mapped`` the rows of
    it that reached a field, ``unknown`` unknown extraction keys (session_id,
    key, value). Returns snapshot, attribute and warning rows to append.
    """
    lost = answers.join(mapped.select("session_id", "ordinal"), ["session_id", "ordinal"], "left_anti")
    attributes = lost.select(
        "session_id", F.lit("questionnaire").alias("source"), F.col("question").alias("original_label"), F.col("answer").alias("value")
    ).unionByName(
        unknown.select("session_id", F.lit("extraction").alias("source"), F.col("key").alias("original_label"), "value")
    )
    warnings = attributes.select(
        "session_id", "source", F.concat(F.lit("no canonical field for: "), "original_label").alias("warning")
    )
    return {"snapshots": answers, "attributes": attributes, "warnings": warnings}
