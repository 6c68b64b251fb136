"""Extraction staging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Stage order and the stage-time column each stage sets.
STAGES = ["pending", "in_progress", "complete", "previewed", "exported", "cleared", "failed"]
STAGE_TIME = {"complete": "extracted_at", "previewed": "previewed_at", "exported": "exported_at", "cleared": "cleared_at"}
CONFIDENCE_THRESHOLD = 0.7


def extractions_with_errors(df: DataFrame, *, k: int = 10) -> DataFrame:
    """newest extractions whose error list is not empty."""
    return df.where(F.size("extraction_errors") > 0).orderBy(F.desc("created_at"), "extraction_id").limit(k)


def stage_audit_trail(df: DataFrame, *, session_id: str) -> DataFrame:
    """stage times of one session's extractions, newest first."""
    return (
        df.where(F.col("session_id") == session_id)
        .select("extraction_id", "extraction_status", "created_at", "extracted_at", "previewed_at", "exported_at")
        .orderBy(F.desc("created_at"), "extraction_id")
    )


def latest_complete_extraction(df: DataFrame, *, extraction_id: str | None = None) -> DataFrame:
    """Newest complete extraction per session; an explicit id is returned whatever its status."""
    if extraction_id:
        return df.where(F.col("extraction_id") == extraction_id)
    rest = [c for c in df.columns if c != "session_id"]
    return (
        df.where(F.col("extraction_status") == "complete")
        .groupBy("session_id")
        .agg(F.max_by(F.struct(*rest), F.struct("extracted_at", "extraction_id")).alias("row"))
        .select("session_id", "row.*")
    )


def extraction_history(df: DataFrame, *, k: int = 10) -> DataFrame:
    """Newest k extractions per session (the rank limit also runs before the shuffle)."""
    newest = W.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("extraction_id"))
    return df.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= k)


def flatten_confidence(df: DataFrame, *, column: str = "field_confidence") -> DataFrame:
    """One row per field path; plain numbers get the default method and status."""
    detailed = dict(df.dtypes)[column].startswith("map<string,struct")
    score = F.col("v.confidence") if detailed else F.col("v")

    def detail(name: str, default: Column) -> Column:
        return F.coalesce(F.col(f"v.{name}"), default) if detailed else default

    return df.select("extraction_id", F.explode(column).alias("field_path", "v")).select(
        "extraction_id", "field_path",
        detail("method", F.lit("unknown")).alias("extraction_method"),
        F.coalesce(score, F.lit(0.0)).cast("double").alias("confidence_score"),
        detail("status", F.lit("unknown")).alias("validation_status"),
    )


def confidence_report(staging: DataFrame, confidence: DataFrame) -> DataFrame:
    """Field confidence with its extraction, lowest first."""
    return (
        confidence.join(staging.select("extraction_id", "session_id", "source_type"), "extraction_id")
        .orderBy("confidence_score", "extraction_id", "field_path")
    )


def confidence_bucket(score: Column, scale: str = "five") -> Column:
    """The three bucket scales."""
    if scale == "five":
        return (
            F.when(score > 0.9, "very_high").when(score > 0.7, "high").when(score > 0.5, "medium")
            .when(score > 0.3, "low").otherwise("very_low")
        )
    if scale == "three":
        return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")
    if scale == "verified":
        return (
            F.when(score >= 0.95, "VERIFIED").when(score >= 0.80, "HIGH").when(score >= 0.60, "MEDIUM")
            .when(score >= 0.40, "LOW").otherwise("UNCERTAIN")
        )
    raise ValueError(f"unknown scale {scale}")


def low_confidence_fields(confidence: DataFrame, *, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """fields that need a follow-up, with their display bucket."""
    return confidence.where(F.col("confidence_score") < threshold).withColumn(
        "bucket", confidence_bucket(F.col("confidence_score"), "three")
    )


def overall_confidence(confidence: DataFrame) -> DataFrame:
    """Mean field confidence per extraction and its level."""
    mean = F.round(F.avg("confidence_score"), 6)
    return confidence.groupBy("extraction_id").agg(mean.alias("overall")).withColumn(
        "level", confidence_bucket(F.col("overall"), "verified")
    )


def extraction_summary(confidence: DataFrame) -> DataFrame:
    """Totals, high-confidence and to-verify counts, average, and a histogram by level."""
    score = F.col("confidence_score")
    level = confidence_bucket(score, "five")
    histogram = [
        F.count(F.when(level == name, 1)).alias(f"level_{name}")
        for name in ("very_high", "high", "medium", "low", "very_low")
    ]
    return confidence.agg(
        F.count(F.lit(1)).alias("total_fields"),
        F.count(F.when(score > 0.7, 1)).alias("high_confidence"),
        F.count(F.when(score <= 0.7, 1)).alias("needs_verification"),
        F.round(F.avg(score), 3).alias("avg_confidence"),
        *histogram,
    )


def fold_stage_events(events: DataFrame) -> DataFrame:
    """Latest status and stage times per extraction out of an append-only stage log."""
    order = F.struct("event_at", "event_id")
    times = [
        F.max(F.when(F.col("stage") == stage, F.col("event_at"))).alias(name) for stage, name in STAGE_TIME.items()
    ]
    return events.where(F.col("stage").isin(STAGES)).groupBy("extraction_id").agg(
        F.max_by("stage", order).alias("extraction_status"),
        F.min("event_at").alias("created_at"),
        F.max("event_at").alias("updated_at"),
        *times,
    )
