"""Domain views over the supplied tables, in Spark and (as CTE text) in DuckDB."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitalake.functions.windows import number_rows, previous_row


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit events, one per row of ``events``."""
    base = load(spark, sf_dir, "events").selectExpr(
        "event_id AS id",
        "concat('s_', user_id, '_', date_format(ts, 'yyyyMMdd')) AS session_id",
        "user_id AS actor_user_id",
        "CASE WHEN user_id % 10 = 0 THEN NULL ELSE concat('user_', user_id) END AS actor_username",
        "CASE event_type WHEN 'signup' THEN 'auth' WHEN 'click' THEN 'chat' WHEN 'view' THEN 'preview' "
        "WHEN 'purchase' THEN 'export' ELSE 'cv' END AS module_name",
        "CASE WHEN event_type = 'signup' THEN 'login' ELSE event_type END AS operation",
        "CASE WHEN event_type = 'error' OR (event_type = 'signup' AND value < 50) THEN 'failed' "
        "ELSE 'success' END AS status",
        "CASE user_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'mobile' ELSE 'api' END AS source_channel",
        "CASE WHEN event_type = 'purchase' THEN 'pdf' END AS export_format",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
        "props",
        "CAST(ts AS TIMESTAMP_NTZ) AS created_at",
    )
    return base.withColumns(
        {
            "http_status": F.expr(
                "CASE WHEN status = 'success' THEN 200 WHEN module_name = 'auth' THEN 401 ELSE 500 END"
            ),
            "error_message": F.expr(
                "CASE WHEN status = 'failed' THEN CASE WHEN k % 5 = 0 THEN '' "
                "ELSE concat('error code ', k % 5) END END"
            ),
            "payload": F.expr(
                "CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN '[1, 2]' WHEN 2 THEN 'not json' ELSE props END"
            ),
        }
    ).withColumn(
        "event_message",
        F.expr(
            "concat(module_name, '.', operation, ' ', status, "
            "CASE WHEN error_message <> '' THEN concat(': ', error_message) ELSE '' END)"
        ),
    ).drop("props")


#: Rows of a task of record work, about.
TASK_ROWS = 50_000


def load_spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """Table whose rows need much work each, spread over the cores in tasks of about TASK_ROWS rows.

    A scan is split by bytes but read by row groups, so a file of one row group comes out of one split, however many
    there are. The rows of each split are counted, which reads footers only; a scan that is uneven or of few splits is
    hashed by its unique id, any other is read as it is, without a shuffle.
    """
    df = load(spark, sf_dir, name)
    held = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(sum(held) / TASK_ROWS))
    return df if max(held, default=0) <= 2 * math.ceil(sum(held) / parts) else df.repartition(parts, key)


AUDIT_LOG = """audit_base AS (
  SELECT event_id AS id, 's_' || user_id || '_' || strftime(ts, '%Y%m%d') AS session_id,
    user_id AS actor_user_id,
    CASE WHEN user_id % 10 = 0 THEN NULL ELSE 'user_' || user_id END AS actor_username,
    CASE event_type WHEN 'signup' THEN 'auth' WHEN 'click' THEN 'chat' WHEN 'view' THEN 'preview'
      WHEN 'purchase' THEN 'export' ELSE 'cv' END AS module_name,
    CASE WHEN event_type = 'signup' THEN 'login' ELSE event_type END AS operation,
    CASE WHEN event_type = 'error' OR (event_type = 'signup' AND value < 50) THEN 'failed' ELSE 'success' END AS status,
    CASE user_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'mobile' ELSE 'api' END AS source_channel,
    CASE WHEN event_type = 'purchase' THEN 'pdf' END AS export_format,
    CAST(json_extract_string(props, '$.k') AS INT) AS k, props, ts AS created_at
  FROM events),
audit_err AS (
  SELECT *, CASE WHEN status = 'success' THEN 200 WHEN module_name = 'auth' THEN 401 ELSE 500 END AS http_status,
    CASE WHEN status = 'failed' THEN CASE WHEN k % 5 = 0 THEN '' ELSE 'error code ' || (k % 5) END END AS error_message,
    CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN '[1, 2]' WHEN 2 THEN 'not json' ELSE props END AS payload
  FROM audit_base),
audit_log AS (
  SELECT *, module_name || '.' || operation || ' ' || status ||
    CASE WHEN error_message <> '' THEN ': ' || error_message ELSE '' END AS event_message
  FROM audit_err)"""


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned session writes: one row per event, numbered within its session."""
    return number_rows(
        audit_log(spark, sf_dir), ["session_id"], ["created_at", "id"],
        F.date_trunc("hour", "created_at"), "version",
    )


SESSION_LOG = AUDIT_LOG + """,
session_log AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS version FROM audit_log)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session state: one row per session id, from map-side combined aggregates."""
    grouped = audit_log(spark, sf_dir).groupBy("session_id").agg(
        F.max("actor_user_id").alias("user_id"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("last_updated_at"),
        F.max(F.when(F.col("module_name") == "export", F.col("created_at"))).alias("exported_at"),
        F.count(F.lit(1)).alias("version"),
        F.count(F.when(F.col("status") == "failed", 1)).alias("errors"),
    )
    return grouped.withColumn(
        "status",
        F.expr("CASE WHEN user_id % 17 = 0 THEN 'deleted' WHEN exported_at IS NOT NULL THEN 'exported' ELSE 'active' END"),
    ).selectExpr(
        "*",
        "last_updated_at + CASE WHEN status = 'exported' THEN INTERVAL '6' HOUR ELSE INTERVAL '24' HOUR END AS expires_at",
        "concat('{\"candidate\":{\"fullName\":\"user ', user_id, '\"},\"events\":', version, '}') AS canonical_cv",
        "concat('{\"errors\":', errors, ',\"can_export\":', CASE WHEN errors = 0 THEN 'true' ELSE 'false' END, '}') AS validation_results",
    )


SESSIONS = AUDIT_LOG + """,
session_agg AS (
  SELECT session_id, max(actor_user_id) AS user_id, min(created_at) AS created_at, max(created_at) AS last_updated_at,
    max(CASE WHEN module_name = 'export' THEN created_at END) AS exported_at, count(*) AS version,
    count(CASE WHEN status = 'failed' THEN 1 END) AS errors
  FROM audit_log GROUP BY session_id),
session_status AS (
  SELECT *, CASE WHEN user_id % 17 = 0 THEN 'deleted' WHEN exported_at IS NOT NULL THEN 'exported' ELSE 'active' END AS status
  FROM session_agg),
sessions AS (
  SELECT *, last_updated_at + CASE WHEN status = 'exported' THEN INTERVAL 6 HOUR ELSE INTERVAL 24 HOUR END AS expires_at,
    '{"candidate":{"fullName":"user ' || user_id || '"},"events":' || version || '}' AS canonical_cv,
    '{"errors":' || errors || ',"can_export":' || CASE WHEN errors = 0 THEN 'true' ELSE 'false' END || '}' AS validation_results
  FROM session_status)"""


def session_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with a nested history: one entry per distinct source type, so its size is bounded."""
    per_type = audit_log(spark, sf_dir).groupBy("session_id", "operation").agg(
        F.min("created_at").alias("event_at"), F.count(F.lit(1)).alias("events")
    )
    return per_type.groupBy("session_id").agg(
        F.sort_array(
            F.collect_list(F.struct("event_at", F.col("operation").alias("source_type"), "events"))
        ).alias("source_history")
    )


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged extractions, one per document."""
    return load(spark, sf_dir, "documents").selectExpr(
        "concat('ex_', doc_id) AS extraction_id",
        "concat('sess_', doc_id % 300) AS session_id",
        "doc_id",
        "CASE doc_id % 3 WHEN 0 THEN 'audio_upload' WHEN 1 THEN 'document_upload' ELSE 'bot_conversation' END AS source_type",
        "text AS raw_extracted_text",
        "CASE doc_id % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 4 THEN 'previewed' "
        "WHEN 5 THEN 'exported' WHEN 6 THEN 'failed' ELSE 'complete' END AS extraction_status",
        "CASE WHEN n_chars < 50 THEN array('short text') ELSE CAST(array() AS ARRAY<STRING>) END AS extraction_errors",
        "timestampadd(MINUTE, doc_id, TIMESTAMP_NTZ'2024-01-01 00:00:00') AS created_at",
        "CASE WHEN doc_id % 7 >= 2 AND doc_id % 7 <> 6 THEN "
        "timestampadd(MINUTE, doc_id + 5, TIMESTAMP_NTZ'2024-01-01 00:00:00') END AS extracted_at",
        "CASE WHEN doc_id % 7 IN (4, 5) THEN "
        "timestampadd(MINUTE, doc_id + 9, TIMESTAMP_NTZ'2024-01-01 00:00:00') END AS previewed_at",
        "CASE WHEN doc_id % 7 = 5 THEN "
        "timestampadd(MINUTE, doc_id + 12, TIMESTAMP_NTZ'2024-01-01 00:00:00') END AS exported_at",
        "map('candidate.email', CASE WHEN text LIKE '%@%' THEN 0.95D ELSE 0.3D END, "
        "'candidate.fullName', CASE WHEN length(text) > 20 THEN 0.8D ELSE 0.4D END, "
        "'skills.primary', least(0.95D, n_chars / 1000D)) AS field_confidence",
    )


EXTRACTIONS = """extractions AS (
  SELECT 'ex_' || doc_id AS extraction_id, 'sess_' || (doc_id % 300) AS session_id, doc_id,
    CASE doc_id % 3 WHEN 0 THEN 'audio_upload' WHEN 1 THEN 'document_upload' ELSE 'bot_conversation' END AS source_type,
    text AS raw_extracted_text,
    CASE doc_id % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 4 THEN 'previewed'
      WHEN 5 THEN 'exported' WHEN 6 THEN 'failed' ELSE 'complete' END AS extraction_status,
    CASE WHEN n_chars < 50 THEN ['short text'] ELSE [] END AS extraction_errors,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at,
    CASE WHEN doc_id % 7 >= 2 AND doc_id % 7 <> 6 THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id + 5) END AS extracted_at,
    CASE WHEN doc_id % 7 IN (4, 5) THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id + 9) END AS previewed_at,
    CASE WHEN doc_id % 7 = 5 THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id + 12) END AS exported_at
  FROM documents),
field_conf AS (
  SELECT 'ex_' || doc_id AS extraction_id, 'candidate.email' AS field_path,
    CASE WHEN text LIKE '%@%' THEN 0.95 ELSE 0.3 END::DOUBLE AS confidence_score FROM documents
  UNION ALL SELECT 'ex_' || doc_id, 'candidate.fullName', CASE WHEN length(text) > 20 THEN 0.8 ELSE 0.4 END::DOUBLE FROM documents
  UNION ALL SELECT 'ex_' || doc_id, 'skills.primary', least(0.95::DOUBLE, n_chars / 1000.0::DOUBLE) FROM documents)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace spans: one per conversation turn, children hang below half their ordinal."""
    return load(spark, sf_dir, "conversations").selectExpr(
        "concat('tr_', conv_id) AS trace_id",
        "conv_id * 1000000 + turn AS span_id",
        "CASE WHEN turn > 0 THEN conv_id * 1000000 + (turn - 1) div 2 END AS parent_span_id",
        "role AS name",
        "CASE WHEN role = 'assistant' THEN 'llm' ELSE 'chain' END AS span_type",
        "CASE WHEN length(text) % 11 = 0 THEN 'error' ELSE 'completed' END AS status",
        "CASE WHEN turn % 5 <> 4 THEN CAST(length(text) AS DOUBLE) END AS duration_ms",
        "CAST(size(split(trim(text), ' ')) AS BIGINT) AS total_tokens",
        "CASE conv_id % 5 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'GPT-4-Turbo-custom' WHEN 2 THEN 'my-gpt-4-copy' "
        "WHEN 3 THEN 'unknown-model' ELSE 'gpt-3.5-turbo' END AS model",
    )


SPANS = """spans AS (
  SELECT 'tr_' || conv_id AS trace_id, conv_id * 1000000 + turn AS span_id,
    CASE WHEN turn > 0 THEN conv_id * 1000000 + (turn - 1) // 2 END AS parent_span_id, role AS name,
    CASE WHEN role = 'assistant' THEN 'llm' ELSE 'chain' END AS span_type,
    CASE WHEN length(text) % 11 = 0 THEN 'error' ELSE 'completed' END AS status,
    CASE WHEN turn % 5 <> 4 THEN length(text)::DOUBLE END AS duration_ms,
    len(string_split(trim(text), ' ')) AS total_tokens,
    CASE conv_id % 5 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'GPT-4-Turbo-custom' WHEN 2 THEN 'my-gpt-4-copy'
      WHEN 3 THEN 'unknown-model' ELSE 'gpt-3.5-turbo' END AS model
  FROM conversations)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer pairs: each user turn with the turn before it."""
    turns = load(spark, sf_dir, "conversations")
    paired = previous_row(
        turns, ["conv_id"], ["turn"], F.floor(F.col("turn") / 1000), F.struct("role", "text"), "asked"
    )
    return paired.where((F.col("role") == "user") & (F.col("asked.role") == "assistant")).select(
        F.concat(F.lit("conv_"), "conv_id").alias("session_id"),
        F.col("turn").alias("ordinal"),
        F.col("asked.text").alias("question"),
        F.col("text").alias("answer"),
    )


ANSWERS = """turn_pairs AS (
  SELECT conv_id, turn, role, text, lag(role) OVER w AS asked_role, lag(text) OVER w AS asked_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
answers AS (
  SELECT 'conv_' || conv_id AS session_id, turn AS ordinal, asked_text AS question, text AS answer
  FROM turn_pairs WHERE role = 'user' AND asked_role = 'assistant')"""
