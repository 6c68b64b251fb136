"""Registered queries: streaming jobs over the whole events table, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitalake.plans import views as v
from vitalake.plans.q_audit import with_
from vitalake.plans.registry import query
from vitalake.session import fresh_path
from vitalake.streaming import jobs

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as a file stream with the audit columns the jobs need."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.selectExpr(
        "event_id AS id", "concat('s_', user_id, '_', date_format(ts, 'yyyyMMdd')) AS session_id",
        "CASE WHEN user_id % 10 = 0 THEN NULL ELSE concat('user_', user_id) END AS actor_username",
        "CASE WHEN event_type = 'signup' THEN 'auth' ELSE 'other' END AS module_name",
        "CASE WHEN event_type = 'error' OR (event_type = 'signup' AND value < 50) THEN 'failed' ELSE 'success' END AS status",
        "CASE user_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'mobile' ELSE 'api' END AS address", "event_type = 'purchase' AS exported", "CAST(get_json_object(props, '$.k') AS INT) AS k", "ts AS created_at",
    )


def _run(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    path = fresh_path(spark, label)
    jobs.write(df, path, fresh_path(spark, "checkpoint"), available_now=True).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@query("stream_ingest", "ST1 ST7 ST8", with_(v.AUDIT_LOG, "SELECT id, status FROM audit_log"))
def stream_ingest(spark, sf):
    path = fresh_path(spark, "audit")
    jobs.ingest_audit(_stream(spark, sf), path, fresh_path(spark, "checkpoint"), available_now=True).awaitTermination()
    return spark.read.parquet(path).select("id", "status")


@query("stream_hourly_failures", "ST2 A3", with_(v.AUDIT_LOG, """
SELECT date_trunc('hour', created_at) AS hour_bucket, count(*) AS failed_events FROM audit_log WHERE status = 'failed' GROUP BY 1
HAVING date_trunc('hour', created_at) + INTERVAL 1 HOUR <= (SELECT max(created_at) FROM audit_log WHERE status = 'failed') - INTERVAL 10 MINUTE"""))
def stream_hourly_failures(spark, sf):
    out = _run(spark, jobs.hourly_failures(_stream(spark, sf)), "hourly")
    return out.select(F.col("hour_bucket").cast("timestamp_ntz").alias("hour_bucket"), "failed_events")


@query("stream_login_abuse", "ST3", with_(v.AUDIT_LOG, """
, w AS (SELECT source_channel AS address, coalesce(lower(actor_username), 'unknown') AS actor, (epoch_us(created_at) // 10000000 - unnest(range(0, 6))) * 10 AS s FROM audit_log WHERE module_name = 'auth' AND status = 'failed')
SELECT address, actor, make_timestamp(s * 1000000) AS window_start, count(*) AS failures FROM w GROUP BY ALL
HAVING make_timestamp((s + 60) * 1000000) <= (SELECT max(created_at) FROM audit_log WHERE module_name = 'auth' AND status = 'failed') - INTERVAL 10 MINUTE""".replace("\n, w", ", w", 1)))
def stream_login_abuse(spark, sf):
    out = _run(spark, jobs.login_abuse(_stream(spark, sf), threshold=1), "abuse")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_session_expiry", "ST4", with_(v.AUDIT_LOG, """
, e AS (SELECT session_id, date_trunc('millisecond', max(created_at)) + CASE WHEN arg_max(module_name, created_at) = 'export' THEN INTERVAL 6 HOUR ELSE INTERVAL 24 HOUR END AS expires_at
  FROM audit_log GROUP BY 1)
SELECT * FROM e WHERE expires_at < date_trunc('millisecond', (SELECT max(created_at) FROM audit_log)) - INTERVAL 10 MINUTE""".replace("\n, e", ", e", 1)))
def stream_session_expiry(spark, sf):
    out = _run(spark, jobs.session_expiry(_stream(spark, sf).select("session_id", "created_at", "exported")), "expiry")
    return out.withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))


@query("stream_attribute_counts", "ST5 A8", with_(v.AUDIT_LOG, """
SELECT session_id AS cv_id, 'events' AS source, 'k' AS source_path, k::VARCHAR AS value, count(*) AS occurrence_count,
  min(created_at) AS first_seen_at, max(created_at) AS last_seen_at FROM audit_log GROUP BY session_id, k"""))
def stream_attribute_counts(spark, sf):
    sightings = _stream(spark, sf).select(
        F.col("session_id").alias("cv_id"), F.lit("events").alias("source"), F.lit("k").alias("source_path"), F.col("k").cast("string").alias("value"),
        F.lit("k").alias("original_label"), F.lit("k").alias("normalized_label"), F.lit("integer").alias("value_type"), F.col("created_at").alias("seen_at"),
    )
    path = fresh_path(spark, "attributes")
    jobs.upsert_attribute_counts(sightings, path, fresh_path(spark, "checkpoint"), available_now=True).awaitTermination()
    return jobs.newest_state(spark, path).drop("original_label", "normalized_label", "value_type")


@query("stream_session_upsert", "ST6 W3", with_(v.AUDIT_LOG, """
SELECT session_id, max(id) AS version, arg_max(status, id) AS status FROM audit_log GROUP BY 1"""))
def stream_session_upsert(spark, sf):
    updates = _stream(spark, sf).select("session_id", F.col("id").alias("version"), "status")
    path = fresh_path(spark, "sessions")
    jobs.upsert_sessions(updates, path, fresh_path(spark, "checkpoint"), available_now=True).awaitTermination()
    return jobs.newest_state(spark, path)
