"""Registered queries: whole tables written by a sink, read back by its reader and compared."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from vitalake.operators import tracing
from vitalake.plans import views as v
from vitalake.plans.q_audit import with_
from vitalake.plans.registry import query
from vitalake.session import fresh_path
from vitalake.sources import readers

STATE = ["session_id", "status", "version", "created_at", "last_updated_at", "exported_at", "expires_at", "canonical_cv", "validation_results"]
LINE = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("version", T.LongType())])
SPAN = "trace_id string, span_id long, parent_span_id long, name string, span_type string, status string, duration_ms double, total_tokens long, model string"


@query("sources_audit_round_trip", "S1 S3", with_(v.AUDIT_LOG, """
SELECT id, session_id, actor_user_id, actor_username, module_name, operation, status, event_message, http_status, payload, created_at FROM audit_log"""))
def sources_audit_round_trip(spark, sf):
    # the message is left to the sink
    path = fresh_path(spark, "audit-log")
    readers.append_audit_events(v.audit_log(spark, sf).drop("event_message"), path)
    return readers.read_audit_log(spark, path).select(
        "id", "session_id", "actor_user_id", "actor_username", "module_name", "operation", "status", "event_message", "http_status", "payload", "created_at")


@query("sources_session_snapshot", "S4 S5 S11", with_(v.SESSIONS, f"SELECT {', '.join(STATE)} FROM sessions"))
def sources_session_snapshot(spark, sf):
    path = fresh_path(spark, "session-snapshot")
    readers.write_sessions_json(v.sessions(spark, sf).select(STATE), path)
    return readers.schema_guard(readers.read_sessions_json(spark, path, one_per_file=False), STATE, key="session_id").select(STATE)


@query("sources_bad_rows", "S4", with_(v.AUDIT_LOG, """
, lines AS (SELECT id, session_id, status, k, '{"session_id":"' || session_id || '","status":"' || status || '","version":' || id || '}' AS line FROM audit_log)
SELECT CASE id % 11 WHEN 0 THEN 'malformed' WHEN 1 THEN 'malformed' WHEN 2 THEN 'missing session_id' ELSE 'ok' END AS reason,
  CASE WHEN id % 11 > 2 THEN session_id END AS session_id, CASE WHEN id % 11 > 2 THEN CASE WHEN id % 11 = 3 THEN 'active' ELSE status END END AS status,
  CASE WHEN id % 11 > 2 THEN id END AS version,
  CASE id % 11 WHEN 0 THEN left(line, length(line) - 3) WHEN 1 THEN '{"session_id":"' || session_id || '","version":"v' || id || '"}'
    WHEN 2 THEN '{"status":"' || status || '","version":' || id || '}' END AS raw FROM lines""".replace("\n, lines", ", lines", 1)))
def sources_bad_rows(spark, sf):
    # of eleven lines one is cut short, one has text for a number, one lacks its key and one its status
    line = F.expr("concat('{\"session_id\":\"', session_id, '\",\"status\":\"', status, '\",\"version\":', id, '}')")
    faulty = v.audit_log(spark, sf).withColumn("line", line).select(F.expr("""
        CASE id % 11 WHEN 0 THEN left(line, length(line) - 3) WHEN 1 THEN concat('{"session_id":"', session_id, '","version":"v', id, '"}')
          WHEN 2 THEN concat('{"status":"', status, '","version":', id, '}') WHEN 3 THEN concat('{"session_id":"', session_id, '","version":', id, '}')
          ELSE line END"""))
    path = fresh_path(spark, "session-lines")
    faulty.write.text(path)
    good, bad = readers.read_json_checked(spark, path, LINE, required=["session_id"], defaults={"status": "active"})
    return good.withColumn("reason", F.lit("ok")).unionByName(bad, allowMissingColumns=True).select("reason", "session_id", "status", "version", "raw")


@query("sources_session_table", "S6", with_(v.SESSIONS, """
SELECT session_id, CASE WHEN version % 4 = 2 THEN 1 ELSE 0 END::BIGINT AS n_history, CASE WHEN version % 4 = 2 THEN 'audio' END AS first_source,
  0::BIGINT AS n_artifacts, CASE WHEN version % 3 = 1 THEN session_id END AS user_id, CASE WHEN version % 2 = 0 THEN '{}' ELSE canonical_cv END AS canonical_cv,
  validation_results, '{}' AS workflow_state, CASE WHEN errors = 0 THEN 'active' ELSE status END AS status,
  CASE WHEN errors = 1 THEN 1 ELSE version END::BIGINT AS version FROM sessions"""))
def sources_session_table(spark, sf):
    raw = v.sessions(spark, sf).selectExpr(
        "session_id", "CASE version % 4 WHEN 1 THEN '' WHEN 2 THEN '[{\"source_type\":\"audio\",\"description\":\"d\"}]' WHEN 3 THEN 'not json' END AS source_history",
        "CASE version % 2 WHEN 1 THEN '' END AS uploaded_artifacts",
        "CASE version % 3 WHEN 1 THEN concat('{\"user_id\":\"', session_id, '\"}') WHEN 2 THEN '{}' END AS metadata",
        "CASE version % 2 WHEN 0 THEN '' ELSE canonical_cv END AS canonical_cv", "validation_results", "CAST(NULL AS STRING) AS workflow_state",
        "CASE WHEN errors > 0 THEN status END AS status", "CASE WHEN errors <> 1 THEN version END AS version",
    )
    return readers.decode_sessions(raw).select(
        "session_id", F.size("source_history").cast("long").alias("n_history"), F.get("source_history", F.lit(0))["source_type"].alias("first_source"),
        F.size("uploaded_artifacts").cast("long").alias("n_artifacts"), "metadata.user_id", "canonical_cv", "validation_results", "workflow_state", "status", "version")


@query("sources_span_export", "S9", with_(v.SPANS, f"SELECT {', '.join(c.split()[0] for c in SPAN.split(', '))} FROM spans"))
def sources_span_export(spark, sf):
    path = fresh_path(spark, "span-export")
    tracing.export_spans(v.spans(spark, sf), path)
    return spark.read.schema(SPAN).json(path)
