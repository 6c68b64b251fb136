"""Registered queries over the audit log, sessions, staging, permissions and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalake.operators import audit, rbac, sessions as ses, staging as stg, tracing
from vitalake.plans import views as v
from vitalake.plans.registry import query
from vitalake.sources import dims


def with_(views: str, body: str) -> str:
    return f"WITH {views}\n{body}"


NOW = "(SELECT max(created_at) FROM audit_log)"
SES_NOW = "(SELECT max(last_updated_at) FROM sessions)"
TIMELINE_SQL = "id, created_at, actor_username, module_name, operation, status, http_status, source_channel, event_message, payload"


@query("audit_events_filtered", "F1", with_(v.AUDIT_LOG, """
SELECT id, session_id, actor_username, module_name, operation, status, http_status, event_message, created_at
FROM audit_log WHERE module_name = 'auth' AND status = 'failed'
  AND created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-25'
ORDER BY created_at DESC, id DESC"""))
def audit_events_filtered(spark, sf):
    return audit.audit_events(
        v.audit_log(spark, sf), limit=None, module_name="auth", operation="", status="failed",
        created_from="2024-01-05 00:00:00", created_to="2024-01-25 00:00:00",
    ).select("id", "session_id", "actor_username", "module_name", "operation", "status", "http_status", "event_message", "created_at")


@query("audit_login_attempts", "F2", with_(v.AUDIT_LOG, """
SELECT id, created_at, actor_username, module_name, operation, status, http_status, event_message
FROM audit_log WHERE module_name = 'auth' AND operation = 'login' ORDER BY created_at DESC, id DESC LIMIT 200"""))
def audit_login_attempts(spark, sf):
    return audit.login_attempts(v.audit_log(spark, sf))


@query("audit_failed_logins", "F3", with_(v.AUDIT_LOG, f"""
SELECT created_at, actor_username, http_status, event_message, payload FROM audit_log
WHERE module_name = 'auth' AND operation = 'login' AND status = 'failed' AND created_at >= {NOW} - INTERVAL 24 HOUR"""))
def audit_failed_logins(spark, sf):
    return audit.failed_logins(v.audit_log(spark, sf))


@query("audit_actor_timeline", "F4", with_(v.AUDIT_LOG, f"""
SELECT actor_user_id, {TIMELINE_SQL} FROM audit_log WHERE actor_username = 'user_7'
ORDER BY created_at DESC, id DESC LIMIT 500"""))
def audit_actor_timeline(spark, sf):
    return audit.actor_timeline(v.audit_log(spark, sf), actor="user_7")


@query("audit_session_timeline", "F5", with_(v.AUDIT_LOG, f"""
SELECT {TIMELINE_SQL} FROM audit_log WHERE session_id = 's_8_20240101' ORDER BY created_at, id"""))
def audit_session_timeline(spark, sf):
    return audit.session_timeline(v.audit_log(spark, sf), session_id="s_8_20240101")


@query("audit_activity_by_user", "A1", with_(v.AUDIT_LOG, f"""
SELECT coalesce(actor_username, 'unknown') AS actor_username, count(*) AS total_events,
  count(*) FILTER (WHERE status = 'success') AS success_count, count(*) FILTER (WHERE status = 'failed') AS failed_count,
  min(created_at) AS first_seen, max(created_at) AS last_seen
FROM audit_log WHERE created_at >= {NOW} - INTERVAL 7 DAY GROUP BY 1"""))
def audit_activity_by_user(spark, sf):
    return audit.activity_by_user(v.audit_log(spark, sf))


@query("audit_module_breakdown", "A2", with_(v.AUDIT_LOG, f"""
SELECT module_name, operation, status, count(*) AS events FROM audit_log
WHERE created_at >= {NOW} - INTERVAL 24 HOUR GROUP BY ALL"""))
def audit_module_breakdown(spark, sf):
    return audit.module_breakdown(v.audit_log(spark, sf))


@query("audit_error_trend", "A3", with_(v.AUDIT_LOG, f"""
SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:00:00') AS hour_bucket, count(*) AS failed_events
FROM audit_log WHERE status = 'failed' AND created_at >= {NOW} - INTERVAL 48 HOUR GROUP BY 1"""))
def audit_error_trend(spark, sf):
    return audit.error_trend(v.audit_log(spark, sf))


@query("audit_top_errors", "A4", with_(v.AUDIT_LOG, f"""
SELECT coalesce(nullif(error_message, ''), 'no_error_message') AS error_message, count(*) AS occurrences
FROM audit_log WHERE status = 'failed' AND created_at >= {NOW} - INTERVAL 7 DAY
GROUP BY 1 ORDER BY occurrences DESC, 1 LIMIT 50"""))
def audit_top_errors(spark, sf):
    return audit.top_errors(v.audit_log(spark, sf))


@query("audit_decoded_payload", "S1 S2", with_(v.AUDIT_LOG, """
SELECT id, CASE WHEN payload IS NULL OR payload = '' THEN '{}'
  WHEN NOT json_valid(payload) THEN json_object('raw', payload)::VARCHAR
  WHEN json_type(payload) = 'OBJECT' THEN replace(json(payload)::VARCHAR, ' ', '')
  ELSE '{"value":' || json(payload)::VARCHAR || '}' END AS payload FROM audit_log"""))
def audit_decoded_payload(spark, sf):
    return v.audit_log(spark, sf).select("id", audit.decode_payload(F.col("payload")).alias("payload"))


@query("audit_event_messages", "S3", with_(v.AUDIT_LOG, """
SELECT event_message, count(*) AS events FROM audit_log GROUP BY 1"""))
def audit_event_messages(spark, sf):
    made = audit.event_message(F.col("module_name"), F.col("operation"), F.col("status"), F.col("error_message"))
    return v.audit_log(spark, sf).groupBy(made.alias("event_message")).agg(F.count(F.lit(1)).alias("events"))


LOGIN_OUTCOME = (
    "CASE WHEN k % 9 = 0 THEN 'inactive' WHEN k % 23 = 5 THEN 'success' ELSE 'bad_credentials' END"
)


@query("audit_login_rate_limit", "W13", with_(v.AUDIT_LOG, f"""
, att AS (SELECT id, created_at, 'ip' || (actor_user_id % 2) || ':user' AS key, epoch(created_at) // 600 AS sec_slow,
    TIMESTAMP '2024-01-01' + to_seconds(CAST(floor(epoch(created_at) - epoch(TIMESTAMP '2024-01-01')) AS BIGINT) // 90) AS tm,
    {LOGIN_OUTCOME} AS outcome FROM audit_log),
e AS (SELECT *, coalesce(sum(CASE WHEN outcome = 'success' THEN 1 ELSE 0 END) OVER (
    PARTITION BY key ORDER BY tm, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch_no FROM att)
SELECT a.id, count(b.id) AS recent_failures, count(b.id) >= 10 AS rate_limited
FROM e a LEFT JOIN e b ON a.key = b.key AND a.epoch_no = b.epoch_no AND b.outcome = 'bad_credentials'
  AND b.tm >= a.tm - INTERVAL 60 SECOND AND (b.tm < a.tm OR (b.tm = a.tm AND b.id < a.id))
GROUP BY a.id""".replace("\n, att", ", att", 1)))
def audit_login_rate_limit(spark, sf):
    # a month of events is squeezed into hours so that the one-minute window fills up
    attempts = v.audit_log(spark, sf).select(
        "id", F.expr("concat('ip', actor_user_id % 2, ':user')").alias("key"),
        F.expr(
            "timestampadd(SECOND, timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', created_at) div 90, "
            "TIMESTAMP_NTZ'2024-01-01 00:00:00')"
        ).alias("at"),
        F.expr(LOGIN_OUTCOME).alias("outcome"),
    )
    return audit.login_rate_limit(attempts, ts="at").select("id", "recent_failures", "rate_limited")


# sessions


@query("sessions_active", "F6", with_(v.SESSIONS, f"""
SELECT session_id, status, version, created_at, last_updated_at FROM sessions WHERE expires_at > {SES_NOW}"""))
def sessions_active(spark, sf):
    return ses.active_sessions(v.sessions(spark, sf))


@query("sessions_expiring", "F7", with_(v.SESSIONS, f"""
SELECT session_id, status, date_diff('microsecond', {SES_NOW}, expires_at) / 1e6 AS seconds_remaining FROM sessions
WHERE expires_at > {SES_NOW} AND expires_at < {SES_NOW} + INTERVAL 1 DAY"""))
def sessions_expiring(spark, sf):
    return ses.sessions_expiring(v.sessions(spark, sf))


@query("sessions_expired", "F8", with_(v.SESSIONS, f"""
SELECT session_id, status, expires_at FROM sessions WHERE expires_at <= {SES_NOW} AND status <> 'deleted'"""))
def sessions_expired(spark, sf):
    return ses.expired_sessions(v.sessions(spark, sf)).select("session_id", "status", "expires_at")


@query("sessions_expired_count", "A5", with_(v.SESSIONS, f"""
SELECT count(*) AS expired FROM sessions WHERE expires_at <= {SES_NOW} AND status <> 'deleted'"""))
def sessions_expired_count(spark, sf):
    return ses.expired_count(v.sessions(spark, sf))


@query("sessions_should_cleanup", "F9", with_(v.SESSIONS, f"""
SELECT session_id, status = 'deleted' OR expires_at <= {SES_NOW} AS cleanup FROM sessions"""))
def sessions_should_cleanup(spark, sf):
    df = v.sessions(spark, sf)
    now = audit.as_of_column(df, "last_updated_at", None)
    return df.select("session_id", ses.should_cleanup(F.col("status"), F.col("expires_at"), now).alias("cleanup"))


@query("sessions_after_cleanup", "M24", with_(v.SESSIONS, f"""
SELECT session_id, status FROM sessions WHERE NOT (status = 'deleted' OR expires_at <= {SES_NOW})"""))
def sessions_after_cleanup(spark, sf):
    return ses.cleanup_expired(v.sessions(spark, sf))[0].select("session_id", "status")


@query("sessions_size_report", "F10", with_(v.SESSIONS, """
SELECT session_id, round(octet_length(canonical_cv::BLOB) / 1024, 2) AS canonical_cv_kb,
  round(octet_length(validation_results::BLOB) / 1024, 2) AS validation_kb, version FROM sessions"""))
def sessions_size_report(spark, sf):
    return ses.session_size_report(v.sessions(spark, sf))


@query("sessions_event_paths", "F11", with_(v.AUDIT_LOG, """
, t AS (SELECT session_id, operation, min(created_at) AS event_at FROM audit_log GROUP BY ALL)
SELECT session_id, string_agg(operation, ',' ORDER BY event_at, operation) AS event_types,
  string_agg(strftime(event_at, '%Y-%m-%d %H:%M:%S'), ',' ORDER BY event_at, operation) AS timestamps
FROM t GROUP BY 1""".replace("\n, t", ", t", 1)))
def sessions_event_paths(spark, sf):
    out = ses.session_event_paths(v.session_sources(spark, sf))
    return out.select(
        "session_id", F.array_join("event_types", ",").alias("event_types"),
        F.array_join(F.transform("timestamps", lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")), ",").alias("timestamps"),
    )


@query("sessions_integrity", "F20", with_(v.SESSIONS, """
, odd AS (SELECT session_id, CASE WHEN user_id % 13 = 0 THEN 0 ELSE version END AS version,
    CASE WHEN user_id % 11 = 0 THEN 'paused' ELSE status END AS status, created_at,
    CASE WHEN user_id % 7 = 0 THEN created_at - INTERVAL 1 HOUR ELSE last_updated_at END AS last_updated_at,
    CASE WHEN user_id % 19 <> 0 THEN expires_at END AS expires_at FROM sessions)
SELECT session_id, concat_ws(';', CASE WHEN expires_at IS NULL THEN 'missing expires_at' END,
  CASE WHEN version < 1 THEN 'version below one' END,
  CASE WHEN status NOT IN ('active', 'exported', 'deleted') THEN 'status is not allowed' END,
  CASE WHEN last_updated_at < created_at THEN 'last_updated_at before created_at' END) AS violations
FROM odd WHERE violations <> ''""".replace("\n, odd", ", odd", 1)))
def sessions_integrity(spark, sf):
    odd = v.sessions(spark, sf).withColumns(
        {
            "version": F.expr("CASE WHEN user_id % 13 = 0 THEN 0 ELSE version END"),
            "status": F.expr("CASE WHEN user_id % 11 = 0 THEN 'paused' ELSE status END"),
            "last_updated_at": F.expr("CASE WHEN user_id % 7 = 0 THEN created_at - INTERVAL '1' HOUR ELSE last_updated_at END"),
            "expires_at": F.expr("CASE WHEN user_id % 19 <> 0 THEN expires_at END"),
        }
    )
    return ses.integrity_check(odd).select("session_id", F.array_join("violations", ";").alias("violations"))


@query("sessions_latest_version", "W3", with_(v.SESSION_LOG, """
SELECT session_id, version, id, operation, status, created_at FROM session_log
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY version DESC) = 1"""))
def sessions_latest_version(spark, sf):
    return ses.latest_session_version(
        v.session_log(spark, sf).select("session_id", "version", "id", "operation", "status", "created_at")
    )


LOCK_EXPECTED = "CASE WHEN k % 10 < 7 THEN version ELSE version - 1 END"


@query("sessions_optimistic_lock", "W4", with_(v.SESSION_LOG, f""".
upd AS (SELECT session_id, id AS seq, {LOCK_EXPECTED} AS expected, version,
    row_number() OVER (PARTITION BY session_id ORDER BY id) AS rn FROM session_log),
fold AS (
  SELECT session_id, rn, seq, expected, CASE WHEN expected = 1 THEN 2 ELSE 1 END AS now, expected = 1 AS hit
  FROM upd WHERE rn = 1
  UNION ALL
  SELECT u.session_id, u.rn, u.seq, u.expected, CASE WHEN u.expected = f.now THEN f.now + 1 ELSE f.now END, u.expected = f.now
  FROM fold f JOIN upd u ON u.session_id = f.session_id AND u.rn = f.rn + 1)
SELECT session_id, seq, expected AS expected_version,
  CASE WHEN CAST(split_part(session_id, '_', 2) AS INT) % 15 = 0 THEN 'not_found' WHEN hit THEN 'accepted' ELSE 'conflict' END AS outcome
FROM fold""".replace(".\nupd", ",\nupd", 1)).replace("WITH ", "WITH RECURSIVE ", 1))
def sessions_optimistic_lock(spark, sf):
    log = v.session_log(spark, sf)
    updates = log.selectExpr("session_id", "id AS seq", f"{LOCK_EXPECTED} AS expected_version")
    state = (
        v.sessions(spark, sf).where("user_id % 15 <> 0").select("session_id", F.lit(1).cast("long").alias("version"))
    )
    return ses.optimistic_lock_check(state, updates).drop("new_version")


@query("sessions_version_history", "W17", with_(v.AUDIT_LOG, """
SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS version_number FROM audit_log"""))
def sessions_version_history(spark, sf):
    log = v.audit_log(spark, sf)
    return ses.session_version_history(log, bucket=F.date_trunc("hour", "created_at")).select(
        "session_id", "id", "version_number"
    )


REVIEW_SQL = v.AUDIT_LOG + """,
reviews AS (
  SELECT id, session_id, created_at AS event_at, CASE operation WHEN 'view' THEN 'in_review' WHEN 'purchase' THEN 'approved'
    WHEN 'error' THEN 'changes_requested' WHEN 'login' THEN 'pending' ELSE 'draft' END AS status,
    actor_username AS reviewer, event_message AS comment FROM audit_log),
known AS (SELECT * FROM reviews WHERE status <> 'draft')"""


def _reviews(spark, sf):
    return v.audit_log(spark, sf).selectExpr(
        "id", "session_id", "created_at AS event_at",
        "CASE operation WHEN 'view' THEN 'in_review' WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'changes_requested' "
        "WHEN 'login' THEN 'pending' ELSE 'draft' END AS status",
        "actor_username AS reviewer", "event_message AS comment",
    )


@query("review_transitions", "W18", with_(REVIEW_SQL, """
, step AS (SELECT coalesce(lag(status) OVER (PARTITION BY session_id ORDER BY event_at, id), 'pending') AS from_status,
  status AS to_status FROM known)
SELECT from_status, to_status, count(*) AS transitions FROM step GROUP BY ALL""".replace("\n, step", ", step", 1)))
def review_transitions(spark, sf):
    steps = ses.review_status_transitions(_reviews(spark, sf), bucket=F.date_trunc("hour", "event_at"))
    return steps.groupBy("from_status", "to_status").agg(F.count(F.lit(1)).alias("transitions"))


@query("review_latest", "W18", with_(REVIEW_SQL, """
SELECT session_id, status, reviewer, comment FROM known
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY event_at DESC, id DESC) = 1"""))
def review_latest(spark, sf):
    return ses.latest_review(_reviews(spark, sf))


@query("sessions_export_completed", "M23", with_(v.SESSIONS, f"""
SELECT session_id, 'exported' AS status, {SES_NOW} AS exported_at, {SES_NOW} + INTERVAL 6 HOUR AS expires_at,
  version + 1 AS version, 'export_pdf' AS event_type FROM sessions WHERE status = 'active'"""))
def sessions_export_completed(spark, sf):
    df = v.sessions(spark, sf)
    now = audit.as_of_column(df, "last_updated_at", None)
    done = ses.export_completed(df.where("status = 'active'"), now=now, export_format="PDF")
    return done.select("session_id", "status", "exported_at", "expires_at", "version", "event_type")


# staging


@query("staging_errors", "F12", with_(v.EXTRACTIONS, """
SELECT extraction_id, session_id, extraction_status, created_at FROM extractions
WHERE len(extraction_errors) > 0 ORDER BY created_at DESC, extraction_id LIMIT 10"""))
def staging_errors(spark, sf):
    return stg.extractions_with_errors(v.extractions(spark, sf)).select(
        "extraction_id", "session_id", "extraction_status", "created_at"
    )


@query("staging_audit_trail", "F13", with_(v.EXTRACTIONS, """
SELECT extraction_id, extraction_status, created_at, extracted_at, previewed_at, exported_at
FROM extractions WHERE session_id = 'sess_4'"""))
def staging_audit_trail(spark, sf):
    return stg.stage_audit_trail(v.extractions(spark, sf), session_id="sess_4")


@query("staging_latest_complete", "W1", with_(v.EXTRACTIONS, """
SELECT session_id, extraction_id, extracted_at FROM extractions WHERE extraction_status = 'complete'
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY extracted_at DESC, extraction_id DESC) = 1"""))
def staging_latest_complete(spark, sf):
    return stg.latest_complete_extraction(
        v.extractions(spark, sf).select("session_id", "extraction_id", "extraction_status", "extracted_at")
    ).select("session_id", "extraction_id", "extracted_at")


@query("staging_history", "W2", with_(v.EXTRACTIONS, """
SELECT session_id, extraction_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, extraction_id DESC)::BIGINT AS recency
FROM extractions QUALIFY recency <= 3"""))
def staging_history(spark, sf):
    cols = v.extractions(spark, sf).select("session_id", "extraction_id", "created_at")
    return stg.extraction_history(cols, k=3).select("session_id", "extraction_id", F.col("recency").cast("long"))


@query("staging_flat_confidence", "M21", with_(v.EXTRACTIONS, """
SELECT extraction_id, field_path, 'unknown' AS extraction_method, confidence_score, 'unknown' AS validation_status FROM field_conf"""))
def staging_flat_confidence(spark, sf):
    return stg.flatten_confidence(v.extractions(spark, sf))


@query("staging_confidence_report", "J16", with_(v.EXTRACTIONS, """
SELECT c.extraction_id, field_path, confidence_score, session_id, source_type
FROM field_conf c JOIN extractions e ON e.extraction_id = c.extraction_id"""))
def staging_confidence_report(spark, sf):
    staged = v.extractions(spark, sf)
    report = stg.confidence_report(staged, stg.flatten_confidence(staged))
    return report.select("extraction_id", "field_path", "confidence_score", "session_id", "source_type")


@query("staging_low_confidence", "F19 X30", with_(v.EXTRACTIONS, """
SELECT extraction_id, field_path, confidence_score, CASE WHEN confidence_score >= 0.8 THEN 'high'
  WHEN confidence_score >= 0.5 THEN 'medium' ELSE 'low' END AS bucket FROM field_conf WHERE confidence_score < 0.7"""))
def staging_low_confidence(spark, sf):
    return stg.low_confidence_fields(stg.flatten_confidence(v.extractions(spark, sf))).select(
        "extraction_id", "field_path", "confidence_score", "bucket"
    )


@query("staging_overall_confidence", "A16 X30", with_(v.EXTRACTIONS, """
SELECT extraction_id, round(avg(confidence_score), 6) AS overall,
  CASE WHEN overall >= 0.95 THEN 'VERIFIED' WHEN overall >= 0.8 THEN 'HIGH' WHEN overall >= 0.6 THEN 'MEDIUM'
    WHEN overall >= 0.4 THEN 'LOW' ELSE 'UNCERTAIN' END AS level
FROM field_conf GROUP BY 1"""))
def staging_overall_confidence(spark, sf):
    return stg.overall_confidence(stg.flatten_confidence(v.extractions(spark, sf)))


@query("staging_extraction_summary", "A14 X30", with_(v.EXTRACTIONS, """
SELECT count(*) AS total_fields, count(*) FILTER (confidence_score > 0.7) AS high_confidence,
  count(*) FILTER (confidence_score <= 0.7) AS needs_verification, round(avg(confidence_score), 3) AS avg_confidence,
  count(*) FILTER (confidence_score > 0.9) AS level_very_high,
  count(*) FILTER (confidence_score > 0.7 AND confidence_score <= 0.9) AS level_high,
  count(*) FILTER (confidence_score > 0.5 AND confidence_score <= 0.7) AS level_medium,
  count(*) FILTER (confidence_score > 0.3 AND confidence_score <= 0.5) AS level_low,
  count(*) FILTER (confidence_score <= 0.3) AS level_very_low FROM field_conf"""))
def staging_extraction_summary(spark, sf):
    return stg.extraction_summary(stg.flatten_confidence(v.extractions(spark, sf)))


@query("staging_lifecycle", "M20", with_(v.EXTRACTIONS, """
, ev AS (
  SELECT extraction_id, 1 AS event_id, 'pending' AS stage, created_at AS event_at FROM extractions
  UNION ALL SELECT extraction_id, 2, 'complete', extracted_at FROM extractions WHERE extracted_at IS NOT NULL
  UNION ALL SELECT extraction_id, 3, 'previewed', previewed_at FROM extractions WHERE previewed_at IS NOT NULL
  UNION ALL SELECT extraction_id, 4, 'exported', exported_at FROM extractions WHERE exported_at IS NOT NULL)
SELECT extraction_id, arg_max(stage, event_id) AS extraction_status, min(event_at) AS created_at, max(event_at) AS updated_at,
  max(CASE WHEN stage = 'complete' THEN event_at END) AS extracted_at,
  max(CASE WHEN stage = 'previewed' THEN event_at END) AS previewed_at,
  max(CASE WHEN stage = 'exported' THEN event_at END) AS exported_at FROM ev GROUP BY 1""".replace("\n, ev", ", ev", 1)))
def staging_lifecycle(spark, sf):
    staged = v.extractions(spark, sf)
    events = staged.select("extraction_id", F.explode(F.array(
        F.struct(F.lit(1).alias("event_id"), F.lit("pending").alias("stage"), F.col("created_at").alias("event_at")),
        F.struct(F.lit(2).alias("event_id"), F.lit("complete").alias("stage"), F.col("extracted_at").alias("event_at")),
        F.struct(F.lit(3).alias("event_id"), F.lit("previewed").alias("stage"), F.col("previewed_at").alias("event_at")),
        F.struct(F.lit(4).alias("event_id"), F.lit("exported").alias("stage"), F.col("exported_at").alias("event_at")),
    )).alias("e")).select("extraction_id", "e.*").where("event_at IS NOT NULL")
    return stg.fold_stage_events(events).drop("cleared_at")


# permissions: customers are users, their market segment is the role


def _rbac(spark, sf):
    cust, sup = v.load(spark, sf, "customer"), v.load(spark, sf, "supplier")
    roles = v.load(spark, sf, "nation").selectExpr("n_nationkey AS id", "n_name AS role_name")
    resources = v.load(spark, sf, "region").selectExpr("r_regionkey AS id", "r_name AS resource_name")
    permissions = v.load(spark, sf, "part").selectExpr(
        "p_partkey AS id", "concat(p_name, ' ', p_partkey) AS permission_name", "p_partkey % 5 AS resource_id", "p_type AS action_name"
    )
    grants = cust.selectExpr("c_nationkey AS role_id", "c_custkey AS permission_id")
    return roles, resources, permissions, grants, sup


RBAC_SQL = """roles AS (SELECT n_nationkey AS id, n_name AS role_name FROM nation),
resources AS (SELECT r_regionkey AS id, r_name AS resource_name FROM region),
permissions AS (SELECT p_partkey AS id, p_name || ' ' || p_partkey AS permission_name, p_partkey % 5 AS resource_id, p_type AS action_name FROM part),
role_permissions AS (SELECT c_nationkey AS role_id, c_custkey AS permission_id FROM customer)"""


@query("rbac_role_permission_listing", "J1", with_(RBAC_SQL, """
SELECT role_name, resource_name, permission_name, action_name FROM role_permissions rp JOIN roles r ON r.id = rp.role_id
JOIN permissions p ON p.id = rp.permission_id JOIN resources s ON s.id = p.resource_id"""))
def rbac_role_permission_listing(spark, sf):
    roles, resources, permissions, grants, _ = _rbac(spark, sf)
    return rbac.role_permission_listing(grants, roles, permissions, resources)


@query("rbac_grants", "J2", with_(RBAC_SQL, """
, wanted AS (SELECT n_name AS role_name, p_name || ' ' || p_partkey AS permission_name
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
SELECT DISTINCT r.id AS role_id, p.id AS permission_id FROM wanted w JOIN roles r USING (role_name) JOIN permissions p USING (permission_name)
WHERE NOT EXISTS (SELECT 1 FROM role_permissions x WHERE x.role_id = r.id AND x.permission_id = p.id)""".replace("\n, wanted", ", wanted", 1)))
def rbac_grants(spark, sf):
    roles, _, permissions, grants, suppliers = _rbac(spark, sf)
    wanted = (
        v.load(spark, sf, "lineitem").join(permissions, F.col("l_partkey") == F.col("id"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(roles.withColumnRenamed("id", "role_key"), F.col("s_nationkey") == F.col("role_key"))
        .select("role_name", "permission_name")
    )
    return rbac.grant_role_permissions(wanted, roles, permissions, grants)


ROLE_OF_SEGMENT = (
    "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'admin' WHEN 'MACHINERY' THEN 'reviewer' "
    "WHEN 'FURNITURE' THEN 'cv_editor' WHEN 'BUILDING' THEN 'guest' ELSE 'user' END"
)


@query("rbac_permissions_for_user", "J3", f"""
SELECT c_custkey AS user_id, {ROLE_OF_SEGMENT} AS role, CASE {ROLE_OF_SEGMENT}
  WHEN 'admin' THEN 'approve_cv,create_cv,edit_cv,export_cv,manage_templates,review_cv'
  WHEN 'reviewer' THEN 'export_cv,review_cv' WHEN 'guest' THEN '' ELSE 'create_cv,edit_cv,export_cv' END AS permissions
FROM customer""")
def rbac_permissions_for_user(spark, sf):
    users = v.load(spark, sf, "customer").selectExpr("c_custkey AS user_id", f"{ROLE_OF_SEGMENT} AS role")
    out = rbac.permissions_for_user(users, dims.role_permissions(spark))
    return out.withColumn("permissions", F.array_join("permissions", ","))


@query("rbac_table_counts", "A6", """
SELECT 'customer' AS table_name, count(*) AS row_count FROM customer UNION ALL
SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders""")
def rbac_table_counts(spark, sf):
    return rbac.table_counts(**{t: v.load(spark, sf, t) for t in ("customer", "lineitem", "orders")})


# spans

PRICE_SQL = """, priced AS (SELECT *, CASE conv_model WHEN 0 THEN 0.005 WHEN 1 THEN 0.01 WHEN 2 THEN 0.03 WHEN 3 THEN 0.01 ELSE 0.0005 END AS p_in,
    CASE conv_model WHEN 0 THEN 0.015 WHEN 1 THEN 0.03 WHEN 2 THEN 0.06 WHEN 3 THEN 0.03 ELSE 0.0015 END AS p_out
  FROM (SELECT *, (span_id // 1000000) % 5 AS conv_model FROM spans)),
costed AS (SELECT *, round(floor(total_tokens * 0.9::DOUBLE) / 1000 * p_in::DOUBLE
    + (total_tokens - floor(total_tokens * 0.9::DOUBLE)) / 1000 * p_out::DOUBLE, 6) AS cost FROM priced)"""


def _costed(spark, sf):
    zero = F.lit(0).cast("long")
    return v.spans(spark, sf).withColumn("cost", tracing.token_cost(F.col("model"), zero, zero, F.col("total_tokens")))


@query("spans_cost", "J18 X21", with_(v.SPANS + PRICE_SQL, "SELECT span_id, model, cost FROM costed"))
def spans_cost(spark, sf):
    return _costed(spark, sf).select("span_id", "model", "cost")


@query("spans_metrics", "A18", with_(v.SPANS, """
SELECT count(*) AS total_spans, count(duration_ms) AS completed_spans, count(*) FILTER (status = 'error') AS error_spans,
  round(error_spans / total_spans, 6) AS error_rate, round(avg(nullif(duration_ms, 0)), 6) AS avg_duration,
  min(nullif(duration_ms, 0)) AS min_duration, max(nullif(duration_ms, 0)) AS max_duration, sum(nullif(duration_ms, 0)) AS total_duration
FROM spans"""))
def spans_metrics(spark, sf):
    return tracing.span_metrics(v.spans(spark, sf))


@query("spans_metrics_by_operation", "A19", with_(v.SPANS, """
SELECT name, count(*) AS span_count, count(*) FILTER (status = 'error') AS errors,
  round(avg(nullif(duration_ms, 0)), 6) AS avg_duration FROM spans GROUP BY 1"""))
def spans_metrics_by_operation(spark, sf):
    return tracing.span_metrics_by_operation(v.spans(spark, sf))


@query("spans_trace_summary", "A20", with_(v.SPANS + PRICE_SQL, """
SELECT trace_id, coalesce(sum(duration_ms), 0.0::DOUBLE) AS duration_ms, count(*) AS span_count, sum(total_tokens)::BIGINT AS total_tokens,
  round(sum(cost), 6) AS total_cost, count(*) FILTER (status = 'error') AS error_count FROM costed GROUP BY 1"""))
def spans_trace_summary(spark, sf):
    return tracing.trace_summary(_costed(spark, sf))


@query("spans_trace_session_summary", "A21", with_(v.SPANS, """
SELECT trace_id, count(*) AS total_spans, count(*) FILTER (span_type = 'llm') AS model_calls, sum(total_tokens)::BIGINT AS total_tokens,
  count(*) FILTER (status = 'error') AS error_count, round(coalesce(sum(duration_ms), 0) / count(*), 6) AS average_duration_ms
FROM spans GROUP BY 1"""))
def spans_trace_session_summary(spark, sf):
    return tracing.trace_session_summary(v.spans(spark, sf))


@query("spans_tree", "J17", with_(v.SPANS, """
, tree AS (
  SELECT span_id, span_id AS root_span_id, 0::BIGINT AS depth FROM spans WHERE parent_span_id IS NULL
  UNION ALL SELECT s.span_id, t.root_span_id, t.depth + 1 FROM spans s JOIN tree t ON s.parent_span_id = t.span_id)
SELECT * FROM tree""".replace("\n, tree", ", tree", 1)).replace("WITH ", "WITH RECURSIVE ", 1))
def spans_tree(spark, sf):
    return tracing.span_tree(v.spans(spark, sf))
