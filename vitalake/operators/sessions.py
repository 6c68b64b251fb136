"""Session lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vitalake.functions.windows import number_rows, previous_row
from vitalake.operators.audit import as_of_column
from vitalake.session import stored

# Fixed values.
SESSION_STATUSES = ["active", "exported", "deleted"]
REVIEW_STATUSES = ["pending", "in_review", "approved", "changes_requested"]
TTL_HOURS = 24
EXPORT_TTL_HOURS = 6


def active_sessions(df: DataFrame, *, as_of=None) -> DataFrame:
    """sessions that have not expired, most recently updated first."""
    now = as_of_column(df, "last_updated_at", as_of)
    return (
        df.where(F.col("expires_at") > now)
        .select("session_id", "status", "version", "created_at", "last_updated_at")
        .orderBy(F.desc("last_updated_at"), "session_id")
    )


def sessions_expiring(df: DataFrame, *, as_of=None, days: int = 1) -> DataFrame:
    """sessions that expire within the coming day, with the seconds left."""
    now = as_of_column(df, "last_updated_at", as_of)
    left = F.timestamp_diff("MICROSECOND", now, F.col("expires_at")) / 1e6
    return (
        df.where((F.col("expires_at") > now) & (F.col("expires_at") < now + F.expr(f"INTERVAL {days} DAYS")))
        .select("session_id", "status", left.alias("seconds_remaining"))
        .orderBy("seconds_remaining", "session_id")
    )


def expired_sessions(df: DataFrame, *, as_of=None) -> DataFrame:
    """F8: expired sessions that are not yet deleted."""
    now = as_of_column(df, "last_updated_at", as_of)
    return df.where((F.col("expires_at") <= now) & (F.col("status") != "deleted"))


def expired_count(df: DataFrame, *, as_of=None) -> DataFrame:
    """A5: number of expired sessions."""
    return expired_sessions(df, as_of=as_of).agg(F.count(F.lit(1)).alias("expired"))


def should_cleanup(status: Column, expires_at: Column, now: Column) -> Column:
    """deleted sessions always, all others once expired."""
    return F.when(status == "deleted", True).otherwise(expires_at <= now)


def cleanup_expired(df: DataFrame, *, as_of=None) -> tuple[DataFrame, DataFrame]:
    """(rows kept, one-row count of rows removed)."""
    now = as_of_column(df, "last_updated_at", as_of)
    drop = should_cleanup(F.col("status"), F.col("expires_at"), now)
    return df.where(~drop), df.agg(F.count(F.when(drop, 1)).alias("removed"))


def session_size_report(df: DataFrame) -> DataFrame:
    """kilobytes of the two JSON columns."""
    return df.select(
        "session_id",
        F.round(F.octet_length("canonical_cv") / 1024, 2).alias("canonical_cv_kb"),
        F.round(F.octet_length("validation_results") / 1024, 2).alias("validation_kb"),
        "version",
    )


def session_event_paths(df: DataFrame) -> DataFrame:
    """source types and times out of the nested history."""
    return df.select(
        "session_id",
        F.transform("source_history", lambda e: e["source_type"]).alias("event_types"),
        F.transform("source_history", lambda e: e["event_at"]).alias("timestamps"),
    )


def integrity_check(df: DataFrame) -> DataFrame:
    """list of violated rules per session, only sessions with any."""
    required = [
        "session_id", "canonical_cv", "validation_results", "status", "created_at", "last_updated_at",
        "expires_at", "version",
    ]
    rules = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]
    rules += [
        F.when(F.trim("session_id") == "", F.lit("blank session id")),
        F.when(F.col("version") < 1, F.lit("version below one")),
        F.when(~F.lower("status").isin(SESSION_STATUSES), F.lit("status is not allowed")),
        F.when(F.col("last_updated_at") < F.col("created_at"), F.lit("last_updated_at before created_at")),
    ]
    return df.select("session_id", F.array_compact(F.array(*rules)).alias("violations")).where(F.size("violations") > 0)


def latest_session_version(log: DataFrame) -> DataFrame:
    """Last write per session, as a map-side combined ``max_by``."""
    rest = [c for c in log.columns if c not in ("session_id", "version")]
    return (
        log.groupBy("session_id")
        .agg(F.max("version").alias("version"), F.max_by(F.struct(*rest), "version").alias("row"))
        .select("session_id", "version", "row.*")
    )


def optimistic_lock_check(state: DataFrame, updates: DataFrame) -> DataFrame:
    """Outcome of versioned updates applied in ``seq`` order.

    ``state`` is (session_id, version), ``updates`` (session_id, seq, expected_version). An update is accepted when its
    expected version is the stored one at its turn and then raises it by one. So whatever is accepted next after an
    update is the first later one that names the version it leaves: one window finds this successor for all updates.
    The accepted ones are those reached from a session's first match. Each round doubles both how far is reached and
    how far the pointers jump, so a chain of n accepted updates takes about log2(n) rounds.
    """
    updates = stored(updates, "lock-updates")
    targets = updates.select("session_id", F.col("expected_version").alias("_v"), "seq", F.lit(True).alias("_target"))
    sources = updates.select("session_id", (F.col("expected_version") + 1).alias("_v"), "seq", F.lit(False).alias("_target"))
    later = W.partitionBy("session_id", "_v").orderBy(F.desc("seq"), "_target").rowsBetween(W.unboundedPreceding, -1)
    successor = F.last(F.when(F.col("_target"), F.col("seq")), ignorenulls=True).over(later)
    jumps = stored(
        targets.unionByName(sources).withColumn("_next", successor).where(~F.col("_target") & F.col("_next").isNotNull()).select("session_id", "seq", "_next"), "lock-jumps"
    )
    reached = stored(
        updates.join(state.select("session_id", F.col("version").alias("expected_version")), ["session_id", "expected_version"])
        .groupBy("session_id").agg(F.min("seq").alias("seq")), "lock-reached"
    )
    while True:
        step = stored(reached.join(jumps, ["session_id", "seq"]).select("session_id", F.col("_next").alias("seq")), "lock-reached")
        if step.isEmpty():
            break
        reached = reached.unionByName(step)
        after = jumps.select("session_id", F.col("seq").alias("_next"), F.col("_next").alias("_after"))
        jumps = stored(jumps.join(after, ["session_id", "_next"]).select("session_id", "seq", F.col("_after").alias("_next")), "lock-jumps")
    out = updates.join(state.select("session_id", F.col("version").alias("_stored")), "session_id", "left")
    return out.join(reached.withColumn("_hit", F.lit(True)), ["session_id", "seq"], "left").withColumns({
        "new_version": F.when(F.col("_hit"), F.col("expected_version") + 1),
        "outcome": F.when(F.col("_stored").isNull(), "not_found").when(F.col("_hit"), "accepted").otherwise("conflict"),
    }).drop("_stored", "_hit")


def session_version_history(events: DataFrame, *, bucket: Column) -> DataFrame:
    """Numbered snapshots per session; ``bucket`` is a coarse form of the order column."""
    return number_rows(events, ["session_id"], ["created_at", "id"], bucket, "version_number")


def review_status_transitions(events: DataFrame, *, bucket: Column) -> DataFrame:
    """Each review event with the status before it; the first starts from ``pending``."""
    known = events.where(F.col("status").isin(REVIEW_STATUSES))
    out = previous_row(known, ["session_id"], ["event_at", "id"], bucket, F.col("status"), "_before")
    return out.withColumn("from_status", F.coalesce("_before", F.lit("pending"))).drop("_before").withColumnRenamed(
        "status", "to_status"
    )


def latest_review(events: DataFrame) -> DataFrame:
    """Latest status, reviewer and comment per session."""
    order = F.struct("event_at", "id")
    return events.where(F.col("status").isin(REVIEW_STATUSES)).groupBy("session_id").agg(
        F.max_by("status", order).alias("status"),
        F.max_by("reviewer", order).alias("reviewer"),
        F.max_by("comment", order).alias("comment"),
    )


def export_completed(df: DataFrame, *, now: Column, export_format: str) -> DataFrame:
    """Mark sessions exported; they expire six hours later."""
    event = {"docx": "export_docx", "pdf": "export_pdf"}.get(export_format.lower(), "export")
    return df.withColumns(
        {
            "status": F.lit("exported"),
            "exported_at": now,
            "last_updated_at": now,
            "expires_at": now + F.expr(f"INTERVAL {EXPORT_TTL_HOURS} HOURS"),
            "version": F.col("version") + 1,
            "event_type": F.lit(event),
        }
    )


def renew(df: DataFrame, *, now: Column) -> DataFrame:
    """M22 (table part): a written session gets a new version and a new time to live."""
    return df.withColumns(
        {
            "last_updated_at": now,
            "expires_at": now + F.expr(f"INTERVAL {TTL_HOURS} HOURS"),
            "version": F.col("version") + 1,
        }
    )
