"""Audit log analytics (F1-F5, A1-A4, W13) and event preparation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def as_of_column(df: DataFrame, column: str, as_of: dt.datetime | str | None) -> Column:
    """The given instant, or the newest value of ``column`` as a scalar subquery (never the clock)."""
    if as_of is None:
        return df.agg(F.max(column)).scalar()
    return F.lit(as_of).cast("timestamp_ntz")


def audit_events(
    df: DataFrame,
    *,
    limit: int | None = 100,
    module_name: str | None = None,
    operation: str | None = None,
    status: str | None = None,
    session_id: str | None = None,
    actor_username: str | None = None,
    created_from: dt.datetime | str | None = None,
    created_to: dt.datetime | str | None = None,
) -> DataFrame:
    """filtered listing, newest first; empty filters are ignored, ``limit=None`` lists all, a limit below 1 counts as 1."""
    equal = {
        "module_name": module_name, "operation": operation, "status": status,
        "session_id": session_id, "actor_username": actor_username,
    }
    for name, value in equal.items():
        if value:
            df = df.where(F.col(name) == value)
    if created_from is not None:
        df = df.where(F.col("created_at") >= utc_instant(created_from))
    if created_to is not None:
        df = df.where(F.col("created_at") <= utc_instant(created_to))
    listed = df.orderBy(F.desc("created_at"), F.desc("id"))
    return listed if limit is None else listed.limit(max(1, limit))


def utc_instant(value: dt.datetime | str) -> Column:
    """Aware instants become naive UTC; naive ones are taken as UTC."""
    if isinstance(value, dt.datetime) and value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return F.lit(value).cast("timestamp_ntz")


def _logins(df: DataFrame) -> DataFrame:
    return df.where((F.col("module_name") == "auth") & (F.col("operation") == "login"))


def login_attempts(df: DataFrame, *, k: int = 200) -> DataFrame:
    """newest login attempts."""
    columns = ["id", "created_at", "actor_username", "module_name", "operation", "status", "http_status", "event_message"]
    return _logins(df).select(*columns).orderBy(F.desc("created_at"), F.desc("id")).limit(k)


def failed_logins(df: DataFrame, *, as_of=None, hours: int = 24) -> DataFrame:
    """failed logins of the trailing day."""
    since = as_of_column(df, "created_at", as_of) - F.expr(f"INTERVAL {hours} HOURS")
    return (
        _logins(df)
        .where((F.col("status") == "failed") & (F.col("created_at") >= since))
        .select("created_at", "actor_username", "http_status", "event_message", "payload")
        .orderBy(F.desc("created_at"))
    )


TIMELINE = [
    "id", "created_at", "actor_username", "module_name", "operation", "status", "http_status",
    "source_channel", "event_message", "payload",
]


def actor_timeline(df: DataFrame, *, actor: str, k: int = 500) -> DataFrame:
    """newest events of one actor."""
    return (
        df.where(F.col("actor_username") == actor)
        .select("actor_user_id", *TIMELINE)
        .orderBy(F.desc("created_at"), F.desc("id"))
        .limit(k)
    )


def session_timeline(df: DataFrame, *, session_id: str) -> DataFrame:
    """all events of one session, oldest first."""
    return df.where(F.col("session_id") == session_id).select(*TIMELINE).orderBy("created_at", "id")


def activity_by_user(df: DataFrame, *, as_of=None, days: int = 7) -> DataFrame:
    """A1: counts and first/last event per actor over the trailing week."""
    since = as_of_column(df, "created_at", as_of) - F.expr(f"INTERVAL {days} DAYS")
    return (
        df.where(F.col("created_at") >= since)
        .groupBy(F.coalesce("actor_username", F.lit("unknown")).alias("actor_username"))
        .agg(
            F.count(F.lit(1)).alias("total_events"),
            F.count(F.when(F.col("status") == "success", 1)).alias("success_count"),
            F.count(F.when(F.col("status") == "failed", 1)).alias("failed_count"),
            F.min("created_at").alias("first_seen"),
            F.max("created_at").alias("last_seen"),
        )
        .orderBy(F.desc("total_events"), "actor_username")
    )


def module_breakdown(df: DataFrame, *, as_of=None, hours: int = 24) -> DataFrame:
    """A2: events per module, operation and status over the trailing day."""
    keys = ["module_name", "operation", "status"]
    since = as_of_column(df, "created_at", as_of) - F.expr(f"INTERVAL {hours} HOURS")
    return (
        df.where(F.col("created_at") >= since)
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("events")).orderBy(*keys)
    )


def error_trend(df: DataFrame, *, as_of=None, hours: int = 48) -> DataFrame:
    """A3: failed events per hour over the trailing two days."""
    since = as_of_column(df, "created_at", as_of) - F.expr(f"INTERVAL {hours} HOURS")
    return (
        df.where((F.col("status") == "failed") & (F.col("created_at") >= since))
        .groupBy(F.date_format(F.date_trunc("hour", "created_at"), "yyyy-MM-dd HH:mm:ss").alias("hour_bucket"))
        .agg(F.count(F.lit(1)).alias("failed_events"))
        .orderBy("hour_bucket")
    )


def top_errors(df: DataFrame, *, as_of=None, days: int = 7, k: int = 50) -> DataFrame:
    """A4: most frequent error messages of the trailing week."""
    since = as_of_column(df, "created_at", as_of) - F.expr(f"INTERVAL {days} DAYS")
    message = F.coalesce(F.nullif("error_message", F.lit("")), F.lit("no_error_message"))
    return (
        df.where((F.col("status") == "failed") & (F.col("created_at") >= since))
        .groupBy(message.alias("error_message"))
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .orderBy(F.desc("occurrences"), "error_message")
        .limit(k)
    )


def decode_payload(payload: Column) -> Column:
    """JSON object text of any payload; scalars and lists go under ``value``, broken text under ``raw``."""
    parsed = F.try_parse_json(payload)
    wrap = F.to_json(F.map_from_arrays(F.array(F.lit("raw")), F.array(payload)))
    return (
        F.when(payload.isNull() | (payload == ""), F.lit("{}"))
        .when(parsed.isNull(), wrap)
        .when(F.schema_of_variant(parsed).startswith("OBJECT"), F.to_json(parsed))
        .otherwise(F.concat(F.lit('{"value":'), F.to_json(parsed), F.lit("}")))
    )


def event_message(module_name: Column, operation: Column, status: Column, error: Column) -> Column:
    """S3: ``module.operation status`` with the error text appended when there is one."""
    head = F.concat(module_name, F.lit("."), operation, F.lit(" "), status)
    return F.when(error.isNull() | (error == ""), head).otherwise(F.concat(head, F.lit(": "), error))


def login_rate_limit(
    df: DataFrame, *, key: str = "key", ts: str = "created_at", window_seconds: int = 60, max_attempts: int = 10
) -> DataFrame:
    """Is each login attempt rejected by the trailing-window limit?

    ``df`` has (key, ts, id, outcome) with outcome ``bad_credentials``,
    ``success`` or anything else (such as an inactive account), which neither
    counts nor resets. Failures count from the last success on, not including
    the row itself. A key is cut into slices of one window length and each row
    is also given to the next slice as context, so a hot key spreads over many
    tasks. The input outcomes are those that a limiter let through.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    window_micros = window_seconds * 1_000_000
    slice_no = F.floor(micros / window_micros)
    cut = df.withColumn("_sec", micros).withColumn(
        "_part", F.explode(F.array(F.struct(slice_no.alias("slice"), F.lit(True).alias("own")),
                                   F.struct((slice_no + 1).alias("slice"), F.lit(False).alias("own"))))
    ).select("*", F.col("_part.slice").alias("_slice"), F.col("_part.own").alias("_own")).drop("_part")
    part = W.partitionBy(key, "_slice")
    ordered = part.orderBy(ts, "id")
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    epoch = F.coalesce(F.sum((F.col("outcome") == "success").cast("int")).over(before), F.lit(0))
    failed = (F.col("outcome") == "bad_credentials").cast("int")
    trailing = (
        W.partitionBy(key, "_slice", "_epoch").orderBy("_sec").rangeBetween(-window_micros, 0)
    )
    # rows at the same instant with a later id are inside the range frame and must not count
    same = W.partitionBy(key, "_slice", "_epoch", "_sec").orderBy("id").rowsBetween(0, W.unboundedFollowing)
    return (
        cut.withColumn("_epoch", epoch)
        .withColumn("_fail", failed)
        .withColumn("recent_failures", F.sum("_fail").over(trailing) - F.sum("_fail").over(same))
        .where("_own")
        .withColumn("rate_limited", F.col("recent_failures") >= max_attempts)
        .drop("_sec", "_slice", "_own", "_epoch", "_fail")
    )
