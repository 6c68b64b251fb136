"""Structured Streaming jobs (ST1-ST8).

Sources and sinks are files; each job takes a streaming DataFrame and returns a
started query. ``available_now`` ends a job when its input is read. Event times
are cast to TIMESTAMP because watermarks reject TIMESTAMP_NTZ (T14). A filter
after the watermark is pushed below it, so the watermark follows the kept events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vitalake.operators.sessions import EXPORT_TTL_HOURS, TTL_HOURS, latest_session_version
from vitalake.operators.unmapped import upsert_attributes

DEFAULT_DELAY = "10 minutes"


def _timed(events: DataFrame, delay: str) -> DataFrame:
    """ST8: event time with the late-data allowance."""
    return events.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay)


def _start(df: DataFrame, path: str, checkpoint: str, *, available_now: bool, mode: str = "append") -> StreamingQuery:
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_audit(events: DataFrame, path: str, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
    """ST1, ST7: append new events once per id, partitioned by day; an event may be any time late.

    A batch is held against the ids of its own days in the sink, so no state is kept, no late row is lost, and a
    batch that is run again after a failure adds nothing twice. Of rows with one id in a batch one is kept.
    """
    def append(batch: DataFrame, _batch_id: int) -> None:
        new = batch.withColumn("created_at", F.col("created_at").cast("timestamp")).dropDuplicates(["id"]).withColumn("event_date", F.to_date("created_at"))
        days = [r["event_date"] for r in new.select("event_date").distinct().collect()]
        try:
            there = batch.sparkSession.read.parquet(path)
        except Exception as error:  # noqa: BLE001 - nothing written so far
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        else:
            same_days = F.col("event_date").isin([d for d in days if d is not None]) | F.col("event_date").isNull()
            new = new.join(there.where(same_days).select("id"), "id", "left_anti")
        new.write.mode("append").partitionBy("event_date").parquet(path)

    writer = events.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def hourly_failures(events: DataFrame, *, delay: str = DEFAULT_DELAY) -> DataFrame:
    """ST2: failed events per closed hour (append mode; T15: the last hours stay open)."""
    return (
        _timed(events, delay).where("status = 'failed'").groupBy(F.window("created_at", "1 hour"))
        .agg(F.count(F.lit(1)).alias("failed_events")).select(F.col("window.start").alias("hour_bucket"), "failed_events")
    )


def login_abuse(events: DataFrame, *, threshold: int = 10, delay: str = DEFAULT_DELAY) -> DataFrame:
    """ST3: address and user with many failed logins in a sliding minute (approximates the exact batch rate limit)."""
    failed = _timed(events, delay).where("module_name = 'auth' AND status = 'failed'")
    address, actor = F.coalesce("address", F.lit("unknown")).alias("address"), F.coalesce(F.lower("actor_username"), F.lit("unknown")).alias("actor")
    return (
        failed.groupBy(F.window("created_at", "60 seconds", "10 seconds"), address, actor)
        .agg(F.count(F.lit(1)).alias("failures")).where(F.col("failures") >= threshold)
        .select("address", "actor", F.col("window.start").alias("window_start"), "failures")
    )


def write(df: DataFrame, path: str, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
    """Append a streaming result to parquet."""
    return _start(df, path, checkpoint, available_now=available_now)


#: Groups that sessions are hashed into. A group is one call of Python, whatever its number of sessions; the number is
#: part of a checkpoint.
BUCKETS = 2048


def _expire(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Per bucket of sessions: keep each one's newest update time and whether it was an export; emit once when its time is over."""
    held = {name: (ms, exported) for name, ms, exported in zip(*state.get)} if state.exists else {}
    for batch in () if state.hasTimedOut else batches:
        at = batch["created_at"].to_numpy("datetime64[ms]")
        names = batch["session_id"] if "session_id" in batch else [key[0]] * len(batch)
        for name, ms, none, flag in zip(names, at.astype("int64").tolist(), np.isnat(at).tolist(), batch["exported"]):
            if none:
                continue
            newest, exported = held.get(name, (ms, False))
            if ms >= newest:
                held[name] = ms, flag is not None and flag == True or exported and ms == newest  # noqa: E712 - a missing flag is no export
    if not held:
        return
    ends = {name: ms + (EXPORT_TTL_HOURS if exported else TTL_HOURS) * 3_600_000 for name, (ms, exported) in held.items()}
    watermark = state.getCurrentWatermarkMs()
    limit = max(watermark, min(ends.values()) + 1) if state.hasTimedOut else watermark
    over = [name for name, end in ends.items() if end < limit]
    left = [(name, *held[name]) for name, end in ends.items() if end >= limit]
    if left:
        state.update(tuple(map(list, zip(*left))))
        state.setTimeoutTimestamp(max(min(end for end in ends.values() if end >= limit), watermark + 1))
    elif state.exists:
        state.remove()
    if over:
        yield pd.DataFrame({"session_id": over, "expires_at": pd.to_datetime([ends[name] for name in over], unit="ms")})


def session_expiry(updates: DataFrame, *, delay: str = DEFAULT_DELAY, buckets: int = BUCKETS) -> DataFrame:
    """ST4: (session_id, expires_at) when event time passes 24 h after the last update, or 6 h after an export.

    ``updates`` is (session_id, created_at, exported). The state per open session is its newest update time and
    whether that was an export, so the result does not depend on how updates are cut into batches. Sessions are hashed
    into ``buckets``, whose state is handled at once: a call of Python for each session would take most of the time.
    """
    hashed = _timed(updates, delay).withColumn("_bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)))
    return hashed.groupBy("_bucket").applyInPandasWithState(
        _expire, "session_id string, expires_at timestamp", "session_id array<string>, newest_ms array<long>, exported array<boolean>", "append",
        GroupStateTimeout.EventTimeTimeout)


def _folder(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """State written by the newest batch before ``batch_id``, if any."""
    for earlier in range(batch_id - 1, -1, -1):
        try:
            return spark.read.parquet(f"{path}/batch={earlier}")
        except Exception as error:  # noqa: BLE001 - a missing folder means no state there
            if "PATH_NOT_FOUND" not in str(error):
                raise
    return None


def upsert_attribute_counts(sightings: DataFrame, path: str, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
    """ST5: attribute counts, one whole state folder per micro-batch.

    A batch reads the state before it and writes its own folder with
    ``overwrite``, so a repeated batch gives the same state.
    """
    def fold(batch: DataFrame, batch_id: int) -> None:
        prior = _folder(batch.sparkSession, path, batch_id)
        upsert_attributes(batch, prior).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = sightings.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def upsert_sessions(updates: DataFrame, path: str, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
    """ST6: newest version per session, one whole state folder per micro-batch."""
    def fold(batch: DataFrame, batch_id: int) -> None:
        prior = _folder(batch.sparkSession, path, batch_id)
        rows = batch if prior is None else batch.unionByName(prior)
        latest_session_version(rows).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = updates.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def newest_state(spark: SparkSession, path: str) -> DataFrame:
    """State of the last finished batch of a folding job; a folder without ``_SUCCESS`` was left half-written."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath() for s in files.listStatus(hadoop) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    batches = [int(p.getName().split("=")[1]) for p in done if p.getName().startswith("batch=")]
    return spark.read.parquet(f"{path}/batch={max(batches)}")
