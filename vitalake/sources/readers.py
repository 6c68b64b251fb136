"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from vitalake.operators.audit import event_message

AUDIT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("session_id", T.StringType()), T.StructField("actor_user_id", T.LongType()),
    T.StructField("actor_username", T.StringType()), T.StructField("module_name", T.StringType()), T.StructField("operation", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("event_message", T.StringType()), T.StructField("source_channel", T.StringType()),
    T.StructField("export_format", T.StringType()), T.StructField("http_status", T.IntegerType()), T.StructField("error_code", T.StringType()),
    T.StructField("error_message", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("created_at", T.TimestampNTZType()),
])

SESSION_SCHEMA = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("canonical_cv", T.StringType()), T.StructField("validation_results", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("created_at", T.TimestampNTZType()), T.StructField("last_updated_at", T.TimestampNTZType()),
    T.StructField("exported_at", T.TimestampNTZType()), T.StructField("expires_at", T.TimestampNTZType()), T.StructField("source_history", T.StringType()),
    T.StructField("uploaded_artifacts", T.StringType()), T.StructField("metadata", T.StringType()), T.StructField("workflow_state", T.StringType()),
    T.StructField("version", T.LongType()),
])
#: Times keep their microseconds in JSON; the default pattern ends at milliseconds.
MICROS = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
CORRUPT = "_corrupt_record"
HISTORY = "array<struct<source_type:string,event_at:timestamp_ntz,description:string,payload_metadata:map<string,string>>>"
ARTIFACTS = (
    "array<struct<artifact_id:string,artifact_type:string,file_name:string,content_type:string,size_bytes:bigint,storage_path:string,"
    "uploaded_at:timestamp_ntz,checksum:string>>"
)
METADATA = "struct<user_id:string,tenant_id:string,ui_locale:string,content_locale:string,client_app:string,tags:map<string,string>>"


def read_audit_log(spark: SparkSession, path: str | None = None, *, jdbc: dict[str, str] | None = None) -> DataFrame:
    """Typed scan of the audit table from parquet files or a JDBC table."""
    if jdbc:
        return spark.read.format("jdbc").options(**jdbc).load()
    return spark.read.schema(AUDIT_SCHEMA).parquet(path)


def append_audit_events(events: DataFrame, path: str) -> None:
    """S3: append, with the message derived where missing, partitioned by day and sorted for file skipping."""
    message = event_message(F.col("module_name"), F.col("operation"), F.col("status"), F.col("error_message"))
    out = events.withColumn("event_message", F.coalesce("event_message", message)) if "event_message" in events.columns else events.withColumn("event_message", message)
    # rows of one day are dealt to several files by time of day, so a busy day is not one task
    day = F.to_date("created_at")
    (
        out.withColumn("event_date", day).repartitionByRange(F.col("event_date"), F.col("created_at"))
        .sortWithinPartitions("event_date", "actor_username", "session_id").write.mode("append").partitionBy("event_date").parquet(path)
    )


def read_sessions_json(spark: SparkSession, path: str, schema: T.StructType = SESSION_SCHEMA, *, one_per_file: bool = True) -> DataFrame:
    """A directory with one JSON file per session, or with a session per line, as ``write_sessions_json`` leaves it."""
    return spark.read.schema(schema).options(multiLine=one_per_file, timestampNTZFormat=MICROS).json(path)


def read_json_checked(
    spark: SparkSession, path: str, schema: T.StructType, *, required: list[str], defaults: dict[str, object] | None = None, one_per_file: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """S4 with a contract: ``(good, bad)``. Rows that do not parse, hold a value of another type or lack a required
    column are bad: ``(reason, raw)``, the text as it stands in the file or, where that parses, the row as JSON.
    Good rows have ``schema``; ``defaults`` replace nulls. An empty folder gives two empty tables.
    """
    columns = [f.name for f in schema.fields]
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])).options(
        multiLine=one_per_file, timestampNTZFormat=MICROS, columnNameOfCorruptRecord=CORRUPT).json(path)
    reason = F.when(F.col(CORRUPT).isNotNull(), "malformed")
    for name in required:
        reason = reason.when(F.col(name).isNull(), f"missing {name}")
    judged = rows.withColumn("reason", reason)
    bad = judged.where(F.col("reason").isNotNull()).select("reason", F.coalesce(CORRUPT, F.to_json(F.struct(*columns))).alias("raw"))
    good = judged.where(F.col("reason").isNull()).select(
        [F.coalesce(name, F.lit((defaults or {}).get(name))).cast(schema[name].dataType).alias(name) for name in columns])
    return good, bad


def write_sessions_json(sessions: DataFrame, path: str) -> None:
    """Whole snapshot; the commit protocol publishes it only when every task is done."""
    sessions.write.mode("error").option("timestampNTZFormat", MICROS).json(path)


def decode_sessions(raw: DataFrame) -> DataFrame:
    """JSON text columns decoded with their defaults; status defaults to active, version to 1."""
    none = F.array()
    return raw.withColumns({
        "source_history": F.coalesce(F.from_json("source_history", HISTORY), none.cast(HISTORY)),
        "uploaded_artifacts": F.coalesce(F.from_json("uploaded_artifacts", ARTIFACTS), none.cast(ARTIFACTS)),
        "metadata": F.from_json(F.coalesce("metadata", F.lit("{}")), METADATA),
        "canonical_cv": F.coalesce(F.nullif("canonical_cv", F.lit("")), F.lit("{}")),
        "validation_results": F.coalesce(F.nullif("validation_results", F.lit("")), F.lit("{}")),
        "workflow_state": F.coalesce(F.nullif("workflow_state", F.lit("")), F.lit("{}")),
        "status": F.coalesce("status", F.lit("active")),
        "version": F.coalesce("version", F.lit(1)),
    })


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def schema_guard(df: DataFrame, expected: list[str], *, key: str | None = None) -> DataFrame:
    """``df`` unchanged, or an error that lists missing columns; the key column must be among them."""
    missing = [c for c in expected if c not in df.columns]
    if key and key not in df.columns and key not in missing:
        missing.append(key)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
