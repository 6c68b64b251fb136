"""Web archives: write and read them, and resolve revisits.

Archives are written by Spark's text writer: a record is one row, the record mark (two line breaks) its line
separator, gzip its compression; the commit protocol, retries and remote paths are those of any Spark table.
Reading goes through ``binaryFile`` and cuts records by their Content-Length, so a payload may hold anything.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COLUMNS = ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_to_url")
SCHEMA = (
    "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, refers_to_url string"
)


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def _record(page_id, url, payload, size, digest, kind, refers_to, refers_url, date: str) -> str:
    """One record without its end mark: warc headers, then the HTTP head and (for a response) the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n"
    body = http + (payload if kind == "response" else "")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {_uri(refers_url)}"]
    return "\r\n".join([*head, f"Content-Length: {len(body.encode())}"]) + END + body


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 2000) -> None:
    """Write rows with the columns ``page_id, url, payload`` as archives below ``path``; null payloads are empty.

    Where ``record_type`` is there, revisits (with ``payload_bytes, payload_digest, refers_to, refers_to_url``)
    are written without payload; else all rows are responses. Sizes and digests of responses are always fresh.
    """
    have = set(records.columns)
    kinds = dict(x.rsplit(" ", 1) for x in SCHEMA.split(", "))
    slim = records.select(*[(F.col(c) if c in have else F.lit(None).cast(kinds[c]).alias(c)) for c in COLUMNS])
    fresh = "record_type" not in have

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(COLUMNS))), strict=True):
                page_id, url, payload, size, digest, kind, refers_to, refers_url = row
                if fresh or kind != "revisit":
                    raw = (payload or "").encode()
                    kind, size, digest = "response", len(raw), payload_digest(raw)
                out.append(_record(page_id, url, payload or "", size, digest, kind, refers_to, refers_url, date))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    slim.mapInArrow(run, "value string").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _inflate(raw: bytes) -> bytes:
    """All gzip members of a file, or the file itself if it is not compressed."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw:
        member = zlib.decompressobj(31)
        out.append(member.decompress(raw) + member.flush())
        raw = member.unused_data
    return b"".join(out)


def _records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(raw):
        cut = raw.index(b"\r\n\r\n", at)
        lines = raw[at:cut].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        start = cut + 4
        stop = start + int(head["Content-Length"])
        if raw[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield head, raw[start:stop]
        at = stop + 4


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records below ``path``, with ``payloads`` or (null) without; a response's digest is held against its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for raw in batch.column(0):
                rows = []
                for head, block in _records(_inflate(raw.as_py())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    if kind == "response" and (size != len(payload) or digest != payload_digest(payload)):
                        raise ValueError(f"payload of {head['WARC-Record-ID']} is not the one that was written")
                    rows.append((
                        _page(head["WARC-Record-ID"]), head["WARC-Target-URI"], payload.decode() if payloads and kind == "response" else None, size, digest,
                        kind, _page(head.get("WARC-Refers-To")), head.get("WARC-Refers-To-Target-URI"),
                    ))
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(COLUMNS))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, SCHEMA)


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(page_id, new_type, new_refers_to, new_url)`` for the records that become revisits.

    Of the responses with one digest and at least ``min_bytes`` bytes, that with the largest page_id stays; those
    with a smaller one revisit it. Revisits already in the archives are joined to the response that stays for
    their digest. Headers alone are shuffled, and the largest page_id is combined before the shuffle, so a payload
    that many records share is no burden. Records of one page_id and payload, and those without a page_id, stay.
    """
    long = headers.where(F.col("payload_bytes") >= min_bytes)
    kept = long.where(F.col("record_type") == "response").groupBy("payload_digest").agg(
        F.max("page_id").alias("new_refers_to"), F.max_by("url", "page_id").alias("new_url")
    )
    return long.select("page_id", "payload_digest").join(kept, "payload_digest").where(F.col("page_id") < F.col("new_refers_to")).select(
        "page_id", "payload_digest", F.lit("revisit").alias("new_type"), "new_refers_to", "new_url"
    ).dropDuplicates(["page_id", "payload_digest"])


def deduplicate_archives(spark: SparkSession, source: str, target: str, min_bytes: int = 0) -> None:
    """Read the archives below ``source``, resolve revisits and write archives with fresh headers below ``target``."""
    plan = resolve_revisits(read_archives(spark, source, payloads=False), min_bytes)
    joined = read_archives(spark, source).join(plan, ["page_id", "payload_digest"], "left")
    revisit = F.col("new_type").isNotNull()
    write_archives(joined.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.coalesce("new_type", "record_type").alias("record_type"), F.when(revisit, F.col("new_refers_to")).otherwise(F.col("refers_to")).alias("refers_to"),
        F.when(revisit, F.col("new_url")).otherwise(F.col("refers_to_url")).alias("refers_to_url"),
    ), target)
