"""Checked readers and linear chunking against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import types as T

from vitalake.operators import retrieval
from vitalake.sources import readers

SCHEMA = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("version", T.LongType()), T.StructField("at", T.TimestampNTZType())])


def test_checked_rows(spark, tmp_path):
    lines = ['{"session_id":"a","version":1,"at":"2024-01-02T03:04:05.678901"}', '{"session_id":"b"}', '{"version":3}', '{"session_id":"d","version":"x"}', '{"session_id":', "", "[]", "text"]
    (tmp_path / "f.json").write_text("\n".join(lines))
    good, bad = readers.read_json_checked(spark, str(tmp_path), SCHEMA, required=["session_id"], defaults={"version": 1})
    assert good.columns == ["session_id", "version", "at"]
    assert sorted(map(tuple, good.collect())) == [("a", 1, dt.datetime(2024, 1, 2, 3, 4, 5, 678901)), ("b", 1, None)]
    got = {(r.reason, r.raw) for r in bad.collect()}
    assert {("malformed", lines[3]), ("malformed", lines[4]), ("malformed", lines[7]), ("missing session_id", '{"version":3}')} <= got


def test_checked_rows_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.json(str(tmp_path / "none"))
    good, bad = readers.read_json_checked(spark, str(tmp_path / "none"), SCHEMA, required=["session_id"])
    assert good.count() == bad.count() == 0


def test_snapshot_keeps_microseconds(spark, tmp_path):
    row = spark.sql(
        "SELECT 's' AS session_id, TIMESTAMP_NTZ'2024-01-02 03:04:05.678901' AS created_at UNION ALL SELECT 't', TIMESTAMP_NTZ'2024-01-02 00:00:00'")
    readers.write_sessions_json(row, str(tmp_path / "s"))
    back = readers.read_sessions_json(spark, str(tmp_path / "s"), one_per_file=False).select("session_id", "created_at")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, row.collect()))


@pytest.mark.parametrize("size", [1, 2, 12, 40])
def test_chunks_by_characters(spark, size):
    rng = random.Random(size)
    texts = ["".join(rng.choice("aé😀. \n\t  ") for _ in range(rng.randrange(300))) for _ in range(60)] + [None, "", " \n", "x" * 100]
    want = []
    for i, text in enumerate(texts):
        chunks, words = [], []
        for w in filter(None, "".join(" " if c in " \n\t" else c for c in text or "").split(" ")):
            words.append(w)
            if len(" ".join(words)) >= size:
                chunks, words = [*chunks, " ".join(words)], []
        want += [(i, n, c) for n, c in enumerate([*chunks, " ".join(words)] if words else chunks)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, retrieval.chunk_chars(df, size=size).collect())) == want


def test_chunks_of_a_long_text(spark):
    words = [f"w{i}" for i in range(40_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "")], "doc_id long, text string")
    by_words = [r.content for r in retrieval.chunk_words(df).orderBy("chunk_no").collect()]
    assert by_words == [" ".join(words[s : s + 500]) for s in range(0, len(words), 450)]
    by_chars = [r.content for r in retrieval.chunk_chars(df).orderBy("chunk_no").collect()]
    assert " ".join(by_chars) == " ".join(words) and all(400 <= len(c) < 410 for c in by_chars[:-1])


def test_chunks_by_paragraphs(spark):
    rng = random.Random(3)
    paragraphs = ["w " * rng.randrange(0, 9) for _ in range(200)]
    want, held, n = [], [], -1
    for x in paragraphs:
        k = len(x.split())
        if n < 0 or n + k > 12:
            want, held, n = [*want, held] if n >= 0 else want, [x], k
        else:
            held, n = [*held, x], n + k
    df = spark.createDataFrame([(1, "\n".join(paragraphs))], "doc_id long, text string")
    got = [r.content for r in retrieval.chunk_paragraphs(df, max_words=12, separator="\n").orderBy("chunk_no").collect()]
    assert got == [" ".join(x) for x in [*want, held]]
