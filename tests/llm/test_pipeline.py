"""The pipeline on a small corpus with planted cases, and its stages on odd tables."""

import random

import corpus_pipeline as pipeline
from vitalake.llm import queries

import __spark_entry__ as entry


def _corpus():
    rng = random.Random(9)
    sounds = {"xx": ["ka", "ko", "tak", "ro", "mi", "zu", "pa", "der"], "yy": ["né", "lé", "mié", "ba", "fou", "gi", "tu", "ser"]}
    prose = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) + ("." if rng.random() < 0.1 else "") for _ in range(n)) + "."
    rows = [(i, prose(lang, 150), lang, f"s{i % 3}") for i in range(120) for lang in [("xx", "yy")[i % 2]]]
    text = dict((r[0], r[1]) for r in rows)
    item, passage = prose("xx", 25), prose("yy", 60)
    return rows + [
        (200, text[0], "xx", "s0"), (201, text[1] + " extra", "yy", None), (202, None, "xx", "s1"), (203, "12 34", "xx", "s1"),
        (204, f"{prose('xx', 80)} {item} {prose('xx', 80)}", "xx", "s2"), (205, f"{prose('yy', 90)} {passage}", "yy", "s2"), (206, f"{prose('yy', 90)} {passage}", None, "s2"),
    ], item


def test_pipeline_end_to_end(spark, tmp_path):
    rows, item = _corpus()
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == pipeline.COLUMNS
        seen.append({r["doc_id"]: r for r in docs.collect()})
    everything = {r[0] for r in rows}
    assert everything - set(seen[0]) == {202, 203}
    assert set(seen[0]) - set(seen[1]) == {200, 201}
    assert set(seen[1]) == set(seen[2]) and seen[2][206]["n_chars"] < seen[1][206]["n_chars"] and seen[2][206]["lang"] == "yy"
    assert seen[2][205]["text"] == seen[1][205]["text"] and all(seen[2][i]["text"] == seen[1][i]["text"] for i in range(120))
    assert set(seen[2]) - set(seen[3]) == {204}
    final = pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in final} == set(seen[3]) and all(r["taken"] <= 2 * r["size"] for r in final)
    total = sum(r["size"] for r in final)
    assert abs(sum(r["taken"] for r in final) - 1.5 * total) <= len(pipeline.STAGES)


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_registered_names():
    names = set(entry.queries())
    assert {"pipeline", *queries.QUERIES} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
