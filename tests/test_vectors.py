"""Vector search against brute force, and the recall of the inverted file."""

import numpy as np
import pytest

from vitalake.operators import vectors

TYPE = "array<double>"


def _frame(spark, rows, key):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], f"{key} long, embedding {TYPE}, score string")


def _cosine(a, b):
    if len(a) != len(b) or not any(a) or not any(b):
        return 0.0
    return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6)


@pytest.mark.parametrize("k,block_bytes", [(5, 1 << 20), (3, 300)])
def test_all_documents_match_brute_force(spark, monkeypatch, k, block_bytes):
    monkeypatch.setattr(vectors, "CELLS", 50)  # many slices
    rng = np.random.default_rng(k)
    docs = [(i, rng.integers(-2, 3, rng.choice([3, 4])).astype(float).tolist()) for i in range(60)] + [(70, []), (None, [1.0, 0.0, 0.0])]
    queries = [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(8)] + [(20, [0.0, 0.0, 0.0]), (21, [1.0] * 7)]
    got = vectors.best_by_vectors(
        _frame(spark, [*queries, (30, None)], "query_id"), _frame(spark, [*docs, (80, None)], "doc_id").repartition(3), k=k, block_bytes=block_bytes)
    want = []
    for q, a in queries:
        ranked = sorted((-_cosine(a, b), i is None, i or 0) for i, b in docs)[:k]
        want += [(q, r + 1, None if null else i, -s + 0.0) for r, (s, null, i) in enumerate(ranked)]
    assert sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()) == sorted(want)
    assert vectors.best_by_vectors(_frame(spark, queries, "query_id"), _frame(spark, [], "doc_id"), k=k).count() == 0
    assert vectors.best_by_vectors(_frame(spark, [], "query_id"), _frame(spark, docs, "doc_id"), k=k).count() == 0


def test_lists_reach_the_recall_asked_for(spark):
    rng = np.random.default_rng(1)
    groups = rng.normal(size=(40, 16))
    points = np.repeat(groups, 30, axis=0) + 0.35 * rng.normal(size=(1200, 16))
    docs = _frame(spark, [(i, p.tolist()) for i, p in enumerate(points)], "doc_id")
    centres = vectors.fit_lists(docs, 12, sample=500)
    listed = vectors.assign_lists(docs, centres).cache()
    assert listed.count() == 1200 and listed.select("list").distinct().count() > 6
    probes, measured = vectors.probes_for_recall(listed, centres, target=0.95)
    assert measured >= 0.95 and probes < 8
    asked = docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    exact = {(r["query_id"], r["doc_id"]) for r in vectors.best_by_vectors(asked, docs, k=5).collect()}
    found = {(r["query_id"], r["doc_id"]) for r in vectors.best_by_vectors(asked, listed, k=5, centres=centres, probes=probes).collect()}
    assert len(exact & found) / len(exact) >= 0.95
    assert found != exact or probes == len(centres)


def test_lists_of_nothing(spark):
    none = _frame(spark, [], "doc_id")
    centres = vectors.fit_lists(none, 4)
    listed = vectors.assign_lists(none, centres)
    assert listed.count() == 0 and vectors.probes_for_recall(listed, centres) == (1, 1.0)
