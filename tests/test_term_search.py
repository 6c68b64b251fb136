"""Term and keyword search in one pass against brute force."""

import random

import pytest

from vitalake.operators import retrieval as r, term_search as ts


def test_automaton_finds_every_term_inside_a_word():
    rng = random.Random(1)
    terms = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(25)} | {"é", "aé"})
    automaton = ts.Automaton([t.encode() for t in terms])
    for _ in range(300):
        word = "".join(rng.choice("abcé") for _ in range(rng.randint(0, 12)))
        assert {terms[t] for t in automaton.scan(word.encode())} == {t for t in terms if t in word}


def _frames(spark, docs, queries):
    return (
        spark.createDataFrame(queries, "query_id long, text string"),
        spark.createDataFrame([(i, t, "x", 1.0) for i, t in docs], "doc_id long, text string, matched string, score double").repartition(3),
    )


@pytest.mark.parametrize("k,block_bytes", [(5, 1 << 20), (2, 200)])
def test_terms_match_brute_force(spark, monkeypatch, k, block_bytes):
    monkeypatch.setattr(ts, "REMEMBERED", 5)  # words are forgotten and scanned again
    rng = random.Random(k)
    words = ["ab", "abc", "b", "Ca", "x y", "dd", "é"]
    docs = [(i, rng.choice([" ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    docs += [(70, None), (71, ""), (None, "ab ca"), (72, "xx" * 60 + "ab")]
    queries = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))) for i in range(12)] + [(20, None), (21, " "), (22, "none here")]
    asked, held = _frames(spark, docs, [*queries, queries[0]])
    got = sorted((x["query_id"], x["rank"], x["doc_id"], x["hits"], x["n_terms"], tuple(x["matched"])) for x in ts.search_terms(asked, held, k=k, block_bytes=block_bytes).collect())
    want = []
    for q, text in queries:
        terms = (text or "").lower().split(" ") if (text or "").strip() else []
        rows = [(-sum(t in (d or "").lower() for t in terms), i is None, i or 0, tuple(t for t in terms if t in (d or "").lower())) for i, d in docs]
        for rank, (n, null, i, matched) in enumerate(sorted(x for x in rows if x[0] < 0)[:k]):
            want.append((q, rank + 1, None if null else i, -n, len(terms), matched))
    assert got == sorted(want)
    assert ts.search_terms(asked, held.limit(0), k=k).count() == 0 and ts.search_terms(asked.limit(0), held, k=k).count() == 0


@pytest.mark.parametrize("scoring", ["jaccard", "share", "count"])
def test_best_keywords_are_those_of_all_scores(spark, scoring):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(25)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 15)))) for i in range(80)] + [(90, None)]
    queries = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 8)))) for i in range(10)]
    asked, held = _frames(spark, docs, queries)
    best = r.rank_results(r.best_keyword_scores(asked, held, scoring=scoring, k=4), k=4)
    if scoring == "count":
        every = r.match_counts(r.postings(asked, key="query_id"), r.postings(held)).selectExpr("query_id", "doc_id", "double(matches) AS score")
    else:
        every = r.keyword_scores(asked, held, scoring=scoring)
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, r.rank_results(every, k=4).select(*best.columns).collect()))


def test_rounding_is_that_of_sql(spark):
    values = [1 / 128, 0.1234565, 2 / 3, 1.0, 5e-7, 0.0000015]
    got = [x[0] for x in spark.createDataFrame([(v,) for v in values], "v double").selectExpr("round(v, 6)").collect()]
    assert got == [ts.rounded(v) for v in values]


def test_one_pass_equals_the_complete_score_tables(spark):
    rng = random.Random(5)
    words = ["engine", "engineer", "gin", "data", "database", "the", "xy", "ab", "Ünder", "cost-cut", "cost"]
    texts = [rng.choice([" ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(60)] + [None, "", "a\n\nb  c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randrange(5)))) for i in range(12)] + [(90, ""), (91, "  "), (92, None)], "query_id long, text string")
    lists = [r.keyword_scores(asked, docs, scoring="share"), r.substring_scores(asked, docs, scoring="fuzzy")]
    # as in SQL a null text has no line; the complete table gives it a score
    there = [df.where("text IS NOT NULL") for df in (asked, docs)]
    for whole, best in ((r.combine_first(lists), r.best_combined_scores), (r.substring_scores(*there, scoring="lines"), r.best_line_scores)):
        want = sorted(map(tuple, r.rank_results(whole, k=5).collect()))
        assert sorted(map(tuple, r.rank_results(best(asked, docs, k=5), k=5).collect())) == want and len(want) > 20


def test_similar_documents_search_equal_keywords_once(spark, monkeypatch):
    texts = ["data engine", "engine data", "data engine core", "core", "", "data"] * 8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sources = docs.selectExpr("doc_id AS query_id", "text", "doc_id AS source_doc_id")
    sizes, search = [], r.best_by_keywords

    def counted(queries, held, **more):
        sizes.append((queries.count(), held.count()))
        return search(queries, held, **more)

    monkeypatch.setattr(r, "best_by_keywords", counted)
    got = sorted(map(tuple, r.similar_documents(sources, docs, k=2).select("query_id", "doc_id", "score", "rank").collect()))
    want = []
    for q, text in enumerate(texts):
        hits = sorted((-len(set(text.split()) & set(t.split())), d) for d, t in enumerate(texts) if d != q and set(text.split()) & set(t.split()))[:2]
        want += [(q, d, round(n / hits[0][0], 6), i + 1) for i, (n, d) in enumerate(hits)]
    assert got == sorted(want) and sizes == [(4, 12)]


def test_only_asked_keywords_reach_python(spark, monkeypatch):
    """All keywords of a document went to Python, so a batch grew with the words of its documents."""
    sent, plain = [], type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, *a, **b: (sent.append(self), plain(self, *a, **b))[1])
    docs = [(i, [f"k{i * 1000 + j}" for j in range(1000 + i)] + ["a", "a", None, f"b{i}"]) for i in range(6)] + [(6, []), (7, None), (None, ["a"])]
    queries = [(i, ["a", f"b{i}", "k3007"]) for i in range(3)] + [(5, []), (6, ["none"])]
    asked = spark.createDataFrame(queries, "query_id long, keywords array<string>")
    held = spark.createDataFrame(docs, "doc_id long, keywords array<string>").coalesce(2)
    got = [tuple(x) for x in ts.best_by_keywords(asked, held, scoring="jaccard", k=9).collect()]
    want = []
    for q, words in queries:
        found = [(-round(n / (len(words) + len(k) - n), 6), i is None, i) for i, k in docs if k and (n := len(set(words) & set(k)))]
        want += [(q, i, -s, rank + 1) for rank, (s, _, i) in enumerate(sorted(found))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    row = sent[-1].selectExpr("max(length(to_json(struct(*)))) AS n").first()
    assert row.n < 3000


def test_blocks_are_searched_one_after_another(spark, monkeypatch):
    """All blocks of queries were one plan: the driver held the plans, marks and broadcasts of all of them."""
    frame = type(spark.range(1))
    plain, before, sent, destroyed = frame.mapInArrow, ts.Broadcast.destroy, [], []
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **b: (sent.append(len(destroyed)), plain(self, *a, **b))[1])
    monkeypatch.setattr(ts.Broadcast, "destroy", lambda self, *a: (destroyed.append(self), before(self, *a))[1])
    rng = random.Random(5)
    words = [f"word{i}" for i in range(12)]
    docs = [(i, rng.sample(words, rng.randint(0, 9))) for i in rng.sample(range(200), 150)] + [(None, words), (None, words[:2]), (7, None), (8, [None, "word1"])]
    queries = [(i, rng.sample(words, rng.randint(1, 5))) for i in range(40)]
    asked = spark.createDataFrame(queries, "query_id long, keywords array<string>")
    held = spark.createDataFrame(docs, "doc_id long, keywords array<string>").repartition(3)
    for scoring in ("count", "jaccard"):
        sent.clear(), destroyed.clear()
        found = ts.best_by_keywords(asked, held, scoring=scoring, k=4, block_bytes=200)
        assert len(sent) > 5 and sent == list(range(len(sent))) and "MapInArrow" not in found._jdf.queryExecution().toString()
        want = []
        for q, terms in queries:
            hits = [(len(set(terms) & set(k or ())), len(terms), len(k or ()), i) for i, k in docs]
            rows = sorted((-(n if scoring == "count" else round(n / (t + d - n), 6)), i is None, i or 0) for n, t, d, i in hits if n)[:4]
            want += [(q, None if null else i, -s, rank + 1) for rank, (s, null, i) in enumerate(rows)]
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
