"""Registered queries: chunks, keywords, scores, fusion over documents (docs) and benchmark items (queries)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalake.operators import retrieval as r, vectors
from vitalake.plans import profiles as p, texts as tx, views as v
from vitalake.plans.registry import query
from vitalake.session import fresh_path

P = "WITH " + p.PROFILES


def _plain(spark, sf):
    """Documents without vectors, for the searches that read none."""
    return v.load_spread(spark, sf, "documents", "doc_id").selectExpr(
        "doc_id", "text", "map_from_arrays(array('lang', 'role', 'seniority'), array(lang, source, CASE WHEN doc_id % 2 = 0 THEN 'mid' ELSE 'senior' END)) AS metadata"
    )


def _docs(spark, sf):
    vectors = v.load(spark, sf, "embeddings").selectExpr("vec_id AS doc_id", "embedding")
    return _plain(spark, sf).join(vectors, "doc_id", "left")


def _queries(spark, sf):
    items = v.load(spark, sf, "benchmark").selectExpr("item_id AS query_id", "text")
    vectors = v.load(spark, sf, "embeddings").selectExpr("vec_id AS query_id", "embedding")
    return items.join(vectors, "query_id", "left")


WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"


def _stop(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _kw(source: str, key: str, mode: str) -> str:
    """Distinct keywords in order of appearance, as rows (key, keyword, i)."""
    body = {
        "short": ("lower(text)", f"length(u) > 3 AND u NOT IN {_stop(r.STOP_SHORT)}"),
        "clean": ("regexp_replace(lower(text), '[^\\pL\\pN_\\s]', ' ', 'g')", f"length(u) > 2 AND u NOT IN {_stop(r.STOP_MEDIUM)}"),
        "ordered": ("lower(text)", f"length(u) > 2 AND u NOT IN {_stop(r.STOP_LONG)}"),
    }[mode]
    word = "regexp_replace(x, '[^\\pL\\pN]', '', 'g')" if mode == "ordered" else "x"
    return (
        f"(SELECT k AS {key}, u AS keyword, i FROM (SELECT k, u, min(i) AS i FROM (SELECT k, {word} AS u, i FROM ("
        f"SELECT {key} AS k, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM (SELECT {key}, {WORDS.format(body[0])} AS ws FROM ({source})))) WHERE {body[1]} GROUP BY k, u))"
    )


DOC_SRC, Q_SRC = "SELECT doc_id, text FROM documents", "SELECT item_id AS query_id, text FROM benchmark"


def _keyword_sql(mode: str, scoring: str) -> str:
    score = "m / (q + d - m)" if scoring == "jaccard" else "least(1, m / q)"
    return f"""WITH dk AS MATERIALIZED {_kw(DOC_SRC, 'doc_id', mode)}, qk AS MATERIALIZED {_kw(Q_SRC, 'query_id', mode)},
dn AS (SELECT doc_id, count(*) AS d FROM dk GROUP BY 1), qn AS (SELECT query_id, count(*) AS q FROM qk GROUP BY 1),
mm AS (SELECT query_id, doc_id, count(*) AS m FROM dk JOIN qk USING (keyword) GROUP BY ALL),
kws AS MATERIALIZED (SELECT query_id, doc_id, round({score}, 6) AS score FROM mm JOIN dn USING (doc_id) JOIN qn USING (query_id))"""


def _ranked(source: str, k: int, alias: str = "") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {source} QUALIFY rank <= {k})"


VEC_SQL = """, vs AS MATERIALIZED (SELECT b.item_id AS query_id, d.doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, documents d JOIN embeddings e ON e.vec_id = d.doc_id)"""


@query("retrieval_chunks_words", "R1", f"""
SELECT doc_id, i AS chunk_no, md5(array_to_string(ws[s + 1 : s + 500], ' ')) AS content FROM (
  SELECT doc_id, ws, unnest(range(0, len(ws), 450)) AS s, generate_subscripts(range(0, len(ws), 450), 1) - 1 AS i FROM (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents))""")
def retrieval_chunks_words(spark, sf):
    out = r.chunk_words(v.load_spread(spark, sf, "documents", "doc_id"))
    return out.select("doc_id", F.col("chunk_no").cast("long"), F.md5("content").alias("content"))


@query("retrieval_chunks_chars", "R1", f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents),
f AS (SELECT doc_id, 0 AS i, 0 AS len, 0 AS no FROM w WHERE len(ws) > 0
  UNION ALL SELECT f.doc_id, f.i + 1, CASE WHEN (CASE WHEN f.len = 0 THEN length(w.ws[f.i + 1]) ELSE f.len + 1 + length(w.ws[f.i + 1]) END) >= 400 THEN 0
    ELSE (CASE WHEN f.len = 0 THEN length(w.ws[f.i + 1]) ELSE f.len + 1 + length(w.ws[f.i + 1]) END) END,
    f.no + CASE WHEN (CASE WHEN f.len = 0 THEN length(w.ws[f.i + 1]) ELSE f.len + 1 + length(w.ws[f.i + 1]) END) >= 400 THEN 1 ELSE 0 END
  FROM f JOIN w ON w.doc_id = f.doc_id WHERE f.i < len(w.ws)),
g AS (SELECT f.doc_id, f.i, f.no - CASE WHEN f.len = 0 AND f.i > 0 THEN 1 ELSE 0 END AS chunk_no FROM f WHERE f.i > 0)
SELECT g.doc_id, chunk_no, count(*) AS words FROM g GROUP BY ALL""")
def retrieval_chunks_chars(spark, sf):
    out = r.chunk_chars(v.load_spread(spark, sf, "documents", "doc_id"))
    return out.select("doc_id", F.col("chunk_no").cast("long"), F.size(F.split("content", " ")).cast("long").alias("words"))


@query("retrieval_chunks_sections", "R1", f"""WITH l AS (SELECT doc_id, channel, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM ({'WITH ' + tx.TEXTS} SELECT * FROM resumes)),
m AS (SELECT *, i > 1 AND ({' OR '.join(f"contains(upper(x), '{w}')" for w in r.SECTION_MARKERS)}) AS opens FROM l),
g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS chunk_no FROM m)
SELECT doc_id, chunk_no::BIGINT AS chunk_no, string_agg(x, chr(10) ORDER BY i) AS content FROM g GROUP BY ALL""")
def retrieval_chunks_sections(spark, sf):
    return r.chunk_sections(tx.resumes(spark, sf)).withColumn("chunk_no", F.col("chunk_no").cast("long"))


@query("retrieval_chunks_paragraphs", "R1", f"""WITH RECURSIVE p AS (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents),
w AS MATERIALIZED (SELECT doc_id, ps, list_transform(ps, lambda x: len({WORDS.format('x')})) AS ns FROM p),
f AS (SELECT doc_id, 0 AS i, -1::BIGINT AS n, -1 AS g FROM w
  UNION ALL SELECT f.doc_id, f.i + 1, CASE WHEN f.n < 0 OR f.n + ns[f.i + 1] > 120 THEN ns[f.i + 1] ELSE f.n + ns[f.i + 1] END,
    f.g + CASE WHEN f.n < 0 OR f.n + ns[f.i + 1] > 120 THEN 1 ELSE 0 END FROM f JOIN w ON w.doc_id = f.doc_id WHERE f.i < len(ps))
SELECT f.doc_id, g::BIGINT AS chunk_no, md5(string_agg(ps[i], ' ' ORDER BY i)) AS content FROM f JOIN w ON w.doc_id = f.doc_id WHERE i > 0 GROUP BY ALL""")
def retrieval_chunks_paragraphs(spark, sf):
    out = r.chunk_paragraphs(v.load_spread(spark, sf, "documents", "doc_id"), max_words=120, separator="\n")
    return out.select("doc_id", F.col("chunk_no").cast("long"), F.md5("content").alias("content"))


for _mode in ("short", "clean", "ordered"):
    def _register(mode: str) -> None:
        @query(f"retrieval_keywords_{mode}", "R2 R3", f"SELECT doc_id, count(*) AS keyword_count, md5(string_agg(keyword, ' ' ORDER BY i)) AS keywords FROM {_kw(DOC_SRC, 'doc_id', mode)} GROUP BY 1")
        def run(spark, sf):
            k = r.keywords(F.col("text"), mode)
            out = v.load_spread(spark, sf, "documents", "doc_id").select("doc_id", k.alias("k")).where("size(k) > 0")
            return out.select("doc_id", F.size("k").cast("long").alias("keyword_count"), F.md5(F.array_join("k", " ")).alias("keywords"))

    _register(_mode)


@query("retrieval_index_reloaded", "S8 R3", f"SELECT doc_id, n_chars, count(*) AS postings FROM {_kw(DOC_SRC, 'doc_id', 'ordered')} JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id) GROUP BY ALL")
def retrieval_index_reloaded(spark, sf):
    path = fresh_path(spark, "retrieval-index")
    r.save_index(v.load(spark, sf, "documents").select("doc_id", "text", "n_chars"), path)
    docs, posts = r.load_index(spark, path)
    counted = posts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("postings"))
    return docs.select("doc_id", "n_chars").join(counted, "doc_id")


@query("retrieval_keyword_jaccard", "J10 R4 O1 W8", _keyword_sql("short", "jaccard") + f" SELECT query_id, doc_id, score, rank FROM {_ranked('kws', 5)}")
def retrieval_keyword_jaccard(spark, sf):
    return _long(r.retrieve(_queries(spark, sf), _plain(spark, sf), strategy="keyword"))


def _long(df):
    return df.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("retrieval_keyword_share", "J10 R4 O2", _keyword_sql("clean", "share") + f" SELECT query_id, doc_id, score, rank FROM {_ranked('(SELECT * FROM kws WHERE score >= 0.5)', 5)}")
def retrieval_keyword_share(spark, sf):
    scores = r.best_keyword_scores(_queries(spark, sf), _plain(spark, sf), scoring="share", mode="clean", k=5)
    return _long(r.rank_results(scores, k=5, min_score=0.5))


@query("retrieval_vector", "J11 R5 X18", "WITH x AS (SELECT 1)" + VEC_SQL + f" SELECT query_id, doc_id, score, rank FROM {_ranked('vs', 5)}")
def retrieval_vector(spark, sf):
    return _long(r.retrieve(_queries(spark, sf), _docs(spark, sf), strategy="semantic"))


@query("retrieval_vector_lists", "R5 J11")
def retrieval_vector_lists(spark, sf):
    # every document is in one of 16 lists, written by list; a query meets as many as a recall of 0.97 takes
    docs = v.load(spark, sf, "embeddings").selectExpr("vec_id AS doc_id", "embedding")
    centres = vectors.fit_lists(docs, 16)
    path = fresh_path(spark, "vector-lists")
    vectors.assign_lists(docs, centres).write.partitionBy("list").parquet(path)
    listed = spark.read.parquet(path)
    probes, _ = vectors.probes_for_recall(listed, centres, k=5, target=0.97)
    return _long(vectors.best_by_vectors(_queries(spark, sf), listed, k=5, centres=centres, probes=probes))


HYBRID_SQL = _keyword_sql("short", "jaccard") + VEC_SQL + """,
sv AS {S}, wv AS {W},
hy AS MATERIALIZED (SELECT coalesce(s.query_id, w.query_id) AS query_id, coalesce(s.doc_id, w.doc_id) AS doc_id, round(coalesce(s.score, 0) * 0.7::DOUBLE + coalesce(w.score, 0) * 0.3::DOUBLE, 8) AS score
  FROM sv s FULL JOIN wv w ON s.query_id = w.query_id AND s.doc_id = w.doc_id)"""


@query("retrieval_hybrid", "R6", HYBRID_SQL.replace("{S}", _ranked("vs", 10)).replace("{W}", _ranked("kws", 10)) + f" SELECT query_id, doc_id, score, rank FROM {_ranked('hy', 5)}")
def retrieval_hybrid(spark, sf):
    return _long(r.retrieve(_queries(spark, sf), _docs(spark, sf), strategy="hybrid"))


CTX_SQL = HYBRID_SQL.replace("{S}", _ranked("vs", 20)).replace("{W}", _ranked("kws", 20)) + f""",
cx AS (SELECT h.query_id, h.doc_id, round(h.score * CASE WHEN d.source = 'engineer' THEN 1.3::DOUBLE ELSE 1 END
  * CASE WHEN (CASE WHEN doc_id % 2 = 0 THEN 'mid' ELSE 'senior' END) = (CASE WHEN regexp_matches(lower(b.text), 'senior|lead|principal') THEN 'senior' WHEN regexp_matches(lower(b.text), 'junior|entry') THEN 'junior' ELSE 'mid' END)
    THEN 1.2::DOUBLE ELSE 1 END, 10) AS score FROM {_ranked('hy', 10)} h JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = h.query_id)"""


@query("retrieval_contextual", "R8", CTX_SQL + f" SELECT query_id, doc_id, score, rank FROM {_ranked('cx', 5)}")
def retrieval_contextual(spark, sf):
    return _long(r.retrieve(_queries(spark, sf), _docs(spark, sf), strategy="contextual"))


@query("retrieval_rrf", "R7", _keyword_sql("short", "jaccard") + VEC_SQL + f""",
u AS (SELECT query_id, doc_id, 1 / (60 + rank) AS p FROM {_ranked('vs', 10)} UNION ALL SELECT query_id, doc_id, 1 / (60 + rank) FROM {_ranked('kws', 10)}),
f AS (SELECT query_id, doc_id, round(sum(p), 6) AS score FROM u GROUP BY ALL)
SELECT query_id, doc_id, score, rank FROM {_ranked('f', 5)}""")
def retrieval_rrf(spark, sf):
    queries, docs = _queries(spark, sf), _docs(spark, sf)
    lists = [r.vector_scores(queries.where("embedding IS NOT NULL"), docs.where("embedding IS NOT NULL"), k=10), r.best_keyword_scores(queries, docs, mode="short", k=10)]
    return _long(r.rank_results(r.reciprocal_rank_fusion(lists), k=5))


@query("retrieval_rerank", "R9", _keyword_sql("short", "jaccard") + f""",
t AS (SELECT * FROM {_ranked('kws', 10)}), w AS (SELECT query_id, doc_id, score, list_distinct({WORDS.format('lower(b.text)')}) AS q, list_distinct({WORDS.format('lower(d.text)')}) AS d,
  contains(lower(d.text), lower(b.text)) AS phrase FROM t JOIN benchmark b ON b.item_id = t.query_id JOIN documents d USING (doc_id)),
o AS (SELECT query_id, doc_id, round(round(score * CASE WHEN phrase THEN 1.2::DOUBLE ELSE 1 END, 6) * (1 + len(list_intersect(q, d)) * 0.1::DOUBLE), 6) AS score FROM w)
SELECT query_id, doc_id, score, rank FROM {_ranked('o', 5)}""")
def retrieval_rerank(spark, sf):
    queries, docs = _queries(spark, sf), _plain(spark, sf)
    top = r.rank_results(r.best_keyword_scores(queries, docs, mode="short", k=10), k=10).drop("rank")
    return _long(r.rank_results(r.rerank(r.rerank(top, queries, docs), queries, docs, method="overlap"), k=5))


PAIR_SQL = f"""WITH q AS (SELECT item_id AS query_id, lower(text) AS q, {WORDS.format('lower(text)')} AS terms FROM benchmark),
pr AS (SELECT query_id, doc_id, q, terms, lower(text) AS d FROM q, documents),
sc AS (SELECT query_id, doc_id, q, d, terms, len(list_filter(terms, lambda w: contains(d, w))) AS hits FROM pr)"""


@query("retrieval_substring", "R4 R10 U8 R13", PAIR_SQL + f""",
c AS (SELECT query_id, doc_id, hits::DOUBLE AS score FROM sc WHERE hits > 0), f AS (SELECT query_id, doc_id, round(hits / len(terms) * 0.8::DOUBLE, 6) AS score FROM sc WHERE hits > 0)
SELECT 'count' AS kind, query_id, doc_id, score, rank FROM {_ranked('c', 3)} UNION ALL SELECT 'fuzzy', query_id, doc_id, score, rank FROM {_ranked('f', 3)}""")
def retrieval_substring(spark, sf):
    # one pass: both scores rank by the number of terms found
    found = r.search_terms(_queries(spark, sf), _plain(spark, sf), k=3)
    kinds = F.array(
        F.struct(F.lit("count").alias("kind"), F.col("hits").cast("double").alias("score")),
        F.struct(F.lit("fuzzy").alias("kind"), F.round(F.col("hits") / F.col("n_terms") * 0.8, 6).alias("score")),
    )
    return found.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.explode(kinds).alias("s")).select("s.kind", "query_id", "doc_id", "s.score", "rank")


@query("retrieval_terms_matched", "R4 R10", PAIR_SQL + f""",
m AS (SELECT query_id, doc_id, round(hits / len(terms), 6) AS score, array_to_string(list_filter(terms, lambda w: contains(d, w)), ' ') AS matched FROM sc WHERE hits > 0)
SELECT query_id, doc_id, score, matched, rank FROM {_ranked('m', 5)}""")
def retrieval_terms_matched(spark, sf):
    found = r.search_terms(_queries(spark, sf), _plain(spark, sf))
    return found.select("query_id", "doc_id", "score", F.array_join("matched", " ").alias("matched"), F.col("rank").cast("long").alias("rank"))


@query("retrieval_search", "R13 R4", PAIR_SQL.replace("FROM q, documents", "FROM q, documents WHERE source = 'src1' AND lang = 'en'") + f""",
m AS (SELECT query_id, doc_id, round(hits / len(terms), 6) AS score FROM sc WHERE hits > 0)
SELECT query_id, doc_id, score, rank FROM {_ranked('m', 5)}""")
def retrieval_search(spark, sf):
    docs = v.load(spark, sf, "documents").selectExpr("doc_id", "text", "lang AS index_type", "source AS user_id")
    return _long(r.search(_queries(spark, sf), docs, index_type="en", user_id="src1"))


@query("retrieval_context_given", "R8", _keyword_sql("short", "jaccard") + f""",
t AS (SELECT * FROM {_ranked('kws', 10)}), x AS (SELECT query_id, doc_id, round(score * CASE WHEN contains(lower(d.source), 'src' || query_id % 5) THEN 1.3::DOUBLE ELSE 1 END
  * CASE WHEN query_id % 3 > 0 AND (CASE WHEN query_id % 3 = 1 THEN 'mid' ELSE 'senior' END) = (CASE WHEN doc_id % 2 = 0 THEN 'mid' ELSE 'senior' END) THEN 1.2::DOUBLE ELSE 1 END
  * CASE WHEN d.lang = 'en' OR query_id % 2 = 1 THEN 1.15::DOUBLE ELSE 1 END, 10) AS score FROM t JOIN documents d USING (doc_id))
SELECT query_id, doc_id, score, rank FROM {_ranked('x', 5)}""")
def retrieval_context_given(spark, sf):
    queries, docs = _queries(spark, sf), _plain(spark, sf)
    context = queries.selectExpr(
        "query_id", "concat('SRC', query_id % 5) AS role", "CASE query_id % 3 WHEN 1 THEN 'mid' WHEN 2 THEN 'senior' END AS experience_level",
        "CASE WHEN query_id % 2 = 1 THEN 'all' ELSE 'en' END AS industry")
    held = docs.selectExpr("doc_id", "metadata['role'] AS role", "metadata['seniority'] AS experience_level", "array('all', metadata['lang']) AS industries")
    top = r.rank_results(r.best_keyword_scores(queries, docs, mode="short", k=10), k=10).drop("rank")
    return _long(r.rank_results(r.context_boost_given(top, context, held), k=5))


@query("retrieval_rerank_dated", "R9", _keyword_sql("short", "jaccard") + f""",
t AS (SELECT * FROM {_ranked('kws', 10)}), x AS (SELECT query_id, doc_id, round(score * CASE WHEN doc_id % 3 = 0 THEN 1.1::DOUBLE ELSE 1 END
  * CASE WHEN contains(lower(d.text), lower(b.text)) THEN 1.2::DOUBLE ELSE 1 END, 6) AS score FROM t JOIN benchmark b ON b.item_id = t.query_id JOIN documents d USING (doc_id))
SELECT query_id, doc_id, score, rank FROM {_ranked('x', 5)}""")
def retrieval_rerank_dated(spark, sf):
    queries, docs = _queries(spark, sf), _plain(spark, sf)
    dated = docs.withColumn("metadata", F.expr("CASE WHEN doc_id % 3 = 0 THEN map_concat(metadata, map('created_at', '2024-01-01')) ELSE metadata END"))
    top = r.rank_results(r.best_keyword_scores(queries, docs, mode="short", k=10), k=10).drop("rank")
    return _long(r.rank_results(r.rerank(top, queries, dated), k=5))


@query("retrieval_lines", "R10", f"""WITH q AS (SELECT item_id AS query_id, lower(text) AS q, {WORDS.format('lower(text)')} AS terms FROM benchmark),
ln AS (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS l, len(string_split(text, chr(10))) AS n FROM documents),
sc AS (SELECT query_id, doc_id, n, sum(CASE WHEN contains(l, q) THEN 1 ELSE len(list_filter(terms, lambda w: contains(l, w))) / len(terms) END) AS t FROM q, ln GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(least(1, t / n), 6) AS score FROM sc WHERE round(least(1, t / n), 6) > 0)
SELECT query_id, doc_id, score, rank FROM {_ranked('s', 5)}""")
def retrieval_lines(spark, sf):
    scores = r.best_line_scores(_queries(spark, sf), _plain(spark, sf), k=5)
    return _long(r.rank_results(scores, k=5))


@query("retrieval_combined_modes", "U8", _keyword_sql("ordered", "share") + ",\n" + PAIR_SQL[5:] + f""",
f AS (SELECT query_id, doc_id, round(hits / len(terms) * 0.8::DOUBLE, 6) AS score FROM sc WHERE hits > 0),
u AS (SELECT query_id, doc_id, coalesce(k.score, f.score) AS score FROM f FULL JOIN kws k USING (query_id, doc_id))
SELECT query_id, doc_id, score, rank FROM {_ranked('u', 5)}""")
def retrieval_combined_modes(spark, sf):
    return _long(r.rank_results(r.best_combined_scores(_queries(spark, sf), _plain(spark, sf), k=5), k=5))


@query("retrieval_similar", "J12 R14", _keyword_sql("ordered", "share") + f""",
b AS (SELECT query_id, max(m) AS best FROM mm GROUP BY 1), s AS (SELECT query_id, doc_id, round(m / best, 6) AS score FROM mm JOIN b USING (query_id))
SELECT query_id, doc_id, score, rank FROM {_ranked('s', 5)}""")
def retrieval_similar(spark, sf):
    return _long(r.similar_documents(_queries(spark, sf), _plain(spark, sf)))


@query("retrieval_similar_profiles", "R14", P + f""", q AS (SELECT cv_id AS query_id, concat_ws(' ', nullif(trim(title), ''), years::VARCHAR || ' years', array_to_string(primary_skills[1:5], ' ')) AS text FROM profiles),
d AS (SELECT cv_id AS doc_id, 'Skills: ' || array_to_string(list_concat(primary_skills, secondary_skills), ', ') || ' ' || trim(title) AS text FROM profiles),
dk AS MATERIALIZED {_kw('SELECT * FROM d', 'doc_id', 'ordered')}, qk AS MATERIALIZED {_kw('SELECT * FROM q', 'query_id', 'ordered')},
mm AS (SELECT query_id, doc_id, count(*) AS m FROM dk JOIN qk USING (keyword) WHERE query_id <> doc_id GROUP BY ALL),
b AS (SELECT query_id, max(m) AS best FROM mm GROUP BY 1), s AS (SELECT query_id, doc_id, round(m / best, 6) AS score FROM mm JOIN b USING (query_id))
SELECT query_id, doc_id, score, rank FROM {_ranked('s', 5)}""")
def retrieval_similar_profiles(spark, sf):
    profiles = p.profiles(spark, sf)
    queries = profiles.select(F.col("cv_id").alias("query_id"), r.similar_query(profiles).alias("text"), F.col("cv_id").alias("source_doc_id"))
    skills = F.array_join(F.concat("primary_skills", "secondary_skills"), ", ")
    docs = profiles.select(F.col("cv_id").alias("doc_id"), F.concat(F.lit("Skills: "), skills, F.lit(" "), F.trim("title")).alias("text"))
    return _long(r.similar_documents(queries, docs))


@query("retrieval_filtered", "R11 R13", _keyword_sql("short", "jaccard") + f"""
SELECT query_id, doc_id, score, rank FROM {_ranked("(SELECT k.* FROM kws k JOIN documents d USING (doc_id) WHERE d.lang = 'en' AND d.doc_id % 2 = 0)", 5)}""")
def retrieval_filtered(spark, sf):
    return _long(r.retrieve(_queries(spark, sf), _plain(spark, sf), strategy="keyword", filters={"lang": "en", "seniority": "mid"}))


ITEM_SQL = P + """, it AS (
  SELECT cv_id, 'summary' AS index_type, 'Professional Summary: ' || summary AS content FROM profiles
  UNION ALL SELECT cv_id, 'skills', 'Skills: ' || array_to_string(list_concat(primary_skills, secondary_skills), ', ') FROM profiles
  UNION ALL SELECT cv_id, 'header', 'Name: ' || full_name || ' Title: ' || trim(title) FROM profiles
  UNION ALL SELECT cv_id, 'experience', 'Role: ' || w.designation || ' Company: ' || w.organization || ' ' || w.description FROM (SELECT cv_id, unnest(work) AS w FROM profiles)
  UNION ALL SELECT cv_id, 'project', 'Project: ' || x.name || ' Technologies: ' || array_to_string(x.technologies, ', ') || ' ' || x.description FROM (SELECT cv_id, unnest(projects) AS x FROM profiles)
  UNION ALL SELECT cv_id, 'education', 'Education: ' || x.degree || ' ' || x.institution || ' ' || x.year FROM (SELECT cv_id, unnest(education) AS x FROM profiles))"""


@query("retrieval_profile_documents", "R12 X19", ITEM_SQL + " SELECT cv_id, index_type, md5(content) AS content, md5(index_type || content) AS content_key FROM it")
def retrieval_profile_documents(spark, sf):
    return r.profile_documents(p.profiles(spark, sf)).select("cv_id", "index_type", F.md5("content").alias("content"), "content_key")


@query("retrieval_index_stats", "A22", ITEM_SQL + f""", n AS (SELECT index_type, content, len(list_distinct(list_filter(list_transform({WORDS.format('lower(content)')}, lambda x: regexp_replace(x, '[^\\pL\\pN]', '', 'g')),
  lambda u: length(u) > 2 AND u NOT IN {_stop(r.STOP_LONG)}))) AS k FROM it)
SELECT index_type, count(*) AS documents, count(*) FILTER (k > 0) AS with_keywords, round(avg(k), 6) AS avg_keywords, round(avg(length(content)), 6) AS avg_length,
  round(sum(strlen(content)) / 1048576, 6) AS size_mb FROM n GROUP BY 1""")
def retrieval_index_stats(spark, sf):
    return r.index_stats(r.profile_documents(p.profiles(spark, sf)))


@query("retrieval_index_stats_vectors", "A22", f"""WITH n AS (SELECT doc_id, lang AS index_type, text AS content, len(list_distinct(list_filter(list_transform({WORDS.format('lower(text)')}, lambda x: regexp_replace(x, '[^\\pL\\pN]', '', 'g')),
  lambda u: length(u) > 2 AND u NOT IN {_stop(r.STOP_LONG)}))) AS k FROM documents)
SELECT index_type, count(*) AS documents, count(*) FILTER (k > 0) AS with_keywords, count(*) FILTER (e.vec_id IS NOT NULL) AS with_embeddings, round(avg(k), 6) AS avg_keywords,
  round(avg(length(content)), 6) AS avg_length, round(sum(strlen(content)) / 1048576, 6) AS size_mb FROM n LEFT JOIN embeddings e ON e.vec_id = n.doc_id GROUP BY 1""")
def retrieval_index_stats_vectors(spark, sf):
    return r.index_stats(_docs(spark, sf).select(F.col("metadata")["lang"].alias("index_type"), F.col("text").alias("content"), "embedding"))


@query("retrieval_deleted", "R15", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def retrieval_deleted(spark, sf):
    return r.delete_documents(_docs(spark, sf), v.load(spark, sf, "labels").where("quality = 0")).select("doc_id")


@query("retrieval_recommendations", "R16", P + """
SELECT cv_id, concat_ws('|', CASE WHEN len(primary_skills) < 5 THEN 'add more skills' END, CASE WHEN len(projects) < 2 THEN 'add more projects' END,
  CASE WHEN len(certs) = 0 THEN 'add achievements' END) AS advice FROM profiles WHERE len(primary_skills) + len(projects) + len(certs) > 0""")
def retrieval_recommendations(spark, sf):
    df = p.profiles(spark, sf)
    kinds = F.concat(
        F.transform("primary_skills", lambda _x: F.lit("skill")), F.transform("projects", lambda _x: F.lit("project")), F.transform("certs", lambda _x: F.lit("achievement"))
    )
    items = df.select("cv_id", F.explode_outer(kinds).alias("index_type")).where("index_type IS NOT NULL")
    return r.index_recommendations(items).withColumn("advice", F.array_join("advice", "|"))


@query("retrieval_suggestions", "R17", "WITH " + tx.TEXTS + """,
l AS (SELECT doc_id % 50 AS query_id, doc_id AS rank, list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'location'))[1] AS line FROM resumes),
s AS (SELECT query_id, trim(string_split(line, ':')[-1]) AS suggestion, min(rank) AS rank FROM l WHERE trim(string_split(line, ':')[-1]) <> '' GROUP BY ALL)
SELECT query_id, suggestion, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, suggestion) AS position FROM s QUALIFY position <= 5""")
def retrieval_suggestions(spark, sf):
    results = tx.resumes(spark, sf).selectExpr("doc_id % 50 AS query_id", "doc_id AS rank", "text AS content")
    return r.field_suggestions(results, "location").withColumn("position", F.col("position").cast("long"))
