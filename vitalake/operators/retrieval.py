"""Chunking, keyword and vector retrieval, fusion and re-ranking.

Documents and queries meet in one of two ways. Keyword scores use postings and
an equi-join on the keyword, salted by document so that a keyword that most
documents contain spreads over many tasks. Vector and substring scores have no
key to join on: documents are hashed into tiles, queries into blocks, both of
bounded size, and each (tile, block) emits only its best k per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vitalake.functions import arrays as A
from vitalake.functions.skills import contains_any
from vitalake.functions.text import typed_id
from vitalake.operators.vectors import best_by_vectors
from vitalake.session import stored
from vitalake.operators.term_search import best_by_keywords, best_by_keywords_or_terms, best_by_lines, search_terms

# Stop words of the three keyword modes.
STOP_SHORT = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for"]
STOP_MEDIUM = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "was", "are", "were", "been", "be",
]
STOP_LONG = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "was", "are", "were", "been", "be",
    "as", "have", "has", "had", "do", "does", "did", "will", "would", "should", "could", "may", "might", "can", "this", "that", "these", "those",
]
ROLES = ["developer", "engineer", "manager", "architect", "analyst", "designer"]
SECTION_MARKERS = ["SUMMARY", "EXPERIENCE", "EDUCATION", "SKILLS", "PROJECTS", "CERTIFICATIONS", "AWARDS"]
RRF_CONSTANT = 60
SALTS = 16
TILE_ROWS = 20_000
BLOCK_ROWS = 512


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _range(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


# --- chunks


def chunk_words(df: DataFrame, *, size: int = 500, overlap: int = 50, key: str = "doc_id") -> DataFrame:
    """R1 b, e: windows of ``size`` words that start every ``size - overlap`` words."""
    step = size - overlap
    words = df.select(key, _words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    # the chunks are cut before the explode: after it every chunk would carry all words
    chunks = F.transform(
        F.sequence(F.lit(0), F.size("_w") - 1, F.lit(step)), lambda s: F.array_join(F.slice("_w", s + 1, F.lit(size)), " "))
    return words.select(key, F.posexplode_outer(chunks).alias("chunk_no", "content"))


def chunk_chars(df: DataFrame, *, size: int = 400, key: str = "doc_id") -> DataFrame:
    """R1 a: words joined until the chunk has ``size`` characters.

    On words one space apart a chunk is ``size`` characters and the rest of the word they end in (the next word, if
    they end in a space): one pass of a pattern over the text, however long.
    """
    joined = F.array_join(_words(F.col("text")), " ")
    chunks = F.regexp_extract_all("_t", F.lit(rf"(?s)\S.{{{size - 1}}}\S*|\S.*"), F.lit(0))
    return df.select(key, joined.alias("_t")).where(F.col("_t") != "").select(key, F.posexplode_outer(chunks).alias("chunk_no", "content"))


def _marked(opens: Column) -> Column:
    """Positions at which ``opens`` is true."""
    return F.filter(F.transform(opens, lambda o, i: F.when(o, i)), lambda i: i.isNotNull())


def _grouped(parts: Column, starts: Column, joiner: str) -> Column:
    """Parts joined per group; ``starts`` are the positions of the parts that start a new group."""
    return A.let(
        F.struct(parts.alias("p"), starts.alias("s")),
        lambda b: F.transform(
            b["s"],
            lambda x, k: F.array_join(F.slice(b["p"], x + 1, F.coalesce(F.get(b["s"], k + 1), F.size(b["p"])) - x), joiner),
        ),
    )


def chunk_paragraphs(df: DataFrame, *, max_words: int = 500, separator: str = "\n\n", key: str = "doc_id") -> DataFrame:
    """R1 c: paragraphs joined while they stay within ``max_words``."""
    parts = F.split("text", separator)
    sizes = F.transform(parts, lambda x: F.size(_words(x)))
    start = F.struct(F.lit(-1).alias("n"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("o"))

    def step(acc: Column, n: Column) -> Column:
        opens = (acc["n"] < 0) | (acc["n"] + n > max_words)
        return F.struct(
            F.when(opens, n).otherwise(acc["n"] + n).alias("n"), (acc["i"] + 1).alias("i"),
            F.when(opens, F.concat(acc["o"], F.array(acc["i"]))).otherwise(acc["o"]).alias("o"),
        )

    marked = df.select(key, parts.alias("_p"), F.aggregate(sizes, start, step)["o"].alias("_o"))
    return marked.select(key, F.posexplode_outer(_grouped(F.col("_p"), F.col("_o"), " ")).alias("chunk_no", "content"))


def chunk_sections(df: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """R1 d: a line that contains a section marker starts a chunk."""
    lines = F.split("text", "\n")
    opens = F.transform(lines, lambda x, i: (i == 0) | contains_any(F.upper(x), SECTION_MARKERS))
    marked = df.select(key, lines.alias("_p"), _marked(opens).alias("_o"))
    return marked.select(key, F.posexplode_outer(_grouped(F.col("_p"), F.col("_o"), "\n")).alias("chunk_no", "content"))


# --- keywords and postings


def keywords(text: Column, mode: str = "ordered", max_keywords: int | None = None) -> Column:
    """R2: (``short``) words longer than 3; (``clean``) punctuation to blanks; (``ordered``) letters and digits only.

    Words keep the order of their first appearance (T3). The whole text is read; ``max_keywords`` keeps the first ones of ``short``.
    """
    low = F.lower(text)
    if mode == "short":
        found = F.filter(_words(low), lambda w: (F.length(w) > 3) & ~w.isin(STOP_SHORT))
        return F.array_distinct(found) if max_keywords is None else F.slice(F.array_distinct(found), 1, max_keywords)
    if mode == "clean":
        found = F.filter(_words(F.regexp_replace(low, r"[^\p{L}\p{N}_\s]", " ")), lambda w: (F.length(w) > 2) & ~w.isin(STOP_MEDIUM))
        return F.array_distinct(found)
    if mode == "ordered":
        bare = F.transform(_words(low), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
        return F.array_distinct(F.filter(bare, lambda w: (F.length(w) > 2) & ~w.isin(STOP_LONG)))
    raise ValueError(f"unknown mode {mode}")


def postings(docs: DataFrame, *, key: str = "doc_id", mode: str = "ordered") -> DataFrame:
    """One row per document and distinct keyword, with the document's keyword count."""
    found = docs.select(key, keywords(F.col("text"), mode).alias("_k"))
    return found.select(key, F.size("_k").alias("keyword_count"), F.explode_outer("_k").alias("keyword")).where("keyword IS NOT NULL")


def match_counts(query_postings: DataFrame, doc_postings: DataFrame, *, salts: int = SALTS) -> DataFrame:
    """Shared keywords per (query, document); salted so that a frequent keyword is split by document."""
    salted = doc_postings.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    copies = query_postings.withColumn("_salt", F.explode(_range(salts)))
    return (
        salted.select("doc_id", F.col("keyword_count").alias("doc_keywords"), "keyword", "_salt")
        .join(copies.select("query_id", F.col("keyword_count").alias("query_keywords"), "keyword", "_salt"), ["keyword", "_salt"])
        .groupBy("query_id", "doc_id")
        .agg(F.count(F.lit(1)).alias("matches"), F.first("query_keywords").alias("query_keywords"), F.first("doc_keywords").alias("doc_keywords"))
    )


def keyword_scores(queries: DataFrame, docs: DataFrame, *, scoring: str = "jaccard", mode: str = "ordered") -> DataFrame:
    """R4 a-c: Jaccard, or matched keywords over the query's keywords."""
    counts = match_counts(
        postings(queries, key="query_id", mode=mode), postings(docs, mode=mode)
    )
    m, q, d = F.col("matches"), F.col("query_keywords"), F.col("doc_keywords")
    score = m / (q + d - m) if scoring == "jaccard" else F.least(F.lit(1.0), m / q)
    return counts.select("query_id", "doc_id", F.round(score, 6).alias("score"))


def best_keyword_scores(queries: DataFrame, docs: DataFrame, *, k: int, scoring: str = "jaccard", mode: str = "ordered") -> DataFrame:
    """The rows of :func:`keyword_scores` that are among a query's ``k`` best, without a shuffle of postings."""
    q = queries.select("query_id", keywords(F.col("text"), mode).alias("keywords"))
    d = docs.select("doc_id", keywords(F.col("text"), mode).alias("keywords"))
    return best_by_keywords(q, d, scoring=scoring, k=k).select("query_id", "doc_id", "score")


def best_line_scores(queries: DataFrame, docs: DataFrame, *, k: int) -> DataFrame:
    """The rows of :func:`substring_scores` by ``lines`` that are among a query's ``k`` best, in one pass. A query without a
    word is searched as a text, like there."""
    found = best_by_lines(queries, docs, k=k).select("query_id", "doc_id", "score")
    blank = queries.where(F.size(_words(F.col("text"))) == 0)
    return found if blank.isEmpty() else found.unionByName(rank_results(substring_scores(blank, docs.where("text IS NOT NULL"), scoring="lines"), k=k).drop("rank"))


def best_combined_scores(queries: DataFrame, docs: DataFrame, *, k: int) -> DataFrame:
    """The rows of :func:`combine_first` over :func:`keyword_scores` by ``share`` and :func:`substring_scores` by ``fuzzy`` that
    are among a query's ``k`` best, in one pass."""
    q, d = (df.select(key, "text", keywords(F.col("text")).alias("keywords")) for df, key in ((queries, "query_id"), (docs, "doc_id")))
    return best_by_keywords_or_terms(q, d, k=k).select("query_id", "doc_id", "score")


def rank_results(scores: DataFrame, *, k: int | None = 5, min_score: float | None = None) -> DataFrame:
    """Rank per query by score, ties by document id; the rank limit also runs before the shuffle."""
    if min_score is not None:
        scores = scores.where(F.col("score") >= min_score)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = scores.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


# --- tiles and blocks


def _cells(n: int, per: int) -> int:
    return max(1, math.ceil(n / per))


def tiled(queries: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_tile`` and ``_block``: every document meets every query in exactly one cell.

    Cells hold about TILE_ROWS documents and BLOCK_ROWS queries, whatever the
    table sizes; ids are hashed, so no cell depends on the data's skew.
    """
    n_docs, blocks = docs.count(), _cells(queries.count(), BLOCK_ROWS)
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    tiles = max(_cells(n_docs, TILE_ROWS), min(parallel, _cells(n_docs, 64)))
    left = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn(
        "_tile", F.explode(_range(tiles))
    )
    right = docs.withColumn("_tile", F.pmod(F.xxhash64("doc_id"), F.lit(tiles))).withColumn(
        "_block", F.explode(_range(blocks))
    )
    return left, right


def vector_scores(queries: DataFrame, docs: DataFrame, *, k: int) -> DataFrame:
    """Cosine of the ``k`` best documents of every query, see :func:`vectors.best_by_vectors`."""
    return best_by_vectors(queries, docs, k=k).drop("rank")


def _levels(terms: Column) -> Column:
    """Distinct terms that occur at least once, at least twice, ...: a repeated query term counts each time."""
    distinct = F.array_distinct(terms)
    counted = F.transform(distinct, lambda t: F.struct(t.alias("t"), F.size(F.filter(terms, lambda x: x == t)).alias("n")))
    return A.let(counted, lambda c: F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(c, lambda s: s["n"])), F.lit(1)))),
        lambda n: F.transform(F.filter(c, lambda s: s["n"] >= n), lambda s: s["t"]),
    ))


def substring_scores(queries: DataFrame, docs: DataFrame, *, scoring: str = "share") -> DataFrame:
    """R4 d, e and R10 by substring: ``count``, ``share``, ``fuzzy`` (share x 0.8) or ``lines``; only scores above 0.

    Each document row meets the query blocks of its tile. The block's distinct
    terms are searched in the document once; every query then intersects its
    terms with those found, so a row leaves only for a (query, document) with a
    score. A term holds no blank, so the distinct words stand for the text.
    """
    left, right = tiled(queries.select("query_id", F.lower("text").alias("q")), docs.select("doc_id", F.lower("text").alias("d")))
    terms = left.withColumn("_terms", _words(F.col("q")))
    packed = terms.groupBy("_tile", "_block").agg(
        F.collect_list(F.struct("query_id", "q", F.size("_terms").alias("n"), _levels(F.col("_terms")).alias("levels"))).alias("queries"),
        F.array_distinct(F.flatten(F.collect_list(F.array_distinct("_terms")))).alias("_all"),
    )
    words = right.withColumn("_words", F.array_join(F.array_distinct(_words(F.col("d"))), " "))
    pairs = words.join(packed, ["_tile", "_block"])
    # bound by let: a column that a lambda reads once would be folded into it and searched again per query
    found = F.filter("_all", lambda w: F.col("_words").contains(w))

    def hits(x: Column, held: Column) -> Column:
        return F.aggregate(x["levels"], F.lit(0), lambda a, level: a + F.size(F.array_intersect(level, held)))

    def share(x: Column, held: Column) -> Column:
        return F.when(x["n"] > 0, hits(x, held) / x["n"]).otherwise(0.0)

    def per_query(score) -> Column:
        return F.transform("queries", lambda x: F.struct(x["query_id"].alias("query_id"), F.round(score(x), 6).alias("score")))

    if scoring == "lines":
        def line_score(x: Column, lines: Column) -> Column:
            total = F.aggregate(lines, F.lit(0.0), lambda a, s: a + F.when(s["l"].contains(x["q"]), 1.0).otherwise(share(x, s["found"])))
            return F.least(F.lit(1.0), total / F.greatest(F.lit(1), F.size(lines)))

        scored = A.let(found, lambda f: A.let(
            F.transform(F.split("d", "\n"), lambda line: F.struct(line.alias("l"), F.filter(f, lambda w: line.contains(w)).alias("found"))),
            lambda lines: per_query(lambda x: line_score(x, lines)),
        ))
    elif scoring == "count":
        scored = A.let(found, lambda f: per_query(lambda x: hits(x, f).cast("double")))
    else:
        factor = {"share": 1.0, "fuzzy": 0.8}[scoring]
        scored = A.let(found, lambda f: per_query(lambda x: share(x, f) * factor))
    out = A.explode_items(pairs, ["doc_id"], scored, "s").select("s.query_id", "doc_id", "s.score")
    return out.where("score > 0")


# --- fusion and re-ranking of score tables (query_id, doc_id, score)


def weighted_hybrid(semantic: DataFrame, keyword: DataFrame, *, weights: tuple[float, float] = (0.7, 0.3), k: int | None = 5) -> DataFrame:
    """Weighted sum over the best 2k of each list (whole lists when ``k`` is None)."""
    cut = None if k is None else 2 * k
    s = rank_results(semantic, k=cut).select("query_id", "doc_id", F.col("score").alias("_s"))
    w = rank_results(keyword, k=cut).select("query_id", "doc_id", F.col("score").alias("_k"))
    joined = s.join(w, ["query_id", "doc_id"], "full_outer")
    score = F.coalesce("_s", F.lit(0.0)) * weights[0] + F.coalesce("_k", F.lit(0.0)) * weights[1]
    return joined.select("query_id", "doc_id", F.round(score, 8).alias("score"))


def reciprocal_rank_fusion(lists: Iterable[DataFrame], *, k: int = 5) -> DataFrame:
    """Sum of 1 / (60 + rank) over the best 2k of each list."""
    out = None
    for scores in lists:
        part = rank_results(scores, k=2 * k).select("query_id", "doc_id", (1.0 / (F.col("rank") + RRF_CONSTANT)).alias("_p"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("query_id", "doc_id").agg(F.round(F.sum("_p"), 6).alias("score"))


def combine_first(lists: Iterable[DataFrame]) -> DataFrame:
    """U8: union of result lists; a document keeps the score of the first list that has it."""
    out = None
    for position, scores in enumerate(lists):
        part = scores.select("query_id", "doc_id", "score", F.lit(position).alias("_p"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("query_id", "doc_id").agg(F.min_by("score", "_p").alias("score"))


def query_context(text: Column) -> Column:
    """Role and seniority named in a query."""
    low = F.lower(text)
    role = F.coalesce(*[F.when(low.contains(r), F.lit(r)) for r in ROLES])
    seniority = (
        F.when(contains_any(low, ["senior", "lead", "principal"]), "senior").when(contains_any(low, ["junior", "entry"]), "junior").otherwise("mid")
    )
    return F.struct(role.alias("role"), seniority.alias("seniority"))


def context_boost(scores: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """x1.3 for an equal role, x1.2 for equal seniority, x1.2 for an equal domain."""
    q = queries.select("query_id", query_context(F.col("text")).alias("c"), *(["domain"] if "domain" in queries.columns else []))
    joined = scores.join(q, "query_id").join(docs.select("doc_id", "metadata"), "doc_id")

    def same(key: str, value: Column, factor: float) -> Column:
        return F.when(F.try_element_at("metadata", F.lit(key)) == value, factor).otherwise(1.0)

    boost = same("role", F.col("c.role"), 1.3) * same("seniority", F.col("c.seniority"), 1.2)
    if "domain" in queries.columns:
        boost = boost * same("domain", F.col("domain"), 1.2)
    return joined.select("query_id", "doc_id", F.round(F.col("score") * boost, 10).alias("score"))


def context_boost_given(scores: DataFrame, context: DataFrame, docs: DataFrame) -> DataFrame:
    """R8, given context: x1.3 if the document's role holds the context's (any case), x1.2 for an equal experience level,
    x1.15 if the document's industries hold the context's; a part that either side lacks changes nothing.

    ``context`` is (query_id, role, experience_level, industry), ``docs`` (doc_id, role, experience_level, industries).
    """
    joined = scores.join(context.alias("c"), "query_id", "left").join(docs.alias("d"), "doc_id", "left")

    def factor(test: Column, by: float) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), by).otherwise(1.0)

    boost = factor(F.lower("d.role").contains(F.lower("c.role")), 1.3) * factor(F.col("c.experience_level") == F.col("d.experience_level"), 1.2)
    boost = boost * factor(F.array_contains("d.industries", F.col("c.industry")), 1.15)
    return joined.select("query_id", "doc_id", F.round(F.col("score") * boost, 10).alias("score"))


def rerank(scores: DataFrame, queries: DataFrame, docs: DataFrame, *, method: str = "signals") -> DataFrame:
    """``signals`` x1.1 with a creation time and x1.2 for the exact phrase; ``overlap`` x (1 + 0.1 shared words)."""
    joined = scores.join(queries.select("query_id", F.lower("text").alias("q")), "query_id").join(
        docs.select("doc_id", F.lower("text").alias("d"), *(["metadata"] if "metadata" in docs.columns else [])), "doc_id"
    )
    if method == "signals":
        dated = F.map_contains_key("metadata", "created_at") if "metadata" in docs.columns else F.lit(False)
        boost = F.when(dated, 1.1).otherwise(1.0) * F.when(F.col("d").contains(F.col("q")), 1.2).otherwise(1.0)
    else:
        boost = 1 + F.size(F.array_intersect(A.words(F.col("q")), A.words(F.col("d")))) * 0.1
    return joined.select("query_id", "doc_id", F.round(F.col("score") * boost, 6).alias("score"))


def metadata_filter(docs: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Every pair must be equal; a missing key is no match. Filters run before scoring."""
    for key, value in filters.items():
        docs = docs.where(F.coalesce(F.try_element_at("metadata", F.lit(key)) == value, F.lit(False)))
    return docs


def retrieve(
    queries: DataFrame, docs: DataFrame, *, strategy: str = "hybrid", k: int = 5, filters: dict[str, str] | None = None,
    min_score: float | None = None,
) -> DataFrame:
    """Ranked results by ``keyword``, ``semantic``, ``hybrid`` or ``contextual`` strategy.

    A query without a vector gets keyword scores: as its only ones in the semantic strategy, as its keyword share in the others.
    """
    if filters:
        docs = metadata_filter(docs, filters)
    if strategy != "keyword" and not {"embedding"} <= set(queries.columns) & set(docs.columns):
        strategy = "keyword"
    if strategy == "keyword":
        scores = best_keyword_scores(queries, docs, mode="short", k=k)
    elif strategy == "semantic":
        scores = vector_scores(queries.where("embedding IS NOT NULL"), docs.where("embedding IS NOT NULL"), k=k).unionByName(
            best_keyword_scores(queries.where("embedding IS NULL"), docs, mode="short", k=k))
    else:
        depth = k if strategy == "hybrid" else 2 * k
        scores = weighted_hybrid(
            vector_scores(queries.where("embedding IS NOT NULL"), docs.where("embedding IS NOT NULL"), k=2 * depth),
            best_keyword_scores(queries, docs, mode="short", k=2 * depth), k=depth,
        )
        if strategy == "contextual":
            scores = context_boost(rank_results(scores, k=2 * k).drop("rank"), queries, docs)
    return rank_results(scores, k=k, min_score=min_score)


def search(queries: DataFrame, docs: DataFrame, *, index_type: str | None = None, user_id: str | None = None, k: int = 5) -> DataFrame:
    """Type and user filters, then the share of the query's terms, with the terms found."""
    if index_type:
        docs = docs.where(F.col("index_type") == index_type)
    if user_id:
        docs = docs.where(F.col("user_id") == user_id)
    return search_terms(queries, docs, k=k)


def similar_documents(sources: DataFrame, docs: DataFrame, *, k: int = 5, mode: str = "ordered") -> DataFrame:
    """Documents by shared keywords with each source, score relative to the source's best; never itself.

    ``sources`` is (query_id, text); where its ids are document ids, the source is excluded by ``source_doc_id``.
    Sources of equal keywords are searched once. Where documents are searched with one another, only the first documents of each
    set of keywords meet them, since equal sets score alike: the work grows with the pairs of different sets.
    """
    own = "source_doc_id" in sources.columns
    asked = sources.select("query_id", F.array_sort(keywords(F.col("text"), mode)).alias("keywords")).where(F.size("keywords") > 0).distinct().withColumn(
        "_set", F.array_join("keywords", " "))
    held = docs.select("doc_id", F.array_sort(keywords(F.col("text"), mode)).alias("keywords")).where(F.size("keywords") > 0)
    if own:
        order = W.partitionBy(F.array_join("keywords", " ")).orderBy(F.col("doc_id").asc_nulls_last())
        first = held.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1).drop("_n")
        asked, held = stored(asked, "similar-asked"), first
    sets = asked.select(F.col("_set").alias("query_id"), "keywords").distinct()
    found = best_by_keywords(sets, held, scoring="count", k=k + own).select(F.col("query_id").alias("_set"), "doc_id", "score")
    counts = asked.select("query_id", "_set").join(found, "_set").drop("_set")
    if own:
        counts = counts.join(sources.select("query_id", F.col("source_doc_id").alias("doc_id")), ["query_id", "doc_id"], "left_anti")
    best = F.max("score").over(W.partitionBy("query_id"))  # over the k best of a query: its best one is among them
    return rank_results(counts.withColumn("score", F.round(F.col("score") / best, 6)), k=k)


def similar_query(df: DataFrame) -> Column:
    """Query text of a record: role, years and the first skills."""
    return F.concat_ws(
        " ", F.nullif(F.trim("title"), F.lit("")), F.when(F.col("years").isNotNull(), F.concat(F.col("years").cast("string"), F.lit(" years"))),
        F.array_join(F.slice("primary_skills", 1, 5), " "),
    )


# --- index maintenance


def profile_documents(df: DataFrame) -> DataFrame:
    """One indexed document per section item of each record."""
    def doc(kind: str, content: Column) -> Column:
        return F.struct(F.lit(kind).alias("index_type"), content.alias("content"))

    one = F.array(
        doc("summary", F.concat(F.lit("Professional Summary: "), F.coalesce("summary", F.lit("")))),
        doc("skills", F.concat(F.lit("Skills: "), F.array_join(F.concat("primary_skills", "secondary_skills"), ", "))),
        doc("header", F.concat(F.lit("Name: "), "full_name", F.lit(" Title: "), F.trim("title"))),
    )
    work = F.transform("work", lambda w: doc("experience", F.concat(F.lit("Role: "), w["designation"], F.lit(" Company: "), w["organization"], F.lit(" "), w["description"])))
    projects = F.transform("projects", lambda x: doc("project", F.concat(F.lit("Project: "), x["name"], F.lit(" Technologies: "), F.array_join(x["technologies"], ", "), F.lit(" "), x["description"])))
    education = F.transform("education", lambda x: doc("education", F.concat(F.lit("Education: "), x["degree"], F.lit(" "), x["institution"], F.lit(" "), x["year"])))
    rows = df.select("cv_id", F.posexplode_outer(F.concat(one, work, projects, education)).alias("position", "d"))
    return rows.select("cv_id", "position", "d.index_type", "d.content", typed_id(F.col("d.index_type"), F.col("d.content")).alias("content_key"))


def index_stats(docs: DataFrame) -> DataFrame:
    """Per type: documents, with keywords, with vectors (where there is a column ``embedding``), mean keywords and
    characters, megabytes."""
    found = docs.withColumn("_k", F.size(keywords(F.col("content"))))
    held = [F.count(F.when(F.size("embedding") > 0, 1)).alias("with_embeddings")] if "embedding" in docs.columns else []
    return found.groupBy("index_type").agg(
        F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("_k") > 0, 1)).alias("with_keywords"), *held,
        F.round(F.avg("_k"), 6).alias("avg_keywords"), F.round(F.avg(F.length("content")), 6).alias("avg_length"),
        F.round(F.sum(F.octet_length("content")) / 1048576, 6).alias("size_mb"),
    )


def delete_documents(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """Index without the removed ids (postings are derived from it)."""
    return docs.join(removed.select("doc_id"), "doc_id", "left_anti")


def index_recommendations(docs: DataFrame) -> DataFrame:
    """Advice per record from the number of indexed items."""
    counts = docs.groupBy("cv_id").agg(
        *[F.count(F.when(F.col("index_type") == t, 1)).alias(t) for t in ("skill", "project", "achievement")]
    )
    advice = F.array_compact(F.array(
        F.when(F.col("skill") < 5, F.lit("add more skills")), F.when(F.col("project") < 2, F.lit("add more projects")),
        F.when(F.col("achievement") == 0, F.lit("add achievements")),
    ))
    return counts.select("cv_id", advice.alias("advice"))


def field_suggestions(results: DataFrame, field: str, *, k: int = 5) -> DataFrame:
    """Distinct values after the last colon of the first line with the field name, by rank.

    ``results`` is (query_id, rank, content).
    """
    line = F.get(F.filter(F.split("content", "\n"), lambda x: F.lower(x).contains(field.lower())), F.lit(0))
    value = F.trim(F.substring_index(line, ":", -1))
    found = results.select("query_id", "rank", value.alias("suggestion")).where("suggestion <> ''")
    first = found.groupBy("query_id", "suggestion").agg(F.min("rank").alias("rank"))
    order = W.partitionBy("query_id").orderBy("rank", "suggestion")
    return first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def save_index(docs: DataFrame, path: str) -> None:
    """Indexed documents as parquet; postings are not stored."""
    docs.write.mode("error").parquet(path)


def load_index(spark, path: str, *, mode: str = "ordered") -> tuple[DataFrame, DataFrame]:
    """(documents, rebuilt postings)."""
    docs = spark.read.parquet(path)
    return docs, postings(docs, mode=mode)
