"""Source divergence audit: how far each source's use of words lies from the other sources of its language.

Tasks cut texts with the translate table, count each document by itself and add the counts up by (language, source)
before anything is shuffled. All later work is sparse: a term that neither of two sources holds has the same rate
for all such terms, so only terms that occur are ever rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vitalake.llm import bytewords, vec
from vitalake.session import fresh_path

#: A rate is a whole number of billionths, plus one.
UNIT = 1_000_000_000
NAMES = ["lang", "source", "term", "n", "d"]


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", held: int = 200_000) -> DataFrame:
    """Rows ``(lang, source, term, n, d)``: occurrences of a term and documents that hold it.

    Every group has one more row with a null term, so groups without terms are there too. Null texts, languages and
    sources count as ''. A task holds about ``held`` terms and the longest text's own ones; more are sent on early.
    """
    def read(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    def send(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (uses, seen) in groups.items():
            terms = [None, *(t.decode() for t in uses)]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.string()),
                pa.array([0, *uses.values()], pa.int64()), pa.array([0, *(seen[t] for t in uses)], pa.int64()),
            ], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            data, offsets = vec.utf8(batch.column(2))
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                counts: Counter = Counter()
                for part in bytewords.words(data[offsets[i] : offsets[i + 1]].tobytes(), bytewords.LETTERS):
                    counts.update(part)
                if key not in groups:
                    groups[key] = (Counter(), Counter())
                    size += 1
                uses, seen = groups[key]
                size -= len(uses)
                uses.update(counts)
                seen.update(counts.keys())
                size += len(uses)
                if size > held:
                    yield from send(groups)
                    groups, size = {}, 0
        yield from send(groups)

    slim = docs.select(read(lang_col).alias("_l"), read(source_col).alias("_s"), read(text_col).alias("_t"))
    partial = slim.mapInArrow(run, "lang string, source string, term string, n long, d long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _rate(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / total), exact at any size; null if the total is 0."""
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), F.nullif(total, F.lit(0)).cast("decimal(20,0)")) + 1


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = 200,
) -> DataFrame:
    """Rows ``(lang, source, part, item, value, rank)``.

    A language keeps the terms of at least ``min_docs`` of its documents. Part ``pair`` ranks the other sources of the
    language by their distance, summed over all kept terms; part ``term`` the ``top`` terms that a source uses more
    than its language does. Equal values follow by item. Null languages, sources and texts count as ''; other columns
    are not read; repeated rows are documents of their own; an empty table gives no rows.

    The counts are written once to the shared folder. Rows meet by (language, term), at most one per source; what is
    squared is the number of sources of a language, as in the result.
    """
    spark = docs.sparkSession
    of_term = W.partitionBy("lang", "term")
    path = fresh_path(spark, "divergence-counts")
    term_counts(docs, text_col, lang_col, source_col).withColumns({
        "in_docs": F.sum("d").over(of_term), "lang_n": F.sum("n").over(of_term), "one": (F.col("source") == F.min("source").over(of_term)).cast("long"),
    }).where(F.col("term").isNull() | (F.col("in_docs") >= min_docs)).select("lang", "source", "term", "n", "lang_n", "one").write.parquet(path)
    kept = spark.read.parquet(path)

    path = fresh_path(spark, "divergence-groups")
    of_lang = W.partitionBy("lang")
    kept.groupBy("lang", "source").agg(
        F.sum("n").alias("n_group"), F.sum(F.when(F.col("term").isNotNull(), F.col("one")).otherwise(0)).alias("firsts"),
    ).withColumns({"n_terms": F.sum("firsts").over(of_lang), "n_lang": F.sum("n_group").over(of_lang)}).withColumn(
        "rest", _rate(F.lit(0), F.col("n_group") + F.col("n_terms"))
    ).select("lang", "source", "n_group", "n_terms", "n_lang", "rest").write.parquet(path)
    groups = spark.read.parquet(path)

    rated = kept.where(F.col("term").isNotNull()).join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "rest", _rate(F.col("n"), F.col("n_group") + F.col("n_terms")).alias("p"),
        _rate(F.col("lang_n"), F.col("n_lang") + F.col("n_terms")).alias("q"),
    )
    terms = rated.where(F.col("p") > F.col("q")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))

    other = groups.select("lang", F.col("source").alias("item"), F.col("rest").alias("item_rest"))
    p, rest, item_rest = F.col("p"), F.col("rest"), F.col("item_rest")
    # as if no source held any term
    base = groups.join(other, "lang").where(F.col("source") != F.col("item")).select(
        "lang", "source", "item", F.when(F.col("n_terms") > 0, F.col("n_terms") * _gap(rest, item_rest)).otherwise(0).alias("value"))
    # what changes for the terms that one of the two holds: equal rates change equally, so they are counted first
    rates = rated.groupBy("lang", "source", "p", "rest").agg(F.count(F.lit(1)).alias("many"))
    alone = rates.join(other, "lang").where(F.col("source") != F.col("item")).groupBy("lang", "source", "item").agg(
        F.sum(F.col("many") * (_gap(p, item_rest) - _gap(rest, item_rest))).alias("ahead"),
        F.sum(F.col("many") * (_gap(item_rest, p) - _gap(item_rest, rest))).alias("back"),
    )
    # and what that leaves wrong for terms of both
    mine = rated.select("lang", "term", "source", "p", "rest")
    theirs = rated.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("item_p"), F.col("rest").alias("item_rest"))
    item_p = F.col("item_p")
    both = mine.join(theirs, ["lang", "term"]).where(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(
        F.sum(_gap(p, item_p) - _gap(p, item_rest) - _gap(rest, item_p) + _gap(rest, item_rest)).alias("ahead"),
        F.sum(_gap(item_p, p) - _gap(item_p, rest) - _gap(item_rest, p) + _gap(item_rest, rest)).alias("back"),
    )
    changes = alone.unionByName(both)
    pairs = base.unionByName(changes.select("lang", "source", "item", F.col("ahead").alias("value"))).unionByName(
        changes.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))
    ).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    ranked = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top).unionByName(
        pairs.withColumn("rank", F.row_number().over(ranked)))


def sql(docs: str, min_docs: int = 3, top: int = 200) -> str:
    """DuckDB text of ``audit`` over the relation ``docs``, with a row for every group and kept term."""
    return f"""
WITH cut AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM {docs}),
uses AS (SELECT doc, lang, source, unnest(terms) AS term FROM cut),
counts AS (SELECT lang, source, term, count(*) AS n FROM uses GROUP BY lang, source, term),
kept AS (SELECT lang, term, count(*) AS n FROM uses GROUP BY lang, term HAVING count(DISTINCT doc) >= {min_docs}),
sizes AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM cut),
filled AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
totals AS (SELECT lang, source, sum(n)::BIGINT AS n FROM filled GROUP BY lang, source),
rated AS (
  SELECT f.lang, f.source, f.term, f.n, 1 + ({UNIT} * (f.n + 1)) // (t.n + s.v) AS p, 1 + ({UNIT} * (f.lang_n + 1)) // (s.n + s.v) AS q
  FROM filled f JOIN totals t ON f.lang = t.lang AND f.source = t.source JOIN sizes s ON f.lang = s.lang),
gaps AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM rated a JOIN rated b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(g.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM rated WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""
