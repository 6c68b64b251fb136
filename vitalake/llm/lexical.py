"""Ranked lexical search over a length-stratified index.

Documents with equal length normaliser form a stratum, and inside a stratum the postings of a term lie by falling
term frequency. One stratum has one impact per frequency, so each is computed once; the first posting of a list
bounds all of it, and the sum of these bounds over an item's terms bounds every document of the stratum. Strata
are visited by falling bound until none can still reach an item's k best.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from vitalake.llm import bytewords, mix, vec
from vitalake.session import fresh_path


def index_documents(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, n, terms, tfs)`` of all documents that have a term: all their terms counted, those of the vocabulary listed."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            data, offsets = vec.utf8(batch.column(1))
            for a, b in vec.blocks(offsets, 8 << 20):
                rows, sizes, ends, terms, tfs = [], [], [0], [], []
                for i in range(a, b):
                    counts: Counter = Counter()
                    for part in bytewords.words(data[offsets[i] : offsets[i + 1]].tobytes(), bytewords.ALPHANUMERIC):
                        counts.update(part)
                    if counts:
                        hits = known.keys() & counts.keys()
                        rows.append(i)
                        sizes.append(counts.total())
                        terms.extend([known[t] for t in hits])
                        tfs.extend([counts[t] for t in hits])
                        ends.append(len(terms))
                where = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(where, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(where, pa.array(tfs, pa.int32())),
                ], names=[id_col, "n", "terms", "tfs"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return slim.mapInArrow(run, f"`{id_col}` {kind}, n long, terms array<int>, tfs array<int>")


@dataclass(frozen=True)
class Query:
    """Items as ranges of ``terms`` and ``repeats``, weights by term, and the two totals that give the normaliser."""

    ends: np.ndarray
    terms: np.ndarray
    repeats: np.ndarray
    weights: np.ndarray
    n_docs: int
    n_terms: int


class Strata:
    """The index of one block of documents."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, query: Query):
        lengths, which = np.unique(sizes, return_inverse=True)
        norms = np.array([100 - 25 + 25 * int(n) * query.n_docs // query.n_terms for n in lengths], np.int64)
        norms, of_length = np.unique(norms, return_inverse=True)
        stratum = of_length[which]
        docs = np.repeat(np.arange(sizes.size), counts)
        at = stratum[docs]
        order = np.lexsort((-tfs, at, terms))
        self.docs, at, terms, tfs = docs[order], at[order], terms[order], tfs[order]
        self.values = np.zeros(tfs.size, np.int64)
        list_starts = runs = np.empty(0, np.int64)
        if tfs.size:
            new_list = np.concatenate([[True], (np.diff(terms) != 0) | (np.diff(at) != 0)])
            list_starts = np.flatnonzero(new_list)
            runs = np.flatnonzero(new_list | np.concatenate([[True], np.diff(tfs) != 0]))  # one impact for each
            tf = tfs[runs].astype(np.int64)
            impacts = query.weights[terms[runs]] * (1_000_000_000 * tf // (1000 * tf + 12 * norms[at[runs]]))
            self.values = np.repeat(impacts, np.diff(np.concatenate([runs, [tfs.size]])))
        self.starts, self.lengths = list_starts, np.diff(np.concatenate([list_starts, [tfs.size]]))
        self.stratum, self.bounds = at[list_starts], self.values[list_starts]
        self.first = np.searchsorted(terms[list_starts], np.arange(query.weights.size + 1))  # lists of each term
        self.n_strata = norms.size
        self.scores = np.zeros(sizes.size, np.int64)

    def search(self, terms: np.ndarray, repeats: np.ndarray, k: int, floor: int, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best with a score of ``floor`` or more; equal scores by ``tie``."""
        many = self.first[terms + 1] - self.first[terms]
        lists = vec.ranges(self.first[terms], many)
        times = np.repeat(repeats, many)
        bounds = np.zeros(self.n_strata, np.int64)
        np.add.at(bounds, self.stratum[lists], self.bounds[lists] * times)
        by_stratum = np.argsort(self.stratum[lists], kind="stable")
        lists, times = lists[by_stratum], times[by_stratum]
        ends = np.searchsorted(self.stratum[lists], np.arange(self.n_strata + 1))
        visits = np.argsort(-bounds, kind="stable")
        best_docs, best = np.empty(0, np.int64), np.empty(0, np.int64)
        at, step = 0, 1
        while at < visits.size and bounds[visits[at]] >= floor:
            some = visits[at : at + step]
            some = some[bounds[some] >= floor]
            chosen = vec.ranges(ends[some], ends[some + 1] - ends[some])
            rows = vec.ranges(self.starts[lists[chosen]], self.lengths[lists[chosen]])
            docs = self.docs[rows]
            np.add.at(self.scores, docs, self.values[rows] * np.repeat(times[chosen], self.lengths[lists[chosen]]))
            docs = np.unique(docs)
            found = self.scores[docs]
            self.scores[docs] = 0
            good = found >= floor
            best_docs, best = np.concatenate([best_docs, docs[good]]), np.concatenate([best, found[good]])
            if best.size > k:
                top = np.lexsort((tie[best_docs], -best))[:k]
                best_docs, best = best_docs[top], best[top]
            if best.size == k:
                floor = max(floor, int(best.min()))
            at, step = at + step, step * 2
        return best_docs, best


def _id_key(value) -> tuple:
    return value is None, value if value is not None else 0


def _item_blocks(items: DataFrame, block_bytes: int) -> DataFrame:
    """Items with the number of their block; a block holds about ``block_bytes`` of text."""
    sliced = items.withColumns({"_all": F.lit(0), "_hash": F.xxhash64("_item", "_text"), "_bytes": F.octet_length("_text") + 1})
    placed = mix.running_sum(sliced.withColumn("_slice", F.shiftrightunsigned("_hash", 54)), ["_all"], "_slice", ["_hash", "_item", "_text"], "_bytes", "_before")
    return placed.select("_item", "_text", F.floor(F.col("_before") / block_bytes).alias("_block"))


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    k: int = 20, block_bytes: int = 1 << 20, block_postings: int = 1 << 20,
) -> DataFrame:
    """Rows ``(item, rank, id, score)``: the ``k`` best documents of each item with a score above 0.

    Every row of ``docs`` is a document, repeated ones too; equal scores go by id, null ids last. Null or empty texts
    have no terms. Equal rows of ``items`` count once, rows with one id and different texts are items of their own. Ids
    may be numbers or text. Either table may be empty: so is the result then. Other columns are not read.

    Items come in blocks of about ``block_bytes`` of text, which bounds what is broadcast; each block writes the
    postings of its terms once and reads them twice, for the document frequencies and for the search. A task sends on
    at most ``k`` rows for each item of the block, whatever it read, so no term, stratum or source is a hot key.
    """
    spark = docs.sparkSession
    whole = isinstance(items.schema[item_col].dataType, T.IntegralType)
    item_kind, item_type = ("bigint", pa.int64()) if whole else ("string", pa.string())
    wanted = items.select(F.col(item_col).cast(item_kind).alias("_item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("_text")).distinct()
    blocks = _item_blocks(wanted, block_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_number int, `{item_col}` {item_kind}, `{id_col}` {kind}, score long"

    def one_block(rows: list) -> DataFrame:
        counted = [Counter(t for part in bytewords.words(r["_text"].encode(), bytewords.ALPHANUMERIC) for t in part) for r in rows]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
        path = fresh_path(spark, "lexical-index")
        index_documents(docs, vocabulary, id_col, text_col).write.parquet(path)
        index = spark.read.parquet(path)
        total = index.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        weights = np.zeros(len(vocabulary), np.int64)
        for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # a row per term of the block
            weights[r["t"]] = math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * r["count"] + 1)))
        shared = spark.sparkContext.broadcast(([r["_item"] for r in rows], Query(
            np.cumsum([0, *map(len, counted)]), np.array([vocabulary[t] for c in counted for t in c], np.int64),
            np.array([n for c in counted for n in c.values()], np.int64), weights, total["docs"], total["terms"],
        )))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, query = shared.value
            best: list[list[tuple]] = [[] for _ in names]
            id_type = None
            for batch in batches:
                id_type = batch.column(0).type
                offsets = batch.column(2).offsets.to_numpy().astype(np.int64)
                for a, b in vec.blocks(offsets, block_postings):
                    part = batch.slice(a, b - a)
                    ids = part.column(0)
                    tie = np.empty(len(ids), np.int64)
                    tie[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
                    strata = Strata(
                        part.column(1).to_numpy(), np.diff(offsets[a : b + 1]),
                        part.column(2).flatten().to_numpy().astype(np.int64), part.column(3).flatten().to_numpy().astype(np.int64), query,
                    )
                    for item in range(len(names)):
                        span = slice(query.ends[item], query.ends[item + 1])
                        floor = -best[item][-1][0] if len(best[item]) == k else 1
                        at, scores = strata.search(query.terms[span], query.repeats[span], k, floor, tie)
                        if at.size:
                            found = [(-s, *_id_key(ids[d].as_py())) for s, d in zip(scores.tolist(), at.tolist())]
                            best[item] = sorted(best[item] + found)[:k]
            if id_type is not None:
                flat = [(i, names[i], None if null else name, -s) for i, rows in enumerate(best) for s, null, name in rows]
                columns = list(zip(*flat)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([
                    pa.array(columns[0], pa.int32()), pa.array(columns[1], item_type), pa.array(columns[2], id_type), pa.array(columns[3], pa.int64()),
                ], names=["_number", item_col, id_col, "score"])

        ranked = W.partitionBy("_number").orderBy(F.col("score").desc(), F.col(id_col).asc_nulls_last())
        return index.select(id_col, "n", "terms", "tfs").mapInArrow(run, schema).withColumn("rank", F.row_number().over(ranked)).where(
            F.col("rank") <= k).select(item_col, "rank", id_col, "score")

    n_blocks = (blocks.agg(F.max("_block")).first()[0] or 0) + 1
    found = None
    for i in range(n_blocks):
        part = one_block(blocks.where(F.col("_block") == i).collect())
        found = part if found is None else found.unionByName(part)
    return found


def sql(docs: str, items: str, k: int = 20) -> str:
    """DuckDB text of ``search`` over two relations, without an index."""
    def terms(column: str) -> str:
        return (f"regexp_extract_all(translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
                "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")

    return f"""
WITH cut AS (SELECT row_number() OVER () AS doc, doc_id, {terms('text')} AS terms FROM {docs}),
sized AS (SELECT doc, doc_id, len(terms)::BIGINT AS n FROM cut WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sized),
asked AS (SELECT item_id, unnest({terms('text')}) AS term FROM (SELECT DISTINCT item_id, text FROM {items})),
wanted AS (SELECT item_id, term, count(*)::BIGINT AS repeats FROM asked GROUP BY item_id, term),
uses AS (SELECT doc, unnest(terms) AS term FROM cut),
tfs AS (SELECT doc, term, count(*)::BIGINT AS tf FROM uses WHERE term IN (SELECT term FROM wanted) GROUP BY doc, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), totals),
impacts AS (
  SELECT f.doc, f.term, w.w * ((1000000000 * f.tf) // (1000 * f.tf + 12 * (100 - 25 + (25 * s.n * t.docs) // t.terms))) AS value
  FROM tfs f JOIN weights w ON f.term = w.term JOIN sized s ON f.doc = s.doc, totals t),
scored AS (SELECT a.item_id, i.doc, sum(i.value * a.repeats)::BIGINT AS score FROM wanted a JOIN impacts i ON a.term = i.term GROUP BY a.item_id, i.doc),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
  FROM scored c JOIN sized s ON c.doc = s.doc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}"""
