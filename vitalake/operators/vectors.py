"""Nearest documents of many query vectors: all of them, or those in the nearest lists.

Query vectors come in blocks of bounded size and are broadcast; the documents stay where they are. A task multiplies a few
thousand document vectors at a time with a block and keeps the best of each query, so neither side is copied to
cells and at most k rows for each task and query are shuffled.

The inverted file divides the documents among coarse centres, fitted on a bounded sample. Every document is in the
list of its nearest centre; a query meets the documents of its nearest lists only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

#: Numbers of a score matrix that a task holds at once.
CELLS = 4_000_000


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of each vector length in a list column."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for size in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == size)
        yield rows, values[offsets[rows][:, None] + np.arange(size)[None, :]].astype(float)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; a zero vector (or one with a missing number) stays zero."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.where(norms > 0, vectors / norms, 0.0), posinf=0.0, neginf=0.0)


def nearest_lists(vectors: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each vector, best first. A vector of another length belongs to the first ones."""
    if vectors.shape[1] != centres.shape[1]:
        return np.tile(np.arange(n), (len(vectors), 1))
    return np.argsort(-(unit(vectors) @ centres.T), axis=1, kind="stable")[:, :n]


class _Best:
    def __init__(self, n: int, k: int):
        self.k, self.top, self.floor = k, [[] for _ in range(n)], np.full(n, -np.inf)

    def offer(self, q: int, scores: np.ndarray, ids: pa.Array, tie: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.floor[q])
        if good.size == 0:
            return
        good = good[np.lexsort((tie[good], -scores[good]))[: self.k]]
        found = [(-scores[i], not ids[i].is_valid, ids[i].as_py() if ids[i].is_valid else 0) for i in good.tolist()]
        self.top[q] = sorted(self.top[q] + found)[: self.k]
        if len(self.top[q]) == self.k:
            self.floor[q] = -self.top[q][-1][0]


def _sampled(docs: DataFrame, about: int) -> DataFrame:
    """About so many documents with a vector, by a hash of the id: hashes lie evenly over 64 bits."""
    held = docs.where(F.col("embedding").isNotNull())
    share = min(1.0, about / max(1, held.count()))
    return held.where(F.xxhash64("doc_id") <= F.lit(min(2**63 - 1, int(-(2**63) + 2**64 * share))))


def fit_lists(docs: DataFrame, lists: int, *, sample: int = 20_000, rounds: int = 10) -> np.ndarray:
    """Centres of ``lists`` lists, fitted on at most about ``sample`` document vectors chosen by a hash of the id.

    Vectors of the most frequent length count; the driver holds the sample and nothing else of the documents.
    """
    chosen = _sampled(docs, sample).select("doc_id", F.col("embedding").cast("array<double>")).orderBy("doc_id").collect()
    by_length: dict[int, list] = {}
    for r in chosen:
        by_length.setdefault(len(r["embedding"]), []).append(r["embedding"])
    if not by_length:
        return np.zeros((1, 1))
    points = unit(np.array(max(by_length.values(), key=len), float))
    centres = points[np.linspace(0, len(points) - 1, min(lists, len(points))).astype(int)]
    for _ in range(rounds):
        own = np.argmax(points @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        filled = np.bincount(own, minlength=len(centres)) > 0
        centres = np.where(filled[:, None], unit(sums), centres)
    return centres


def assign_lists(docs: DataFrame, centres: np.ndarray) -> DataFrame:
    """``doc_id, embedding`` of all documents with the list of each, to be written (``partitionBy("list")``) or searched."""
    shared = docs.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.zeros(batch.num_rows, np.int32)
            for rows, matrix in _matrices(batch.column(1)):
                own[rows] = nearest_lists(matrix, shared.value, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own)], names=["doc_id", "embedding", "list"])

    slim = docs.where(F.col("embedding").isNotNull()).select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return slim.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, embedding array<double>, list int")


def probes_for_recall(listed: DataFrame, centres: np.ndarray, *, k: int = 5, target: float = 0.95, sample: int = 200) -> tuple[int, float]:
    """Fewest lists that a query must meet for a recall of ``target``, and the recall measured with them.

    About ``sample`` documents are searched in all lists; a neighbour is found later exactly if its list is among those
    that the query meets, so one exact search gives the recall for every number of lists.
    """
    asked = _sampled(listed, sample).select(F.col("doc_id").alias("query_id"), "embedding")
    near = best_by_vectors(asked, listed, k=k).join(listed.select("doc_id", "list"), "doc_id").join(asked, "query_id").select("embedding", "list").collect()
    if not near:
        return 1, 1.0
    places = np.array([nearest_lists(np.array([r["embedding"]], float), centres, len(centres))[0].tolist().index(r["list"]) for r in near])
    recall = np.array([(places < p).mean() for p in range(1, len(centres) + 1)])
    probes = int(np.argmax(recall >= target)) + 1
    return probes, float(recall[probes - 1])


def best_by_vectors(
    queries: DataFrame, docs: DataFrame, *, k: int, centres: np.ndarray | None = None, probes: int = 1, block_bytes: int = 16 << 20,
) -> DataFrame:
    """Rows ``(query_id, doc_id, score, rank)``: the ``k`` documents of highest cosine, equal ones by id, null ids last.

    With ``centres``, ``docs`` has the column ``list`` and a query meets its ``probes`` nearest lists only. Scores have six
    decimals; vectors of other lengths than the query's and zero vectors score 0. Null vectors are left out, repeated
    documents rank each, queries of one id have their own list each.
    """
    spark = docs.sparkSession
    held = queries.where(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    size = held.agg(F.sum(F.size("embedding").cast("long") * 8 + 64)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    types = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (docs, "doc_id"))}
    listed = F.col("list").cast("int") if centres is not None else F.lit(0)
    slim = docs.where(F.col("embedding").isNotNull()).select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"), listed.alias("list"))

    def one_block(rows: list) -> DataFrame:
        vectors = [np.array(r["embedding"], float) for r in rows]
        sizes = np.array([len(v) for v in vectors], np.int64)
        grouped = {n: (np.flatnonzero(sizes == n), unit(np.stack([v for v in vectors if len(v) == n]))) for n in set(sizes.tolist())}
        probed: list[list[int]] | None = None
        if centres is not None:
            n_lists = min(probes, len(centres))
            probed = [nearest_lists(v[None, :], centres, n_lists)[0].tolist() for v in vectors]
        shared = spark.sparkContext.broadcast((grouped, probed, len(rows)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of_length, of_query, n = shared.value
            best, id_type = _Best(n, k), None
            askers: dict[int, list[int]] = {}
            for q, chosen in enumerate(of_query or []):
                for x in chosen:
                    askers.setdefault(x, []).append(q)
            step = max(1, CELLS // max(1, n))
            for batch in batches:
                id_type = batch.column(0).type
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    ids, lists = part.column(0), part.column(2).to_numpy()
                    tie = np.empty(len(ids), np.int64)
                    tie[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
                    scores = np.zeros((n, len(ids)))
                    for cols, matrix in _matrices(part.column(1)):
                        if matrix.shape[1] in of_length:
                            who, asked = of_length[matrix.shape[1]]
                            scores[np.ix_(who, cols)] = asked @ unit(matrix).T
                    np.round(scores, 6, out=scores)
                    scores += 0.0
                    if of_query is None:
                        for q in range(n):
                            best.offer(q, scores[q], ids, tie)
                    else:
                        for x in np.unique(lists).tolist():
                            here = np.flatnonzero(lists == x)
                            sub = ids.take(pa.array(here))
                            for q in askers.get(x, []):
                                best.offer(q, scores[q, here], sub, tie[here])
            if id_type is not None:
                flat = [(q, None if null else doc, -s) for q, top in enumerate(best.top) for s, null, doc in top]
                columns = list(zip(*flat)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], id_type), pa.array(columns[2], pa.float64())], names=["_q", "doc_id", "score"])

        order = W.partitionBy("_q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = slim.mapInArrow(run, f"_q int, doc_id {types['doc_id']}, score double").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        labels = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(rows)], f"_q int, query_id {types['query_id']}")
        return ranked.join(labels, "_q").select("query_id", "doc_id", "score", "rank")

    out = None
    for b in range(blocks):
        part = one_block(held.where(F.pmod(F.xxhash64("query_id", "embedding"), F.lit(blocks)) == b).collect())
        out = part if out is None else out.unionByName(part)
    return out
