"""Near-duplicate classes by consistent weighted sampling over TF-IDF shingles.

A shingle is a run of five words (a shorter text is one shingle); its weight is its count in the text times its
inverse document frequency. Improved consistent weighted sampling draws, per sample, one shingle with a
probability in proportion to weights such that two texts draw the same with the probability of their weighted
Jaccard similarity. Samples are banded; texts that meet in a band are verified by the exact weighted Jaccard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitalake.llm import vec
from vitalake.session import fresh_path

#: Document frequencies are counted by hashed shingle, over all documents, in so many cells: a rare shingle gets the
#: frequency of its cell, the same share of the corpus at any size, and only frequent ones stand out.
CELLS = 1 << 16
_tables: dict[str, np.ndarray] = {}


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: later steps neither compute it again nor guess its size."""
    path = fresh_path(df.sparkSession, "near")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes by document (sorted within it), their counts, and the documents' offsets."""
    starts, _, hashes = vec.word_hashes(data, offsets[:-1])
    lo, hi = vec.per_doc(starts, offsets[:-1], offsets[1:])
    words = hi - lo
    many = np.where(words > 0, np.maximum(1, words - size + 1), 0)
    doc = np.repeat(np.arange(words.size), many)
    at = vec.ranges(lo, many)
    if at.size == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(words.size + 1, np.int64)
    keys = vec.Prefix(hashes).segments(at, np.minimum(at + size, hi[doc]))
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(keys.size, bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, keys.size))
    return keys[first], counts, np.searchsorted(doc[first], np.arange(words.size + 1))


def cell_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(48)).astype(np.int64)


def idf_table(texts: DataFrame, size: int) -> np.ndarray:
    """Inverse document frequency by cell, over all rows. Each task adds up a table of ``CELLS`` counts; the sum,
    of that fixed size, is what comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            data, offsets = vec.utf8(batch.column(1))
            for a, b in vec.blocks(offsets):
                keys, _, bounds = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                total += np.bincount(cell_of(keys), minlength=CELLS)
                docs += int((np.diff(bounds) > 0).sum())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, CELLS)), pa.array(np.append(total[used], docs))], names=["cell", "n"])

    counts = texts.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(CELLS + 1)
    for row in counts:
        frequency[row["cell"]] = row["n"]
    return np.log1p(frequency[CELLS] / np.maximum(frequency[:CELLS], 1.0))


def _gamma_table(bits: int = 16) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of ``2**bits`` equal shares."""
    if "gamma" not in _tables:
        share = (np.arange(1 << bits) + 0.5) / (1 << bits)
        low, high = np.zeros(share.size), np.full(share.size, 40.0)
        for _ in range(60):
            mid = (low + high) / 2
            under = 1 - (1 + mid) * np.exp(-mid) < share
            low, high = np.where(under, mid, low), np.where(under, high, mid)
        _tables["gamma"] = (low + high) / 2
        _tables["log_gamma"] = np.log(_tables["gamma"])
    return _tables["gamma"]


def sample(keys: np.ndarray, weights: np.ndarray, bounds: np.ndarray, samples: int) -> np.ndarray:
    """Consistent weighted samples, one row per document that has shingles, one 32-bit mark per sample.

    Per shingle and sample: r and c from Gamma(2, 1), b uniform, t = floor(ln w / r + b); the shingle with the
    smallest ln c - r (t - b + 1) is drawn, and its mark is that of (shingle, t).
    """
    gamma = _gamma_table()
    log_gamma = _tables["log_gamma"]
    filled = np.flatnonzero(np.diff(bounds) > 0)
    starts, lengths = bounds[filled], np.diff(bounds)[filled]
    out = np.empty((filled.size, samples), np.uint32)
    log_w = np.log(weights)
    low = np.uint64(0xFFFF)
    for j in range(samples):
        h = vec.seeded(keys, j)
        r, b = gamma[(h & low).astype(np.int64)], ((h >> np.uint64(32)) & low).astype(np.float64) / 65536
        t = np.floor(log_w / r + b)
        log_a = log_gamma[((h >> np.uint64(16)) & low).astype(np.int64)] - r * (t - b + 1)
        least = np.minimum.reduceat(log_a, starts)
        hits = np.flatnonzero(log_a == np.repeat(least, lengths))
        drawn = hits[np.searchsorted(hits, starts)]
        out[:, j] = (vec.mix64(keys[drawn] ^ (t[drawn].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(32)).astype(np.uint32)
    return out


def signatures(docs: DataFrame, idf: np.ndarray, size: int, bands: int, rows: int) -> DataFrame:
    """``(_id, _copy, _marks, _bands)`` of the rows ``(_id, _copy, _text)`` that have a word."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            data, offsets = vec.utf8(batch.column(2))
            for a, b in vec.blocks(offsets):
                keys, counts, bounds = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                filled = np.flatnonzero(np.diff(bounds) > 0)
                if filled.size == 0:
                    continue
                marks = sample(keys, counts * table[cell_of(keys)], bounds, bands * rows)
                buckets = np.zeros((filled.size, bands), np.uint64)
                for j in range(bands * rows):
                    buckets[:, j // rows] = vec.seeded(buckets[:, j // rows] ^ marks[:, j].astype(np.uint64), j // rows)
                take = pa.array(filled + a)

                def lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel(), kind))

                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), lists(marks.view(np.int32), pa.int32()), lists(buckets.view(np.int64), pa.int64())],
                    names=["_id", "_copy", "_marks", "_bands"],
                )

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"_id {kind}, _copy string, _marks array<int>, _bands array<long>")


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two sorted (keys, weights)."""
    if x[0].size == 0 or y[0].size == 0:
        return 0.0
    at = np.minimum(np.searchsorted(y[0], x[0]), y[0].size - 1)
    both = y[0][at] == x[0]
    shared = np.minimum(x[1][both], y[1][at[both]]).sum()
    return float(shared / (x[1].sum() + y[1].sum() - shared))


def verify(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, size: int) -> DataFrame:
    """``(_a, _b, similarity)`` of the pairs ``(_a, _b)``, exactly; ``texts`` has one row ``(_id, _text)`` per id. Texts meet by two equi-joins; the text of a
    document with many partners is shuffled once, and the partners' rows of a hot one can be split."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)
    both = pairs.join(texts.select(F.col("_id").alias("_b"), F.col("_text").alias("_tb")), "_b").join(
        texts.select(F.col("_id").alias("_a"), F.col("_text").alias("_ta")), "_a").select("_a", "_b", "_ta", "_tb")

    def weighed(text: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(text, np.uint8)
        keys, counts, _ = shingles(data, np.array([0, data.size]), size)
        return keys, counts * table[cell_of(keys)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, last, known = shared.value, None, None
        for batch in batches:
            data_a, at_a = vec.utf8(batch.column(2))
            data_b, at_b = vec.utf8(batch.column(3))
            out = np.zeros(batch.num_rows)
            for i, a in enumerate(batch.column(0).to_pylist()):
                if a != last or known is None:
                    last, known = a, weighed(data_a[at_a[i] : at_a[i + 1]].tobytes(), table)
                out[i] = similarity(known, weighed(data_b[at_b[i] : at_b[i + 1]].tobytes(), table))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["_a", "_b", "similarity"])

    kind = pairs.schema["_a"].dataType.simpleString()
    return both.mapInArrow(run, f"_a {kind}, _b {kind}, similarity double")


def linkable(texts: DataFrame, ids: DataFrame, idf: np.ndarray, size: int, threshold: float) -> DataFrame:
    """Those of ``ids`` that can have a link among each other: a text of which more than ``1 - threshold`` of the
    weight is in shingles that none of the others has is less similar to all of them. Counted by aggregates alone."""
    shared = texts.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            data, offsets = vec.utf8(batch.column(1))
            for a, b in vec.blocks(offsets):
                keys, counts, bounds = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                doc = np.repeat(np.arange(b - a), np.diff(bounds))
                weights = counts * table[cell_of(keys)]
                # one more row per text, under a key of its own, carries its whole weight
                own = vec.seeded(batch.column(0).to_numpy()[a:b].astype(np.uint64), 1 << 20)
                whole = np.bincount(doc, weights=weights, minlength=b - a)
                ids_here = batch.column(0).take(pa.array(np.concatenate([doc, np.arange(b - a)]) + a))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([keys, own]).view(np.int64)), ids_here, pa.array(np.concatenate([weights, np.zeros(b - a)])),
                    pa.array(np.concatenate([np.zeros(keys.size), whole]))], names=["_k", "_id", "_w", "_all"])

    rows = texts.join(ids, "_id", "left_semi").select("_id", "_text").mapInArrow(run, "_k long, _id long, _w double, _all double")
    single = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_id"), F.max("_w").alias("_w"), F.max("_all").alias("_all")).where("_n = 1")
    alone = single.groupBy("_id").agg(F.sum("_w").alias("_alone"), F.max("_all").alias("_all"))
    return ids.join(alone.where(F.col("_alone") > (1 - threshold + 1e-9) * F.col("_all")), "_id", "left_anti")


def across(members: DataFrame, texts: DataFrame, idf: np.ndarray, size: int, threshold: float, samples: int, block: int = 400) -> DataFrame:
    """Links between bucket members ``(_key, _id, _class, _marks, _bands)`` of different classes.

    A bucket is cut into blocks by a hash of the id, and each pair of blocks is a task's group, so a group holds
    ``2 * block`` texts or so whatever the bucket's size, and pairs that are no links never leave their task. A
    pair of several buckets is looked at in that of its first common band; pairs that share fewer than half of
    their samples are passed over (for a similarity of 0.8 less than one in 100,000).
    """
    shared = texts.sparkSession.sparkContext.broadcast(idf)
    sizes = members.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_y")
    dealt = members.join(sizes, "_key").withColumn("_x", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int")).select("*", other).join(texts, "_id")
    grouped = dealt.groupBy("_key", F.least("_x", "_y").alias("_i"), F.greatest("_x", "_y").alias("_j"))

    def run(table: pa.Table) -> pa.Table:
        idf_here = shared.value
        ids, label, x, key = (table[c].to_numpy() for c in ("_id", "_class", "_x", "_key"))
        marks = np.stack(table["_marks"].to_pylist()) if ids.size else np.empty((0, samples))
        buckets = np.stack(table["_bands"].to_pylist()) if ids.size else np.empty((0, 1))
        data, offsets = vec.utf8(table["_text"].cast(pa.large_string()))
        weighed: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def of(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in weighed:
                part = data[offsets[i] : offsets[i + 1]]
                keys, counts, _ = shingles(part, np.array([0, part.size]), size)
                weighed[i] = keys, counts * idf_here[cell_of(keys)]
            return weighed[i]

        twins = x.min(initial=0) == x.max(initial=0)  # one block against itself: each pair once
        out = []
        for i in range(ids.size):
            mates = np.flatnonzero((label != label[i]) & ((ids > ids[i]) if twins else (x > x[i])))
            mates = mates[(marks[mates] == marks[i]).sum(1) * 2 >= samples]
            common = buckets[mates] == buckets[i]
            mates = mates[buckets[i][common.argmax(1)] == key[i]] if mates.size else mates
            for j in mates.tolist():
                likeness = similarity(of(i), of(j))
                if likeness >= threshold:
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j]), likeness))
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"_a": pa.array(a, pa.int64()), "_b": pa.array(b, pa.int64()), "similarity": pa.array(c, pa.float64())})

    return grouped.applyInArrow(run, "_a long, _b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """``(_v, _class)``: each linked vertex with the smallest one of its component. Every round points all vertices
    at their smallest neighbour and contracts the links, so rounds follow the logarithm of the longest chain. The
    state between rounds is a table in the shared folder."""
    edges = kept(links.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).where("_a <> _b").distinct())
    labels = edges.select(F.explode(F.array("_a", "_b")).alias("_v")).distinct().withColumn("_class", F.col("_v"))
    while not edges.isEmpty():
        ways = edges.select(F.explode(F.array(F.struct(F.col("_a").alias("_f"), F.col("_b").alias("_t")), F.struct(F.col("_b").alias("_f"), F.col("_a").alias("_t")))).alias("e")).select("e.*")
        parent = ways.groupBy("_f").agg(F.min("_t").alias("_t")).select("_f", F.least("_f", "_t").alias("_t"))
        up = parent.select(F.col("_f").alias("_t"), F.col("_t").alias("_u"))
        parent = kept(parent.join(up, "_t").select("_f", F.col("_u").alias("_t")))
        labels = kept(labels.join(parent, labels["_class"] == parent["_f"], "left").select("_v", F.coalesce("_t", "_class").alias("_class")))
        for end in ("_a", "_b"):
            edges = edges.join(parent, edges[end] == parent["_f"]).drop(end, "_f").withColumnRenamed("_t", end)
        edges = kept(edges.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).where("_a <> _b").distinct())
    return labels


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, size: int = 5, bands: int = 12, rows: int = 3,
) -> DataFrame:
    """Rows ``(id, class_id, n_links)``, one per input row: the smallest id of its class of near copies.

    Two texts are linked if their weighted Jaccard is ``threshold`` or more; classes are the components of the
    links. Equal texts are one text from the start, whose smallest id stands for all. In each band bucket every
    text is verified against three leaders (first, last, and one by hash). Texts that are then still in different
    classes are verified against each other if they can be linked (``linkable``), block by block (``across``), so no pair that met in a band is passed over for a bucket's size. At the defaults a pair of similarity 0.8 meets with probability 0.9998. ``n_links`` counts the verified
    links of a row's text to other texts (pairs inside one class that were not needed are not verified).

    Words are lower-cased runs without white space. A text without words (null, empty, blank) is a class of its
    own with id ``class_id``. Rows with one id and different texts take the class of their text; null ids come
    out with null classes unless an equal or near text has an id. Texts cross a shuffle for verification only.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    texts = base.withColumn("_id", F.col("_id").cast("long")).withColumn("_copy", F.md5(F.col("_text").cast("binary"))).select("_id", "_copy", "_text")
    idf = idf_table(texts.select("_id", "_text"), size)
    signed = kept(signatures(texts, idf, size, bands, rows))
    firsts = kept(signed.where(F.col("_id").isNotNull()).groupBy("_copy").agg(
        F.min("_id").alias("_id"), F.max("_marks").alias("_marks"), F.max("_bands").alias("_bands")))
    met = firsts.select("_id", F.explode("_bands").alias("_key"))
    drawn = F.min_by("_id", F.xxhash64("_key", "_id"))
    leaders = met.groupBy("_key").agg(F.array_distinct(F.array(F.min("_id"), F.max("_id"), drawn)).alias("_leaders"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    star = met.join(leaders, "_key").select("_key", "_id", "_n", F.explode("_leaders").alias("_a")).where(F.col("_id") != F.col("_a"))
    pairs = star.select(F.least("_a", "_id").alias("_a"), F.greatest("_a", "_id").alias("_b")).distinct()
    # the texts that share a bucket, taken from the corpus once for all steps below
    own = kept(texts.select("_id", "_text").join(star.select("_id").union(star.select("_a")).distinct(), "_id", "left_semi").dropDuplicates(["_id"]))
    links = kept(verify(pairs, own, idf, size).where(F.col("similarity") >= threshold))
    found = components(links)

    # what the leaders did not link: members of other classes, against each other
    placed = met.join(leaders.where(F.col("_n") > 2).select("_key"), "_key").join(found, F.col("_id") == F.col("_v"), "left").select(
        "_key", "_id", F.coalesce("_class", "_id").alias("_class"))
    mixed = placed.groupBy("_key").agg(F.min("_class").alias("_x"), F.max("_class").alias("_y")).where(F.col("_x") != F.col("_y")).select("_key")
    open_ones = kept(placed.join(mixed, "_key", "left_semi"))
    able = kept(linkable(own, open_ones.select("_id").distinct(), idf, size, threshold))
    rest = open_ones.join(able, "_id").join(firsts, "_id").select("_key", "_id", "_class", "_marks", "_bands")
    extra = kept(across(rest, own, idf, size, threshold, bands * rows))
    if not extra.isEmpty():
        links = kept(links.unionByName(extra))
        found = components(links)

    degree = links.select(F.explode(F.array("_a", "_b")).alias("_v")).groupBy("_v").agg(F.count(F.lit(1)).alias("n_links"))
    by_text = firsts.select("_copy", "_id").join(found, F.col("_id") == F.col("_v"), "left").select(
        "_copy", F.coalesce("_class", "_id").alias("_class"), F.col("_id").alias("_v")).join(degree, "_v", "left").drop("_v")
    copies = texts.select("_id", "_copy").join(by_text, "_copy", "left")
    return copies.select(
        F.col("_id").alias(id_col), F.coalesce("_class", "_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
