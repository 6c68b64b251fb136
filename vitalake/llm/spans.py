"""Substring deduplication by sliding sentence spans.

Every run of several consecutive sentences is hashed: from each sentence on, and back from each sentence, the
shortest run with at least ``min_sentences`` sentences and ``min_words`` words. Runs are joined over all documents
by their hash; sentences that any run covers which is not the first of its kind are removed.

Text without stop marks would be one sentence, and a repeated passage inside it no run. A sentence of more than
``long_sentence`` words is therefore cut where a word's hash says so, in the same places in each copy.

A passage may also start and end inside sentences and hold no two whole ones. Grams of ``GRAM`` words are therefore
hashed wherever they stand, and winnowed: of the grams in each stretch of ``passage`` words the one of the smallest
hash joins the runs, so every repeated stretch of that length has a gram that is picked in each copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from vitalake.llm import vec

#: One word in so many ends a piece of a long sentence.
CUT_EVERY = 8
#: Words of a winnowed gram: what a passage across sentence bounds loses at a time.
GRAM = 30
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?"]] = True


def sentence_words(data: np.ndarray, doc_starts: np.ndarray, long_sentence: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word hashes, and the index of each sentence's first word. A sentence ends with a word that
    ends in a stop mark, with a line, or with its document; a long one also by hash, and where no hash cuts it for
    four times that length (one word over and over), after every ``long_sentence`` words."""
    starts, ends, hashes = vec.word_hashes(data, doc_starts)
    if starts.size == 0:
        return starts, hashes, starts
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    first = np.ones(starts.size, bool)
    first[1:] = STOP[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])
    first[np.searchsorted(starts, doc_starts[doc_starts <= starts[-1]])] = True
    if long_sentence is None:
        return starts, hashes, np.flatnonzero(first)

    def sized() -> tuple[np.ndarray, np.ndarray]:
        begin = np.flatnonzero(first)
        length = np.diff(np.append(begin, starts.size))
        return np.repeat(begin, length), np.repeat(length, length)

    first[1:] |= (sized()[1][1:] > long_sentence) & (hashes[:-1] % np.uint64(CUT_EVERY) == 0)
    begin, length = sized()
    first |= (length > 4 * long_sentence) & ((np.arange(starts.size) - begin) % long_sentence == 0)
    return starts, hashes, np.flatnonzero(first)


def runs(first: np.ndarray, n_words: int, lo: np.ndarray, hi: np.ndarray, min_sentences: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence of every run. ``lo`` and ``hi``: each sentence's document as a range of sentences."""
    n = first.size
    bounds = np.append(first, n_words)
    at = np.arange(n)
    ahead = np.maximum(at + min_sentences, np.searchsorted(bounds, bounds[:-1] + min_words))  # first sentence after the run
    back = np.minimum(at + 1 - min_sentences, np.searchsorted(bounds, bounds[1:] - min_words, side="right") - 1)
    pairs = np.concatenate([
        np.stack([at, ahead - 1], 1)[ahead <= hi], np.stack([back, at], 1)[back >= lo],
    ])
    if pairs.size == 0:
        return at[:0], at[:0]
    codes = np.unique(pairs[:, 0] * np.int64(n) + pairs[:, 1])
    return codes // n, codes % n


def winnowed(sums: vec.Prefix, lo: np.ndarray, hi: np.ndarray, gram: int, passage: int) -> np.ndarray:
    """First words of the grams that have the smallest hash in some stretch of ``passage`` words of a document.
    ``lo`` and ``hi``: each document as a range of words."""
    n, wide = int(hi.max(initial=0)) - passage + 1, passage - gram + 1  # stretches, and the grams of each
    if n <= 0:
        return np.empty(0, np.int64)
    at = np.arange(n + wide - 1)
    hashes = sums.segments(at, at + gram)

    def slide(values: np.ndarray, pick: np.ufunc) -> np.ndarray:
        step = 1
        while 2 * step <= wide:
            values = pick(values[:-step], values[step:])
            step *= 2
        return pick(values[: values.size - (wide - step)], values[wide - step :])

    many = np.maximum(0, hi - lo - passage + 1)
    inside = np.zeros(n, bool)
    inside[vec.ranges(lo, many)] = True
    least = np.where(inside, slide(hashes, np.minimum), np.uint64(0))
    rim = np.zeros(wide - 1, np.uint64)
    most = slide(np.concatenate([rim, least, rim]), np.maximum)
    return np.flatnonzero((hashes == most) & (most > 0))


class Block:
    """The sentences and runs of a block of documents; runs are ranges of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_sentences: int, min_words: int, long_sentence: int | None, passage: int):
        self.starts, hashes, self.first = sentence_words(data, offsets[:-1], long_sentence)
        n = self.first.size
        begins = self.starts[self.first] if n else self.starts
        self.lo, self.hi = vec.per_doc(begins, offsets[:-1], offsets[1:])
        self.word_lo, self.word_hi = vec.per_doc(self.starts, offsets[:-1], offsets[1:])
        if n == 0:
            self.a = self.b = np.empty(0, np.int64)
            self.keys = np.empty(0, np.int64)
            return
        of = np.repeat(np.arange(offsets.size - 1), self.hi - self.lo)
        a, b = runs(self.first, self.starts.size, self.lo[of], self.hi[of], min_sentences, min_words)
        bounds = np.append(self.first, self.starts.size)
        a, b = bounds[a], bounds[b + 1]
        sums = vec.Prefix(hashes)
        if long_sentence is not None:
            at = winnowed(sums, self.word_lo, self.word_hi, min(GRAM, passage), passage)
            a, b = np.append(a, at), np.append(b, at + min(GRAM, passage))
        codes = np.unique(a * np.int64(self.starts.size + 1) + b)
        self.a, self.b = codes // (self.starts.size + 1), codes % (self.starts.size + 1)
        self.keys = sums.segments(self.a, self.b).view(np.int64)

    def firsts(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents and keys of the runs, each key once per document."""
        docs = np.searchsorted(self.word_hi, self.a, side="right")
        order = np.lexsort((self.keys, docs))
        docs, keys = docs[order], self.keys[order]
        new = np.ones(docs.size, bool)
        new[1:] = (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])
        return docs[new], keys[new]

    def covered(self, doc: int, repeated: np.ndarray) -> np.ndarray:
        """Which words of a document are removed: those in a run that other documents had before, or that the
        document itself had before."""
        lo, hi = self.word_lo[doc], self.word_hi[doc]
        x, y = np.searchsorted(self.a, [lo, hi])
        keys = self.keys[x:y]
        seen = np.ones(keys.size, bool)
        order = np.argsort(keys, kind="stable")
        seen[order[np.concatenate([[True], keys[order][1:] != keys[order][:-1]])] if keys.size else order] = False
        gone = seen | np.isin(keys, repeated)
        marks = np.zeros(hi - lo + 1, np.int64)
        np.add.at(marks, self.a[x:y][gone] - lo, 1)
        np.add.at(marks, self.b[x:y][gone] - lo, -1)
        return np.cumsum(marks)[:-1] > 0


def remove_repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = 2, min_words: int = 15,
    long_sentence: int | None = 25, passage: int = 51,
) -> DataFrame:
    """``docs`` with the text rewritten, and ``n_sentences``, ``n_removed`` added; one row per input row.

    A stretch of ``passage`` words that an earlier document has never stays whole, wherever it starts and ends; up to
    ``passage - GRAM`` words may stay at either end of it. With ``long_sentence`` None only runs of sentences count.
    ``n_removed`` counts the sentences that lose words. The first of equal runs is the one with the smallest id, then the earliest start. Words are compared exactly,
    white space is not. Rows of one id count as one document: they are no repeats of each other, and each loses
    the runs that an earlier document has. Null texts stay null, texts that lose nothing stay as they
    are. Only ``(hash, id)`` of each run is shuffled, once: a document sends a hash once, so a passage of
    many documents adds one narrow row for each of them; the removed hashes come back to their documents by id.
    Columns named like the two added ones are replaced; others are kept, whatever their names. Rows with a null id
    lose nothing and take nothing from others.
    """
    columns = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    kind = docs.schema[id_col].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vec.utf8(batch.column(1))
            for a, b in vec.blocks(offsets):
                part, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                owner, keys = Block(part, local, min_sentences, min_words, long_sentence, passage).firsts()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner + a)), pa.array(keys)], names=["_id", "_h"])

    slim = docs.where(F.col(id_col).isNotNull()).select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    spans = slim.mapInArrow(emit, f"_id {kind}, _h long")
    later = spans.withColumn("_first", F.min("_id").over(W.partitionBy("_h"))).where(F.col("_id") > F.col("_first"))
    own = "_span"  # names that no column of the documents has
    while any(c.lower().startswith(own) for c in columns):
        own += "_"
    by_doc = later.groupBy(F.col("_id").alias(f"{own}_id")).agg(F.collect_set("_h").alias(f"{own}_gone"))
    joined = docs.select(*columns).join(by_doc, F.col(id_col) == F.col(f"{own}_id"), "left").drop(f"{own}_id")
    at = columns.index(text_col)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            data, offsets = vec.utf8(texts.fill_null(""))
            gone = batch.column(len(columns))
            values, ends = gone.values.to_numpy(zero_copy_only=False), gone.offsets.to_numpy()
            out: list[str | None] = [None] * batch.num_rows
            total, removed = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for a, b in vec.blocks(offsets):
                part, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                block = Block(part, local, min_sentences, min_words, long_sentence, passage)
                for i in range(b - a):
                    lost = block.covered(i, values[ends[a + i] : ends[a + i + 1]])
                    total[a + i] = block.hi[i] - block.lo[i]
                    own = part[local[i] : local[i + 1]]
                    if not lost.any():
                        out[a + i] = own.tobytes().decode()
                        continue
                    removed[a + i] = np.logical_or.reduceat(lost, block.first[block.lo[i] : block.hi[i]] - block.word_lo[i]).sum()
                    begins = block.starts[block.word_lo[i] : block.word_hi[i]] - local[i]
                    stay = np.ones(own.size, bool)
                    stay[begins[0] :] = np.repeat(~lost, np.diff(np.append(begins, own.size)))
                    out[a + i] = own[stay].tobytes().decode().strip()
            fresh = pa.array([t if ok else None for t, ok in zip(out, texts.is_valid().to_pylist(), strict=True)], pa.string())
            arrays = [fresh if j == at else batch.column(j) for j in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total), pa.array(removed)], names=[*columns, "n_sentences", "n_removed"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return joined.mapInArrow(rewrite, f"{schema}, n_sentences long, n_removed long")
