"""Language identification by word-first backoff.

A word that the model knows scores its log relative frequency in each language. A word it does not know backs
off to character n-grams, longest first: the first length of which any n-gram is known decides, with the mean
over the known ones. A text scores the mean over its words.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vitalake.llm import vec

UNKNOWN = "und"
_letters: list[np.ndarray] = []


@dataclass(frozen=True)
class Model:
    """Sorted hashes and score rows (one column per language) of words (key 0) and n-grams (key n)."""

    langs: list[str]
    keys: dict[int, np.ndarray]
    scores: dict[int, np.ndarray]
    orders: tuple[int, ...]


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def _hashed(points: np.ndarray) -> np.ndarray:
    return vec.mix64((points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _text_hash(text: str) -> np.uint64:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return vec.Prefix(_hashed(points)).segments(np.array([0]), np.array([points.size]))[0]


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each wanted hash and whether it is there."""
    if keys.size == 0:
        return np.zeros(wanted.size, np.int64), np.zeros(wanted.size, bool)
    at = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
    return at, keys[at] == wanted


def _table(counts: dict[str, Counter], langs: list[str], penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Score rows: log10 of the relative frequency; what a language lacks costs its rarest entry and the penalty."""
    totals = {x: max(1, sum(c[x] for c in counts.values())) for x in langs}
    names = sorted(counts)
    keys = np.array([_text_hash(n) for n in names], np.uint64)
    floor = {x: -np.log10(totals[x]) - penalty for x in langs}
    rows = np.array([[np.log10(counts[n][x] / totals[x]) if counts[n][x] else floor[x] for x in langs] for n in names])
    order = np.argsort(keys, kind="stable")
    return keys[order], rows.reshape(len(names), len(langs))[order]


def learn(
    docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_docs: int = 20_000, max_words: int = 60_000, orders: tuple[int, ...] = (5, 4, 3, 2, 1), penalty: float = 1.0,
) -> Model:
    """Learn from about ``sample_docs`` labelled documents for which ``usable`` holds, chosen by a hash of the id.

    Word counts are a Spark aggregate; the ``max_words`` most frequent words (with their counts by language) come
    to the driver, so the model's size is bounded by the two parameters whatever the corpus holds.
    """
    labelled = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.xxhash64(F.col(id_col).cast("string")).alias("_h"), F.col(text_col).alias("_t"), F.col(lang_col).cast("string").alias("_l")
    )
    n = docs.where(usable & F.col(lang_col).isNotNull()).count()
    if n > sample_docs:
        labelled = labelled.where(F.col("_h") < int(-(2**63) + 2**64 * (sample_docs / n)))
    words = F.filter(F.split(F.lower(F.col("_t")), r"[^\p{L}]+"), lambda w: w != "")
    counted = labelled.select("_l", F.explode(words).alias("_w")).groupBy("_l", "_w").agg(F.count(F.lit(1)).alias("_n"))
    top = counted.groupBy("_w").agg(
        F.sum("_n").alias("_all"), F.map_from_entries(F.collect_list(F.struct("_l", "_n"))).alias("_by")
    ).orderBy(F.col("_all").desc(), "_w").limit(max_words)
    by_word = {r["_w"]: Counter(r["_by"]) for r in top.collect()}
    langs = sorted({x for c in by_word.values() for x in c})
    grams: dict[int, dict[str, Counter]] = {k: defaultdict(Counter) for k in orders}
    for word, counts in by_word.items():
        padded = f" {word} "
        for k in orders:
            for i in range(len(padded) - k + 1):
                piece = padded[i : i + k]
                if piece.strip():
                    for lang, c in counts.items():
                        grams[k][piece][lang] += c
    tables = {0: _table(by_word, langs, penalty)} | {k: _table(grams[k], langs, penalty) for k in orders}
    return Model(langs, {k: t[0] for k, t in tables.items()}, {k: t[1] for k, t in tables.items()}, tuple(orders))


def _back_off(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Scores of unknown words from their n-grams, and which words had any."""
    lengths = ends - starts
    padded = np.full(int((lengths + 2).sum()), 32, np.uint32)
    begin = np.concatenate([[0], np.cumsum(lengths + 2)])[:-1]
    padded[vec.ranges(begin + 1, lengths)] = points[vec.ranges(starts, lengths)]
    sums = vec.Prefix(_hashed(padded))
    scores = np.zeros((starts.size, len(model.langs)))
    done = np.zeros(starts.size, bool)
    for k in model.orders:
        open_ones = np.flatnonzero(~done & (lengths + 2 >= k))
        if open_ones.size == 0:
            continue
        many = lengths[open_ones] + 3 - k
        at = vec.ranges(begin[open_ones], many)
        row, hit = lookup(model.keys[k], sums.segments(at, at + k))
        owner = np.repeat(open_ones, many)[hit]
        hits = np.bincount(owner, minlength=starts.size)
        found = hits > 0
        for j in range(len(model.langs)):
            total = np.bincount(owner, weights=model.scores[k][row[hit], j], minlength=starts.size)
            scores[found, j] = total[found] / hits[found]
        done |= found
    return scores, done


def _predict(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best language (-1: none) and its share, by document of one block."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    inside = letter_table()[points]
    starts, ends = vec.run_bounds(inside, chars[:-1])
    docs = offsets.size - 1
    if starts.size == 0 or not model.langs:
        return np.full(docs, -1), np.zeros(docs)
    hashes = vec.Prefix(_hashed(points)).segments(starts, ends)
    _, shown, which = np.unique(hashes, return_index=True, return_inverse=True)
    row, known = lookup(model.keys[0], hashes[shown])
    scores = np.zeros((shown.size, len(model.langs)))
    scores[known] = model.scores[0][row[known]]
    rest = np.flatnonzero(~known)
    if rest.size:
        scores[rest], done = _back_off(points, starts[shown[rest]], ends[shown[rest]], model)
        known[rest] = done
    lo, hi = vec.per_doc(starts, chars[:-1], chars[1:])
    run = lambda v: (lambda s: s[hi] - s[lo])(np.concatenate([[0.0], np.cumsum(v[which])]))
    scored = np.round(run(known.astype(float)))
    mean = np.stack([run(scores[:, j]) for j in range(len(model.langs))], 1) / np.maximum(scored, 1)[:, None]
    share = np.power(10.0, mean - mean.max(1, keepdims=True))
    share /= share.sum(1, keepdims=True)
    best = np.argmax(np.round(mean, 9), 1)  # the first of equal languages
    # letters of which the model knows nothing: the first language, with an even share
    return np.where(hi > lo, best, -1), np.where(hi > lo, share[np.arange(docs), best], 0.0)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``(keep..., id, lang_pred, score)``, one per input row, from the text alone.

    No shuffle; the model is broadcast and bounded by ``learn``'s parameters. A null text, or one without a
    letter, is ``und`` with score 0; equal scores go to the first language by name. An empty model (no labelled
    document) makes every text ``und``. Texts are read whole.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        names = np.array([*fitted.langs, UNKNOWN], dtype=object)
        for batch in batches:
            data, offsets = vec.utf8(batch.column(batch.num_columns - 1))
            best, share = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for a, b in vec.blocks(offsets):
                part, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                best[a:b], share[a:b] = _predict(part, local, fitted)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names[best], pa.string()), pa.array(share)], names=[*keep, id_col, "lang_pred", "score"])

    columns = [*keep, id_col]
    slim = docs.select(*columns, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return slim.mapInArrow(run, f"{schema}, lang_pred string, score double")


def remainder(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3
