"""Benchmark decontamination by an edit-distance embedding.

Texts are sequences of words (runs of letters and digits, lower case). A random walk over a window repeats each
word a random number of times (CGK embedding): windows a few edits apart become sequences a small Hamming distance
apart, because two walks that an edit drives apart soon meet again. Sampling a few places of the walk is a
locality-sensitive hash for that distance; several walks and samples reach the target recall. Windows follow the
size of the items: items are classed by length, a window has half of the class's smallest size, at most 24 words, and
a text's windows start at multiples of a quarter of that, so that a copy holds several windows and few edits fall into
the best of them.
Pairs that meet are verified by the exact edit distance between item and text.

The walks sample. Where no match may be lost, an item can also be cut into one piece more than a match may have
edits: at least one piece stands unchanged in every match, so looking up all pieces loses none (``exact``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from vitalake.llm import vec

#: Edits drive walks apart faster than windows grow: longer items have more windows, not longer ones.
LONGEST_WINDOW = 24
INSIDE = np.zeros(256, bool)
for _b in range(256):
    INSIDE[_b] = chr(_b).isalnum() and _b < 128 or _b >= 128


def words(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and hashes of the words."""
    starts, ends = vec.run_bounds(INSIDE[data], doc_starts)
    if starts.size == 0:
        return starts, np.empty(0, np.uint64)
    return starts, vec.Prefix(vec.BYTE_HASH[data]).segments(starts, ends)


@dataclass(frozen=True)
class Walk:
    """Where one class of windows is sampled: ``places[k]`` are the sampled steps of key ``k`` of walk ``seed``."""

    seed: int
    size: int
    places: tuple[tuple[int, ...], ...]

    def keys(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Keys (one row per sample) of the windows that start at ``at``; all must fit into ``symbols``."""
        out = np.full((len(self.places), at.size), self.seed + 1, np.uint64)
        last = max(max(p) for p in self.places)
        place, limit = at.astype(np.intp), at + self.size
        padded = np.append(symbols, np.zeros(last + 1, np.uint64))
        for step in range(last + 1):
            if step % 64 == 0:
                coins = vec.seeded(padded, 1000 * self.seed + step // 64)
            if step % 8 == 0:
                bits = (coins >> np.uint64(step % 64)).astype(np.uint8)
            wanted = [k for k, p in enumerate(self.places) if step in p]
            if wanted:
                symbol = np.where(place < limit, padded[place], np.uint64(0))  # nothing follows a window's end
                for k in wanted:
                    out[k] = (out[k] ^ symbol) * np.uint64(0x9E3779B97F4A7C15)
                    out[k] ^= out[k] >> np.uint64(29)
            place += (bits[place] >> np.uint8(step % 8)) & np.uint8(1)
        return out


@dataclass(frozen=True)
class SizeClass:
    """Items of ``low`` to ``2 * low - 1`` words: windows of ``size`` words at multiples of ``stride``."""

    size: int
    stride: int
    walks: tuple[Walk, ...]
    tables: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]  # by key: sorted keys, items, offsets


def index(items: list[np.ndarray], walks: int, samples: int, width: int) -> list[SizeClass]:
    """Key tables of all windows of all items."""
    classes = []
    lengths = np.array([x.size for x in items], np.int64)
    left = np.unique(lengths[lengths > 0])
    while left.size:
        low = int(left[0])
        members = np.flatnonzero((lengths >= low) & (lengths < 2 * low))
        left = left[left >= 2 * low]
        size = min(-(-low // 2), LONGEST_WINDOW)
        stride = max(1, size // 4)
        steps = 2 * size  # after about as many the walk has left the window, and there is nothing to sample
        rng = np.random.default_rng(low)
        plan = tuple(
            Walk(w, size, tuple(tuple(sorted(rng.choice(steps, min(width, steps), replace=False).tolist())) for _ in range(samples)))
            for w in range(walks)
        )
        joined = np.concatenate([items[m] for m in members])
        base = np.concatenate([[0], np.cumsum(lengths[members])])[:-1]
        many = lengths[members] - size + 1
        at = vec.ranges(base, many)
        owner, offset = np.repeat(members, many), at - np.repeat(base, many)
        tables = []
        for walk in plan:
            for keys in walk.keys(joined, at):
                order = np.argsort(keys, kind="stable")
                tables.append((keys[order], owner[order], offset[order]))
        classes.append(SizeClass(size, stride, plan, tuple(tables)))
    return classes


@dataclass(frozen=True)
class Pieces:
    """Pieces of ``size`` words of the items: sorted keys, items, offsets, and the key heads that occur."""

    size: int
    known: np.ndarray
    owner: np.ndarray
    offset: np.ndarray
    heads: np.ndarray


def pieces(items: list[np.ndarray], max_share: float) -> list[Pieces]:
    """Every item cut evenly into one piece more than ``max_share`` of its words, by size of the pieces."""
    rows: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for i, item in enumerate(items):
        if item.size == 0:
            continue
        n_pieces = min(int(max_share * item.size) + 1, item.size)
        bounds = np.arange(n_pieces + 1) * item.size // n_pieces
        keys = vec.Prefix(item).segments(bounds[:-1], bounds[1:])
        for size in np.unique(np.diff(bounds)).tolist():
            own = np.diff(bounds) == size
            rows.setdefault(size, []).append((keys[own], np.full(own.sum(), i), bounds[:-1][own]))
    out = []
    for size, parts in rows.items():
        known, owner, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(known, kind="stable")
        heads = np.zeros(1 << 20, bool)
        heads[(known >> np.uint64(44)).astype(np.int64)] = True
        out.append(Pieces(size, known[order], owner[order], offset[order], heads))
    return out


def _candidates(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray, classes: list[SizeClass], parts: list[Pieces]) -> np.ndarray:
    """Rows ``(document, item, word at which the item would start)``, each once."""
    found = []
    items = 1 + max((int(owner.max(initial=0)) for c in classes for _, owner, _ in c.tables), default=0)
    words_in_all = hashes.size + 1
    for c in classes:
        many = np.maximum(0, (hi - lo - c.size) // c.stride + 1) * (hi - lo >= c.size)
        doc = np.repeat(np.arange(lo.size), many)
        at = lo[doc] + (np.arange(doc.size) - np.repeat(np.cumsum(many) - many, many)) * c.stride
        if at.size == 0:
            continue
        tables = iter(c.tables)
        for walk in c.walks:
            for keys in walk.keys(hashes, at):
                known, owner, offset = next(tables)
                flags = np.zeros(1 << 16, bool)
                flags[(known >> np.uint64(48)).astype(np.int64)] = True
                maybe = np.flatnonzero(flags[(keys >> np.uint64(48)).astype(np.int64)])
                x, y = np.searchsorted(known, keys[maybe]), np.searchsorted(known, keys[maybe], side="right")
                rows = vec.ranges(x, y - x)
                start = np.repeat(at[maybe], y - x) - offset[rows] + words_in_all  # may lie before the block
                found.append((start * items + owner[rows]) * lo.size + np.repeat(doc[maybe], y - x))
    sums = vec.Prefix(hashes) if parts else None
    for p in parts:
        at = np.arange(max(0, hashes.size - p.size + 1))
        keys = sums.segments(at, at + p.size)
        maybe = np.flatnonzero(p.heads[(keys >> np.uint64(44)).astype(np.int64)])
        doc = np.searchsorted(hi, maybe, side="right")
        inside = maybe + p.size <= hi[doc]
        maybe, doc = maybe[inside], doc[inside]
        x, y = np.searchsorted(p.known, keys[maybe]), np.searchsorted(p.known, keys[maybe], side="right")
        rows = vec.ranges(x, y - x)
        start = np.repeat(maybe, y - x) - p.offset[rows] + words_in_all
        found.append((start * items + p.owner[rows]) * lo.size + np.repeat(doc, y - x))
    codes = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    doc, rest = codes % max(lo.size, 1), codes // max(lo.size, 1)
    return np.stack([doc, rest % items, rest // items - words_in_all - lo[doc]], 1)


def best_match(item: list[int], text: list[int]) -> tuple[int, int]:
    """Smallest edit distance between ``item`` and any stretch of ``text``, and the end of the first such stretch
    (bit-parallel: one column of the distance table is two integers)."""
    places: dict[int, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, where = n, 0
    for j, w in enumerate(text):
        equal = places.get(w, 0)
        xv = equal | minus
        xh = (((equal & plus) + plus) ^ plus) | equal
        up, down = (minus | ~(xh | plus)) & full, plus & xh
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = (down | ~(xv | up)) & full, up & xv
        if score < best:
            best, where = score, j + 1
    return best, where


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    max_share: float = 0.2, walks: int = 3, samples: int = 6, width: int = 6, items_per_block: int = 5000, exact: bool = False,
) -> DataFrame:
    """Rows ``(id, item, item_words, distance, start_word)``: items within ``max_share`` of their words of a stretch of the text.

    One row per document row and item, the smallest distance (then the earliest start). Whole texts are read; there
    is no shuffle, hence no hot key. Items are broadcast in blocks of about ``items_per_block``, so a large
    benchmark costs passes over the documents and never memory. Unedited copies are always found; at ``max_share`` edits
    the walks find 0.95 of the matches or more at any item length, fewer edits lose less. With ``exact`` every match is
    found, at the price of a look-up per word and size of pieces. Null or empty texts and items match
    nothing; items with equal ids and different texts each count, equal rows once per document. Either table may
    be empty: so is the result then.
    """
    spark = docs.sparkSession
    whole = isinstance(items.schema[item_col].dataType, T.IntegralType)
    item_kind, item_type = ("bigint", pa.int64()) if whole else ("string", pa.string())
    wanted = items.select(F.col(item_col).cast(item_kind).alias("_item"), F.lower(F.coalesce(F.col(item_text), F.lit(""))).alias("_text")).distinct()
    n_blocks = max(1, math.ceil(wanted.count() / items_per_block))
    slim = docs.select(F.col(id_col), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, item_words long, distance long, start_word long"

    def one_block(rows: list) -> DataFrame:
        ids = [r["_item"] for r in rows]
        sequences = [words(np.frombuffer(r["_text"].encode(), np.uint8), np.array([0]))[1] for r in rows]
        shared = spark.sparkContext.broadcast((ids, sequences, index(sequences, walks, samples, width), pieces(sequences, max_share) if exact else []))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, known, classes, parts = shared.value
            lists = [x.tolist() for x in known]
            sets = [set(x) for x in lists]
            for batch in batches:
                data, offsets = vec.utf8(batch.column(1))
                best: dict[tuple[int, int], tuple[int, int]] = {}
                for a, b in vec.blocks(offsets):
                    part, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                    starts, hashes = words(part, local[:-1])
                    lo, hi = vec.per_doc(starts, local[:-1], local[1:])
                    for doc, item, start in _candidates(hashes, lo, hi, classes, parts).tolist():
                        n = len(lists[item])
                        slack = int(max_share * n)
                        x, y = max(0, start - slack), min(int(hi[doc] - lo[doc]), start + n + slack)
                        stretch = hashes[lo[doc] + x : lo[doc] + y].tolist()
                        if sum(w in sets[item] for w in stretch) < n - slack:  # fewer words in common than any match has
                            continue
                        distance, end = best_match(lists[item], stretch)
                        if distance <= max_share * n:
                            row = (distance, max(0, x + end - n))
                            best[a + doc, item] = min(best.get((a + doc, item), row), row)
                keys = list(best)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([k[0] for k in keys], pa.int64())), pa.array([names[k[1]] for k in keys], item_type),
                    pa.array([len(lists[k[1]]) for k in keys], pa.int64()), pa.array([best[k][0] for k in keys], pa.int64()),
                    pa.array([best[k][1] for k in keys], pa.int64()),
                ], names=[id_col, item_col, "item_words", "distance", "start_word"])

        return slim.mapInArrow(run, schema)

    found = None
    for i in range(n_blocks):
        rows = wanted.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(n_blocks)) == i).collect()
        part = one_block(rows)
        found = part if found is None else found.unionByName(part)
    return found
