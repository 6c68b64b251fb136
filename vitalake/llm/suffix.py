"""Removal of repeated byte strings by sorting sparse suffixes, deep-shallow.

Each window of ``min_len`` bytes picks one of its positions, that of the smallest hash among its short strings
(grams), so equal windows pick equal places and only a few positions per hundred bytes are anchors. Suffixes (and
reversed prefixes) at anchors whose gram occurs more than once are sorted: multikey quicksort to a shallow depth,
then blind tries for groups that share more. The common prefixes of neighbours then say, for each window that an
anchor stands for, which occurrences are equal; all but the first are removed.

Anchors are dealt out by gram hash; equal surroundings within a block of documents are sorted and reduced to the
first before that, so a passage that many documents share reaches its task once per block. Equal texts are one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitalake.llm import vec

#: Words of eight bytes that the quicksort looks at before the tries take over.
SHALLOW = 2
#: Windows that one anchor can stand for: one bit each of a 64-bit mask.
SPREAD = 64


def multikey_quicksort(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by their first ``depth`` words, and the ranges of that order that are equal so far.

    All ranges are split at once, three ways around their middle row's word: rows below and above stay at their
    word, equal rows go on to the next.
    """
    order = np.arange(words.shape[0])
    starts, ends, at = np.array([0]), np.array([order.size]), np.array([0])
    deep: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        shallow = (ends - starts > 1) & (at < depth)
        tied = (ends - starts > 1) & (at >= depth)
        deep.append((starts[tied], ends[tied]))
        starts, ends, at = starts[shallow], ends[shallow], at[shallow]
        if starts.size == 0:
            break
        place = vec.ranges(starts, ends - starts)
        group = np.repeat(np.arange(starts.size), ends - starts)
        rows = order[place]
        value, pivot = words[rows, at[group]], words[order[(starts + ends) // 2], at][group]
        code = group * 3 + (value >= pivot) + (value > pivot)
        order[place] = rows[np.argsort(code, kind="stable")]
        sizes = np.bincount(code, minlength=starts.size * 3)
        begin = np.repeat(starts, 3) + (np.cumsum(sizes.reshape(-1, 3), 1) - sizes.reshape(-1, 3)).ravel()
        starts, ends = begin, begin + sizes
        at = (at[:, None] + np.array([0, 1, 0])).ravel()
    return order, np.concatenate([d[0] for d in deep]), np.concatenate([d[1] for d in deep])


def blind_tries(strings: np.ndarray, words: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
    """Put each range of ``order`` into order by one blind trie: a node knows only the byte at which its strings
    first differ; they are dealt out by that byte, and what they share before it is never looked at again."""
    width = strings.shape[1]
    while starts.size:
        place = vec.ranges(starts, ends - starts)
        group = np.repeat(np.arange(starts.size), ends - starts)
        rows = order[place]
        apart = first_difference(words[rows], words[order[starts]][group])
        node = np.minimum.reduceat(apart, np.concatenate([[0], np.cumsum(ends - starts)[:-1]]))
        branch = np.where(node[group] < width, strings[rows, np.minimum(node[group], width - 1)], 0).astype(np.int64)
        code = group * 256 + branch
        moved = np.argsort(code, kind="stable")
        order[place] = rows[moved]
        code = code[moved]
        cut = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        length = np.diff(np.append(cut, code.size))
        open_ones = (length > 1) & (node[code[cut] // 256] < width)
        starts, ends = place[cut][open_ones], place[cut][open_ones] + length[open_ones]


def first_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of the first byte in which rows of big-endian words differ; 8 times their number where none does."""
    out = np.full(a.shape[0], 8 * a.shape[1], np.int64)
    left = np.arange(a.shape[0])
    for k in range(a.shape[1]):
        other = a[left, k] ^ b[left, k]
        found = other != 0
        if found.any():
            # leading zero bits from the exponent; halves keep the conversion exact
            x = other[found]
            high = (x >> np.uint64(32)) > 0
            half = np.where(high, x >> np.uint64(32), x).astype(np.float64)
            out[left[found]] = 8 * k + (np.where(high, 0, 4) + (32 - np.frexp(half)[1]) // 8)
            left = left[~found]
        if left.size == 0:
            break
    return out


def sort_strings(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix, and the common prefix of each with the one before it (0 for the first)."""
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    words = padded.view(">u8").astype(np.uint64)
    order, starts, ends = multikey_quicksort(words, min(SHALLOW, words.shape[1]))
    blind_tries(strings, words, order, starts, ends)
    common = np.zeros(n, np.int64)
    if n > 1:
        common[1:] = np.minimum(first_difference(words[order[1:]], words[order[:-1]]), width)
    return order, common


class Sorted:
    """Sorted strings: numbers that are equal for rows with equal first ``depth`` bytes."""

    def __init__(self, strings: np.ndarray):
        self.order, self.common = sort_strings(strings)

    def at(self, depth: int) -> np.ndarray:
        out = np.empty(self.order.size, np.int64)
        out[self.order] = np.cumsum(self.common < depth)
        return out


def later_ones(*keys: np.ndarray) -> np.ndarray:
    """Rows that have an earlier row with the same keys."""
    order = np.lexsort((np.arange(keys[0].size), *keys))
    same = np.ones(order.size, bool)
    same[:1] = False
    for k in keys:
        same[1:] &= k[order][1:] == k[order][:-1]
    out = np.zeros(order.size, bool)
    out[order] = same
    return out


class Surroundings:
    """Bytes around anchors, in order of occurrence: ``before`` bytes to the left (nearest first) and ``min_len``
    to the right, with how many of them are there."""

    def __init__(self, matrix: np.ndarray, left: np.ndarray, right: np.ndarray, min_len: int):
        self.min_len, self.before = min_len, matrix.shape[1] - min_len
        self.left, self.right = left.astype(np.int64), right.astype(np.int64)
        self.ahead = Sorted(np.ascontiguousarray(matrix[:, self.before :]))
        self.back = Sorted(np.ascontiguousarray(matrix[:, : self.before][:, ::-1]))

    def all_windows(self) -> np.ndarray:
        """Mask of the windows that are there: bit d is the one that starts d bytes before the anchor."""
        low = np.maximum(0, self.min_len - self.right)
        bits = np.where(self.left - low + 1 > 0, self.left - low + 1, 0).astype(np.uint64)
        ones = np.where(bits >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(bits, np.uint64(63))) - np.uint64(1))
        return np.where(bits > 0, ones << np.minimum(low, 63).astype(np.uint64), np.uint64(0))

    def whole_copies(self) -> np.ndarray:
        """Rows whose surroundings all occurred before."""
        return later_ones(self.ahead.at(self.min_len), self.back.at(self.before), self.left, self.right)

    def repeated(self) -> np.ndarray:
        """Mask, by row, of the windows that an earlier row has."""
        copies = self.whole_copies()
        out = np.where(copies, self.all_windows(), np.uint64(0))
        gram = self.ahead.at(self.min_len - self.before)
        fresh = np.flatnonzero(~copies)
        shared = np.bincount(gram[fresh], minlength=int(gram.max(initial=0)) + 1)[gram[fresh]] > 1
        rows = fresh[shared]
        if rows.size == 0:
            return out
        for d in range(self.before + 1):
            there = rows[(self.left[rows] >= d) & (self.right[rows] >= self.min_len - d)]
            if there.size < 2:
                continue
            again = later_ones(self.ahead.at(self.min_len - d)[there], self.back.at(d)[there])
            out[there[again]] |= np.uint64(1) << np.uint64(d)
        return out


def anchors(data: np.ndarray, offsets: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that some window of ``min_len`` bytes inside a document picks, and the hashes of their grams."""
    gram = min_len - SPREAD + 1
    n = data.size - gram + 1
    if n < SPREAD:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    sums = vec.Prefix(vec.BYTE_HASH[data])
    hashes = vec.mix64((sums.sums[gram:] - sums.sums[:-gram]) * sums.down[:n])
    least = hashes
    step = 1
    while step < SPREAD:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    # windows start where SPREAD grams follow; those that cross a document's end pick nothing
    inside = np.ones(least.size + 1, np.int32)
    marks = np.zeros(least.size + 1, np.int64)
    last = np.maximum(offsets[1:] - min_len + 1, offsets[:-1])  # first start that is too late
    np.add.at(marks, np.minimum(last, least.size), 1)
    np.add.at(marks, np.minimum(offsets[1:], least.size), -1)
    inside = np.cumsum(marks)[: least.size] == 0
    most = np.concatenate([np.zeros(SPREAD - 1, np.uint64), np.where(inside, least, np.uint64(0)), np.zeros(SPREAD - 1, np.uint64)])
    step = 1
    while step < SPREAD:
        most = np.maximum(most[:-step], most[step:])
        step *= 2
    at = np.flatnonzero((hashes == most) & (most > 0))
    return at, hashes[at]


def cut_out(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, doc: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Surroundings of anchors as a byte matrix (zero where a document ends), and the bytes there are on each side."""
    before = SPREAD - 1
    left = np.minimum(before, at - offsets[doc])
    right = np.minimum(min_len, offsets[doc + 1] - at)
    place = at[:, None] + np.arange(-before, min_len)
    there = (place >= (at - left)[:, None]) & (place < (at + right)[:, None])
    return np.where(there, data[np.where(there, place, 0)] if data.size else 0, 0).astype(np.uint8), left, right


def _reduced(data: np.ndarray, offsets: np.ndarray, min_len: int) -> tuple[np.ndarray, ...]:
    """Anchors of a block: positions, documents, hashes, and the mask of those that are whole copies within it."""
    at, hashes = anchors(data, offsets, min_len)
    doc = np.searchsorted(offsets, at, side="right") - 1
    mask = np.zeros(at.size, np.uint64)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    many = np.sort(order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]) if at.size else order
    if many.size:
        around = Surroundings(*cut_out(data, offsets, at[many], doc[many], min_len), min_len)
        copies = around.whole_copies()
        mask[many[copies]] = around.all_windows()[copies]
    return at - offsets[doc], doc, hashes, mask


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 100) -> DataFrame:
    """Rows ``(id, n_bytes, kept, spans)``: the bytes that stay, and the removed runs ``(start, end)`` in bytes.

    A byte goes if a string of ``min_len`` bytes over it (``min_len`` at least 80) also starts earlier: in a document with a smaller
    id, or earlier in the same one. Strings are those of the input, and none crosses documents. Ids are whole
    numbers; rows without one are left out, and of rows with one id the greatest text counts. A null text is empty.
    A text that an earlier document has too is removed whole (if it has ``min_len`` bytes), so groups of copies
    take part once. Memory of a task follows its share of the anchors; no group is brought together but the
    distinct surroundings of one gram, one per block and kind.
    """
    if min_len < SPREAD + 16:
        raise ValueError(f"min_len must be {SPREAD + 16} or more")
    texts = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    ).groupBy("_id").agg(F.max("_text").cast("binary").alias("_text"))
    firsts = texts.groupBy(F.sha2("_text", 256).alias("_sha")).agg(F.min("_id").alias("_id")).select("_id", F.lit(True).alias("_first"))
    own = texts.join(firsts, "_id").drop("_first")
    row = "_key long, _id long, _at int, _mask long"
    names = ["_key", "_id", "_at", "_mask"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vec.utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")  # a block's documents must come in order of their ids
            for group in _in_order(order, offsets):
                part = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in group])
                local = np.concatenate([[0], np.cumsum(offsets[group + 1] - offsets[group])])
                at, doc, hashes, mask = _reduced(part, local, min_len)
                key = np.where(mask > 0, vec.mix64(ids[group][doc].astype(np.uint64) * np.uint64(SPREAD) + at.astype(np.uint64)), hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(ids[group][doc]), pa.array(at.astype(np.int32)), pa.array(mask.view(np.int64))], names=names)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("_key", pa.int64()), ("_id", pa.int64()), ("_at", pa.int32()), ("_mask", pa.int64())]))
        key, mask = table["_key"].to_numpy(), table["_mask"].to_numpy()
        candidates = np.flatnonzero(mask == 0)
        order = candidates[np.argsort(key[candidates], kind="stable")]
        same = key[order][1:] == key[order][:-1]
        keep = mask != 0
        keep[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if order.size else False
        yield from table.filter(pa.array(keep)).to_batches(max_chunksize=50_000)

    found = own.mapInArrow(emit, row).repartition("_key").mapInArrow(shared, row)
    by_doc = found.groupBy("_id").agg(F.collect_list(F.struct("_key", "_at", "_mask")).alias("_list"))
    before = SPREAD - 1

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vec.utf8(batch.column(1))
            ids, items = batch.column(0).to_numpy(), batch.column(2)
            bounds, fields = items.offsets.to_numpy(), items.values
            for lo, hi in vec.blocks(offsets, vec.BLOCK):
                a, b = bounds[lo], bounds[hi]
                key, at, mask = (fields.field(i).to_numpy()[a:b] for i in range(3))
                doc = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
                part, local = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                for x in range(0, key.size, 20_000):
                    cut = slice(x, x + 20_000)
                    matrix, left, right = cut_out(part, local, at[cut] + local[doc[cut]], doc[cut], min_len)
                    done = mask[cut] != 0  # whole copies within their block need no bytes
                    lengths = np.where(done, 0, before + min_len)
                    around = pa.Array.from_buffers(pa.binary(), lengths.size, [
                        None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(matrix[~done]))])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(key[cut]), pa.array(ids[lo + doc[cut]]), pa.array(at[cut]), pa.array(mask[cut]), around,
                        pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))], names=[*names, "_around", "_left", "_right"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, open_ones = [], []
        for batch in batches:
            done = np.flatnonzero(batch.column(3).to_numpy() != 0)
            rows.append(batch.select([1, 2, 3]).take(pa.array(done)))
            open_ones.append(batch.take(pa.array(np.flatnonzero(batch.column(3).to_numpy() == 0))))
        yield from rows
        if not sum(x.num_rows for x in open_ones):
            return
        table = pa.Table.from_batches(open_ones)
        table = table.take(pa.array(np.lexsort((table["_at"].to_numpy(), table["_id"].to_numpy()))))
        data, offsets = vec.utf8(table["_around"].cast(pa.large_binary()))
        matrix = data[offsets[0] : offsets[-1]].reshape(-1, before + min_len)
        mask = Surroundings(matrix, table["_left"].to_numpy(), table["_right"].to_numpy(), min_len).repeated()
        hit = np.flatnonzero(mask)
        yield pa.RecordBatch.from_arrays([
            pa.array(table["_id"].to_numpy()[hit]), pa.array(table["_at"].to_numpy()[hit]), pa.array(mask[hit].view(np.int64))], names=names[1:])

    masks = texts.join(by_doc, "_id").select("_id", "_text", "_list").mapInArrow(
        surround, f"{row}, _around binary, _left int, _right int").repartition("_key").mapInArrow(decide, "_id long, _at int, _mask long")
    gone = masks.groupBy("_id").agg(F.collect_list(F.struct("_at", "_mask")).alias("_gone"))
    joined = texts.join(firsts, "_id", "left").join(gone, "_id", "left").select("_id", "_text", F.coalesce("_first", F.lit(False)).alias("_first"), "_gone")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = np.arange(SPREAD, dtype=np.uint64)
        for batch in batches:
            data, offsets = vec.utf8(batch.column(1))
            first, gone = batch.column(2).to_pylist(), batch.column(3)
            bounds, fields = gone.offsets.to_numpy(), gone.values
            at_all, mask_all = (fields.field(i).to_numpy() for i in range(2))
            kept, spans = [], []
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                if not first[i] and text.size >= min_len:
                    kept.append(b"")
                    spans.append([{"start": 0, "end": text.size}])
                    continue
                at, mask = at_all[bounds[i] : bounds[i + 1]].astype(np.int64), mask_all[bounds[i] : bounds[i + 1]].view(np.uint64)
                which, d = np.nonzero((mask[:, None] >> bit) & np.uint64(1))
                starts = at[which] - d
                marks = np.zeros(text.size + 1, np.int32)
                np.add.at(marks, starts, 1)
                np.add.at(marks, starts + min_len, -1)
                lost = np.cumsum(marks)[:-1] > 0
                a, b = vec.run_bounds(lost, np.empty(0, np.int64))
                kept.append(text[~lost].tobytes())
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(kept, pa.binary()), pa.array(spans, kind)], names=[id_col, "n_bytes", "kept", "spans"])

    return joined.mapInArrow(rewrite, f"`{id_col}` long, n_bytes long, kept binary, spans array<struct<start:bigint,end:bigint>>")


def _in_order(order: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in the given order, in groups of about a block of bytes."""
    sizes = np.concatenate([[0], np.cumsum(offsets[order + 1] - offsets[order])]) if order.size else np.zeros(1, np.int64)
    for a, b in vec.blocks(sizes):
        yield order[a:b]
