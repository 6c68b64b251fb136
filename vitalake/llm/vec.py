"""Vectorised text work inside Arrow tasks: byte views, words, and hashes of many segments at once.

All functions take and return numpy arrays; nothing here knows about Spark. A task cuts its rows into
blocks of about ``BLOCK`` bytes (a longer document is a block of its own), so memory follows the longest
document and not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits (one to one)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(values: np.ndarray, seed: int) -> np.ndarray:
    """Another independent hash of 64-bit hashes."""
    return mix64(values ^ mix64(np.array([seed + 1], dtype=np.uint64) * np.uint64(_BASE))[0])


BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if _powers.get("up", np.empty(0)).size < n:
        size = max(n, BLOCK + 1024)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


class Prefix:
    """Prefix sums of a polynomial hash: the hash of any segment in constant time."""

    def __init__(self, hashed: np.ndarray):
        up, self.down = powers(hashed.size + 1)
        self.sums = np.empty(hashed.size + 1, dtype=np.uint64)
        self.sums[0] = 0
        np.cumsum(hashed * up[: hashed.size], dtype=np.uint64, out=self.sums[1:])

    def segments(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column without nulls, as views where possible."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row is a range of its own."""
    at, rows = 0, offsets.size - 1
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), rows)
        yield at, to
        at = to


def word_bounds(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space; no run crosses a document's start."""
    return run_bounds(~SPACE[data], doc_starts)


def run_bounds(inside: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; no run crosses a document's start."""
    n = inside.size
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = doc_starts[doc_starts < n]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[cuts > 0] - 1
    last[cuts] = inside[cuts]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + length - 1`` of each pair, one after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if total == 0:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def per_doc(items: np.ndarray, doc_starts: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted positions: index of the first of each document and of the first after it."""
    return np.searchsorted(items, doc_starts), np.searchsorted(items, doc_ends)


def word_hashes(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of all words."""
    starts, ends = word_bounds(data, doc_starts)
    if starts.size == 0:
        return starts, ends, np.empty(0, np.uint64)
    return starts, ends, Prefix(BYTE_HASH[data]).segments(starts, ends)
