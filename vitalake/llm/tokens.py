"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

A trie of the vocabulary gets a failure link and a number of popped tokens per node. Reading a word symbol by
symbol, a missing edge adds the node's popped tokens to the count and follows its failure link, so the greedy
longest-match split is counted in time linear in the word and no piece is ever built. Counts are the number of
word pieces that the greedy split has.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitalake.llm import vec

#: Symbols 0 to 255 are bytes inside a word, 256 to 511 the same bytes as a word's last one.
LAST = 256
WIDTH = 512


@dataclass(frozen=True)
class Automaton:
    """Sorted edge keys (node * WIDTH + symbol), the nodes they lead to, failure links and popped tokens by node."""

    keys: np.ndarray
    to: np.ndarray
    fail: np.ndarray
    pops: np.ndarray

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each segment, all segments stepped together; -1 where the vocabulary lacks a symbol."""
        total = np.zeros(starts.size, np.int64)
        node = np.zeros(starts.size, np.int64)
        at = starts.copy()
        live = np.flatnonzero(at < ends)
        while live.size:
            here, pos = node[live], at[live]
            symbol = data[pos].astype(np.int64) + np.where(pos + 1 == ends[live], LAST, 0)
            key = here * WIDTH + symbol
            found = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
            hit = self.keys[found] == key
            stuck = ~hit & (self.fail[here] < 0)
            total[live] += np.where(hit, 0, self.pops[here])
            node[live] = np.where(hit, self.to[found], self.fail[here])
            at[live] += hit
            if stuck.any():
                total[live[stuck]] = -1
                at[live[stuck]] = ends[live[stuck]]
            live = live[at[live] < ends[live]]
        # what is still open at the end of a word is popped along the failure links
        live = np.flatnonzero((node > 0) & (total >= 0))
        while live.size:
            here = node[live]
            lost = self.fail[here] < 0
            total[live] = np.where(lost, -1, total[live] + self.pops[here])
            node[live] = np.where(lost, 0, self.fail[here])
            live = live[node[live] > 0]
        return total


def build(pieces: list[tuple[int, ...]]) -> Automaton:
    """Trie with failure links and popped-token counts, breadth first (root is node 0)."""
    children: list[dict[int, int]] = [{}]
    final: set[int] = set()
    for piece in pieces:
        node = 0
        for symbol in piece:
            if symbol not in children[node]:
                children[node][symbol] = len(children)
                children.append({})
            node = children[node][symbol]
        if node:
            final.add(node)
    fail, pops = [-1] * len(children), [0] * len(children)
    waiting = deque([0])
    while waiting:
        parent = waiting.popleft()
        for symbol, node in children[parent].items():
            waiting.append(node)
            if node in final:
                fail[node], pops[node] = 0, 1
                continue
            popped, back = pops[parent], fail[parent]
            while back >= 0 and symbol not in children[back]:
                popped, back = popped + pops[back], fail[back]
            if back >= 0:
                fail[node], pops[node] = children[back][symbol], popped
    edges = sorted((n * WIDTH + s, to) for n, kids in enumerate(children) for s, to in kids.items())
    keys = np.array([k for k, _ in edges], np.int64) if edges else np.array([-1], np.int64)
    to = np.array([t for _, t in edges], np.int64) if edges else np.array([0], np.int64)
    return Automaton(keys, to, np.array(fail, np.int64), np.array(pops, np.int64))


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, turned round: printable Latin-1
    stands for itself, the other bytes count up from code point 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str, word_end: str = "</w>") -> list[tuple[int, ...]]:
    """Pieces of a byte-level tokenizer file (JSON with ``model.vocab``) as symbol tuples."""
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    table, pieces = byte_letters(), []
    for name in names:
        body, ended = (name[: -len(word_end)], True) if name.endswith(word_end) and name != word_end else (name, False)
        if body and all(c in table for c in body):
            symbols = [table[c] for c in body]
            symbols[-1] += LAST * ended
            pieces.append(tuple(symbols))
    return pieces


def _classes() -> np.ndarray:
    """0 white space, 1 letters (all bytes of non-ASCII characters too), 2 others, 3 digits."""
    kinds = np.full(256, 2, np.uint8)
    for b in range(256):
        if re.match(rb"[A-Za-z\x80-\xff]", bytes([b])):
            kinds[b] = 1
    kinds[48:58] = 3
    kinds[vec.SPACE] = 0
    return kinds


KINDS = _classes()


def words(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters, runs of other marks, and single digits."""
    kinds = KINDS[data]
    first = kinds != 0
    first[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == 3)
    cuts = doc_starts[doc_starts < data.size]
    first[cuts] = kinds[cuts] != 0
    starts = np.flatnonzero(first)
    edge = np.ones(data.size + 1, bool)
    edge[1:-1] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 3)
    edge[cuts] = True
    edges = np.flatnonzero(edge)
    return starts, edges[np.searchsorted(edges, starts) + 1] if starts.size else starts


def count_tokens(docs: DataFrame, vocabulary: list[tuple[int, ...]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, n_words, n_tokens)``, one per input row; texts are lower-cased first.

    No shuffle: each Arrow batch is counted by itself, each distinct word of a block once. The automaton is
    broadcast; its size follows from the vocabulary. Null and blank texts have no words and no tokens, repeated
    rows are counted each, other columns are not read. A word with a byte that no piece covers is one (unknown) token.
    """
    spark = docs.sparkSession
    automaton = spark.sparkContext.broadcast(build(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = automaton.value
        for batch in batches:
            data, offsets = vec.utf8(batch.column(1))
            n_words = np.zeros(batch.num_rows, np.int64)
            n_tokens = np.zeros(batch.num_rows, np.int64)
            for a, b in vec.blocks(offsets):
                part, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends = words(part, local[:-1])
                if starts.size == 0:
                    continue
                hashes = vec.Prefix(vec.BYTE_HASH[part]).segments(starts, ends)
                _, shown, which = np.unique(hashes, return_index=True, return_inverse=True)
                counts = model.count(part, starts[shown], ends[shown])
                counts = np.where(counts < 0, 1, counts)
                summed = np.concatenate([[0], np.cumsum(counts[which])])
                lo, hi = vec.per_doc(starts, local[:-1], local[1:])
                n_words[a:b], n_tokens[a:b] = hi - lo, summed[hi] - summed[lo]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_tokens)], names=[id_col, "n_words", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    return slim.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_tokens long")
