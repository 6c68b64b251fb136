"""License scans by template markup.

A template is license wording with marked regions: ``<<beginOptional>> ... <<endOptional>>`` may be missing (and may be
nested), ``<<var;max=n>>`` stands for up to n words of any kind. Templates compile into one automaton over words; a
text holds a template where all its mandatory words stand one after the other, with nothing but these regions between.
Case, white space and punctuation are not wording.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vitalake.llm import bytewords, vec

OTHER = 0
_MARK = re.compile(r"<<(.*?)>>", re.S)
_VAR = re.compile(r"var(?:;\s*name=[^;]*)?;\s*max=(\d+)")


@dataclass(frozen=True)
class Template:
    label: str
    markup: str
    base: bool = False


#: Fixed phrases and their labels.
BASE = (
    Template("mit", "under the MIT license", True),
    Template("apache-2", "Apache License Version 2", True),
    Template("cc-by-nc", "CC BY NC", True),
)
_GNU_TAIL = (
    " General Public License <<beginOptional>>GPL<<endOptional>> <<beginOptional>>as published by the Free Software Foundation<<endOptional>> "
    "<<beginOptional>>either<<endOptional>> <<beginOptional>>version<<endOptional>> "
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "<<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "<<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution. "
)
#: Public license wordings and notices; the labels are this module's own.
OWN = (
    Template("mit-text", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name=software;max=8>> "
        "<<beginOptional>>and associated documentation files<<endOptional>> <<beginOptional>>(the \"Software\")<<endOptional>>, to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software."
    )),
    Template("isc-text", (
        "Permission to use, copy, modify, <<beginOptional>>and<<endOptional>> <<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    )),
    Template("bsd-text", _BSD_HEAD),
    Template("bsd-3-clause-text", _BSD_HEAD + (
        "<<beginOptional>>3<<endOptional>> Neither the name of <<var;name=holder;max=12>> nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."
    )),
    Template("apache-2-notice", (
        "Licensed under the Apache License, Version 2.0 <<beginOptional>>(the \"License\")<<endOptional>>; you may not use <<var;name=file;max=4>> except in compliance with the License."
    )),
    Template("apache-2-name", "Apache <<beginOptional>>Software<<endOptional>> <<beginOptional>>License<<endOptional>> <<beginOptional>>version<<endOptional>> 2.0"),
    Template("gpl-2", "GNU" + _GNU_TAIL + "2"),
    Template("gpl-3", "GNU" + _GNU_TAIL + "3"),
    Template("lgpl-2.1", "GNU Lesser" + _GNU_TAIL + "2.1"),
    Template("lgpl-3", "GNU Lesser" + _GNU_TAIL + "3"),
    Template("agpl-3", "GNU Affero" + _GNU_TAIL + "3"),
    Template("mpl-2", "Mozilla Public License <<beginOptional>>(MPL)<<endOptional>> <<beginOptional>>version<<endOptional>> 2.0"),
    Template("cc-by-4", "CC BY 4.0"),
    Template("cc-by-4", "Creative Commons Attribution 4.0 <<beginOptional>>International<<endOptional>> <<beginOptional>>Public<<endOptional>> License"),
    Template("cc-by-sa-4", "CC BY SA 4.0"),
    Template("cc-by-sa-4", "Creative Commons Attribution-ShareAlike 4.0 <<beginOptional>>International<<endOptional>> <<beginOptional>>Public<<endOptional>> License"),
    Template("cc-by-nc-4", "CC BY NC 4.0"),
    Template("cc-by-nc-4", "Creative Commons Attribution-NonCommercial 4.0 <<beginOptional>>International<<endOptional>> <<beginOptional>>Public<<endOptional>> License"),
)
TEMPLATES = BASE + OWN


def cut(text: str) -> list[bytes]:
    return [w for part in bytewords.words(text.encode(), bytewords.ALPHANUMERIC) for w in part]


@dataclass
class Automaton:
    """States of all templates. ``words[s]`` maps a word id to the next state, ``anything[s]`` is the next state on any word."""

    ids: dict[bytes, int] = field(default_factory=dict)
    words: list[dict[int, int]] = field(default_factory=list)
    anything: dict[int, int] = field(default_factory=dict)
    free: list[list[int]] = field(default_factory=list)
    accepts: dict[int, int] = field(default_factory=dict)

    def state(self) -> int:
        self.words.append({})
        self.free.append([])
        return len(self.words) - 1

    def add(self, template: Template, number: int) -> int:
        """Adds a template and returns its first state."""
        first = here = self.state()
        open_regions: list[int] = []
        for i, piece in enumerate(_MARK.split(template.markup)):
            if i % 2 == 0:
                for word in cut(piece):
                    after = self.state()
                    self.words[here][self.ids.setdefault(word, len(self.ids) + 1)] = after
                    here = after
            elif piece.strip() == "beginOptional":
                after = self.state()  # an own state, so that the way round does not pass through words before it
                self.free[here].append(after)
                here = after
                open_regions.append(here)
            elif piece.strip() == "endOptional" and open_regions:
                after = self.state()
                self.free[here].append(after)
                self.free[open_regions.pop()].append(after)
                here = after
            elif _VAR.fullmatch(piece.strip()):
                after = self.state()
                self.free[here].append(after)
                for _ in range(int(_VAR.fullmatch(piece.strip())[1])):
                    self.anything[here] = here = self.state()
                    self.free[here].append(after)
                here = after
            else:
                raise ValueError(f"template {template.label}: unknown or unopened mark {piece!r}")
        if open_regions:
            raise ValueError(f"template {template.label}: an optional region is not closed")
        self.accepts[here] = number
        return first

    def finish(self, firsts: list[int]) -> Matcher:
        def reach(states: Sequence[int]) -> frozenset[int]:
            seen, todo = set(states), list(states)
            while todo:
                for s in self.free[todo.pop()]:
                    if s not in seen:
                        seen.add(s)
                        todo.append(s)
            return frozenset(seen)

        closed = [reach([s]) for s in range(len(self.words))]
        start = reach(firsts)
        if any(s in self.anything or s in self.accepts for s in start):
            raise ValueError("a template must hold a word and must not begin with a replaceable region")
        by_word: dict[int, frozenset[int]] = {}
        for s in start:
            for word, to in self.words[s].items():
                by_word[word] = by_word.get(word, frozenset()) | closed[to]
        return Matcher(self.ids, self.words, self.anything, self.accepts, closed, by_word)


@dataclass(frozen=True)
class Matcher:
    ids: dict[bytes, int]
    words: list[dict[int, int]]
    anything: dict[int, int]
    accepts: dict[int, int]
    closed: list[frozenset[int]]
    by_word: dict[int, frozenset[int]]

    def numbers(self, text: bytes) -> np.ndarray:
        """Word ids of a whole text; words of no template are all ``OTHER``."""
        parts = [np.fromiter(map(self.ids.get, part, repeat(OTHER)), np.int32, len(part)) for part in bytewords.words(text, bytewords.ALPHANUMERIC)]
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def at(self, numbers: np.ndarray, start: int) -> dict[int, int]:
        """Template number -> end of its longest match from ``start``."""
        found: dict[int, int] = {}
        states, here = self.by_word.get(int(numbers[start]), frozenset()), start + 1
        while states:
            for s in states:
                if s in self.accepts:
                    found[self.accepts[s]] = here
            if here == numbers.size:
                break
            word, after = int(numbers[here]), set()
            for s in states:
                if word in self.words[s]:
                    after |= self.closed[self.words[s][word]]
                if s in self.anything:
                    after |= self.closed[self.anything[s]]
            states, here = after, here + 1
        return found

    def matches(self, numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(template number, start, end)`` by start."""
        begins = np.zeros(len(self.ids) + 1, bool)
        begins[list(self.by_word)] = True
        for start in np.flatnonzero(begins[numbers]).tolist():
            for number, end in sorted(self.at(numbers, start).items()):
                yield number, start, end


def compile_templates(templates: Sequence[Template]) -> Matcher:
    automaton = Automaton()
    return automaton.finish([automaton.add(t, i) for i, t in enumerate(templates)])


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, n_words, n_covered, matches)``, one per input row; ``matches`` are ``(label, base, start, end)`` by start, in words.

    A template counts once per start, with its longest match; ``n_covered`` are the words in any match. Null or empty
    texts have no words. Whole texts are read in pieces of a megabyte. There is no shuffle; the templates are a
    parameter and travel with the task. Ids may repeat or be null, other columns are not read.
    """
    matcher, listed = compile_templates(templates), tuple(templates)
    kind = docs.schema[id_col].dataType.simpleString()
    entry = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vec.utf8(batch.column(1))
            sizes, covered, lists = [], [], []
            for i in range(batch.num_rows):
                numbers = matcher.numbers(data[offsets[i] : offsets[i + 1]].tobytes())
                found, reached, total = [], 0, 0
                for number, start, end in matcher.matches(numbers):
                    found.append({"label": listed[number].label, "base": listed[number].base, "start": start, "end": end})
                    total += max(0, end - max(start, reached))
                    reached = max(reached, end)
                sizes.append(numbers.size)
                covered.append(total)
                lists.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(covered, pa.int64()), pa.array(lists, pa.list_(entry))],
                names=[id_col, "n_words", "n_covered", "matches"],
            )

    slim = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return slim.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_covered long, matches array<struct<label: string, base: boolean, start: long, end: long>>")


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: places, first and last start and labels of the base phrases, labels of all templates, and the
    share of the words that lie in matches."""
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])

    def joined(matches: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    return scanned.select(
        id_col, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("matches")).alias("labels"),
        F.when(F.col("n_words") > 0, F.col("n_covered") / F.col("n_words")).otherwise(0.0).alias("score"),
    )
