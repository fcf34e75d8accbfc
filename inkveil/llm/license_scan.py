"""License scans: texts against a generalised suffix automaton of licence templates.

1. Templates (label, text) become numbers of words; one automaton holds all their runs, with a state's first end in each template.
2. A text's words are looked up in the templates' vocabulary by hash. Only runs of words whose neighbours stand so in some
   template, at least LEAST_RUN long, go through the automaton: any longer match lies in such a run, so none is lost.
3. Matching statistics: for each word of a run the longest match that ends there. Where a match ends (the next one isn't longer), a match of
   LEAST_RUN words or more is a block with its places in templates.
4. Chain: for each template, blocks in the order of the text extend the open chain where they go on in the template, within GAP words
   in both; the chain's covered words over the template's are its coverage. Chains from LEAST_COVER on are spans with the template's label.

A task holds the automaton, of the templates' size, and one text's words at a time; no rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import Words, slices
from inkveil.llm.substring_dedup import word_hashes

#: Words of a match at least; words between two blocks of a chain at most; part of a template that a chain covers at least.
LEAST_RUN, GAP, LEAST_COVER = 4, 40, 0.6

#: What a base phrase without a template's text is worth.
PHRASE_SCORE = 0.5

# Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public texts of licences, as far as they are the same in all copies.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "This project is licensed under the terms of the MIT license."),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
    ),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0-text",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You "
        "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
        "express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-text",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "bsd-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl-2.0-text",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)

#: The bytes between words, once A-Z are in lower case.
IS_GAP = np.zeros(256, bool)
IS_GAP[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_SPANS = "array<struct<label:string,first_word:long,last_word:long,covered:long,coverage:double>>"


def words_of(texts: list[bytes]) -> Words:
    return Words([t.lower() for t in texts], IS_GAP)  # bytes: A-Z only


@dataclass
class Automaton:
    """A generalised suffix automaton of sequences of numbers: each state is the runs that end at the same places.

    next: by state, from a number to a state. link: the state of the longest run that isn't in the state itself. length: of a state's longest
    run. ends: for each state the places (sequence, index of the last number) where its runs end.
    """

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    @classmethod
    def of(cls, sequences: list[list[int]]) -> Automaton:
        out = cls()
        for k, sequence in enumerate(sequences):
            last = 0
            for at, number in enumerate(sequence):
                last = out._append(last, number)
                out.ends[last].add((k, at))
        for state in sorted(range(1, len(out.link)), key=lambda s: -out.length[s]):
            out.ends[out.link[state]] |= out.ends[state]
        out.ends[0] = set()
        return out

    def _new(self, length: int, arcs: dict[int, int], link: int) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, state: int, target: int, number: int) -> int:
        """The state of the runs of target that are state's longest run and number, apart from longer ones."""
        if self.length[target] == self.length[state] + 1:
            return target
        part = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = part
        while state >= 0 and self.next[state].get(number) == target:
            self.next[state][number] = part
            state = self.link[state]
        return part

    def _append(self, last: int, number: int) -> int:
        if number in self.next[last]:
            return self._split(last, self.next[last][number], number)
        new, state = self._new(self.length[last] + 1, {}, 0), last
        while state >= 0 and number not in self.next[state]:
            self.next[state][number] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, self.next[state][number], number)
        return new

    def statistics(self, numbers: list[int]) -> Iterator[tuple[int, int]]:
        """For each number the length of the longest run of a sequence that ends there, and its state."""
        state = size = 0
        for number in numbers:
            while state and number not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if number in self.next[state]:
                state, size = self.next[state][number], size + 1
            yield size, state

    def blocks(self, numbers: list[int], least: int) -> Iterator[tuple[int, int, set[tuple[int, int]]]]:
        """Matches of at least so many numbers that no match of the next number contains: index of the last, length, places of ends."""
        found = list(self.statistics(numbers))
        for at, (size, state) in enumerate(found):
            if size >= least and (at + 1 == len(found) or found[at + 1][0] <= size):
                yield at, size, self.ends[state]


@dataclass
class Chain:
    """Blocks in the order of a text and a template: places of the first and last word in both, words that they cover."""

    first: int
    last: int
    end: int
    covered: int


class Scanner:
    """Phrases and templates, ready for texts."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], least_run: int, gap: int, least_cover: float):
        self.labels = [label for label, _ in templates]
        self.least_run, self.gap, self.least_cover = least_run, gap, least_cover
        texts = [t.encode() for _, t in templates] + [p.encode() for p in phrases]
        words = words_of(texts)
        hashes = word_hashes(words)
        self.known, numbers = np.unique(hashes, return_inverse=True)
        places = np.zeros(len(self.known), np.int64)
        places[numbers] = np.arange(len(numbers))
        #: the words themselves, by number
        self.bytes = [words.data[words.start[p] : words.end[p]].tobytes() for p in places.tolist()]
        each = [numbers[a:b].tolist() for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
        self.sizes, self.phrases = [len(s) for s in each[: len(templates)]], list(zip(each[len(templates) :], phrases.values(), strict=True))
        self.automaton = Automaton.of(each[: len(templates)])
        n = len(self.known) + 1
        self.neighbours = np.unique([a * n + b for s in each[: len(templates)] for a, b in zip(s[:-1], s[1:], strict=True)] or [-1])

    def numbers(self, words: Words) -> np.ndarray:
        """Each word's number; of words that aren't known, that of no word."""
        hashes = word_hashes(words)
        if not len(self.known) or not len(hashes):
            return np.full(len(hashes), len(self.known))
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, len(self.known))

    def _same(self, words: Words, numbers: np.ndarray, first: int, n: int) -> bool:
        """Whether the words are those of their numbers, not only alike in hash."""
        return all(words.data[words.start[k] : words.end[k]].tobytes() == self.bytes[numbers[k]] for k in range(first, first + n))

    def phrase_places(self, words: Words, numbers: np.ndarray) -> list[tuple[int, str]]:
        """Places of phrases (index of the first word among all words, label), in order."""
        found = []
        for phrase, label in self.phrases:
            m = len(phrase)
            here = np.ones(max(len(numbers) - m + 1, 0), bool)
            for j, number in enumerate(phrase):
                here &= numbers[j : j + len(here)] == number
            at = np.flatnonzero(here)
            at = at[words.row[at] == words.row[at + m - 1]] if len(at) else at
            found += [(k, label) for k in at.tolist() if self._same(words, numbers, k, m)]
        return sorted(found)

    def runs(self, words: Words, numbers: np.ndarray) -> list[tuple[int, int]]:
        """Runs of words (from, to) in one text whose neighbours stand so in a template, of least_run words or more."""
        if len(numbers) < max(2, self.least_run):
            return []
        pair = numbers[:-1] * (len(self.known) + 1) + numbers[1:]
        at = np.minimum(np.searchsorted(self.neighbours, pair), len(self.neighbours) - 1)
        good = np.concatenate(([False], (self.neighbours[at] == pair) & (words.row[:-1] == words.row[1:]), [False]))
        turn = np.flatnonzero(good[1:] != good[:-1])
        return [(a, b + 1) for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True) if b + 1 - a >= self.least_run]

    def spans(self, runs: list[tuple[int, list[int]]]) -> list[tuple[str, int, int, int, float]]:
        """Of one text's runs (place, numbers): label, first and last word, words covered, coverage of each chain; in order."""
        whole: list[tuple[str, int, int, int, float]] = []
        open_: dict[int, Chain] = {}

        def close(k: int) -> None:
            c = open_.pop(k)
            coverage = c.covered / self.sizes[k]
            if coverage >= self.least_cover:
                whole.append((self.labels[k], c.first, c.last, c.covered, coverage))

        for place, numbers in runs:
            for at, size, ends in self.automaton.blocks(numbers, self.least_run):
                last, of = place + at, {}
                for k, end in sorted(ends):
                    of.setdefault(k, []).append(end)
                for k, places in of.items():
                    c = open_.get(k)
                    # what a block shares with the chain counts once
                    after = [e for e in places if c and last > c.last and e > c.end and e - size - c.end <= self.gap] if c and last - size - c.last <= self.gap else []
                    if after:
                        end = after[0]
                        c.covered += min(size, last - c.last, end - c.end)
                        c.last, c.end = last, end
                        continue
                    if c:
                        close(k)
                    open_[k] = Chain(last - size + 1, last, places[0], size)
        for k in list(open_):
            close(k)
        return sorted(whole, key=lambda s: (s[1], s[2], s[0]))

    def scan(self, texts: list[bytes]) -> list[dict[str, object]]:
        words = words_of(texts)
        numbers = self.numbers(words)
        first = words.first.tolist()
        phrases: list[list[tuple[int, str]]] = [[] for _ in texts]
        runs: list[list[tuple[int, list[int]]]] = [[] for _ in texts]
        for at, label in self.phrase_places(words, numbers):
            k = int(words.row[at])
            phrases[k].append((at - first[k], label))
        for a, b in self.runs(words, numbers):
            k = int(words.row[a])
            if self._same(words, numbers, a, b - a):
                runs[k].append((a - first[k], numbers[a:b].tolist()))
        return [self._row(first[k + 1] - first[k], phrases[k], self.spans(runs[k]) if runs[k] else []) for k in range(len(texts))]

    def _row(self, n: int, phrases: list[tuple[int, str]], spans: list[tuple[str, int, int, int, float]]) -> dict[str, object]:
        base = sorted({label for _, label in phrases})
        names = ("label", "first_word", "last_word", "covered", "coverage")
        return {
            "n_words": n, "n_base": len(phrases), "first_word": phrases[0][0] if phrases else None, "last_word": phrases[-1][0] if phrases else None,
            "base_labels": ",".join(base), "labels": ",".join(sorted({*base, *(s[0] for s in spans)})),
            "score": max([PHRASE_SCORE if phrases else 0.0, *(s[4] for s in spans)]), "spans": [dict(zip(names, s, strict=True)) for s in spans],
        }


_COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans " + _SPANS


def _arrow(kind: str) -> pa.DataType:
    if kind == "string":
        return pa.string()
    return pa.float64() if kind == "double" else pa.int64()


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] | None = None,
    least_run: int = LEAST_RUN, gap: int = GAP, least_cover: float = LEAST_COVER,
) -> DataFrame:
    """One row per row of docs: the id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base: all places of phrases; first_word and last_word: their smallest and largest start. spans: label, first and last word, covered
    words and coverage of each chain of template matches. labels: of phrases and spans. score: the best coverage, or PHRASE_SCORE if only phrases stand there.

    A null or empty text has no words, no labels and score 0. Null or repeated ids are rows as others are. Texts are read whole; very long ones
    take time in proportion to their words. An empty table gives an empty result. Templates of fewer words than least_run never match. Other columns aren't read.
    """
    known = PHRASES if phrases is None else phrases
    of_span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("coverage", pa.float64())])
    plain = [c.split() for c in _COLUMNS.split(", spans")[0].split(", ")]
    schema = pa.struct([*((name, _arrow(kind)) for name, kind in plain), ("spans", pa.list_(of_span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(list(templates), known, least_run, gap, least_cover)
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                found = pa.array(scanner.scan(texts), schema)
                yield pa.RecordBatch.from_arrays([part.column(0), *found.flatten()], ["_id", *(f.name for f in schema)])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, {_COLUMNS}").withColumnRenamed("_id", id_col)
