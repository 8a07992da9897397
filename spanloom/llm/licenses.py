"""License scans by patience alignment.

A template is aligned with a stretch of a text word by word: equal words at both ends first, then the words that
occur once in each, of which the longest increasing subsequence stays; the gaps between these are aligned the same
way. Coverage is the aligned share of the template's words. A stretch whose coverage reaches ``least``, in no more
than ``SPREAD`` times the template's words from its first to its last aligned word, is a match.

Stretches: a match holds at least ``least`` of the template's words, so it holds one of those that make up the
rest and more; these are the template's anchors (rare words first), and places near anchors are stretches. A text
without any anchor is done after a substring search. A stretch that repeats a word of the template which the
template has once is cut there, so that several copies of a notice are found one by one.

Defined results: a null or empty text has no match; of overlapping matches the one of most aligned words stays
(ties: the earlier, then the first template); repeated rows are reported each; all columns are kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, table

LEAST, SPREAD = 0.8, 2
WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")

#: Public license notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs (i, j) of aligned equal words, ascending in both."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            found.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        once_a, once_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        place = {w: k for k, w in enumerate(b[j:j_end], j) if once_b[w] == 1}
        pairs = [(k, place[w]) for k, w in enumerate(a[i:i_end], i) if once_a[w] == 1 and w in place]
        chain = increasing(pairs)
        if not chain:
            continue
        found += chain
        before = (i - 1, j - 1)
        for k, m in [*chain, (i_end, j_end)]:
            todo.append((before[0] + 1, k, before[1] + 1, m))
            before = (k, m)
    return sorted(found)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (ascending first parts) whose second parts ascend."""
    tops, last, back = [], [], [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        tops[k : k + 1], last[k : k + 1] = [j], [n]
        back[n] = last[k - 1] if k else -1
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


@dataclass(frozen=True)
class Match:
    name: str
    start: int  # words
    end: int
    aligned: int
    coverage: float


class Template:
    def __init__(self, name: str, text: str, least: float) -> None:
        self.name, self.words, self.least = name, words_of(text), least
        counts, total, self.anchors = Counter(self.words), 0, set()
        for w in sorted(counts, key=lambda w: (-len(w), w)):  # long words are rare
            if total > (1 - least) * len(self.words) + 1e-9:
                break
            self.anchors.add(w)
            total += counts[w]
        self.once = {w for w in counts if counts[w] == 1}

    def stretches(self, words: list[str]) -> list[tuple[int, int]]:
        reach, out = SPREAD * len(self.words), []
        for p in (i for i, w in enumerate(words) if w in self.anchors):
            if out and p - reach <= out[-1][1]:
                out[-1][1] = p + reach
            else:
                out.append([p - reach, p + reach])
        cut = []
        for lo, hi in out:
            lo, hi = max(0, lo), min(len(words), hi + 1)
            counts = Counter(w for w in words[lo:hi] if w in self.once)
            again = next((w for w in self.words if counts.get(w, 0) > 1 and w in self.anchors), None)
            cut.append((lo, hi))
            if again is None:
                continue
            lead = self.words.index(again)
            starts = [k for k in range(lo, hi) if words[k] == again]
            for n, k in enumerate(starts):  # one copy of the word in each piece
                left = max(lo, k - lead * SPREAD, starts[n - 1] + 1 if n else lo)
                right = min(hi, k + reach, starts[n + 1] if n + 1 < len(starts) else hi)
                cut.append((left, right))
        return cut

    def matches(self, words: list[str]) -> Iterator[Match]:
        for lo, hi in self.stretches(words):
            pairs = align(self.words, words[lo:hi])
            if len(pairs) >= self.least * len(self.words) - 1e-9:
                start, end = lo + pairs[0][1], lo + pairs[-1][1] + 1
                if end - start <= SPREAD * len(self.words):
                    yield Match(self.name, start, end, len(pairs), len(pairs) / len(self.words))


class Scanner:
    def __init__(self, notices: dict[str, str], least: float) -> None:
        self.templates = [Template(k, v, least) for k, v in notices.items()]
        self.anchors = sorted({a for t in self.templates for a in t.anchors})

    def __call__(self, text: str | None) -> list[Match]:
        low = (text or "").lower()
        if not any(a in low for a in self.anchors):
            return []
        words = words_of(low)
        held = set(words)
        found = [m for t in self.templates if t.anchors & held for m in t.matches(words)]
        kept: list[Match] = []  # in order of their places
        for m in sorted(found, key=lambda m: (-m.aligned, m.start)):
            at = bisect_left(kept, m.start, key=lambda k: k.start)
            if (not at or kept[at - 1].end <= m.start) and (at == len(kept) or m.end <= kept[at].start):
                kept.insert(at, m)
        return kept


@lru_cache(4)
def _scanner(notices: tuple, least: float) -> Scanner:
    return Scanner(dict(notices), least)


MATCHES = "array<struct<license:string,start:int,end:int,coverage:double>>"


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES, least: float = LEAST, text: str = "text", out: str = "licenses") -> DataFrame:
    """docs with ``out``: array of (license, start, end, coverage); start and end count words."""
    known = tuple(notices.items())
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(MATCHES)
    def matched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = _scanner(known, least)
        for texts in batches:
            yield pd.Series([[{"license": m.name, "start": m.start, "end": m.end, "coverage": m.coverage} for m in scanner(t)] for t in texts])

    (name,) = fresh(docs, out)
    df = docs.withColumn(name, matched(F.col(text)))
    return df if name == out else df.withColumnRenamed(name, out)


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("licenses", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"))), ",")
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda m: m["license"]))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("licenses", lambda m: m["coverage"])), F.lit(0.0)).alias("coverage"), spans.alias("spans"),
    )
