"""License notices found by patience alignment with templates.

A template is aligned with a stretch of text by anchoring on the words that occur exactly once in
either, keeping the longest run of anchors that is in order in both, and aligning the gaps between
anchors in the same way; where a gap has no such words, its common beginning and end count. Coverage is the
share of the template's words aligned. A notice is an alignment of the wanted coverage inside a stretch of at most
``STRETCH`` times its template's words, in which the phrases that tell the template from its relatives (version, kind)
stand unbroken: so a GPL-2.0 notice is no GPL-3.0 notice, and an LGPL notice no GPL notice. Only stretches that hold enough of
the template's different words are aligned, which every notice does; text without notices costs a set intersection.

Known are (``TEMPLATES``): Apache-2.0, MIT, ISC, BSD-2-Clause, BSD-3-Clause, GPL-2.0 and 3.0, LGPL-2.1 and 3.0, AGPL-3.0, MPL-2.0,
CC0-1.0, the six CC BY licenses 4.0, and the Unlicense. Other licenses are not reported.

Defined results. NULL and empty texts hold nothing. Texts of any length are read whole, one document at a time. Every
occurrence is a row; of overlapping ones that with most words aligned, then the best covered, then the first by name. Rows repeating an id are read each. An empty
table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table

COVERAGE = 0.8
STRETCH = 2.0  # a notice lies in a stretch of text at most so many times as long as its template
WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")


@dataclass(frozen=True)
class Template:
    """A notice, and the phrases that tell it from its relatives: of each, one occurrence has to be aligned unbroken."""

    text: str
    phrases: tuple[str, ...] = ()


def _gnu(name: str, version: str, what: str) -> dict[str, Template]:
    """The notice of a GNU license, and the line that names it."""
    spoken = f"GNU {name}General Public License"
    letter = {"": "", "Lesser ": "L", "Affero ": "A"}[name]
    phrases = (f"gnu {name}general", f"version {version}")
    short = version if "." in version else f"{version}.0"
    return {
        f"{letter}GPL-{short} line": Template(f"This work is licensed under the {spoken}, version {version}.", phrases),
        f"{letter}GPL-{short} notice": Template(
            f"""This {what} is free software: you can redistribute it and/or modify it under the terms of the {spoken} as
            published by the Free Software Foundation, either version {version} of the License, or (at your option) any
            later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
            without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {spoken}
            for more details.""", phrases)}


def _creative_commons(code: str, name: str) -> dict[str, Template]:
    """The short line that names a license by its code, and the statement with its whole name."""
    return {
        f"CC-{code}-4.0 line": Template(f"Licensed under CC {code} 4.0.", (f"cc {code} 4.0",)),
        f"CC-{code}-4.0 statement": Template(
            f"This work is licensed under a Creative Commons {name} 4.0 International License.",
            (f"creative commons {name} 4.0",))}


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
    this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
    distribution."""

# Public license notices, as licensors ask for them to be quoted.
TEMPLATES = {
    "Apache-2.0 line": Template("Licensed under the Apache License, Version 2.0.", ("apache license version 2.0",)),
    "Apache-2.0 notice": Template("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""", ("apache license version 2.0",)),
    **_creative_commons("BY", "Attribution"),
    **_creative_commons("BY-SA", "Attribution-ShareAlike"),
    **_creative_commons("BY-NC", "Attribution-NonCommercial"),
    **_creative_commons("BY-ND", "Attribution-NoDerivatives"),
    **_creative_commons("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    **_creative_commons("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC0-1.0 statement": Template("""To the extent possible under law, the author has waived all copyright and related or
        neighboring rights to this work.""", ("waived all copyright",)),
    **_gnu("", "2", "program"), **_gnu("", "3", "program"),
    **_gnu("Lesser ", "2.1", "library"), **_gnu("Lesser ", "3", "library"), **_gnu("Affero ", "3", "program"),
    "GPL-2.0-only notice": Template("""This program is free software; you can redistribute it and/or modify it under the terms
        of version 2 of the GNU General Public License as published by the Free Software Foundation.""",
        ("version 2 of the gnu general public",)),
    "MPL-2.0 notice": Template("""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a
        copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        ("mozilla public license v 2.0",)),
    "Unlicense": Template("""This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means.""", ("unencumbered software",)),
    "ISC": Template("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    "MIT line": Template("Released under the MIT License.", ("mit license",)),
    "MIT grant": Template("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software."""),
    "BSD-2-Clause": Template(BSD),
    "BSD-3-Clause": Template(f"""{BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be
        used to endorse or promote products derived from this software without specific prior written permission.""",
        ("endorse or promote products",)),
}


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def rising(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience sorting."""
    tops, piles, below = [], [], [-1] * len(values)
    for i, value in enumerate(values):
        pile = bisect_left(tops, value)
        below[i] = piles[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(value)
            piles.append(i)
        else:
            tops[pile], piles[pile] = value, i
    chain, at = [], piles[-1] if piles else -1
    while at >= 0:
        chain.append(at)
        at = below[at]
    return chain[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal words (text, template), in order in both; gaps wait on a list, not on the call stack."""
    found, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a >= b or c >= d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        at = {text[i]: i for i in range(a, b) if in_text[text[i]] == 1}
        anchors = [(at[template[j]], j) for j in range(c, d) if in_template[template[j]] == 1 and template[j] in at]
        chain = [anchors[i] for i in rising([i for i, _ in anchors])]
        if not chain:
            continue
        found += chain
        edges = [(a - 1, c - 1), *chain, (b, d)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(found)


class Scanner:
    """All templates, looked for in one text after the other."""

    def __init__(self, templates: dict[str, Template] = TEMPLATES, coverage: float = COVERAGE, stretch: float = STRETCH):
        self.coverage, self.stretch = coverage, stretch
        self.templates = [(name, ws, Counter(ws)) for name, t in templates.items() if (ws := words_of(t.text))]
        self.vocabulary = {w for _, ws, _ in self.templates for w in ws}
        self.phrases = {name: [_places(ws, words_of(p)) for p in templates[name].phrases] for name, ws, _ in self.templates}

    def scan(self, text: str | None) -> Iterator[tuple[str, float, int, int]]:
        """(template, coverage, first word, last word) of every occurrence."""
        words = words_of(text)
        there = self.vocabulary.intersection(words)
        if not there:
            return
        candidates = [(n, ws, c) for n, ws, c in self.templates
                      if sum(k for w, k in c.items() if w in there) >= self.coverage * len(ws)]
        if not candidates:
            return
        places: dict[str, list[int]] = {}
        wanted = {w for _, ws, _ in candidates for w in ws}
        for i, word in enumerate(words):
            if word in wanted:
                places.setdefault(word, []).append(i)
        found = [hit for name, template, counts in candidates
                 for hit in self._occurrences(name, words, template, counts, places)]
        kept: list[tuple[str, float, int, int]] = []
        sizes = {name: len(template) for name, template, _ in candidates}
        for hit in sorted(found, key=lambda h: (-round(h[1] * sizes[h[0]]), -h[1], h[0])):  # most words aligned first
            if all(hit[3] < other[2] or hit[2] > other[3] for other in kept):
                kept.append(hit)
        yield from sorted(kept, key=lambda h: h[2:])

    def _occurrences(self, name: str, words: list[str], template: list[str], counts: Counter,
                     places: dict[str, list[int]]) -> Iterator[tuple[str, float, int, int]]:
        reach = int(self.stretch * len(template))
        need = self.coverage * len(template)
        hits = sorted((i, w) for w in counts for i in places.get(w, ()))
        inside: Counter = Counter()
        have, first, behind = 0, 0, -1  # template words that the stretch's words could cover; last word reported
        for at, (place, word) in enumerate(hits):
            inside[word] += 1
            have += inside[word] <= counts[word]
            while hits[first][0] <= place - reach or hits[first][0] <= behind:
                gone = hits[first][1]
                have -= inside[gone] <= counts[gone]
                inside[gone] -= 1
                first += 1
                if first > at:
                    break
            if have < need or first > at:
                continue
            begin, end = hits[first][0], min(len(words), place + len(template))
            pairs = _densest(align(words[begin:end], template), reach)
            if pairs:  # once more without the strays, with room for the words that they took
                (a, i), (b, j) = pairs[0], pairs[-1]
                begin, end = max(begin, begin + a - i), begin + b + len(template) - j
                pairs = _densest(align(words[begin:end], template), reach)
            if len(pairs) >= need and self._told(name, pairs):
                pairs = _tightened(words, template, [(begin + i, j) for i, j in pairs])
                behind = pairs[-1][0]
                yield name, len(pairs) / len(template), pairs[0][0], behind


    def _told(self, name: str, pairs: list[tuple[int, int]]) -> bool:
        """Whether one occurrence of every phrase is aligned with consecutive words."""
        at = {j: i for i, j in pairs}
        return all(any(all(at.get(j + n, -1) == at.get(j, -2) + n for n in range(size)) for j in begins)
                   for begins, size in self.phrases[name])


def _places(words: list[str], phrase: list[str]) -> tuple[list[int], int]:
    """Where a phrase begins, and how many words it has."""
    size = len(phrase)
    begins = [i for i in range(len(words) - size + 1) if words[i:i + size] == phrase]
    if not begins:
        raise ValueError(f"not in its template: {' '.join(phrase)}")
    return begins, size


def _tightened(words: list[str], template: list[str], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """As many pairs in a shorter stretch, while leaving out its first or its last word costs none."""
    while True:
        first, last = pairs[0][0], pairs[-1][0]
        for begin, end in ((first + 1, last + 1), (first, last)):
            closer = [(begin + i, j) for i, j in align(words[begin:end], template)]
            if len(closer) >= len(pairs):
                pairs = closer
                break
        else:
            return pairs


def _densest(pairs: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """The most pairs that lie in a stretch of ``reach`` words of text; strays at the ends fall off."""
    best, first = (0, 0, 0), 0  # pairs, length of the stretch (negative), index of the first
    for last, (place, _) in enumerate(pairs):
        while pairs[first][0] <= place - reach:
            first += 1
        best = max(best, (last + 1 - first, pairs[first][0] - place, first))
    return pairs[best[2]:best[2] + best[0]]


FOUND = "license string, coverage double, first_word bigint, last_word bigint"


def _found(batches: Iterator[pa.RecordBatch], templates: dict[str, Template], coverage: float) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(templates, coverage)
    for batch in batches:
        rows = [(i, *hit) for i, text in enumerate(batch.column("text")) for hit in scanner.scan(text.as_py())]
        index, *columns = zip(*rows, strict=True) if rows else [()] * 5
        kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(index, pa.int64())),
             *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
            ["doc_id", "license", "coverage", "first_word", "last_word"])


def license_notices(docs: DataFrame, templates: dict[str, Template] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, first_word and last_word of every notice in the texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _found(batches, templates, coverage), f"doc_id {kind}, {FOUND}")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_notices(table(spark, sf_dir, "documents"))
