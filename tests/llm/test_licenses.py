import random
from bisect import bisect_left

import pytest

from tests.llm.cases import awkward, nothing
from tidemark.llm import licenses

SCANNER = licenses.Scanner()


def test_longest_rising_sequence():
    rng = random.Random(2)
    for _ in range(200):
        values = rng.sample(range(100), rng.randrange(0, 30))
        tops = []
        for v in values:
            at = bisect_left(tops, v)
            tops[at:at + 1] = [v]
        chain = [values[i] for i in licenses.rising(values)]
        assert len(chain) == len(tops) and chain == sorted(set(chain))


def test_alignment_is_in_order_and_of_equal_words():
    rng = random.Random(4)
    for _ in range(300):
        text = [rng.choice("abcdefghij") for _ in range(rng.randrange(40))]
        template = [rng.choice("abcdefghij") for _ in range(rng.randrange(20))]
        pairs = licenses.align(text, template)
        assert all(text[i] == template[j] for i, j in pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:], strict=False))
    same = [str(i) for i in range(50)]
    assert licenses.align(same, same) == [(i, i) for i in range(50)]


def test_every_template_is_found_whole_and_with_edits():
    rng = random.Random(6)
    filler = [f"w{i}" for i in range(300)] + ["the", "of", "this", "in", "license"]
    for name, whole in licenses.TEMPLATES.items():
        template = whole.text
        words = template.split()
        around = [" ".join(rng.choices(filler, k=200)) for _ in range(2)]
        hits = list(SCANNER.scan(f"{around[0]}\n{template}\n{around[1]}"))
        assert [(h[0], h[1]) for h in hits] == [(name, 1.0)], name
        assert hits[0][3] - hits[0][2] + 1 == len(licenses.words_of(template))
        if len(words) > 30 and name != "GPL-2.0-only notice":  # the changes take away the phrase that names this one
            changed = words[:10] + ["inserted"] + words[10:20] + words[22:]
            changed[-5] = "replaced"
            found = [h for h in SCANNER.scan(f"{around[0]} {' '.join(changed)} {around[1]} {template}") if h[0] == name]
            assert len(found) == 2 and found[0][1] >= 0.85 and found[1][1] == 1.0


def test_similar_notices_are_told_apart():
    text = "Licensed under CC BY-SA 4.0. some words between Licensed under CC BY-NC 4.0."
    assert [h[0] for h in SCANNER.scan(text)] == ["CC-BY-SA-4.0 line", "CC-BY-NC-4.0 line"]


NOTICES = {
    "GPL-2.0 notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
        Public License for more details.""",
    "LGPL-2.1 notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or
        (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        Lesser General Public License for more details.""",
    "AGPL-3.0 notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        Affero General Public License for more details.""",
    "GPL-2.0-only notice": """This program is free software; you can redistribute it and/or modify it under the terms of
        version 2 of the GNU General Public License as published by the Free Software Foundation.""",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-ND-4.0 line": "Licensed under CC BY-ND 4.0.",
    "CC-BY-ND-4.0 statement": """This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International
        License.""",
    "BSD-3-Clause": licenses.TEMPLATES["BSD-3-Clause"].text,
    "BSD-2-Clause": licenses.TEMPLATES["BSD-2-Clause"].text,
    "MPL-2.0 notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}


def test_relatives_are_told_apart():
    for name, text in NOTICES.items():
        assert [h[0] for h in SCANNER.scan(f"some words before it. {text} and some after it")] == [name]


def test_an_unknown_relative_is_nothing():
    old = NOTICES["LGPL-2.1 notice"]
    for text in (old.replace("Lesser", "Library").replace("2.1", "2"), old.replace("2.1", "7"), "Licensed under CC BY-XX 4.0.",
                 "Licensed under CC BY 3.0.", "Released under the Apache License.", "Released under the Other License."):
        assert not list(SCANNER.scan(text)), text


def test_a_phrase_has_to_be_in_its_template():
    with pytest.raises(ValueError, match="not in its template"):
        licenses.Scanner({"x": licenses.Template("one two three", ("two one",))})


def every_stretch(scanner, words, name, template):
    """Whether any stretch of the allowed length, tried one after the other, holds the notice."""
    reach = int(scanner.stretch * len(template))
    for begin in range(len(words)):
        for end in range(begin + 1, min(len(words), begin + reach) + 1):
            pairs = licenses.align(words[begin:end], template)
            if len(pairs) >= scanner.coverage * len(template) and scanner._told(name, pairs):
                return True
    return False


def test_agrees_with_every_stretch_of_text():
    rng = random.Random(8)
    texts = {"short": licenses.Template("alpha beta gamma delta two", ("delta two",)),
             "long": licenses.Template("the one may use the two and the three or copy it under the five of six", ("five of six",))}
    scanner = licenses.Scanner(texts)
    outcomes = set()
    for round_ in range(250):
        name = rng.choice(list(texts))
        template = licenses.words_of(texts[name].text)
        noted = [w for w in template if rng.random() > rng.choice([0.0, 0.08, 0.2])]
        for _ in range(rng.randrange(0, int(1.3 * len(template)))):
            noted.insert(rng.randrange(len(noted) + 1), rng.choice(["x", "y", "z", "the"]))
        words = rng.choices(["the", "of", "alpha", "u", "v"], k=rng.randrange(6)) + noted + rng.choices(["u", "it"], k=3)
        found = any(h[0] == name for h in scanner.scan(" ".join(words)))
        wanted = every_stretch(scanner, words, name, template)
        outcomes.add(wanted)
        assert found == wanted, (round_, name, " ".join(words))
    assert outcomes == {True, False}


def test_the_span_is_no_wider_than_needed():
    text = "this work, this work is licensed under the GNU General Public License, version 3. this version 3"
    assert [h[2:] for h in SCANNER.scan(text)] == [(2, 13)]


def test_clean_text_has_none():
    assert not list(SCANNER.scan("the version of this license is under the general public " * 50 and "no notice here"))
    assert not list(SCANNER.scan(None)) and not list(SCANNER.scan(""))


def test_rows(spark):
    assert licenses.license_notices(awkward(spark)).count() == 0
    assert licenses.license_notices(nothing(spark)).count() == 0
    docs = spark.createDataFrame([(None, "Released under the MIT License."), (1, "x Released under the MIT License. y")] * 2,
                                 "doc_id bigint, text string")
    rows = sorted(map(tuple, licenses.license_notices(docs).collect()), key=str)
    assert rows == [(1, "MIT line", 1.0, 1, 5)] * 2 + [(None, "MIT line", 1.0, 0, 4)] * 2
