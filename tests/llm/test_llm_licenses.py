import random
import re

import pytest

from codeassay.llm import licenses
from codeassay.llm.licenses import PHRASES, Automaton, Template, compile_template, with_licenses
from odd_rows import TEXTS, lower, no_documents, odd_documents, rows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
MIT = (
    "Copyright (c) 2020 A. Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, '
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice "
    'and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
    "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
    "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
GPL = (
    "MyTool is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
    "either version 3 of the License, or (at your option) any later version."
)
SAID = [
    (300, "This work is licensed under the GNU General Public License, version 3."), (301, "Licensed under CC BY-NC 4.0."), (302, "Released under the MIT License."),
    (303, "Licensed under the Apache License, Version 2.0."), (304, MIT), (305, MIT.replace("free of charge", "for money")), (306, GPL), (307, "mit license " * 50), (308, "no MIT licence, a summit license"),
    (309, "SPDX-License-Identifier: LGPL-2.1"), (310, "licensed under the GNU Lesser General Public License version 2.1 or at your option any later version"), (311, "cc\nby cc by the apache-license"),
    (312, "licensed under licensed under the the MIT license released under an x11 mit license"), (313, "Licensed under Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    (314, "ÉLicensed under the MIT License"), (315, "x " * 3000 + MIT + " y" * 3000 + GPL + GPL),
]


def expression(template):
    """The template over words that each begin with a blank, as Python's own engine reads it."""
    out, at = [], 0
    word = lambda text: "".join(f" {w}" for w in WORD.findall(lower(text)))
    for m in re.finditer("<<(.*?)>>", template.markup):
        out.append(word(template.markup[at : m.start()]))
        at, fields = m.end(), dict(re.findall(r'(\w+)="(.*?)"', m[1]))
        out.append({"beginOptional": "(?:", "endOptional": ")?"}.get(m[1]) or "(?: (?:%s)){%s,%s}" % (fields["match"].replace(".+", "[^ ]+"), fields["least"], fields["most"]))
    return re.compile("".join(out) + word(template.markup[at:]) + "(?= |$)")


def expected(key, text, templates):
    w = WORD.findall(lower(text))
    said = "".join(f" {x}" for x in w)
    places, base = [], set()
    for p in PHRASES:
        own = p.markup.split()
        at = [i for i in range(len(w)) if w[i : i + len(own)] == own]
        places += at
        base |= {p.label} if at else set()
    met = [t for t in templates if expression(t).search(said)]
    worth = [len(compile_template(t).mandatory) for t in met] + [len(p.markup.split()) for p in PHRASES if p.label in base]
    return key, len(w), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(base | {t.label for t in met}), max((x / (x + 8) for x in worth), default=0.0)


def test_like_brute_force(spark):
    texts = TEXTS + SAID
    out = with_licenses(odd_documents(spark, texts))
    templates = licenses.default_templates()
    found = rows(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert found == sorted((expected(*x, templates) for x in texts), key=repr)
    labels = {r["doc_id"]: r["labels"] for r in out.collect()}
    assert labels[300] == ["gpl", "gpl-3.0"] and labels[301] == ["cc-by", "cc-by-nc-4.0"] and labels[304] == ["mit-text"] and labels[305] == [] and labels[306] == ["gpl", "gpl-notice"]
    assert labels[313] == ["cc-by-nc-sa-4.0"] and "lgpl-2.1" in labels[309] and labels[308] == [] and labels[314] == ["mit"]


def test_spans_hold_what_was_accepted(spark):
    rows = with_licenses(odd_documents(spark, SAID)).collect()
    for r in rows:
        w = WORD.findall(lower(r["text"]))
        for s in r["spans"]:
            assert 0 <= s["start"] < s["end"] <= len(w)
        assert {s["label"] for s in r["spans"]} == set(r["labels"])
    long = next(r for r in rows if r["doc_id"] == 315)
    assert [s["start"] for s in long["spans"] if s["label"] == "mit-text"] == [3000 + len("Copyright c 2020 A Person".split())]
    assert len([s for s in long["spans"] if s["label"] == "gpl-notice"]) == 2


def test_odd_rows(spark):
    assert with_licenses(no_documents(spark)).count() == 0
    docs = odd_documents(spark).withColumnRenamed("kept", "labels").withColumnRenamed("row", "Score")
    out = with_licenses(docs)
    assert out.count() == len(TEXTS) and [c.lower() for c in out.columns].count("score") == 1
    assert not any(r["labels"] for r in with_licenses(odd_documents(spark, SAID), templates=[], phrases=()).collect())


@pytest.mark.parametrize("markup", ("<<beginOptional>>a", "a<<endOptional>>", "<<beginOptional>>a<<endOptional>>", "<<other>> a", '<<var;least="3";most="2">> a', ""))
def test_faulty_markup(spark, markup):
    with pytest.raises(ValueError):
        with_licenses(no_documents(spark), templates=[Template("x", markup)])


def test_automata_read_like_expressions():
    """Random templates over three words: the longest accepted span from each place is that of the expression."""
    rng = random.Random(3)

    def region(depth):
        out = []
        for _ in range(rng.randrange(1, 4)):
            kind = rng.randrange(4 if depth else 2)
            if kind <= 1:
                out.append(rng.choice("abc"))
            elif kind == 2:
                out.append(f"<<beginOptional>>{region(depth - 1)}<<endOptional>>")
            else:
                least = rng.randrange(3)
                out.append(f'<<var;name="v";match="{rng.choice(("a|b", ".+", "c"))}";least="{least}";most="{least + rng.randrange(3)}">>')
        return " ".join(out)

    for _ in range(300):
        template = Template("t", f"{region(2)} {rng.choice('abc')} {region(2)}")
        automaton, whole = Automaton(compile_template(template)), expression(template)
        w = [rng.choice("abcd") for _ in range(14)]
        for first in range(len(w)):
            ends = [e for e in range(first + 1, len(w) + 1) if whole.fullmatch("".join(f" {x}" for x in w[first:e]))]
            assert automaton.longest(w.__getitem__, first, len(w), {}) == max(ends, default=-1), (template.markup, w, first)
        least, most = automaton.compiled.before
        size = len(automaton.compiled.anchor)
        for first in range(len(w)):
            if automaton.longest(w.__getitem__, first, len(w), {}) > 0:
                assert any(tuple(w[first + d : first + d + size]) == automaton.compiled.anchor for d in range(least, most + 1))
