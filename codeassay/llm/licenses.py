"""License scans by template markup, compiled into token automata.

A template is wording with optional regions and replaceable ones, as license
lists write them::

    <<beginOptional>>this work is<<endOptional>> licensed under
    <<var;name="article";match="a|the";least="0";most="1">> mit license

Words are mandatory unless they stand in an optional region; a replaceable
region takes ``least`` to ``most`` words that match as a whole.  A template
becomes an automaton over words, in which optional parts are jumps forward.  A
span of a text is accepted if it is read from the first state to the last, so
all mandatory wording stands there exactly and in order.

Every accepted span holds the longest run of mandatory words of its template.
Its first words are the anchor: hashes of all word windows find anchors for a
slice at once, and automata only start at the few words before them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import ALNUM, LOWER, Slice, Words, inside_text, slices, window_hashes, words_of, worker_cache

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_MARKUP = re.compile(r"<<(.*?)>>", re.S)
_FIELD = re.compile(r'(\w+)="(.*?)"')
MOST_ANCHOR = 3
#: Mandatory words at which a template counts half.
HALF_WORDS = 8


@dataclass(frozen=True)
class Template:
    """``label`` for texts that hold the wording. A phrase is a template that is counted at every place."""

    label: str
    markup: str
    phrase: bool = False


# The phrases of the contract, and public wording of license texts and notices.
PHRASES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)
GRANT = '<<var;name="verb";match="licensed|released|distributed|published|available|provided";least="1";most="1">> under <<beginOptional>>the terms of<<endOptional>>'
ARTICLE = '<<var;name="article";match="a|an|the";least="0";most="1">>'
OWNER = '<<var;name="owner";match=".+";least="1";most="12">>'
AS_IS_MIT = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and noninfringement in no event shall <<var;name=\"holder\";match=\".+\";least=\"2\";most=\"12\">> be liable for any claim damages or other liability "
    "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
AS_IS_BSD = (
    f"this software is provided by {OWNER} as is and any express or implied warranties including but not limited to the implied warranties of merchantability "
    f"and fitness for a particular purpose are disclaimed in no event shall {OWNER} be liable for any direct indirect incidental special exemplary or consequential damages "
    "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability "
    "whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
BULLET = '<<var;name="bullet";match="[0-9a-z]";least="0";most="1">>'
BSD_TWO = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    f"{BULLET} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    f"{BULLET} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
BSD_THIRD = (
    f"{BULLET} neither the name of {OWNER} nor the names of <<var;name=\"whose\";match=\"its|their|the\";least=\"1\";most=\"1\">> contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission"
)
TEXTS = (
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> "
        "shall be included in all copies or substantial portions of the software " + AS_IS_MIT,
    ),
    Template(
        "isc-text",
        "permission to use copy modify and <<var;name=\"or\";match=\"or\";least=\"0\";most=\"1\">> distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var;name=\"author\";match=\".+\";least=\"1\";most=\"12\">> disclaims all warranties "
        "with regard to this software including all implied warranties of merchantability and fitness",
    ),
    Template("bsd-2-text", f"{BSD_TWO} {AS_IS_BSD}"),
    Template("bsd-3-text", f"{BSD_TWO} {BSD_THIRD} {AS_IS_BSD}"),
    Template(
        "zlib-text",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
    Template(
        "apache-2.0-notice",
        "licensed under the apache license version 2 0 the license you may not use this <<var;name=\"what\";match=\"file|work|software|project\";least=\"1\";most=\"1\">> except in compliance with the license",
    ),
    Template(
        "gpl-notice",
        "<<var;name=\"program\";match=\".+\";least=\"1\";most=\"6\">> is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version <<var;name=\"version\";match=\"[0-9]\";least=\"1\";most=\"1\">> of the license or at your option any later version",
    ),
    Template("mit", f"{GRANT} {ARTICLE} <<beginOptional>>x11<<endOptional>> mit license"),
    Template("apache-2.0", f"{GRANT} {ARTICLE} apache license <<beginOptional>>version<<endOptional>> 2 <<beginOptional>>0<<endOptional>>"),
    Template("unlicense", f"{GRANT} {ARTICLE} unlicense"),
)


def gnu_notices() -> list[Template]:
    """Notices of the GNU licenses, by name and version."""
    names = {"gpl": "", "lgpl": "lesser", "agpl": "affero"}
    versions = {"gpl": (("2", "0"), ("3", "0")), "lgpl": (("2", "1"), ("3", "0")), "agpl": (("3", "0"),)}
    out = []
    for short, word in names.items():
        for major, minor in versions[short]:
            rest = f"<<beginOptional>>{minor}<<endOptional>>" if minor == "0" else minor
            tail = "<<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>"
            wording = f"{GRANT} {ARTICLE} gnu {word} general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>version<<endOptional>> {major} {rest} {tail}"
            out.append(Template(f"{short}-{major}.{minor}", wording))
    return out


def creative_commons_notices() -> list[Template]:
    """Short and long notices of the Creative Commons licenses, by elements and version."""
    long = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
    out = []
    for elements in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        for version in ("3 0", "4 0"):
            name = f"cc-{elements.replace(' ', '-')}-{version.replace(' ', '.')}"
            full = " ".join(long[e] for e in elements.split())
            tail = "<<beginOptional>><<var;name=\"scope\";match=\"international|unported\";least=\"1\";most=\"1\">><<endOptional>> <<beginOptional>><<beginOptional>>public<<endOptional>> license<<endOptional>>"
            out.append(Template(name, f"{GRANT} {ARTICLE} cc {elements} {version}"))
            out.append(Template(name, f"{GRANT} {ARTICLE} creative commons {full} {version} {tail}"))
    return out


def identifier_lines(labels: list[str]) -> list[Template]:
    """Lines that name a license by its identifier."""
    return [Template(x, f"spdx license identifier {x.replace('-', ' ').replace('.', ' ')}") for x in labels]


def default_templates() -> list[Template]:
    notices = gnu_notices() + creative_commons_notices()
    return [*TEXTS, *notices, *identifier_lines(sorted({t.label for t in notices} | {"mit", "apache-2.0", "unlicense"}))]


# ------------------------------------------------------------------ templates
@dataclass(frozen=True)
class Item:
    """One place of a template: a word, or a word that matches; ``skip`` lists the later places that may follow instead."""

    word: str | None
    match: str | None = None


@dataclass(frozen=True)
class Compiled:
    """An automaton: place i reads a word and leads to i + 1; ``jumps`` (from, to) lead forward without a word."""

    template: Template
    items: tuple[Item, ...]
    jumps: tuple[tuple[int, int], ...]
    mandatory: tuple[str, ...]
    anchor: tuple[str, ...]
    before: tuple[int, int]


def compile_template(template: Template) -> Compiled:
    """Reads the markup. A template needs a mandatory word, and its regions must close."""
    items: list[Item] = []
    jumps: list[tuple[int, int]] = []
    opened: list[int] = []
    needed: list[bool] = []
    at = 0

    def wording(text: str) -> None:
        for w in WORD.findall(text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))):
            items.append(Item(w))
            needed.append(not opened)

    for m in _MARKUP.finditer(template.markup):
        wording(template.markup[at : m.start()])
        at, (kind, *_) = m.end(), m[1].split(";")
        if kind == "beginOptional":
            opened.append(len(items))
        elif kind == "endOptional":
            if not opened:
                raise ValueError(f"{template.label}: a region ends that did not begin")
            jumps.append((opened.pop(), len(items)))
        elif kind == "var":
            fields = dict(_FIELD.findall(m[1]))
            least, most = int(fields.get("least", 1)), int(fields.get("most", fields.get("least", 1)))
            if not 0 <= least <= most:
                raise ValueError(f"{template.label}: a replaceable region takes {least} to {most} words")
            end = len(items) + most
            jumps += [(len(items) + k, end) for k in range(least, most)]
            items += [Item(None, fields.get("match", ".+"))] * most
            needed += [False] * most
        else:
            raise ValueError(f"{template.label}: unknown markup {kind}")
    wording(template.markup[at:])
    if opened:
        raise ValueError(f"{template.label}: a region does not end")
    # The longest run of mandatory words; among equals the first.
    runs, i = [], 0
    while i < len(items):
        j = i
        while j < len(items) and needed[j]:
            j += 1
        if j > i:
            runs.append((i - j, i))
        i = max(j, i + 1)
    if not runs:
        raise ValueError(f"{template.label}: no mandatory word")
    length, first = min(runs)
    anchor = tuple(items[k].word for k in range(first, first + min(MOST_ANCHOR, -length)))
    mandatory = tuple(x.word for x, need in zip(items, needed, strict=True) if need)
    least = _least_words(len(items), jumps, first)
    return Compiled(template, tuple(items), tuple(jumps), mandatory, anchor, (least, first))


def _least_words(n: int, jumps: list[tuple[int, int]], goal: int) -> int:
    """Fewest words that lead from the first place to ``goal``."""
    least = list(range(n + 1))
    for i in range(n + 1):
        if i:
            least[i] = min(least[i], least[i - 1] + 1)
        for a, b in jumps:
            if a == i:
                least[b] = min(least[b], least[i])
    return least[goal]


class Automaton:
    """Sets of places as bits, determinised as words come up."""

    def __init__(self, compiled: Compiled):
        self.compiled = compiled
        n = len(compiled.items)
        reach = [1 << i for i in range(n + 1)]
        for i in range(n, -1, -1):
            for a, b in compiled.jumps:
                if a == i:
                    reach[i] |= reach[b]
        self.reach, self.final = reach, 1 << n
        self.start = reach[0]
        self.literal: dict[str, int] = {}
        matches: dict[str, int] = {}
        for i, x in enumerate(compiled.items):
            if x.word is not None:
                self.literal[x.word] = self.literal.get(x.word, 0) | 1 << i
            else:
                matches[x.match] = matches.get(x.match, 0) | 1 << i
        self.matches = [(re.compile(k), bits) for k, bits in matches.items()]
        self.after: dict[tuple[int, int], int] = {}

    def reads(self, word: str) -> int:
        """Places that take the word."""
        bits = self.literal.get(word, 0)
        for pattern, places in self.matches:
            if pattern.fullmatch(word):
                bits |= places
        return bits

    def step(self, state: int, read: int) -> int:
        taken = state & read
        if (state, taken) not in self.after:
            out, i = 0, taken
            while i:
                low = i & -i
                out |= self.reach[low.bit_length()]
                i ^= low
            self.after[state, taken] = out
        return self.after[state, taken]

    def longest(self, words, first: int, last: int, read: dict[int, int]) -> int:
        """Where the longest accepted span that begins at ``first`` ends, or -1. ``words(i)`` is a word; ``read`` keeps what takes it."""
        state, end = self.start, -1
        for i in range(first, last):
            if i not in read:
                read[i] = self.reads(words(i))
            state = self.step(state, read[i])
            if not state:
                break
            if state & self.final:
                end = i + 1
        return end


class Scanner:
    """All automata with their anchors."""

    def __init__(self, templates: tuple[Template, ...]):
        self.automata = [Automaton(compile_template(t)) for t in templates]
        self.anchors: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = {}
        by_size: dict[int, dict[int, list[int]]] = {}
        for k, a in enumerate(self.automata):
            data = " ".join(a.compiled.anchor).encode()
            words = words_of(Slice(0, data, np.array([0, len(data)])), ALNUM)
            size = len(words.hash)
            by_size.setdefault(size, {}).setdefault(int(window_hashes(words.hash, size)[0]), []).append(k)
        for size, found in by_size.items():
            self.anchors[size] = (np.array(sorted(found), np.uint64), found)

    def spans(self, part: Slice, words: Words) -> dict[int, list[tuple[int, int, int]]]:
        """For each text with any: (template, first word, end) of accepted spans; a phrase at every place, of a template the
        leftmost longest spans that do not overlap. ``part`` is in lower case; words count within the text."""
        starts: dict[tuple[int, int], set[int]] = {}
        for size, (wanted, owners) in self.anchors.items():
            at = inside_text(words.bounds, size)
            if not len(at):
                continue
            hashes = window_hashes(words.hash, size)[at]
            met = np.isin(hashes, wanted)
            at, hashes = at[met], hashes[met]
            texts = np.searchsorted(words.bounds, at, "right") - 1
            for a, h, t in zip(at.tolist(), hashes.tolist(), texts.tolist(), strict=True):
                low = int(words.bounds[t])
                for k in owners[h]:
                    least, most = self.automata[k].compiled.before
                    starts.setdefault((t, k), set()).update(range(max(low, a - most), a - least + 1))
        out: dict[int, list[tuple[int, int, int]]] = {}
        said: dict[int, str] = {}

        def word(i: int) -> str:
            if i not in said:
                said[i] = part.data[words.start[i] : words.end[i]].decode()
            return said[i]

        for (t, k), firsts in sorted(starts.items()):
            automaton, low, last, free, read = self.automata[k], int(words.bounds[t]), int(words.bounds[t + 1]), 0, {}
            for first in sorted(firsts):
                if first < free or first < low:
                    continue
                end = automaton.longest(word, first, last, read)
                if end > 0:
                    out.setdefault(t, []).append((k, first - low, end - low))
                    free = 0 if automaton.compiled.template.phrase else end
        return out


def scanner(templates: tuple[Template, ...]) -> Scanner:
    cache = worker_cache()
    if cache.get("license templates") != templates:
        cache["license templates"], cache["license scanner"] = templates, Scanner(templates)
    return cache["license scanner"]


COLUMNS = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, score double, spans array<struct<label:string,start:bigint,end:bigint>>"


def strength(mandatory_words: int) -> float:
    """What a template's wording is worth as evidence, from 0 to 1: half at HALF_WORDS mandatory words."""
    return mandatory_words / (mandatory_words + HALF_WORDS)


def with_licenses(docs: DataFrame, text: str = "text", templates: list[Template] | None = None, phrases: tuple[Template, ...] = PHRASES) -> DataFrame:
    """The columns of ``docs`` and those of ``COLUMNS``, by one narrow pass over whole texts.

    ``n_base`` counts the places of phrases, ``first_word`` and ``last_word``
    are their smallest and largest start (null without any), ``base_labels``
    their labels; ``labels`` adds those of accepted templates; ``spans`` lists
    what was accepted, in words.  ``score`` is the strength of the longest
    mandatory wording accepted.  A null or empty text has no words and no
    labels.  Rows are judged one by one, so repeated rows agree.  Columns of
    ``docs`` that bear one of the new names give way.  An empty table gives an
    empty one.
    """
    every = (*phrases, *(default_templates() if templates is None else templates))
    n_phrases = len(phrases)
    new = [x.split()[0] for x in COLUMNS.split(", ")]
    if text in new:
        raise ValueError(f"rename {text}: a new column has that name")
    kept = [c for c in docs.columns if c.lower() not in new]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), COLUMNS])
    for t in every:
        compile_template(t)  # a faulty template is an error here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(every)
        worth = [strength(len(a.compiled.mandatory)) for a in scan.automata]
        names = [a.compiled.template.label for a in scan.automata]
        span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for part in slices(batch.column(text)):
                low = Slice(part.first, part.data.translate(LOWER), part.cuts)
                words, rows = words_of(low, ALNUM), batch.slice(part.first, part.count)
                met = scan.spans(low, words)
                n_base, first, last, base, labels, score, spans = [], [], [], [], [], [], []
                for i in range(part.count):
                    own = met.get(i, [])
                    places = [a for k, a, _ in own if k < n_phrases]
                    n_base.append(len(places))
                    first.append(min(places, default=None))
                    last.append(max(places, default=None))
                    base.append(sorted({names[k] for k, _, _ in own if k < n_phrases}))
                    labels.append(sorted({names[k] for k, _, _ in own}))
                    score.append(max((worth[k] for k, _, _ in own), default=0.0))
                    spans.append([{"label": names[k], "start": a, "end": b} for k, a, b in sorted(own, key=lambda x: x[1:] + x[:1])])
                arrays = [
                    pa.array(words.counts(), pa.int64()), pa.array(n_base, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()),
                    pa.array(base, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.string())), pa.array(score, pa.float64()), pa.array(spans, pa.list_(span)),
                ]
                yield pa.RecordBatch.from_arrays([*rows.columns, *arrays], names=[*kept, *new])

    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(run, schema)
