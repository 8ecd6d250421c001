"""Language identification by cross-parsing entropy.

A suffix automaton holds all substrings of a language's labelled text.  A text
is parsed against it greedily: each phrase is the longest match from where the
last one ended.  Text of the same language needs few phrases; phrases times the
logarithm of the labelled text's length, per character, estimate the cross
entropy, and the language with the least wins.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .words import ODD_1, slices, worker_cache

UNKNOWN, APART, PAD = 0, 1, 2  # symbols: letters that the language does not have, everything but letters, nothing
MISS = 1 << 30
SEGMENT = 256
#: Code points that are parsed at once, a multiple of SEGMENT.
BLOCK = SEGMENT << 12
#: Transitions stand in a table of states x letters up to so many cells for a language and for all of them; beyond, in a hash table.
DENSE_CELLS, ALL_DENSE_CELLS = 1 << 22, 1 << 24


@dataclass(frozen=True)
class Sample:
    """Bound of what is learned: texts of each language, code points of each text, and code points of all languages together.

    With so many labels that the last would not do, each gets fewer texts, and shorter ones when one is left.
    """

    texts: int = 48
    chars: int = 512
    total: int = 1 << 22

    def of(self, labels: int) -> tuple[int, int]:
        """Texts a label and code points a text."""
        share = self.total // max(1, labels)
        return max(1, min(self.texts, share // self.chars)), max(16, min(self.chars, share))


def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case, and whether it is a letter."""
    if "letters" not in (cache := worker_cache()):
        points = [chr(i) for i in range(0x110000)]
        lower = np.array([ord(x.lower()[0]) for x in points], np.int32)
        cache["letters"] = lower, np.array([x.isalpha() for x in points])
    return cache["letters"]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a symbol sequence, from state 0."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in symbols:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


@dataclass
class Hashed:
    """Transitions by (state, letter), at the cost of the transitions there are and not of states x letters."""

    keys: np.ndarray
    targets: np.ndarray
    shift: np.uint64

    @classmethod
    def of(cls, keys: np.ndarray, targets: np.ndarray) -> Hashed:
        bits = max(4, int(2 * len(keys) - 1).bit_length())
        out = cls(np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32), np.uint64(64 - bits))
        at, left = out.slots(keys), np.arange(len(keys))
        while len(left):  # each free slot takes one of those that want it, the others move on
            free = out.keys[at[left]] < 0
            first = np.unique(at[left][free], return_index=True)[1]
            won = left[free][first]
            out.keys[at[won]], out.targets[at[won]] = keys[won], targets[won]
            left = left[out.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (len(out.keys) - 1)
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * ODD_1) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The targets; -1 where there is no transition."""
        at = self.slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.targets[at], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.targets[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class Language:
    """The automaton of one language over its own letters, ready to walk many texts at once."""

    def __init__(self, sequence: list[int], size: int, dense_cells: int) -> None:
        step = suffix_automaton(sequence)
        self.size, self.between = size, len(step)  # the last state is the one where no phrase is open
        self.bits = math.log2(max(2, len(sequence)))
        root = np.full(size, -1, np.int32)
        root[list(step[0])] = list(step[0].values())
        self.start = np.where(root < 0, self.between | MISS, root | MISS).astype(np.int32)  # a new phrase with this symbol; unknown ones end at once
        self.start[UNKNOWN] = self.between | MISS
        self.start[PAD] = self.between  # behind the end of a text, at no cost; labelled texts are not joined either
        keys = np.fromiter((s * size + c for s, out in enumerate(step) for c in out if c != PAD), np.int64)
        targets = np.fromiter((t for out in step for c, t in out.items() if c != PAD), np.int32)
        self.cells = (len(step) + 1) * size
        self.table = self.hashed = None
        if self.cells <= dense_cells:
            table = np.broadcast_to(self.start, (len(step) + 1, size)).reshape(-1).copy()
            table[keys] = targets
            self.table = table
        else:
            self.cells, self.hashed = 0, Hashed.of(keys, targets)

    def phrases(self, symbols: np.ndarray) -> np.ndarray:
        """How many phrases each column of symbols takes."""
        state, count = np.full(symbols.shape[1], self.between, np.int32), np.zeros(symbols.shape[1], np.int32)
        size = np.int32(self.size) if self.table is not None else np.int64(self.size)
        for row in symbols:
            if self.table is not None:
                found = self.table[state * size + row]
            else:
                found = self.hashed.find(state * size + row)
                found = np.where(found < 0, self.start[row], found)
            count += found >> 30
            state = found & np.int32(MISS - 1)
        return count


class Model:
    """All languages. Letters get numbers in common, and from these each language its own."""

    def __init__(self, texts: dict[str, list[str]], dense_cells: int = DENSE_CELLS, all_dense_cells: int = ALL_DENSE_CELLS) -> None:
        lower, alpha = letters()
        self.names = sorted(texts)
        own = [np.unique(np.concatenate([np.unique(lower[codes_of(x)]) for x in texts[name]] or [np.empty(0, np.int32)])) for name in self.names]
        own = [x[alpha[x]] for x in own]
        seen = np.unique(np.concatenate(own)) if own else np.empty(0, np.int32)
        self.symbol = np.full(0x110000, UNKNOWN, np.int32)
        self.symbol[~alpha] = APART
        self.symbol[seen] = 3 + np.arange(len(seen))
        self.symbol = self.symbol[lower]
        self.letter, self.languages, self.local = alpha, [], []
        for name, known in zip(self.names, own, strict=True):
            local = np.zeros(3 + len(seen), np.uint16 if len(known) < 65_000 else np.int32)  # UNKNOWN
            local[[APART, PAD]] = APART, PAD
            local[3 + np.searchsorted(seen, known)] = 3 + np.arange(len(known))
            sequence = [s for x in texts[name] for s in [*local[self.symbol[codes_of(x)]].tolist(), PAD]]
            self.languages.append(Language(sequence, 3 + len(known), min(dense_cells, all_dense_cells - sum(x.cells for x in self.languages))))
            self.local.append(local)

    def phrases(self, symbols: np.ndarray) -> np.ndarray:
        """For each language and each column of symbols, how many phrases it takes."""
        out = np.zeros((len(self.names), symbols.shape[1]), np.int64)
        for k, language in enumerate(self.languages):
            out[k] = language.phrases(self.local[k][symbols].astype(np.int32))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and margin of each text; a text is parsed in segments of fixed length, each with phrases of its own.

        Texts go through in blocks of bounded size, a huge one in several.
        """
        total, lettered = np.zeros((len(self.names), len(texts))), np.zeros(len(texts), bool)
        sizes = np.array([len(x) for x in texts], np.int64)
        block: list[tuple[int, str]] = []
        held = 0
        for i, x in enumerate(texts):
            for a in range(0, len(x), BLOCK):
                block.append((i, x[a : a + BLOCK]))
                held += len(block[-1][1])
                if held >= BLOCK:
                    self._add(block, total, lettered)
                    block, held = [], 0
        if block:
            self._add(block, total, lettered)
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts)
        total *= np.array([x.bits for x in self.languages])[:, None] / np.maximum(sizes, 1)
        best = total.argmin(0)
        order = np.sort(total, 0)
        margin = 1 - order[0] / np.maximum(order[1], 1e-12) if len(self.names) > 1 else np.ones(len(texts))
        return [self.names[b] if x else "und" for b, x in zip(best, lettered, strict=True)], np.where(lettered, margin, 0.0).tolist()

    def _add(self, block: list[tuple[int, str]], total: np.ndarray, lettered: np.ndarray) -> None:
        """Adds the phrases of the pieces to those of their texts."""
        of, sizes = np.array([i for i, _ in block]), np.array([len(x) for _, x in block], np.int64)
        codes, ends = codes_of("".join(x for _, x in block)), np.cumsum(sizes)
        lettered[of[np.diff(np.concatenate([[0], np.cumsum(self.letter[codes])])[np.concatenate([[0], ends])]) > 0]] = True
        parts = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(block)), parts)
        begin = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT + (ends - sizes)[owner]
        length = np.minimum(SEGMENT, ends[owner] - begin)
        at = begin[None, :] + np.arange(SEGMENT)[:, None]
        symbols = np.where(np.arange(SEGMENT)[:, None] < length[None, :], self.symbol[codes[np.minimum(at, len(codes) - 1)]], PAD)
        for k, found in enumerate(self.phrases(symbols.astype(np.int32))):
            total[k] += np.bincount(of[owner], found, total.shape[1])


def labelled_sample(docs: DataFrame, learn: Column, key: str, text: str, lang: str, sample: Sample) -> dict[str, list[str]]:
    """A bounded sample of distinct labelled texts of each language, of each one stretch that begins anywhere.

    Texts are chosen by their hash, so copies count once and the choice does
    not depend on the order of rows.  Only the chosen stretches reach the driver.
    """
    some = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    found = some.select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h")).distinct()
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    texts, chars = sample.of(found.select("lang").distinct().count())
    chosen = found.withColumn("n", order).filter(F.col("n") <= texts).drop("n")
    begin = F.pmod(F.xxhash64(F.lit("begin"), text), F.greatest(F.char_length(text) - chars + 1, F.lit(1)))
    stretch = some.select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.substr(text, (begin + 1).cast("int"), F.lit(chars)).alias("stretch"))
    # ``chosen`` is bounded by the sample, so it may be broadcast.
    rows = stretch.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("stretch").alias("stretch")).orderBy("lang", "h").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append(r["stretch"])
    return out


def with_language(docs: DataFrame, labelled: dict[str, list[str]], text: str = "text") -> DataFrame:
    """The columns of ``docs``, ``lang_pred`` and ``score``, by one narrow pass over whole texts.

    ``labelled``: texts of each language.  Texts that are null or have no
    letter, and all texts if nothing is labelled, are ``und`` with score 0.  The
    score is one less the ratio of the least to the next cross entropy; of
    languages that tie, the first by name wins.  Columns of ``docs`` with the
    new names give way.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "lang_pred string, score double"])
    name = "languages " + hashlib.sha256(repr(sorted(labelled.items())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        if name not in cache:
            cache[name] = Model(labelled)
        for batch in batches:
            for part in slices(batch.column(text)):
                rows = batch.slice(part.first, part.count)
                lang, score = cache[name].predict([part.text(i).decode() for i in range(part.count)])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(run, schema)
