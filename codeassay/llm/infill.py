"""Fill-in-the-middle documents as piece tables.

A document becomes descriptors (buffer, start, end) over two immutable buffers:
its text and the sentinels.  Cutting splits a descriptor, an arrangement
permutes the descriptors, the inverse permutation restores them, and hashes
read the described bytes piece by piece.  Text is only joined where it leaves
the operator.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .keys import fresh
from .words import NOT_SPACE, SPACE, Slice, slices, word_spans

TEXT, MARKS = 0, 1
PREFIX, MIDDLE, SUFFIX, P, S, M = range(6)
#: Which descriptor stands where in a form; descriptors are prefix, middle, suffix and the three sentinels.
ORDERS = {"psm": (P, PREFIX, S, SUFFIX, M, MIDDLE), "spm": (S, SUFFIX, P, PREFIX, M, MIDDLE)}
COLUMNS = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string"


class Piece(NamedTuple):
    buffer: int
    start: int
    end: int


@dataclass(frozen=True)
class PieceTable:
    buffers: tuple[bytes, ...]
    pieces: tuple[Piece, ...]

    @classmethod
    def of(cls, *buffers: bytes) -> PieceTable:
        """One descriptor over the whole first buffer."""
        return cls(buffers, (Piece(0, 0, len(buffers[0])),))

    def cut(self, at: int) -> PieceTable:
        """Splits the descriptor that holds the offset; at the end of a descriptor the second half is empty."""
        out, left, done = [], at, False
        for p in self.pieces:
            size = p.end - p.start
            if not done and left <= size:
                out += [Piece(p.buffer, p.start, p.start + left), Piece(p.buffer, p.start + left, p.end)]
                done = True
            else:
                out.append(p)
                left -= size
        return PieceTable(self.buffers, tuple(out))

    def with_pieces(self, more: tuple[Piece, ...]) -> PieceTable:
        return PieceTable(self.buffers, self.pieces + more)

    def arranged(self, order: tuple[int, ...]) -> PieceTable:
        return PieceTable(self.buffers, tuple(self.pieces[i] for i in order))

    def without_last(self, n: int) -> PieceTable:
        return PieceTable(self.buffers, self.pieces[: len(self.pieces) - n])

    def stream(self) -> Iterator[memoryview]:
        for p in self.pieces:
            yield memoryview(self.buffers[p.buffer])[p.start : p.end]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part)
        return digest.hexdigest()

    def text(self) -> str:
        return b"".join(self.stream()).decode()

    def chars(self, i: int) -> int:
        """Code points of a descriptor."""
        p = self.pieces[i]
        return len(str(memoryview(self.buffers[p.buffer])[p.start : p.end], "utf-8"))


@dataclass(frozen=True)
class Infill:
    """How documents are cut: hashes of ``seed:key`` decide; ``percent`` of the documents are cut, ``spm_percent`` of these begin with the suffix."""

    seed: str = "42"
    percent: int = 50
    spm_percent: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def marks(self) -> tuple[bytes, tuple[Piece, ...]]:
        """The buffer of sentinels and their descriptors, in the order prefix, suffix, middle."""
        parts = [x.encode() for x in (self.prefix, self.suffix, self.middle)]
        ends = np.cumsum([len(x) for x in parts]).tolist()
        return b"".join(parts), tuple(Piece(MARKS, e - len(x), e) for x, e in zip(parts, ends, strict=True))


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    out = [0] * len(order)
    for place, i in enumerate(order):
        out[i] = place
    return tuple(out)


def draws(key: str, seed: str, n: int = 4) -> Column:
    """The first n groups of 8 digits of the SHA-256 of ``seed:key``, as numbers; a null key counts as an empty text."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(n)])


def unit_ends(part: Slice) -> list[np.ndarray]:
    """For each text of the slice, where its units end: a unit is a word with the white space before it, or white space that ends the text."""
    starts, ends = word_spans(part, NOT_SPACE)
    bounds = np.searchsorted(starts, part.cuts)
    out = []
    for i in range(part.count):
        own = ends[bounds[i] : bounds[i + 1]] - part.cuts[i]
        size = int(part.cuts[i + 1] - part.cuts[i])
        tail = size > 0 and part.data[part.cuts[i + 1] - 1] in SPACE
        out.append(np.append(own, size) if tail else own)
    return out


def infilled(text: bytes, ends: np.ndarray, h: list[int], rule: Infill) -> tuple[str, PieceTable, int | None, int | None]:
    """Form, arranged table, and the code points of prefix and middle."""
    marks, sentinels = rule.marks()
    table, n = PieceTable.of(text, marks), len(ends)
    if not text or h[2] % 100 >= rule.percent or any(x.encode() in text for x in (rule.prefix, rule.suffix, rule.middle)):
        return "plain", table, None, None
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    table = table.cut(int(ends[second - 1]) if second else 0).cut(int(ends[first - 1]) if first else 0).with_pieces(sentinels)
    form = "spm" if h[3] % 100 < rule.spm_percent else "psm"
    return form, table.arranged(ORDERS[form]), table.chars(PREFIX), table.chars(MIDDLE)


def restored(output: bytes, form: str, rule: Infill) -> PieceTable:
    """The text as a table over the output alone: cut at its sentinels, put back by the inverse permutation, sentinels dropped.

    A sentinel that begins and ends with characters found nowhere else in it is
    met only where it was put, as texts that hold one stay plain.
    """
    table = PieceTable.of(output)
    if form == "plain":
        return table
    order = ORDERS[form]
    names = {P: rule.prefix.encode(), S: rule.suffix.encode(), M: rule.middle.encode()}
    at = 0
    for i in order[::2]:
        at = output.index(names[i], at)
        for edge in (at, at + len(names[i])):
            if edge:  # the first sentinel begins the output
                table = table.cut(edge)
        at += len(names[i])
    return table.arranged(inverse(order)).without_last(3)


def _kept(df: DataFrame, new: list[str]) -> list[str]:
    lower = {c.lower() for c in new}
    return [c for c in df.columns if c.lower() not in lower]


def with_infill(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Infill | None = None) -> DataFrame:
    """The columns of ``docs`` and those of ``COLUMNS``, by one narrow pass over whole texts.

    ``n`` units are the words with the white space before them, and white
    space at the end.  A null or empty text and one that holds a sentinel stay
    plain; plain texts have no prefix and no middle.  Rows that share key and
    text are cut alike; a null key is one key.  Columns of ``docs`` that bear
    one of the new names give way to them.  An empty table gives an empty one.
    """
    rule = rule or Infill()
    new = [x.split()[0] for x in COLUMNS.split(", ")]
    kept, h = _kept(docs, new), fresh("_draws", docs)
    if key not in kept or text not in kept:
        raise ValueError(f"rename {key} or {text}: new columns have that name")
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), COLUMNS])
    types = {"bigint": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(text)):
                rows, found = batch.slice(part.first, part.count), []
                for i, ends in enumerate(unit_ends(part)):
                    form, table, prefix, middle = infilled(part.text(i), ends, rows.column(h)[i].as_py(), rule)
                    found.append((len(ends), form, prefix, middle, table.text(), table.sha256()))
                columns = zip(*found, strict=True)
                arrays = [pa.array(list(c), types[t]) for c, t in zip(columns, (x.split()[1] for x in COLUMNS.split(", ")), strict=True)]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *arrays], names=[*kept, *new])

    return docs.select(*[f"`{c}`" for c in kept], draws(key, rule.seed).alias(h)).mapInArrow(run, schema)


def with_restored(outputs: DataFrame, output: str = "output", form: str = "form", rule: Infill | None = None) -> DataFrame:
    """The columns of ``outputs``, ``restored`` (the exact text, from output and form alone) and ``restored_sha256``.

    A null output is an empty text.  Columns with the new names give way.
    """
    rule = rule or Infill()
    kept = _kept(outputs, ["restored", "restored_sha256"])
    schema = ", ".join([*(f"`{c}` {outputs.schema[c].dataType.simpleString()}" for c in kept), "restored string, restored_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(output)):
                rows = batch.slice(part.first, part.count)
                forms = rows.column(form).to_pylist()
                tables = [restored(part.text(i), forms[i] or "plain", rule) for i in range(part.count)]
                new = [pa.array([t.text() for t in tables], pa.string()), pa.array([t.sha256() for t in tables], pa.string())]
                yield pa.RecordBatch.from_arrays([*rows.columns, *new], names=[*kept, "restored", "restored_sha256"])

    return outputs.select(*[f"`{c}`" for c in kept]).mapInArrow(run, schema)
