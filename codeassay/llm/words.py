"""Words of whole texts as arrays: positions and 64-bit hashes, for Python workers.

Texts stay UTF-8 bytes.  Work goes through slices of bounded size, so memory
follows the slice and not the Arrow batch; a text longer than a slice is a
slice of its own.
"""

from __future__ import annotations

import ctypes
import hashlib
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
LONG_WORD = 4096
ODD_1, ODD_2, ODD_3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Bases of two independent polynomial hashes of word windows.
BASES = (np.uint64(0x5851F42D4C957F2D), np.uint64(0xD1342543DE82EF95))

SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes that belong to a word: everything but ASCII white space.
NOT_SPACE = bytes(int(i not in SPACE) for i in range(256))
#: Bytes that belong to a word: ASCII digits and letters, and everything that is not ASCII.
ALNUM = bytes(int(i >= 128 or chr(i).isalnum()) for i in range(256))
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def worker_cache() -> dict:
    """Survives from task to task in a Python worker, unlike globals of functions that travel by value."""
    return sys.modules.setdefault("codeassay_worker_cache", types.ModuleType("codeassay_worker_cache")).__dict__


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on through the stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
    if trim:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * ODD_2
    h = (h ^ (h >> np.uint64(27))) * ODD_3
    return h ^ (h >> np.uint64(31))


@dataclass
class Slice:
    """Consecutive texts of a column. ``data`` are their bytes, ``cuts`` the bounds of each text; rows count from ``first``."""

    first: int
    data: bytes
    cuts: np.ndarray

    @property
    def count(self) -> int:
        return len(self.cuts) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.cuts[i] : self.cuts[i + 1]]


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of about ``most`` bytes; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    cuts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2] or pa.py_buffer(b"")
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + most, "right")) - 1)
        yield Slice(i, data.slice(int(cuts[i]), int(cuts[j] - cuts[i])).to_pybytes(), cuts[i : j + 1] - cuts[i])
        i = j
    give_back()


@dataclass
class Words:
    """Words of a slice in order: byte bounds, hash, and for each text the range of its words."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def word_spans(part: Slice, kind: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of the words of all texts of the slice; no word crosses texts."""
    inside = np.zeros(len(part.data) + 2, np.int8)
    inside[1:-1] = np.frombuffer(part.data.translate(kind), np.int8)
    edge = np.diff(inside)
    starts, ends = edge[:-1] == 1, edge[1:] == -1
    at = part.cuts[1:-1]
    at = at[(at > 0) & (at < len(part.data))]
    met = at[(inside[at] == 1) & (inside[at + 1] == 1)]  # a word ends one text and another begins the next
    starts[met], ends[met - 1] = True, True
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, eight bytes at a time for all words at once."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    left = end - start
    h = left.astype(np.uint64) * ODD_1
    live, at = np.flatnonzero(left <= LONG_WORD), 0
    while len(live):
        rest = left[live] - at
        chunk = eight[start[live] + at] & masks[np.minimum(rest, 8)]
        h[live] = mix(h[live] ^ chunk)
        live, at = live[rest > 8], at + 8
    for i in np.flatnonzero(left > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


def words_of(part: Slice, kind: bytes = NOT_SPACE, lower: bool = False) -> Words:
    if lower:
        part = Slice(part.first, part.data.translate(LOWER), part.cuts)
    start, end = word_spans(part, kind)
    return Words(start, end, word_hashes(part.data, start, end), np.searchsorted(start, part.cuts))


def window_hashes(h: np.ndarray, k: int, base: np.uint64 = BASES[0]) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive words, modulo 2^64.

    Windows of doubling width are put together by the polynomial's own rule, so
    the cost follows the logarithm of k.
    """
    if len(h) < k:
        return np.empty(0, np.uint64)
    power, width, part, out, done = int(base), 1, h, None, 0
    while True:
        factor = np.uint64(power)
        if k & width:
            out = part if out is None else out[: len(h) - done - width + 1] * factor + part[done : done + len(h) - done - width + 1]
            done += width
            if done == k:
                return mix(out[: len(h) - k + 1])
        part, power, width = part[:-width] * factor + part[width:], power * power % 2**64, width * 2


def inside_text(bounds: np.ndarray, k: int) -> np.ndarray:
    """Start positions of the windows of k words that lie within one text."""
    n = int(bounds[-1])
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    return np.flatnonzero(room >= k)


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words that begins at one of the starts."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + k, n), -1)
    return np.cumsum(step[:-1]) > 0
