"""Quality rules: counts of words, lines and repeats, and bands of zstandard ratios.

Text that repeats itself compresses too well, noise does not compress; how well
plain prose compresses depends on its length.  So a text is judged by the ratio
of its bytes to its compressed bytes within a band for its length, and a long
text also by its chunks of fixed size, which show repeats that a whole text
dilutes and junk that a whole text hides.

Noise spelt in few letters (hexadecimal, base64) has the ratio of prose in a
large script, so no fixed limit tells them apart.  The lower end of a band is
therefore also relative: the ratio over that of the same characters in mixed
order, which noise does not exceed, whatever its letters, and prose does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from zstandard import ZstdCompressor

from .words import NOT_SPACE, Slice, covered, inside_text, mix, slices, window_hashes, words_of

SYMBOLS = b"#*$%&|<>"
_SYMBOL = bytes(int(i in SYMBOLS) for i in range(256))
#: Bytes that begin a code point inside a word.
_WORD_CHAR = bytes(int(NOT_SPACE[i] and not 0x80 <= i < 0xC0) for i in range(256))
REPEAT_WINDOW = 3
COLUMNS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "ratio double, chunk_low double, chunk_high double, chunks_outside double, kept boolean"
)


@dataclass(frozen=True)
class Bands:
    """Limits of compression. ``by_bytes``: (least bytes, lowest ratio of bytes, most code points a compressed byte), ascending; the last that fits holds.

    The upper end counts code points, as scripts of two and three bytes a
    letter compress the better for it without repeating anything.  It was set
    from real prose (licenses, manuals, changelogs; 1027 texts cut to each
    length): between the 97th and the 99th of a hundred, so lists and tables
    pass and text that says much twice does not.
    """

    by_bytes: tuple = ((0, 0.5, 1.9), (256, 0.9, 2.2), (512, 0.9, 2.6), (1024, 1.15, 3.0), (2048, 1.15, 3.5), (4096, 1.3, 4.0), (16384, 1.3, 5.5), (65536, 1.3, 6.5))
    chunk_bytes: int = 4096
    chunk: tuple = (1.2, 4.0)
    #: (least bytes, lowest ratio over that of the same characters in mixed order), ascending, for chunks and texts of one chunk at most.
    #: Noise measured at most 1.03 from 1024 bytes; prose in 29 languages (Latin, Cyrillic, Greek, Chinese, Japanese, Korean) at least
    #: 1.04 (1024 bytes), 1.11 (2048) and 1.20 (4096).  The limits are low enough for the invented prose of sf0.1 (1.02 from 1024 bytes,
    #: 1.09 from 2048).  Below 1024 bytes prose reaches down to noise.
    gain_by_bytes: tuple = ((1024, 1.02), (1280, 1.035), (2048, 1.05), (4096, 1.06))
    #: A text fails when more than this share of its chunks lies outside.
    most_outside: float = 0.2
    level: int = 3
    least_words: int = 50
    most_repeated_percent: int = 50

    def of(self, n: int) -> tuple[float, float]:
        return next((low, high) for least, low, high in reversed(self.by_bytes) if n >= least)

    def least_gain(self, n: int) -> float:
        return next((gain for least, gain in reversed(self.gain_by_bytes) if n >= least), 0.0)


@dataclass
class _Ratios:
    bands: Bands
    packer: ZstdCompressor = field(init=False)
    orders: list[np.ndarray] = field(init=False)

    def __post_init__(self) -> None:
        self.packer = ZstdCompressor(level=self.bands.level)
        self.orders = [np.random.default_rng(k).permutation(self.bands.chunk_bytes) for k in range(4)]

    def one(self, data: bytes) -> float:
        return len(data) / len(self.packer.compress(data))

    def gain(self, data: bytes, ratio: float) -> float:
        """The ratio over that of the same characters in mixed order, always the same orders, more of them for shorter texts.

        Takes at most a chunk; parts of characters at its ends are left out of the mixed ones, and bytes without a character gain nothing.
        """
        ascii, packed = data.isascii(), 0.0
        points = np.frombuffer(data if ascii else data.decode("utf-8", "ignore").encode("utf-32-le"), np.uint8 if ascii else np.uint32)
        if not len(points):
            return 0.0
        orders = self.orders[: max(1, self.bands.chunk_bytes // len(data))]
        for order in orders:
            mixed = points[order[order < len(points)]].tobytes()
            packed += 1 / self.one(mixed if ascii else mixed.decode("utf-32-le").encode())
        return ratio * packed / len(orders)

    def is_noise(self, data: bytes, ratio: float) -> bool:
        least = self.bands.least_gain(len(data))
        return least > 0 and self.gain(data, ratio) < least

    def judge(self, data: bytes) -> tuple[float | None, float | None, float | None, float | None, bool]:
        """Ratio, lowest and highest ratio of a chunk, share of chunks outside, verdict. Chunks count in texts longer than one; the last ends with the text."""
        if not data:
            return None, None, None, None, False
        low, high = self.bands.of(len(data))
        whole = self.one(data)
        inside, size = low <= whole and whole * letters_a_byte(data) <= high, self.bands.chunk_bytes
        if len(data) <= size:
            return whole, None, None, None, inside and not self.is_noise(data, whole)
        starts = [*range(0, len(data) - size, size), len(data) - size]
        chunks = [data[i : i + size] for i in starts]
        each = [self.one(x) for x in chunks]
        low, high = self.bands.chunk
        outside = sum(x < low or x * letters_a_byte(c) > high or self.is_noise(c, x) for c, x in zip(chunks, each)) / len(each)
        return whole, min(each), max(each), outside, inside and outside <= self.bands.most_outside


_INNER = bytes(range(0x80, 0xC0))  # bytes that continue a code point


def letters_a_byte(data: bytes) -> float:
    """Code points a byte."""
    return len(data.translate(None, _INNER)) / len(data)


def _per_text(data: bytes, table: bytes, cuts: np.ndarray) -> np.ndarray:
    """How many bytes of each text the table marks."""
    total = np.concatenate([[0], np.cumsum(np.frombuffer(data.translate(table), np.uint8), dtype=np.int64)])
    return np.diff(total[cuts])


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def repeated_words(hashes: np.ndarray, bounds: np.ndarray, k: int = REPEAT_WINDOW) -> np.ndarray:
    """For each text, its words that lie in a window of k words found again in that text."""
    at = inside_text(bounds, k)
    text = np.searchsorted(bounds, at, "right") - 1
    keys = window_hashes(hashes, k)[at] ^ mix(text.astype(np.uint64) + np.uint64(1))
    _, where, n = np.unique(keys, return_inverse=True, return_counts=True)
    hit = covered(at[n[where] > 1], k, len(hashes))
    return np.diff(np.concatenate([[0], np.cumsum(hit)])[bounds])


def measure(part: Slice, bands: Bands) -> dict[str, list | np.ndarray]:
    words = words_of(part)
    n, repeats = words.counts(), repeated_words(words.hash, words.bounds)
    failed = (n < bands.least_words) | (100 * repeats > bands.most_repeated_percent * n)
    ratios, texts = _Ratios(bands), [part.text(i) for i in range(part.count)]
    whole, low, high, outside, fits = zip(*map(ratios.judge, texts), strict=True)
    return {
        "n_words": n, "word_chars": _per_text(part.data, _WORD_CHAR, part.cuts), "n_symbols": _per_text(part.data, _SYMBOL, part.cuts),
        "n_dup_lines": [duplicate_lines(x) for x in texts], "n_repeat_words": repeats, "base_failed": failed,
        "ratio": whole, "chunk_low": low, "chunk_high": high, "chunks_outside": outside, "kept": np.array(fits, bool) & ~failed,
    }


def with_quality(docs: DataFrame, text: str = "text", bands: Bands | None = None) -> DataFrame:
    """The columns of ``docs`` and, by one narrow pass over whole texts, those of ``COLUMNS``.

    A null or empty text has no words and so fails.  Columns of ``docs`` that
    bear one of the new names give way to them.  Every row is judged by
    itself: repeated rows and ties get the same verdict.
    """
    bands = bands or Bands()
    new = [x.split()[0] for x in COLUMNS.split(", ")]
    kept = [c for c in docs.columns if c not in new]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(text)):
                rows, found = batch.slice(part.first, part.count), measure(part, bands)
                types = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
                arrays = [pa.array(found[c], types[t]) for c, t in (x.split() for x in COLUMNS.split(", "))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *arrays], names=[*kept, *new])

    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(run, schema)
