"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced exactly."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Encoder, Vocabulary, public_vocabulary
from .words import slices

#: A blank between two characters that are not white space begins a piece whatever stands before it: no piece has a
#: blank inside, so the one before ends here, and encoding from here on does not depend on what came before.
STABLE = re.compile(r"(?<!\s)(?<!^) (?=\S)")
COLUMNS = "n_bytes bigint, n_tokens bigint"


@dataclass(frozen=True)
class Chunks:
    """Texts longer than ``size`` code points are cut; ``overlap`` is what neighbours share at first."""

    size: int = 32768
    overlap: int = 256


def splice_point(text: str, begin: int, end: int, left: tuple, right: tuple, left_at: int) -> tuple[int, int, int] | None:
    """First stable place of text[begin:end] where both encodings have a boundary: (place, ids of left before it, ids of right before it).

    ``left`` encodes the text from ``left_at`` to ``end``, ``right`` from ``begin`` on.  The character behind the place must lie within ``left``.
    """
    for m in STABLE.finditer(text, begin + 1, end):
        counts = []
        for (starts, before), at in ((left, left_at), (right, begin)):
            k = int(np.searchsorted(starts, m.start() - at))
            if k < len(starts) and starts[k] == m.start() - at:
                counts.append(int(before[k]))
        if len(counts) == 2:
            return m.start(), *counts
    return None


def spliced_count(text: str, encoder: Encoder, chunks: Chunks) -> int:
    """Number of ids of the whole text, from overlapping chunks.

    A chunk is encoded from its nominal start, in the middle of anything; its
    ids count from the splice point on.  Where no stable boundary lies in an
    overlap, the left chunk is encoded again with twice the overlap; at worst it
    reaches the end of the text, which is the plain encoding.
    """
    total, at, skipped = 0, 0, 0  # the current chunk: where it begins, and how many of its first ids another chunk has given
    current, reach = None, 0
    while True:
        cut, overlap = at + chunks.size, chunks.overlap
        found, following = None, None
        while found is None:
            reach = min(len(text), cut + overlap)
            current = encoder.marks([text[at:reach]])[0]
            if reach == len(text):
                return total + int(current[1][-1]) - skipped
            if following is None or len(following[0]) == 0:
                following = encoder.marks([text[cut : cut + chunks.overlap]])[0]
            if overlap > chunks.overlap:
                following = encoder.marks([text[cut:reach]])[0]
            found = splice_point(text, cut, reach, current, following, at)
            overlap *= 2
        _, left, skip = found
        total, at, skipped = total + left - skipped, cut, skip


def token_counts(texts: list[str], encoder: Encoder, chunks: Chunks) -> np.ndarray:
    short = [i for i, x in enumerate(texts) if len(x) <= chunks.size]
    out = np.zeros(len(texts), np.int64)
    out[short] = encoder.lengths([texts[i] for i in short])
    for i in set(range(len(texts))) - set(short):
        out[i] = spliced_count(texts[i], encoder, chunks)
    return out


def with_token_counts(docs: DataFrame, text: str = "text", vocabulary: Vocabulary | None = None, chunks: Chunks | None = None) -> DataFrame:
    """The columns of ``docs``, ``n_bytes`` (UTF-8) and ``n_tokens``, by one narrow pass.

    Counts are the tokenizers library's for the vocabulary, without added
    special tokens; strings of special tokens inside texts are those tokens.
    A null is an empty text with no bytes and no tokens.  Columns of ``docs``
    with the new names give way.  Each row is counted by itself.
    """
    vocabulary, chunks = vocabulary or public_vocabulary(), chunks or Chunks()
    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for part in slices(batch.column(text)):
                rows = batch.slice(part.first, part.count)
                texts = [part.text(i).decode() for i in range(part.count)]
                new = [pa.array(np.diff(part.cuts)), pa.array(token_counts(texts, encoder, chunks))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *new], names=[*kept, "n_bytes", "n_tokens"])

    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(run, schema)
