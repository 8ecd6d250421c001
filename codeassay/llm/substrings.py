"""Substring dedup: every window of a fixed number of words that occurs again is removed, word by word.

Rabin-Karp hashes of all windows are counted in Spark over all texts (see
``blocks``); repeated windows merge into maximal intervals of words.  A hash has
64 bits and its bucket is taken from a second, independent hash, so among n
windows about n^2 / (2^65 buckets) pairs are confused: 0.001 at 9 billion.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import BLOCK_BYTES, BUCKET_BYTES, classes_of, in_blocks, repeat_classes, with_answers
from .words import BASES, Slice, covered, inside_text, mix, slices, window_hashes, words_of

COLUMNS = "n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_text string"


def windows(part: Slice, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows of a slice, their hashes and bucket words, and the bounds of the texts' words."""
    words = words_of(part)
    at = inside_text(words.bounds, k)
    if not len(at):
        return at, np.empty(0, np.uint64), np.empty(0, np.uint64), words.bounds
    second = window_hashes(mix(words.hash), k, BASES[1])[at]
    return at, window_hashes(words.hash, k)[at], second, words.bounds


def distinct_windows(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = [windows(part, k)[1:3] for part in slices(column)]
    keys, first, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *(x for x, _ in found)]), return_index=True, return_counts=True)
    return keys, np.concatenate([np.empty(0, np.uint64), *(x for _, x in found)])[first], counts


def intervals(hit: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [{"start": a, "end": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: key, words, removed words, the removed intervals of word positions, and the words left.

    Words are runs of anything but ASCII white space; the words left are joined
    by one blank.  A word goes if any window that covers it also starts
    elsewhere, in another text or in its own; windows are judged on the input.
    A null text has no words; texts shorter than a window stay whole.  Repeated
    rows are texts of their own and so repeat each other.  Keys may be null or
    repeated.  Other columns are not carried.  An empty table gives an empty result.
    """
    blocks, n, total = in_blocks(docs, {key: "k"}, text, block_bytes)
    buckets = max(1, -(-total * 2 // BUCKET_BYTES))  # a window is eight bytes, a word about five

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, word, _ = distinct_windows(left["t"], window)
        repeated = keys[classes_of(right, keys, word, buckets) > 0]
        n_words, n_removed, spans, kept = [], [], [], []
        for part in slices(left["t"]):
            at, hashes, _, bounds = windows(part, window)
            hit = covered(at[np.isin(hashes, repeated)], window, int(bounds[-1]))
            for i in range(part.count):
                gone, words = hit[bounds[i] : bounds[i + 1]], part.text(i).split()
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                spans.append(intervals(gone))
                kept.append(b" ".join(compress(words, (~gone).tolist()) if n_removed[-1] else words).decode())
        spans = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.table({"k": left["k"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "spans": spans, "kept_text": pa.array(kept, pa.string())})

    answers = repeat_classes(blocks, lambda column: distinct_windows(column, window), buckets)
    kind = docs.schema[key].dataType.simpleString()
    return with_answers(blocks, answers, work, f"k {kind}, {COLUMNS}").withColumnRenamed("k", key)
