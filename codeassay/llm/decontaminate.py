"""Benchmark decontamination by winnowing.

A window of ``window`` words is found by its fingerprint, the least hash of the
k-grams in it.  Equal windows have equal fingerprints, so every shared span of a
window or more is met; a run of windows mostly has one fingerprint, so there are
few.  Texts and benchmark items join on fingerprints; each hit is then extended:
the text's windows with that fingerprint join the items' windows by their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.session import cut_lineage
from .keys import fresh, row_key, without
from .words import ALNUM, LOWER, Slice, covered, inside_text, mix, slices, window_hashes, words_of

#: Up to so many fingerprints of items (8 bytes each) go to all tasks as a filter before the join; beyond, the join does without.
FILTER_FINGERPRINTS = 1_000_000
#: Windows of a text that are written out at a time.
WINDOWS = 16_384


@dataclass(frozen=True)
class Winnow:
    window: int = 10
    gram: int = 5


def fingerprints(hashes: np.ndarray, bounds: np.ndarray, winnow: Winnow, short: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, start, fingerprint) of all windows of the texts: those of full width, and those as wide as the short items."""
    at = inside_text(bounds, winnow.window)
    if len(at):
        grams = window_hashes(hashes, winnow.gram)
        least = grams[at]
        for k in range(1, winnow.window - winnow.gram + 1):
            least = np.minimum(least, grams[at + k])
        yield winnow.window, at, least
    for m in short:
        at = inside_text(bounds, m)
        if len(at):
            yield m, at, mix(window_hashes(hashes, m)[at] + np.uint64(m))


def item_windows(items: DataFrame, item: str, text: str, winnow: Winnow) -> DataFrame:
    """(item, width, words, fingerprint) of each window of each item; an item of fewer words is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                words, low = words_of(part, ALNUM, lower=True), part.data.translate(LOWER)
                owner, counts = words.text_of(), words.counts()
                short = sorted({int(c) for c in counts if 0 < c < winnow.window})
                rows, width, said, prints = [], [], [], []
                for m, at, found in fingerprints(words.hash, words.bounds, winnow, short):
                    for a, h in zip(at.tolist(), found.view(np.int64).tolist(), strict=True):
                        if m == min(winnow.window, counts[owner[a]]):
                            rows.append(part.first + int(owner[a]))
                            width.append(m)
                            said.append(b" ".join(low[words.start[j] : words.end[j]] for j in range(a, a + m)).decode())
                            prints.append(h)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(width, pa.int32()), pa.array(said, pa.string()), pa.array(prints, pa.int64())],
                    names=["item", "width", "words", "print"],
                )

    return items.select(F.col(item).cast("string").alias("item"), F.col(text).alias("t")).mapInArrow(run, "item string, width int, words string, print bigint")


def marked_texts(docs: DataFrame, key: str, text: str, winnow: Winnow, short: list[int], known: np.ndarray | None) -> DataFrame:
    """(k, n_words, t, prints): each text with its distinct fingerprints, those of items only if they are ``known``; without any, t is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                words = words_of(part, ALNUM, lower=True)
                owner, prints = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
                for _, at, found in fingerprints(words.hash, words.bounds, winnow, short):
                    if known is not None:
                        met = np.isin(found, known)
                        at, found = at[met], found[met]
                    owner.append(np.searchsorted(words.bounds, at, "right") - 1)
                    prints.append(found)
                owner, prints = np.concatenate(owner), np.concatenate(prints)
                order = np.lexsort((prints, owner))
                owner, prints = owner[order], prints[order]
                new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (prints[1:] != prints[:-1])]) if len(owner) else np.empty(0, bool)
                owner, prints = owner[new], prints[new]
                offsets = np.searchsorted(owner, np.arange(part.count + 1))
                rows = batch.slice(part.first, part.count)
                marks = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(prints.view(np.int64)))
                texts = pa.array([part.text(i).decode() if n else None for i, n in enumerate(np.diff(offsets))], pa.string())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(words.counts(), pa.int64()), texts, marks], names=["k", "n_words", "t", "prints"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_words bigint, t string, prints array<bigint>")


def windows_of(text: bytes, prints: np.ndarray, winnow: Winnow, short: list[int], most: int) -> Iterator[tuple[int, int, np.ndarray, list[str]]]:
    """(number of words, width, starts, words) of those windows of a text that have one of the fingerprints, at most so many at a time."""
    words = words_of(Slice(0, text.translate(LOWER), np.array([0, len(text)])), ALNUM)
    low = text.translate(LOWER)
    for width, at, found in fingerprints(words.hash, words.bounds, winnow, short):
        at = at[np.isin(found, prints)]
        for i in range(0, len(at), most):
            some = at[i : i + most]
            yield len(words.hash), width, some, [b" ".join(low[words.start[j] : words.end[j]] for j in range(a, a + width)).decode() for a in some.tolist()]


def benchmark_hits(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    winnow: Winnow | None = None, filter_fingerprints: int = FILTER_FINGERPRINTS,
) -> DataFrame:
    """One row per row of ``docs``: key, ``n_words``, ``n_hit``, ``spans`` of hit words, ``item_ids`` (sorted as strings).

    Words are runs of ASCII letters (lower-cased) and digits and of anything
    beyond ASCII.  A word is hit inside any occurrence of a window of an item.
    A null text has no words; items without words have no windows.  Rows with
    one item id are one item; an item without id hits words but is not listed.
    Rows of ``docs`` may repeat and keys may be null.  Other columns are not
    carried.  Empty tables on either side give rows without hits, or no rows.
    """
    winnow = winnow or Winnow()
    windows = cut_lineage(item_windows(items, item, item_text, winnow))
    short = [r["width"] for r in windows.select("width").distinct().collect() if r["width"] < winnow.window]  # fewer than ``window`` values
    # Windows with the same items share one group, so a window that many items have is carried as one name.
    grouped = windows.groupBy("print", "width", "words").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    grouped = grouped.withColumn("items", F.sha2(F.to_json("ids"), 256))
    groups = grouped.select("items", "ids").dropDuplicates(["items"])
    prints = windows.select("print").distinct()
    known = None
    if prints.count() <= filter_fingerprints:
        known = np.sort(np.array([r["print"] for r in prints.collect()], np.int64)).view(np.uint64)
    texts = cut_lineage(marked_texts(docs, key, text, winnow, sorted(short), known).withColumn("row", F.monotonically_increasing_id()))
    tried = texts.filter("t is not null").select("row", "t", "prints")
    if known is None:  # of a text's own fingerprints those that an item has
        met = tried.select("row", F.explode("prints").alias("print")).join(prints, "print").groupBy("row").agg(F.collect_list("print").alias("prints"))
        tried = tried.drop("prints").join(met, "row")

    def found_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, text_, own = (batch.column(c)[i].as_py() for c in range(3))
                for n, width, at, said in windows_of(text_.encode(), np.array(own, np.int64).view(np.uint64), winnow, sorted(short), WINDOWS):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x] * len(at), t) for x, t in ((row, pa.int64()), (n, pa.int64()), (width, pa.int32()))] + [pa.array(at, pa.int64()), pa.array(said, pa.string())],
                        names=["row", "n", "width", "start", "words"],
                    )

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, at = batch.column(1)[i].as_py(), batch.column(2)[i].values
                width, start = at.field("width").to_numpy(), at.field("start").to_numpy()
                hit = np.zeros(n, bool)
                for m in np.unique(width).tolist():
                    hit |= covered(start[width == m], m, n)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()
                spans = [[{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([int(hit.sum())], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), batch.column(3).slice(i, 1)],
                    names=["row", "n_hit", "spans", "groups"],
                )

    # A text's row only carries windows that occur in it, however many items share a fingerprint.
    occurring = tried.mapInArrow(found_windows, "row bigint, n bigint, width int, start bigint, words string").join(grouped.select("words", "items"), "words")
    hits = occurring.groupBy("row", "n").agg(F.collect_list(F.struct("width", "start")).alias("at"), F.collect_set("items").alias("groups"))
    found = cut_lineage(hits.mapInArrow(merged, "row bigint, n_hit bigint, spans array<struct<start:bigint,end:bigint>>, groups array<string>"))
    listed = found.select("row", F.explode("groups").alias("items")).join(groups, "items").select("row", F.explode("ids").alias("id"))
    listed = listed.groupBy("row").agg(F.array_sort(F.collect_set("id")).alias("item_ids"))
    out = texts.select("k", "n_words", "row").join(found.drop("groups"), "row", "left").join(listed, "row", "left")
    nothing = F.array().cast("array<string>")
    return out.select(
        F.col("k").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"), F.coalesce("item_ids", nothing).alias("item_ids"),
    )


def without_hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", winnow: Winnow | None = None) -> DataFrame:
    """``docs`` without the rows that have a hit word. All columns are kept; nulls as in ``benchmark_hits``."""
    name = fresh("row_key", docs)
    named = docs.withColumn(name, row_key(key, text))
    found = benchmark_hits(named, items, name, text, item, item_text, winnow)
    gone = cut_lineage(found.filter("n_hit > 0").select(name).distinct())
    return without(named, name, gone).drop(name)
