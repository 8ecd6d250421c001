"""Ranked lexical search of all documents by blocked dense multiplication.

Items are dealt into tiles of bounded size, each with the compact vocabulary of
its own terms, cut into column tiles.  A slice of documents becomes impact
tiles, documents x terms; one matrix product gives the partial scores of all
items of a tile for all documents of the slice.  Impacts are whole numbers held
in float64, and a column tile is closed before the partial sums of any document
could reach 2^53, so every product is exact in whatever order it is summed;
column tiles are added as 64-bit integers.

Each task keeps the best documents of each item, ties by key; these meet by
item in two steps, so no task gathers more than a bounded number of rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.session import cut_lineage
from .words import ALNUM, Slice, Words, slices, words_of

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Whole numbers up to here are exact in float64.
EXACT = 1 << 53
#: (1000000000 * tf) div (1000 * tf + 8 * m) stays below this, as m is positive.
MOST_SHARE = 1_000_000
SHARDS = 64


@dataclass(frozen=True)
class Tiles:
    """Bounds of the blocks: items and columns of a tile, documents of an impact tile, and (item, term) pairs that go to all tasks at once."""

    items: int = 256
    columns: int = 4096
    documents: int = 512
    pairs: int = 1 << 20


def distinct_terms(text: str) -> Column:
    """Distinct terms of a text, A-Z lower-cased; none of a null."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"({TERM})"), F.lit(1)))


def term_hashes(terms: list[str]) -> np.ndarray:
    """The hashes by which tasks find the terms."""
    data = [t.encode() for t in terms]
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    return words_of(Slice(0, b"".join(data), cuts), ALNUM).hash


@dataclass
class Occurrences:
    """Terms of a vocabulary in the texts of a slice: text, place in the vocabulary, count."""

    text: np.ndarray
    term: np.ndarray
    count: np.ndarray


def occurrences(words: Words, vocabulary: np.ndarray) -> Occurrences:
    """``vocabulary`` are sorted hashes."""
    if not len(vocabulary) or not len(words.hash):
        none = np.empty(0, np.int64)
        return Occurrences(none, none, none)
    at = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
    met = vocabulary[at] == words.hash
    pair, count = np.unique(words.text_of()[met] * np.int64(len(vocabulary)) + at[met], return_counts=True)
    return Occurrences(pair // len(vocabulary), pair % len(vocabulary), count)


@dataclass
class ItemTile:
    """Items (by number) and, for each column tile, its terms and the pairs (row, column) that are one."""

    items: np.ndarray
    columns: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def column_tiles(terms: np.ndarray, most_impact: np.ndarray, columns: int) -> list[tuple[int, int]]:
    """Bounds of tiles of at most ``columns`` terms whose greatest impacts sum up to less than 2^53."""
    out, first, total = [], 0, 0
    for i, impact in enumerate(most_impact.tolist()):
        if impact >= EXACT:
            raise OverflowError("an impact of 2^53 or more")
        if i > first and (i - first >= columns or total + impact >= EXACT):
            out.append((first, i))
            first, total = i, 0
        total += impact
    return [*out, (first, len(terms))] if len(terms) else []


def item_tiles(item: np.ndarray, term: np.ndarray, weight: np.ndarray, tiles: Tiles) -> list[ItemTile]:
    """Tiles of the pairs (item number, term number), each pair once; numbers of items ascend without gaps."""
    order = np.lexsort((term, item))
    item, term = item[order], term[order]
    out = []
    for first in range(0, int(item[-1]) + 1 if len(item) else 0, tiles.items):
        a, b = np.searchsorted(item, (first, first + tiles.items))
        rows, own = item[a:b] - first, np.unique(term[a:b])
        at, columns = np.searchsorted(own, term[a:b]), []
        for low, high in column_tiles(own, weight[own] * MOST_SHARE, tiles.columns):
            inside = (at >= low) & (at < high)
            columns.append((own[low:high], rows[inside], at[inside] - low))
        out.append(ItemTile(np.arange(first, min(first + tiles.items, int(item[-1]) + 1)), columns))
    return out


def length_part(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of each document: 100 - 90 + (90 * n * N) div L."""
    if int(n.max(initial=0)) * 90 * n_docs < 1 << 63:
        return 10 + (90 * n.astype(np.int64) * np.int64(n_docs)) // np.int64(max(n_terms, 1))
    return np.array([10 + 90 * x * n_docs // n_terms for x in n.tolist()], np.int64)


def impacts(found: Occurrences, m: np.ndarray, weight: np.ndarray) -> np.ndarray:
    tf = found.count.astype(np.int64)
    return weight[found.term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[found.text]))


class Best:
    """The best (score, key) of each item: highest score first, then least key; a null key comes first."""

    def __init__(self, n_items: int, k: int):
        self.k, self.kept, self.floor = k, [[] for _ in range(n_items)], np.zeros(n_items, np.int64)

    def add(self, items: np.ndarray, scores: np.ndarray, keys: list) -> None:
        """``scores``: items x documents. Only scores that reach an item's worst kept one are looked at; equal ones compete by key."""
        row, column = np.nonzero(scores >= np.maximum(self.floor[items], 1)[:, None])
        if not len(row):
            return
        bounds = np.searchsorted(row, np.arange(len(items) + 1))
        for r in np.unique(row).tolist():
            i, at = int(items[r]), column[bounds[r] : bounds[r + 1]]
            own = scores[r, at]
            if len(own) > self.k:  # ties with the last place stay in
                least = np.partition(own, len(own) - self.k)[len(own) - self.k]
                at, own = at[own >= least], own[own >= least]
            new = [(-s, keys[c] is not None, keys[c]) for s, c in zip(own.tolist(), at.tolist(), strict=True)]
            best = heapq.nsmallest(self.k, self.kept[i] + new, key=lambda x: (x[0], x[1], x[2] if x[1] else 0))
            self.kept[i] = best
            if len(best) == self.k:
                self.floor[i] = -best[-1][0]

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for i, own in enumerate(self.kept):
            for negative, _, key in own:
                yield i, key, -negative


def scores_of(tile: ItemTile, column: np.ndarray, found: Occurrences, value: np.ndarray, first: int, last: int, documents: int) -> np.ndarray:
    """Scores of the tile's items for the documents of occurrences first to last."""
    out = np.zeros((len(tile.items), documents), np.int64)
    for terms, rows, at in tile.columns:
        column[terms] = np.arange(len(terms))
        place = column[found.term[first:last]]
        inside = place >= 0
        impact = np.zeros((documents, len(terms)))
        impact[found.text[first:last][inside] - (found.text[first] if last > first else 0), place[inside]] = value[first:last][inside]
        wanted = np.zeros((len(tile.items), len(terms)))
        wanted[rows, at] = 1.0
        out += (wanted @ impact.T).astype(np.int64)
        column[terms] = -1
    return out


def search_group(docs: DataFrame, key: str, text: str, pairs: DataFrame, totals: tuple[int, int] | None, k: int, tiles: Tiles) -> tuple[DataFrame | None, tuple[int, int]]:
    """(item, key, score) of the best documents of the items of ``pairs`` (item, term), a few from each task; and N and L.

    The pairs come to the driver: the caller bounds their number.
    """
    spark = docs.sparkSession
    listed = sorted(((r["item"], r["term"]) for r in pairs.collect()), key=lambda x: (x[0] is not None, x[0] if x[0] is not None else "", x[1]))
    names = list(dict.fromkeys(i for i, _ in listed))
    terms = sorted({t for _, t in listed})
    hashes = term_hashes(terms)
    order = np.argsort(hashes)
    vocabulary = hashes[order]
    if len(np.unique(vocabulary)) < len(vocabulary):
        raise RuntimeError("two terms of the items share a hash of 64 bits")
    place_of = {terms[t]: p for p, t in enumerate(order.tolist())}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task: documents with a term and terms (place -1), and the documents that hold each term of the vocabulary."""
        df, n_docs, n_terms = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            for part in slices(batch.column(1)):
                words = words_of(part, ALNUM, lower=True)
                n = words.counts()
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
                df += np.bincount(occurrences(words, vocabulary).term, minlength=len(vocabulary))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *held.tolist()], pa.int64()), pa.array([n_docs, n_terms, *df[held].tolist()], pa.int64())], names=["place", "n"])

    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{text}`").alias("t"))
    counted = {r["place"]: r["n"] for r in texts.mapInArrow(count, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()}
    totals = totals or (counted.get(-1, 0), counted.get(-2, 0))
    n_docs, n_terms = totals
    if not listed or not n_docs:
        return None, totals
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counted.get(p, 0) + 1))) for p in range(len(vocabulary))], np.int64)
    number = {x: i for i, x in enumerate(names)}
    blocks = item_tiles(np.array([number[i] for i, _ in listed]), np.array([place_of[t] for _, t in listed]), weight, tiles)
    shared = spark.sparkContext.broadcast((vocabulary, weight, blocks))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weight, blocks = shared.value
        best, column = Best(len(names), k), np.full(len(vocabulary), -1, np.int64)
        for batch in batches:
            for part in slices(batch.column(1)):
                words = words_of(part, ALNUM, lower=True)
                found = occurrences(words, vocabulary)
                value = impacts(found, length_part(words.counts(), n_docs, n_terms), weight)
                keys = batch.column(0).slice(part.first, part.count).to_pylist()
                held = np.unique(found.text)  # documents without a term of an item have no score
                found.text = np.searchsorted(held, found.text)
                for low in range(0, len(held), tiles.documents):
                    own = held[low : low + tiles.documents]
                    a, b = np.searchsorted(found.text, (low, low + len(own)))
                    for tile in blocks:
                        best.add(tile.items, scores_of(tile, column, found, value, a, b, len(own)), [keys[i] for i in own.tolist()])
        rows = list(best.rows())
        for i in range(0, len(rows), 1 << 16):
            item, own, score = zip(*rows[i : i + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(own, pa.int64()), pa.array(score, pa.int64())], names=["i", "key", "score"])

    found = texts.mapInArrow(rank, "i int, key bigint, score bigint").withColumn("shard", F.pmod(F.spark_partition_id(), F.lit(SHARDS)))
    kind = pairs.schema["item"].dataType.simpleString()
    named = spark.createDataFrame(list(enumerate(names)), f"i int, item {kind}")
    for group in (["i", "shard"], ["i"]):
        best = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_first("key"))
        found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.join(named, "i").select("item", "rank", "key", "score"), totals


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", tiles: Tiles | None = None,
) -> DataFrame:
    """(``item``, rank, ``key``, score): the ``k`` best documents of each item, scores above 0, equal ones by ascending key.

    All rows of ``docs`` are searched.  Keys are whole numbers; a null key
    ranks before others of its score.  Repeated rows rank one by one.  Rows
    with one item id are one item, also those without id; terms count once.
    Null or empty texts on either side have no terms; an item without a term
    in any document has no rows.  Empty tables give no rows.

    Items go through the tasks in groups of about ``tiles.pairs`` (item, term)
    pairs, or one item where that has more; each group reads the documents twice.
    """
    tiles, names = tiles or Tiles(), (item, "rank", key, "score")
    pairs = items.select(F.col(f"`{item}`").alias("item"), F.explode(distinct_terms(item_text)).alias("term")).distinct()
    pairs = cut_lineage(pairs)
    groups = max(1, math.ceil(pairs.count() / tiles.pairs))
    out, totals = None, None
    for g in range(groups):
        own = pairs if groups == 1 else pairs.filter(F.pmod(F.xxhash64("item"), F.lit(groups)) == g)
        found, totals = search_group(docs, key, text, own, totals, k, tiles)
        if found is not None:
            found = found if groups == 1 else cut_lineage(found)
            out = found if out is None else out.union(found)
    if out is None:
        out = pairs.select("item", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("score")).limit(0)
    return out.select(*[F.col(a).alias(b) for a, b in zip(("item", "rank", "key", "score"), names, strict=True)])
