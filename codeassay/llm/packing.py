"""Packing by the cutting-stock method: column generation over a histogram of lengths.

A text's ids are cut into pieces of a full sequence and one remainder.  The
histogram of remainders, in bins of a few tokens, is all that reaches the
driver: its size is bounded by the length of a sequence.  There a linear program
chooses how often each pattern (so many pieces of each bin in one sequence) is
used; a knapsack over the bins finds the pattern that lowers the cost most until
none does.  Spark then ranks the pieces of each bin and gives every rank its
place in a pattern.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.session import cut_lineage
from .bpe import Encoder, Vocabulary, public_vocabulary
from .words import slices

PIECE_COLUMNS = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
#: Rows that one task ranks; more ranked rows make more shards.
RANKED_ROWS = 100_000


@dataclass(frozen=True)
class Sheet:
    """``size`` of a sequence, ``step`` of the bins of lengths, id that ends each text."""

    size: int = 2048
    step: int = 8
    end_id: int = 1
    rounds: int = 2000
    tolerance: float = 1e-4


def best_pattern(value: np.ndarray, size: np.ndarray, room: int) -> np.ndarray:
    """Unbounded knapsack: how many of each bin give the greatest value within the room."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = size <= c
        if fits.any():
            gain = np.where(fits, best[c - np.where(fits, size, 0)] + value, -np.inf)
            k = int(gain.argmax())
            if gain[k] > best[c - 1]:
                best[c], pick[c] = gain[k], k
                continue
        best[c] = best[c - 1]
    out, c = np.zeros(len(size), np.int64), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[pick[c]] += 1
            c -= int(size[pick[c]])
    return out


def inverse_of(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots. Plain array operations: a BLAS with threads of its own can stall beside a JVM."""
    m = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(m)])
    for k in range(m):
        p = k + int(np.abs(work[k:, k]).argmax())
        work[[k, p]] = work[[p, k]]
        work[k] /= work[k, k]
        factor = work[:, k].copy()
        factor[k] = 0
        work -= np.outer(factor, work[k])
    return work[:, m:]


def times(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Matrix by vector, or vector by matrix, without a BLAS."""
    return (left * right).sum(1) if left.ndim == 2 else (left[:, None] * right).sum(0)


def first_basis(size: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """As many patterns as bins, and their amounts: largest pieces first, each pattern used until a bin is empty."""
    m, left, live = len(size), demand.copy(), np.ones(len(size), bool)
    columns, amount = np.zeros((m, m)), np.zeros(m)
    while live.any():
        pattern, free = np.zeros(m), room
        for k in np.flatnonzero(live)[::-1]:
            pattern[k] = min(np.ceil(left[k] - 1e-9), free // size[k])
            free -= int(pattern[k] * size[k])
        used = np.flatnonzero(pattern > 0)
        if not len(used):
            used = np.flatnonzero(live)[-1:]
            pattern[used] = room // size[used]
        out = used[(left[used] / pattern[used]).argmin()]
        columns[:, out], amount[out] = pattern, max(left[out] / pattern[out], 0)
        left = np.maximum(left - amount[out] * pattern, 0)
        left[out], live[out] = 0, False
    return columns, amount


def solve(size: np.ndarray, demand: np.ndarray, room: int, sheet: Sheet) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the linear program uses them; at the end of the rounds, the best so far.

    The revised simplex method, begun at the first basis.  It stops at the
    optimum, or when the room that all patterns leave is below the tolerance.
    """
    m = len(size)
    columns, amount = first_basis(size, demand, room)
    cost, inverse, least = np.ones(m), inverse_of(columns), (size * demand).sum() / room
    for r in range(sheet.rounds):
        if (cost * amount).sum() <= least * (1 + sheet.tolerance):
            break
        price = times(cost, inverse)
        if price.min() < -1e-9:  # more than the demand of this bin is free
            column, c = -np.eye(m)[int(price.argmin())], 0.0
        else:
            column, c = best_pattern(price, size, room).astype(float), 1.0
            if (price * column).sum() <= 1 + 1e-9:
                break
        change = times(inverse, column)
        ratio = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[:, out], cost[out] = column, c
        if r % 100 == 99:  # rounding errors do not pile up
            inverse = inverse_of(columns)
            amount = np.maximum(times(inverse, demand), 0)
            continue
        amount = np.maximum(amount - ratio[out] * change, 0)
        amount[out] = ratio[out]
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
    return [(columns[:, k].astype(np.int64), amount[k]) for k in range(m) if cost[k] == 1 and amount[k] > 0]


def whole_patterns(size: np.ndarray, demand: np.ndarray, room: int, sheet: Sheet) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole counts that hold all pieces: the program's amounts rounded down, the rest largest first."""
    left, out = demand.astype(np.int64).copy(), []
    for pattern, x in solve(size, demand.astype(float), room, sheet):
        while (n := min(int(x + 1e-6), *(left[pattern > 0] // pattern[pattern > 0]).tolist())) > 0:
            out.append((pattern, n))
            left, x = left - n * pattern, x - n
    order = np.argsort(-size)
    while left.any():
        pattern, free = np.zeros(len(size), np.int64), room
        for k in order:
            n = min(left[k], free // size[k])
            pattern[k], free = n, free - n * size[k]
        n = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((pattern, n))
        left -= n * pattern
    return out


def places(patterns: list[tuple[np.ndarray, int]], bins: np.ndarray) -> list[tuple]:
    """Which ranks of a bin go to which sequences: (bin, first rank, end, pieces in a sequence, first sequence, first slot)."""
    done, first, out = np.zeros(len(bins), np.int64), 0, []
    for pattern, n in patterns:
        slot = 0
        for k in np.flatnonzero(pattern)[::-1]:
            each = int(pattern[k])
            out.append((int(bins[k]), int(done[k]), int(done[k] + each * n), each, first, slot))
            done[k] += each * n
            slot += each
        first += n
    return out


def pieces_of(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: Vocabulary | None = None, sheet: Sheet | None = None) -> DataFrame:
    """One row per piece: key, start, length, crc32 of its ids, tokens of its text. A narrow pass that encodes each text once."""
    vocabulary, sheet = vocabulary or public_vocabulary(), sheet or Sheet()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for part in slices(batch.column(1)):
                row, start, length, crc, total = [], [], [], [], []
                for i, ids in enumerate(encoder.ids([part.text(i).decode() for i in range(part.count)])):
                    data = np.append(ids, sheet.end_id).astype("<u4").tobytes()
                    for a in range(0, len(ids) + 1, sheet.size):
                        piece = data[4 * a : 4 * (a + sheet.size)]
                        row.append(part.first + i)
                        start.append(a)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(len(ids) + 1)
                columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, {PIECE_COLUMNS}").withColumnRenamed("k", key)


def ranked(df: DataFrame, group: str, order: list[Column], total: int, name: str = "rank") -> DataFrame:
    """Rows of a group numbered from 0, a hot group in many tasks: ranks within shards plus the rows of the shards before."""
    shards = max(1, -(-total // RANKED_ROWS))
    df = df.withColumn("_shard", F.pmod(F.xxhash64(*order), F.lit(shards)).cast("int"))
    counts = df.groupBy(group, "_shard").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy(group, "_shard").orderBy(*order)) - 1
    return df.withColumn(name, inner).join(counts, [group, "_shard"]).withColumn(name, F.col(name) + F.col("_before")).drop("_shard", "_before")


def pack(pieces: DataFrame, key: str = "doc_id", sheet: Sheet | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; each piece lies in one sequence, offsets are gapless from 0.

    ``pieces`` is read several times and should be a stored table.  Repeated
    rows are pieces of their own.  An empty table gives an empty result.
    """
    sheet, spark = sheet or Sheet(), pieces.sparkSession
    room = sheet.size // sheet.step
    binned = pieces.withColumn("_bin", F.ceil(F.col("length") / sheet.step).cast("int"))
    histogram = binned.groupBy("_bin").agg(F.count("*").alias("n")).collect()  # at most size / step rows
    counts = {r["_bin"]: r["n"] for r in histogram}
    bins = np.array(sorted(b for b in counts if b < room), np.int64)
    plan = [(np.zeros(len(bins), np.int64), 0)] if not len(bins) else whole_patterns(bins, np.array([counts[b] for b in bins], np.int64), room, sheet)
    rows = places(plan, bins)
    if room in counts:  # full pieces are sequences of their own
        rows.append((room, 0, counts[room], 1, sum(n for _, n in plan), 0))
    table = spark.createDataFrame(rows, "_bin int, _low bigint, _end bigint, _each bigint, _first bigint, _slot bigint")
    at = ranked(binned, "_bin", [F.col(key), F.col("start"), F.col("length"), F.col("ids_crc32")], sum(counts.values()), "_rank")
    # The table of places is bounded by the bins of the histogram, not by the data.
    at = at.join(F.broadcast(table), (at["_bin"] == table["_bin"]) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_end"))).drop(table["_bin"])
    past = F.col("_rank") - F.col("_low")
    at = at.withColumn("sequence_id", F.col("_first") + F.floor(past / F.col("_each"))).withColumn("_slot", F.col("_slot") + past % F.col("_each"))
    within = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)))
    return at.select(*pieces.columns, "sequence_id", "offset")


def packed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: Vocabulary | None = None, sheet: Sheet | None = None) -> DataFrame:
    """Encode, cut and pack ``docs``: one row per piece.

    A null text is empty and has only the ending id.  Other columns of ``docs``
    are not carried.  Pieces are checkpointed in the shared folder, because the
    histogram and the places must see the same rows.
    """
    return pack(cut_lineage(pieces_of(docs, key, text, vocabulary, sheet)), key, sheet)
