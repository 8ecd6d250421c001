"""Count the hashes of all texts without a row for each: blocks of texts talk to buckets of hashes.

Texts are dealt to blocks of some megabytes.  A block sends each bucket its
distinct hashes as one sorted array, so a hash that fills a third of all texts
still goes once from each block.  A bucket adds up and answers each block with
one byte for each hash, in the order they came.  The block, which makes the same
array again, looks up its answers; so neither texts nor hashes are joined row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import give_back

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
MESSAGE = "bucket int, block int, hashes binary, counts binary"
ANSWER = "block int, bucket int, classes binary"

#: What a block's texts give: hashes, the bucket word of each (independent of the hash), and how often each occurs.
Hashes = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


def in_blocks(docs: DataFrame, columns: dict[str, str], text: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int, int]:
    """Columns (renamed) and text of ``docs`` with the number of their block; how many blocks there are, and bytes of text.

    One pass over the texts sums their sizes.  A text longer than a block is in a block with few others.
    """
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    named = [F.col(old).alias(new) for old, new in columns.items()]
    block = F.pmod(F.xxhash64(*columns, text), F.lit(blocks)).cast("int").alias("block")
    return docs.select(*named, F.col(text).alias("t"), block), blocks, total


def planes(keys: np.ndarray) -> bytes:
    """Bytes of sorted keys, highest bytes first: equal ones lie together and compress."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(">u8").reshape(-1).astype(np.uint64)


def by_bucket(keys: np.ndarray, bucket_word: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct keys by (bucket, key), and the bounds of each bucket."""
    bucket = (bucket_word % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((keys, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def repeat_classes(blocks: DataFrame, hashes: Hashes, buckets: int) -> DataFrame:
    """Answers for all blocks: for each of its distinct hashes 0 if it occurs once in all texts, else 1 + floor(log2(occurrences))."""

    def send(table: pa.Table) -> pa.Table:
        keys, word, counts = hashes(table["t"])
        order, bounds = by_bucket(keys, word, buckets)
        keys, counts = keys[order], np.minimum(counts[order], 255).astype(np.uint8)
        used = np.flatnonzero(np.diff(bounds))
        cut = [slice(bounds[b], bounds[b + 1]) for b in used]
        return pa.table({
            "bucket": pa.array(used, pa.int32()), "block": pa.array([table["block"][0].as_py()] * len(used), pa.int32()),
            "hashes": pa.array([planes(keys[c]) for c in cut], pa.binary()), "counts": pa.array([counts[c].tobytes() for c in cut], pa.binary()),
        })

    def answer(table: pa.Table) -> pa.Table:
        data = [from_planes(x) for x in table["hashes"].to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table["counts"].to_pylist()]).astype(np.int64)
        keys = np.concatenate(data)
        order = np.argsort(keys)
        sorted_keys = keys[order]
        begin = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
        total = np.add.reduceat(counts[order], begin)
        kind = np.where(total > 1, 1 + np.floor(np.log2(total)), 0).astype(np.uint8)
        out = np.empty(len(keys), np.uint8)
        out[order] = np.repeat(kind, np.diff(np.append(begin, len(keys))))
        ends = np.cumsum([len(x) for x in data])
        parts = [out[e - len(x) : e].tobytes() for x, e in zip(data, ends, strict=True)]
        give_back()
        return pa.table({"block": table["block"], "bucket": table["bucket"], "classes": pa.array(parts, pa.binary())})

    return blocks.groupBy("block").applyInArrow(send, MESSAGE).groupBy("bucket").applyInArrow(answer, ANSWER)


def classes_of(answers: pa.Table, keys: np.ndarray, word: np.ndarray, buckets: int) -> np.ndarray:
    """The class of each distinct key of a block, from its answers."""
    order, _ = by_bucket(keys, word, buckets)
    got = sorted(zip(answers["bucket"].to_pylist(), answers["classes"].to_pylist(), strict=True))
    out = np.empty(len(keys), np.uint8)
    out[order] = np.frombuffer(b"".join(x for _, x in got), np.uint8)
    return out


def with_answers(blocks: DataFrame, answers: DataFrame, work: Callable[[pa.Table, pa.Table], Iterator | pa.Table], schema: str) -> DataFrame:
    """``work(texts of a block, its answers)`` for all blocks; the texts' shuffle is the one the counts came from."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left, right)
        give_back()
        return out

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
