"""Look-ups of a cache on a stream: an entry lives for some time from its loading, the first look-up after that loads it anew.

Which look-ups load follows from event times alone: each depends on the one
before, so a key's look-ups are kept in state until the watermark has passed
them, and each trigger gives the entries that it changed.  A late look-up may
move the entries after it; those it takes the place of are withdrawn.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .runner import run_updates
from .sessions import microseconds


def entries(times: list, ttl: int) -> list:
    """Look-ups [time, number] in order -> entries [loaded, look-ups]; one up to ``ttl`` after the loading hits."""
    out: list = []
    for at, n in times:
        if out and at - out[-1][0] <= ttl:
            out[-1][1] += n
        else:
            out.append([at, n])
    return out


def settled(first: list, times: list, ttl: int, passed: int) -> tuple[list, list]:
    """What must be kept once no look-up before ``passed`` can come: the entry that may still be hit (or none), and the later look-ups."""
    last = entries(first + [t for t in times if t[0] < passed], ttl)[-1:]
    return [e for e in last if e[0] + ttl >= passed], [t for t in times if t[0] >= passed]


def entries_of(lookups: DataFrame, ttl: str, watermark: str) -> DataFrame:
    """Stream (key, ts) -> updates (key, loaded_us, lookups, gone), keyed by key and loaded_us.

    State holds the distinct times of a key within the watermark and one entry.
    """
    life, kind = microseconds(ttl), lookups.schema["key"].dataType.simpleString()

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, times = json.loads(state.get[0]) if state.exists else ([], [])
        held, now = entries(first + times, life), None
        if not state.hasTimedOut:
            counts = Counter(dict(times))
            for frame in frames:
                counts.update({int(at): int(n) for at, n in frame["us"].value_counts().items()})
            times = [[at, counts[at]] for at in sorted(counts)]
            now = entries(sorted(first + times), life)
            before, after = {e[0]: e[1] for e in held}, {e[0]: e[1] for e in now}
            rows = [(at, n, False) for at, n in after.items() if before.get(at) != n] + [(at, 0, True) for at in before if at not in after]
            frame = pd.DataFrame(rows, columns=["loaded_us", "lookups", "gone"])
            frame.insert(0, "key", key[0])
            yield frame
        passed = state.getCurrentWatermarkMs()
        first, times = settled(first, times, life, passed * 1000)
        if first or times:
            state.update((json.dumps([first, times]),))
            state.setTimeoutTimestamp(max(((first or times)[0][0] + life) // 1000 + 1, passed + 1))
        elif state.exists:
            state.remove()

    r = lookups.withWatermark("ts", watermark).select("key", "ts", F.unix_micros("ts").alias("us"))
    return r.groupBy("key").applyInPandasWithState(
        update, f"key {kind}, loaded_us bigint, lookups bigint, gone boolean", "held string", "update", GroupStateTimeout.EventTimeTimeout
    )


def cached(lookups: DataFrame, name: str, ttl: str = "5 minutes", watermark: str = "1 hour", path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """(key, loaded_at, lookups, hits) of all available look-ups (key, ts): each row is a look-up that goes through, the others are answered by it.

    The same for any order over the triggers, within the watermark.  Look-ups of
    one moment are one loading; a null key is a key; null times are left out.
    """
    last = run_updates(entries_of(lookups.filter("ts is not null"), ttl, watermark), name, ["key", "loaded_us"], path, checkpoint)
    return last.filter("not gone").select("key", F.timestamp_micros("loaded_us").alias("loaded_at"), "lookups", (F.col("lookups") - 1).alias("hits"))
