"""Debounced edits on a stream: sessions in state, merged as edits arrive, given out while they are still open.

Spark's session windows are given out on a stream only after the watermark has
passed them.  An editor waits for the first quiet moment instead, so here each
trigger gives the present state of every session it touched; a session that an
older edit has joined to another one is withdrawn.  What holds in the end is
the same however edits fall into triggers, as long as they arrive within the
watermark.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .runner import run_updates

UNITS = {"millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def microseconds(duration: str) -> int:
    """``300 milliseconds``, ``6 hours`` ..."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", duration)
    if not m or m[2] not in UNITS:
        raise ValueError(f"no duration: {duration}")
    return int(m[1]) * UNITS[m[2]]


def merged(sessions: list, gap: int) -> list:
    """Sessions [first, last, text] in order, those up to ``gap`` apart joined, as session windows are; the text is the last edit's, of several at once the greatest."""
    out: list = []
    for first, last, text in sorted(sessions, key=lambda s: (s[0], s[1], s[2] is not None, s[2] or "")):
        if out and first - out[-1][1] <= gap:
            newest = max((out[-1][1], out[-1][2] is not None, out[-1][2] or ""), (last, text is not None, text or ""))
            out[-1] = [out[-1][0], newest[0], newest[2] if newest[1] else None]
        else:
            out.append([first, last, text])
    return out


def sessions_of(edits: DataFrame, gap: str, watermark: str) -> DataFrame:
    """Stream (uri, text, ts) -> updates (uri, first_us, last_us, text, gone), keyed by uri and first_us.

    State holds the sessions of a document that an edit may still join, and
    goes with the watermark.  A document is one group: its edits of a trigger
    pass through in batches and only sessions are kept.
    """
    width, kind = microseconds(gap), edits.schema["uri"].dataType.simpleString()

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        now = held
        if not state.hasTimedOut:
            for frame in frames:
                texts = [None if pd.isna(x) else x for x in frame["text"]]
                now = merged(now + [[t, t, x] for t, x in zip(frame["us"].tolist(), texts, strict=True)], width)
        before, after = {s[0]: s for s in held}, {s[0]: s for s in now}
        rows = [(*s, False) for first, s in after.items() if before.get(first) != s] + [(*s, True) for first, s in before.items() if first not in after]
        passed = state.getCurrentWatermarkMs()
        left = [s for s in now if (s[1] + width) // 1000 >= passed]
        if left:
            state.update((json.dumps(left),))
            state.setTimeoutTimestamp(max(min((s[1] + width) // 1000 + 1 for s in left), passed + 1))
        elif state.exists:
            state.remove()
        if rows:
            frame = pd.DataFrame(rows, columns=["first_us", "last_us", "text", "gone"])
            frame.insert(0, "uri", key[0])
            yield frame

    e = edits.withWatermark("ts", watermark).select("uri", "text", "ts", F.unix_micros("ts").alias("us"))
    return e.groupBy("uri").applyInPandasWithState(
        update, f"uri {kind}, first_us bigint, last_us bigint, text string, gone boolean", "sessions string", "update", GroupStateTimeout.EventTimeTimeout
    )


def debounced(edits: DataFrame, name: str, gap: str = "300 milliseconds", watermark: str = "1 minute", path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """All available edits of a stream as ``events.debounce`` has them in a batch: (uri, session_start, session_end, text), open sessions included."""
    last = run_updates(sessions_of(edits, gap, watermark), name, ["uri", "first_us"], path, checkpoint)
    return last.filter("not gone").select(
        "uri", F.timestamp_micros("first_us").alias("session_start"), F.timestamp_micros(F.col("last_us") + microseconds(gap)).alias("session_end"), "text"
    )
