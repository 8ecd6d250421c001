"""The life cycle of scans on a stream, with a timer for each scan that runs: the failure of a stuck scan is given out when its time is up.

A timer on event time fires once the watermark has passed a scan's deadline, in
whichever trigger that is, also when nothing else of the scan ever arrives.  So
no table of all scans is searched for stuck ones.  Other transitions are given
out in the trigger in which their events arrive; one that an older event takes
the place of is corrected or withdrawn.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..catalog import registries as reg
from .runner import run_updates
from .sessions import microseconds

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = Row("key", "step", "status", "at_ms", "gone")
STEPS = {"pending": "pending", "running": "running", "completed": "ended", "failed": "ended"}


def steps(firsts: dict, limit: int, expired: bool = False) -> dict:
    """First events of a scan, {pending, running, ended: [ms, event, status]} -> its transitions, {place: (status, ms)}.

    Only what precedes the end counts, and pending only before running.  A scan
    that ended after its deadline, or whose deadline has ``expired``, failed
    when the limit ran out.
    """
    end = firsts.get("ended")
    before = lambda a, b: a is not None and (b is None or a < b)
    run = firsts.get("running") if before(firsts.get("running"), end) else None
    wait = firsts.get("pending")
    out = {}
    if before(wait, run) and before(wait, end):
        out[0] = ("pending", wait[0])
    if run:
        out[1] = ("running", run[0])
    if run and (end[0] > run[0] + limit if end else expired):
        out[2] = ("failed", run[0] + limit)
    elif end:
        out[2] = (end[2], end[0])
    return out


def merged_firsts(firsts: dict, ms: list, events: list, statuses: list) -> dict:
    """The first event of each kind, by time, then number, with those of some more events; ``last`` is the time of the last one."""
    out = dict(firsts)
    for at, event, status in zip(ms, events, statuses, strict=True):
        kind = STEPS.get(status)
        if kind:
            out[kind] = min(out.get(kind, [at, event, status]), [at, event, status])
        out["last"] = max(out.get("last", at), at)
    return out


class _Lives(StatefulProcessor):
    """State of a scan: its first events and whether its deadline has passed; one timer, for the deadline or for forgetting it."""

    def __init__(self, limit: int, remember: int):
        self.limit, self.remember = limit, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "firsts string, expired boolean, timer bigint")

    def _load(self) -> tuple[dict, bool, int | None]:
        held = self.held.get()
        return (json.loads(held[0]), held[1], held[2]) if held else ({}, False, None)

    def _wake(self, firsts: dict, expired: bool) -> int:
        """When to look at the scan again: its deadline, while that is open, else when no more is expected."""
        at = steps(firsts, self.limit)
        if 1 in at and 2 not in at and not expired:
            return at[1][1] + self.limit
        return max([firsts["last"], *(ms for _, ms in steps(firsts, self.limit, expired).values())]) + self.remember

    def _store(self, firsts: dict, expired: bool, timer: int | None) -> None:
        wake = self._wake(firsts, expired)
        if wake != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wake)
        self.held.update((json.dumps(firsts), expired, wake))

    @staticmethod
    def _changes(key: tuple, before: dict, after: dict) -> Iterator[Row]:
        if before is not after:
            yield from (CHANGE(key[0], k, *v, False) for k, v in after.items() if before.get(k) != v)
            yield from (CHANGE(key[0], k, *v, True) for k, v in before.items() if k not in after)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        old, expired, timer = self._load()
        new = merged_firsts(old, *zip(*((r["ms"], r["event_id"], r["status"]) for r in rows), strict=True))
        # A scan whose deadline moved to an earlier event is woken again.
        still = expired and new.get("running") == old.get("running")
        self._store(new, still, timer)
        return self._changes(key, steps(old, self.limit, expired), steps(new, self.limit, still))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        firsts, expired, timer = self._load()
        before = steps(firsts, self.limit, expired)
        after = before
        if timer == expiredTimerInfo.getExpiryTimeInMs():
            if 1 in before and 2 not in before and not expired:
                after = steps(firsts, self.limit, True)
            if self._wake(firsts, True) > timerValues.getCurrentWatermarkInMs():
                self._store(firsts, True, None)
            else:
                self.held.clear()
        return self._changes(key, before, after)

    def close(self) -> None:
        pass


def lives_of(events: DataFrame, minutes: int, watermark: str, remember: str) -> DataFrame:
    """Stream (scan_id, event_id, status, ts) -> updates (scan_id, step, status, at_ms, gone), keyed by scan_id and step."""
    # A null key would be dealt together with its neighbours, so ids go as texts with a sign before them.
    key = F.coalesce(F.concat(F.lit("="), F.col("scan_id").cast("string")), F.lit("")).alias("key")
    e = events.withWatermark("ts", watermark).select(
        key, F.col("event_id").cast("bigint").alias("event_id"), F.coalesce("status", F.lit("")).alias("status"), "ts", F.unix_millis("ts").alias("ms")
    )
    steps_of = e.groupBy("key").transformWithState(
        _Lives(minutes * 60_000, microseconds(remember) // 1000), "key string, step int, status string, at_ms bigint, gone boolean", "update", "EventTime"
    )
    scan = F.when(F.col("key") != "", F.substring("key", 2, 2**31 - 1)).cast(events.schema["scan_id"].dataType)
    return steps_of.select(scan.alias("scan_id"), "step", "status", "at_ms", "gone")


def lifetimes(
    events: DataFrame, name: str, minutes: int = reg.STUCK_MINUTES, watermark: str = "1 hour", remember: str = "1 day",
    path: str | None = None, checkpoint: str | None = None,
) -> DataFrame:
    """(scan_id, status, at_ms) of all available status events: pending, then running, then one end, each once.

    A scan that runs for ``minutes`` without an end fails at that moment: as soon
    as the watermark has passed it, or an end arrives that is later.  The same
    for any order over the triggers, within the watermark.  A scan is forgotten
    ``remember`` after its last event or end; what comes later is taken for a
    new one, so events of a scan must lie closer.  A null scan is a scan; events
    without a time or a number are left out, unknown states only keep a scan in
    mind.
    """
    spark = events.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    former = spark.conf.get(setting, None)
    # Timers need this store; a query takes the setting along when it starts.
    spark.conf.set(setting, ROCKSDB)
    try:
        known = events.filter("ts is not null and event_id is not null")
        last = run_updates(lives_of(known, minutes, watermark, remember), name, ["scan_id", "step"], path, checkpoint)
    finally:
        spark.conf.set(setting, former) if former else spark.conf.unset(setting)
    return last.filter("not gone").select("scan_id", "status", "at_ms")
