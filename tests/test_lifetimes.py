import datetime as dt
import random

from codeassay.streaming import events as ev
from codeassay.streaming.lifetimes import lifetimes, merged_firsts, steps

SCHEMA = "scan_id bigint, event_id bigint, status string, ts timestamp"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
BASE = int(START.timestamp() * 1000)


def run(spark, parts, here, **options):
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(here / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(here / "in"))
    got = lifetimes(stream, "l", path=str(here / "o"), checkpoint=str(here / "c"), **options)
    return sorted(map(tuple, got.collect()), key=repr)


def expected(rows, minutes, passed):
    """By hand: events of a scan in order."""
    out, scans = [], {}
    for r in rows:
        if r[1] is not None and r[3] is not None:
            scans.setdefault(r[0], []).append((int(r[3].timestamp() * 1000), r[1], r[2]))
    for scan, own in scans.items():
        stage, run_at = 0, None
        for at, _, status in sorted(own, key=lambda x: x[:2]):
            if stage == 2 and at > run_at + minutes * 60_000:
                break
            if status == "pending" and stage == 0:
                out.append((scan, "pending", at))
                stage = 1
            elif status == "running" and stage < 2:
                out.append((scan, "running", at))
                stage, run_at = 2, at
            elif status in ("completed", "failed"):
                out.append((scan, status, at))
                stage = 3
                break
        ended = any(s in ("completed", "failed") for _, _, s in own)
        if stage == 2 and (ended or run_at + minutes * 60_000 < passed):
            out.append((scan, "failed", run_at + minutes * 60_000))
    return sorted(out, key=repr)


def events(seed, scans=40):
    rnd, rows = random.Random(seed), []
    for scan in range(scans):
        at = rnd.randrange(0, 50)
        for _ in range(rnd.randint(1, 5)):
            status = rnd.choice(["pending", "running", "running", "completed", "failed", None, "queued"])
            rows.append((scan if scan else None, len(rows), status, START + dt.timedelta(minutes=at, milliseconds=rnd.randrange(1000))))
            at += rnd.choice([0, 1, 5, 14, 15, 16, 30])
    return rows


def test_any_order_over_the_triggers(spark, tmp_path):
    rows = events(4)
    rows += [(None, None, "running", START), (3, 999, "running", None)]
    rows.append((900, 1000, "pending", START + dt.timedelta(hours=8)))
    passed = BASE + 60_000 * 120  # the watermark stands six hours behind the last event
    want = expected(rows, 15, passed)
    assert {s for _, s, _ in want} == {"pending", "running", "completed", "failed"}
    rest, last = rows[:-1], rows[-1:]
    mixed = random.Random(1).sample(rest, len(rest))
    half = len(mixed) // 2
    assert run(spark, [mixed[:half], mixed[half:], last], tmp_path / "mixed", watermark="6 hours") == want
    assert run(spark, [rows], tmp_path / "whole", watermark="6 hours") == want


def test_stuck_scan_fails_by_its_timer_and_state_goes(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    parts = [
        [(1, 1, "pending", at(0)), (1, 2, "running", at(1)), (2, 3, "running", at(1)), (3, 9, "running", at(2))],
        [(2, 4, "completed", at(6)), (7, 5, "pending", at(40))],  # the watermark passes 16 with the next trigger
        [(7, 6, "running", at(41)), (3, 10, "completed", at(30))],  # late: an end after the deadline changes nothing
        [(8, 8, "pending", at(400))],
    ]
    got = run(spark, parts, tmp_path, watermark="5 minutes", remember="2 hours")
    ms = lambda m: BASE + 60_000 * m
    assert got == sorted([
        (1, "pending", ms(0)), (1, "running", ms(1)), (1, "failed", ms(16)), (2, "running", ms(1)), (2, "completed", ms(6)),
        (3, "running", ms(2)), (3, "failed", ms(17)), (7, "pending", ms(40)), (7, "running", ms(41)), (7, "failed", ms(56)), (8, "pending", ms(400)),
    ], key=repr)
    # The failure of scan 1 was given out by a trigger that held no event of it.
    given = spark.read.parquet(str(tmp_path / "o")).filter("scan_id = 1 and step = 2").collect()
    assert len(given) == 1 and given[0]["trigger"] in (2, 3)
    left = spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "c"))
    assert [r[0] for r in left.select("key.key").collect()] == ["=8"]


def test_without_events(spark, tmp_path):
    assert run(spark, [[]], tmp_path) == []


def test_steps_like_the_batch(spark):
    rows = [r for r in events(11, 60) if r[0] is not None]
    as_of = BASE + 60_000 * 1000
    batch = ev.transitions(ev.status_minima(spark.createDataFrame(rows, SCHEMA)), as_of)
    found = []
    for scan in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == scan]
        firsts = merged_firsts({}, [int(r[3].timestamp() * 1000) for r in own], [r[1] for r in own], [r[2] for r in own])
        found += [(scan, *x) for x in steps(firsts, ev.reg.STUCK_MINUTES * 60_000, True).values()]
    assert sorted(found) == sorted(map(tuple, batch.collect()))
