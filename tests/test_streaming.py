import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from codeassay.plans.scan import scan
from codeassay.streaming import events as ev, lookups as lk
from codeassay.streaming.runner import run_available, run_updates
from codeassay.streaming.sessions import debounced, merged, microseconds


def as_stream(spark, df, tmp_path, parts=1):
    path = str(tmp_path / "in")
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_scan_equals_batch(spark, files, tmp_path):
    corpus = files(*[(f"d{i}.js", f"eval(x{i});\nok();\nconst password = 'abcdefgh{i}';") for i in range(12)])
    batch = sorted((r.file_path, r.line, r.rule_id) for r in scan(corpus).collect())
    stream = run_available(scan(as_stream(spark, corpus, tmp_path, 3)), "t", path=str(tmp_path / "o"), checkpoint=str(tmp_path / "c"))
    assert sorted((r.file_path, r.line, r.rule_id) for r in stream.collect()) == batch


def test_windows_of_a_stream_equal_a_batch(spark, tmp_path):
    rnd = random.Random(3)
    rows, start = [], dt.datetime(2024, 1, 1)
    for key in ("a", "b"):
        t = 0
        for _ in range(300):
            t += rnd.choice([1, 5, 20, 61, 400])
            rows.append((key, key == "b", len(rows), start + dt.timedelta(seconds=t)))
    df = spark.createDataFrame(rows, "key string, authenticated boolean, request_id bigint, ts timestamp").orderBy("ts")
    for name, make in (("q", lambda x: ev.quota_windows(x, "1 minute", 2)), ("l", lambda x: ev.lookup_windows(x, "1 hour"))):
        stream = make(as_stream(spark, df, tmp_path / name, 4))
        got = run_updates(stream, name, ["key", "window_start"], path=str(tmp_path / name / "o"), checkpoint=str(tmp_path / name / "c"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, make(df).collect()))


def test_lifecycle_transitions_and_timeout(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(1, 1, "pending", t(0)), (1, 2, "running", t(1)), (1, 3, "running", t(2)), (1, 4, "completed", t(3)), (1, 5, "failed", t(4)),
            (2, 6, "running", t(0)), (3, 7, "pending", t(60))]
    df = spark.createDataFrame(rows, "scan_id bigint, event_id bigint, status string, ts timestamp")
    stream = ev.status_minima(as_stream(spark, df, tmp_path, 3))
    minima = run_updates(stream, "l", ["scan_id", "day"], path=str(tmp_path / "o"), checkpoint=str(tmp_path / "c"))
    got = ev.transitions(minima, int(t(60).timestamp() * 1000))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ev.transitions(ev.status_minima(df), int(t(60).timestamp() * 1000)).collect()))
    seen = sorted((r.scan_id, r.at_ms, r.status) for r in got.collect())
    assert [s for i, _, s in seen if i == 1] == ["pending", "running", "completed"]
    assert [s for i, _, s in seen if i == 2] == ["running", "failed"]
    final = {r.scan_id: r.status for r in ev.lifecycle(df).collect()}
    assert final == {1: "completed", 2: "running", 3: "pending"}


def test_debounced_stream_equals_batch(spark, tmp_path):
    """Edits in any order over the triggers: sessions that span triggers, grow at both ends and join."""
    rnd, start, rows = random.Random(9), dt.datetime(2024, 1, 1), []
    for uri in range(6):
        t = 0
        for n in range(40):
            t += rnd.choice([1, 10, 29, 30, 31, 90])
            rows.append((uri, None if n % 11 == 7 else f"{uri}-{n}", start + dt.timedelta(seconds=t)))
    for order in (rnd.sample(rows, len(rows)), sorted(rows, key=lambda r: r[2])):
        here = tmp_path / str(len(list(tmp_path.iterdir())))
        for i in range(0, len(order), 48):
            spark.createDataFrame(order[i : i + 48], "uri bigint, text string, ts timestamp").coalesce(1).write.mode("append").parquet(str(here / "in"))
        df = spark.read.parquet(str(here / "in"))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(here / "in"))
        got = debounced(stream, "d", "30 seconds", "2 days", str(here / "o"), str(here / "c"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ev.debounce(df, "30 seconds").collect()))


def test_sessions_leave_state_behind_the_watermark(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    for k in range(6):
        rows = [(1, f"a{k}", start + dt.timedelta(hours=k)), (2 + k, "b", start + dt.timedelta(hours=k, seconds=3))]
        spark.createDataFrame(rows, "uri bigint, text string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = debounced(stream, "d", "30 seconds", "10 minutes", str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ev.debounce(df, "30 seconds").collect()))


def test_merging_and_durations():
    assert merged([[0, 0, "a"], [5, 5, "b"], [15, 15, "c"], [14, 14, "d"]], 10) == [[0, 15, "c"]]
    assert merged([[11, 11, "b"], [0, 0, "a"]], 10) == [[0, 0, "a"], [11, 11, "b"]]
    assert [microseconds(x) for x in ("300 milliseconds", "1 minute", "6 hours")] == [300_000, 60_000_000, 21_600_000_000]
    with pytest.raises(ValueError):
        microseconds("soon")


def loads(rows, life):
    out = {}
    for key, at in sorted(rows, key=lambda r: (r[0] is not None, r)):
        own = out.setdefault(key, [])
        if own and at - own[-1][0] <= dt.timedelta(seconds=life):
            own[-1][1] += 1
        else:
            own.append([at, 1])
    return sorted(((k, at, n, n - 1) for k, own in out.items() for at, n in own), key=repr)


def test_cache_entries_in_any_order(spark, tmp_path):
    """Late look-ups move the loadings after them; each order over the triggers ends in the same entries."""
    rnd, start, rows = random.Random(5), dt.datetime(2024, 1, 1), []
    for key in ("a", "b", None):
        t = 0
        for _ in range(90):
            t += rnd.choice([0, 5, 29, 30, 31, 70])
            rows.append((key, start + dt.timedelta(seconds=t)))
    for n, order in enumerate((rnd.sample(rows, len(rows)), sorted(rows, key=lambda r: r[1]))):
        here = tmp_path / str(n)
        for i in range(0, len(order), 54):
            spark.createDataFrame(order[i : i + 54], "key string, ts timestamp").coalesce(1).write.mode("append").parquet(str(here / "in"))
        stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(here / "in"))
        got = lk.cached(stream, "c", "30 seconds", "2 days", str(here / "o"), str(here / "c"))
        assert sorted(map(tuple, got.collect()), key=repr) == loads(rows, 30)


def test_cache_state_goes_with_the_watermark(spark, tmp_path):
    start, rows = dt.datetime(2024, 1, 1), []
    for k in range(6):
        part = [("a", start + dt.timedelta(minutes=20 * k + m)) for m in (0, 3, 5, 6, 14)] + [(f"b{k}", start + dt.timedelta(minutes=20 * k + 1))]
        rows += part
        spark.createDataFrame(part, "key string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = lk.cached(stream, "c", "5 minutes", "10 minutes", str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(map(tuple, got.collect()), key=repr) == loads(rows, 300)
    assert lk.settled([[0, 3]], [[4, 1], [12, 1], [30, 1]], 10, 20) == ([[12, 1]], [[30, 1]])
    assert lk.settled([[0, 3]], [], 10, 20) == ([], [])
