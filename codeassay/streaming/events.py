"""Event streams: pull requests, edits, request quotas, scan status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..catalog import registries as reg


# ------------------------------------------------------------- pull requests
def pull_requests_to_scan(events: DataFrame, projects: DataFrame) -> DataFrame:
    """Opened or updated pull requests of known projects whose owner switched the feature on.

    ``projects`` is a table (owner_repo, project_id, enabled); works on a batch
    and, as a stream-static join, on a stream.
    """
    wanted = events.filter((F.col("event") == "pull_request") & F.col("action").isin("opened", "synchronize"))
    return wanted.join(projects.filter("enabled").select("owner_repo", "project_id"), "owner_repo")


# --------------------------------------------------------------------- edits
def debounce(edits: DataFrame, gap: str = "300 milliseconds", watermark: str = "1 minute") -> DataFrame:
    """Last text per document once it has been quiet for ``gap``.

    (uri, text, ts) -> (uri, session_start, session_end, text); the same code
    serves a batch and a stream.
    """
    e = edits.withWatermark("ts", watermark) if edits.isStreaming else edits
    return e.groupBy("uri", F.session_window("ts", gap).alias("w")).agg(F.max_by("text", "ts").alias("text")).select(
        "uri", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "text"
    )


# -------------------------------------------------------------------- quotas
def quota_windows(requests: DataFrame, window: str, limit: int, watermark: str = "1 day") -> DataFrame:
    """(key, window_start, n, over): requests of a key in each fixed window, and how many of them are over the limit.

    Windows follow the clock.  Serves a batch and, in update mode, a stream;
    state goes with the watermark.
    """
    r = requests.withWatermark("ts", watermark) if requests.isStreaming else requests
    return r.groupBy("key", F.window("ts", window).alias("w")).agg(F.count("*").alias("n")).select(
        "key", F.col("w.start").alias("window_start"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("over")
    )


def sliding_quota(requests: DataFrame, seconds: int = reg.SLIDING_SECONDS) -> DataFrame:
    """Requests in the last ``seconds`` per key, and whether the limit is exceeded.

    (key, authenticated, request_id, ts).  Each row is counted in its own time
    bucket and offered to the next one, so a window never holds more than two
    buckets of a key, however busy the key is.
    """
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    width = seconds * 1000
    r = requests.withColumn("_ms", ms).withColumn("_b", F.floor(F.col("_ms") / width))
    r = r.select("*", F.explode(F.array(F.struct(F.col("_b").alias("b"), F.lit(True).alias("own")), F.struct((F.col("_b") + 1).alias("b"), F.lit(False).alias("own")))).alias("_x"))
    w = Window.partitionBy("key", "_x.b").orderBy("_ms").rangeBetween(-(width - 1), 0)
    limit = F.when(F.col("authenticated"), F.lit(reg.SLIDING_USER)).otherwise(F.lit(reg.SLIDING_ANON))
    return (
        r.withColumn("in_window", F.count("*").over(w))
        .filter("_x.own")
        .select("key", "request_id", "in_window", (F.col("in_window") > limit).alias("rejected"))
    )


def sliding_quota_stream(
    requests: DataFrame, window: str = f"{reg.SLIDING_SECONDS} seconds", slide: str = "10 seconds", watermark: str = "5 minutes"
) -> DataFrame:
    """Approximation on a stream: requests of keys in overlapping windows, and whether they exceed the key's limit."""
    limit = F.when(F.col("authenticated"), F.lit(reg.SLIDING_USER)).otherwise(F.lit(reg.SLIDING_ANON))
    return (
        requests.withWatermark("ts", watermark)
        .groupBy("key", "authenticated", F.window("ts", window, slide).alias("w"))
        .agg(F.count("*").alias("n"))
        .select("key", F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("rejected"))
    )


# ------------------------------------------------------------ cached look-ups
def lookup_windows(lookups: DataFrame, ttl: str = "5 minutes", watermark: str = "1 day") -> DataFrame:
    """(key, window_start, lookups, hits): look-ups of a cache whose entries live to the end of their window; the first of a window misses."""
    r = lookups.withWatermark("ts", watermark) if lookups.isStreaming else lookups
    return r.groupBy("key", F.window("ts", ttl).alias("w")).agg(F.count("*").alias("lookups")).select(
        "key", F.col("w.start").alias("window_start"), "lookups", (F.col("lookups") - 1).alias("hits")
    )


# ----------------------------------------------------------------- lifecycle
def status_rank(status: Column) -> Column:
    return F.when(status.isin("completed", "failed"), 2).when(status == "running", 1).otherwise(0)


def lifecycle(status_events: DataFrame) -> DataFrame:
    """Final status per scan: the furthest stage wins, and the first terminal
    status sticks.  One aggregate with partial reduction."""
    r = status_rank(F.col("status"))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    # first event of the highest stage
    pick = F.max(F.struct(r.alias("r"), (-ms).alias("t"), (-F.col("event_id")).alias("e"), F.col("status").alias("status")))
    started = F.min(F.when(F.col("status") == "running", ms))
    return status_events.groupBy("scan_id").agg(pick.alias("p"), started.alias("started_ms")).select(
        "scan_id", F.col("p.status").alias("status"), (-F.col("p.t")).alias("since_ms"), "started_ms"
    )


def status_minima(status_events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """First events of each kind per scan and day: (scan_id, day, pending, running, ended, last_ms).

    Serves a batch and, in update mode, a stream; days go with the watermark, so
    state does not grow with the number of scans.
    """
    e = status_events.withWatermark("ts", watermark) if status_events.isStreaming else status_events
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    at, status = F.struct(ms.alias("ms"), F.col("event_id").alias("e"), F.col("status").alias("status")), F.col("status")
    return e.groupBy("scan_id", F.window("ts", "1 day").alias("w")).agg(
        F.min(F.when(status == "pending", at)).alias("pending"), F.min(F.when(status == "running", at)).alias("running"),
        F.min(F.when(status.isin("completed", "failed"), at)).alias("ended"), F.max(ms).alias("last_ms"),
    ).select("scan_id", F.col("w.start").alias("day"), "pending", "running", "ended", "last_ms")


def transitions(minima: DataFrame, as_of_ms: int, minutes: int = reg.STUCK_MINUTES) -> DataFrame:
    """(scan_id, status, at_ms): pending, then running, then one terminal status, each once.

    Only event times decide: a scan that has run for longer than the limit
    without an end, up to ``as_of_ms``, failed when the limit ran out, however
    events fell into triggers.
    """
    s = minima.groupBy("scan_id").agg(*[F.min(c).alias(c) for c in ("pending", "running", "ended")])
    running = F.when(F.col("ended").isNull() | (F.col("running") < F.col("ended")), F.col("running"))
    s = s.withColumn("run", running).withColumn("pend", F.when((F.col("run").isNull() | (F.col("pending") < F.col("run"))) & (F.col("ended").isNull() | (F.col("pending") < F.col("ended"))), F.col("pending")))
    deadline = F.col("run.ms") + minutes * 60_000
    late = (deadline <= as_of_ms) & (F.col("ended").isNull() | (F.col("ended.ms") > deadline))
    row = lambda status, at: F.when(at.isNotNull(), F.struct(status.alias("status"), at.cast("bigint").alias("at_ms")))
    end = F.when(late, F.struct(F.lit("failed").alias("status"), deadline.cast("bigint").alias("at_ms"))).otherwise(row(F.col("ended.status"), F.col("ended.ms")))
    each = F.array(row(F.lit("pending"), F.col("pend.ms")), row(F.lit("running"), F.col("run.ms")), end)
    return s.select("scan_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("scan_id", "x.*")


def completion_notices(transitions: DataFrame) -> DataFrame:
    """One notice per completed scan, from lifecycle transitions."""
    return transitions.filter(F.col("status") == "completed").select(
        "scan_id", F.lit("scheduled_scan").alias("type"), F.concat(F.lit("/scans/"), F.col("scan_id").cast("string")).alias("link")
    )


# --------------------------------------------------------------------- trend
def daily_counts(findings: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Finding counts per day.  On a stream, in update mode, a day's counts grow until the watermark closes it."""
    f = findings.withWatermark("created_at", watermark) if findings.isStreaming else findings
    s = F.col("severity")
    return f.groupBy(F.window("created_at", "1 day").alias("w")).agg(
        F.count("*").alias("total"), F.count_if(s == "critical").alias("critical"), F.count_if(s == "warning").alias("warning")
    ).select(F.col("w.start").alias("day"), "total", "critical", "warning")
