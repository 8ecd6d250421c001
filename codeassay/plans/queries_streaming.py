"""Registered queries: event streams, each run over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import detectors as cat
from ..sources import derived as d, oracle_views as v
from ..streaming import events as ev, lookups as lk
from ..streaming.lifetimes import lifetimes
from ..streaming.runner import run_available, run_updates
from ..streaming.sessions import debounced
from . import sast_oracle as so
from .queries_sast import OUT
from .scan import scan

QUERIES: dict = {}
ORACLE: dict = {}


def query(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


ACTIONS = ("opened", "synchronize", "closed", "reopened", "labeled")


def _pr_events(e):
    return e.select(
        "event_id", F.when(F.col("event_type") == "error", "push").otherwise("pull_request").alias("event"),
        d._pick(ACTIONS, F.col("event_id") % 5).alias("action"),
        F.concat(F.lit("org/"), F.col("user_id").cast("string")).alias("owner_repo"), F.col("ts").cast("timestamp").alias("ts"),
    )


def _pr_projects(spark, sf):
    c = d.table(spark, sf, "customer")
    return c.select(
        F.concat(F.lit("org/"), F.col("c_custkey").cast("string")).alias("owner_repo"), F.col("c_custkey").alias("project_id"),
        (F.col("c_custkey") % 3 != 0).alias("enabled"),
    )


PR_SQL = """SELECT e.event_id, c.c_custkey AS project_id FROM events e JOIN customer c ON c.c_custkey = e.user_id
  WHERE c.c_custkey % 3 <> 0 AND e.event_type <> 'error' AND e.event_id % 5 IN (0, 1)"""


@query("pull_request_events", PR_SQL)
def pull_request_events(spark, sf):
    return ev.pull_requests_to_scan(_pr_events(d.table(spark, sf, "events")), _pr_projects(spark, sf)).select("event_id", "project_id")


@query("pull_request_events_stream", PR_SQL)
def pull_request_events_stream(spark, sf):
    s = _pr_events(d.table_stream(spark, sf, "events"))
    out = ev.pull_requests_to_scan(s, _pr_projects(spark, sf)).select("event_id", "project_id")
    return run_available(out, "pull-requests")


@query("scan_stream", so.scan_sql(numbers=cat.META, declarative=True, secrets=True, dedup=True))
def scan_stream(spark, sf):
    """Arriving files go through the same narrow plan as a batch."""
    docs = d.table_stream(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    return run_available(scan(d.corpus(spark, sf, docs)).select(*OUT), "scan")


GAP_SQL = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
  SELECT user_id AS uri, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, arg_max(props, ts) AS text FROM s GROUP BY user_id, sid"""


@query("debounced_edits", GAP_SQL)
def debounced_edits(spark, sf):
    e = d.table(spark, sf, "events").select(F.col("user_id").alias("uri"), F.col("props").alias("text"), F.col("ts").cast("timestamp").alias("ts"))
    return ev.debounce(e, "6 hours")


@query("debounced_edits_stream", GAP_SQL)
def debounced_edits_stream(spark, sf):
    e = d.table_stream(spark, sf, "events").select(F.col("user_id").alias("uri"), F.col("props").alias("text"), F.col("ts").cast("timestamp").alias("ts"))
    return debounced(e, "debounced", "6 hours", "30 days")


QUOTA_SQL = """SELECT CAST(user_id AS VARCHAR) AS key, date_trunc('{unit}', ts) AS window_start, count(*) AS n, greatest(count(*) - {limit}, 0) AS over FROM events GROUP BY 1, 2"""


def _requests(spark, sf, stream):
    e = d.table_stream(spark, sf, "events") if stream else d.table(spark, sf, "events")
    return e.select(
        F.col("user_id").cast("string").alias("key"), (F.col("user_id") % 4 == 0).alias("authenticated"),
        F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"),
    )


@query("quota_fixed_window", QUOTA_SQL.format(unit="day", limit=30))
def quota_fixed_window(spark, sf):
    windows = ev.quota_windows(_requests(spark, sf, True), "1 day", 30)
    return run_updates(windows, "quota", ["key", "window_start"])


@query("quota_fixed_window_tight", QUOTA_SQL.format(unit="minute", limit=1))
def quota_fixed_window_tight(spark, sf):
    windows = ev.quota_windows(_requests(spark, sf, True), "1 minute", 1)
    return run_updates(windows, "quota", ["key", "window_start"])


@query(
    "quota_sliding_window",
    """WITH w AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000) RANGE BETWEEN 172799999 PRECEDING AND CURRENT ROW) AS n FROM events)
    SELECT CAST(user_id AS VARCHAR) AS key, event_id AS request_id, n AS in_window, n > CASE WHEN user_id % 4 = 0 THEN 20 ELSE 5 END AS rejected FROM w""",
)
def quota_sliding_window(spark, sf):
    return ev.sliding_quota(_requests(spark, sf, False), seconds=172_800)


STATUS = ("pending", "running", "completed", "failed", "running")


def _status_events(e):
    return e.select(
        F.floor(F.col("event_id") / 4).alias("scan_id"), "event_id", d._pick(STATUS, F.col("event_id") * 7 % 5).alias("status"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


@query(
    "scan_lifecycle",
    """WITH e AS (SELECT event_id // 4 AS scan_id, event_id, ['pending', 'running', 'completed', 'failed', 'running'][event_id * 7 % 5 + 1] AS status, (epoch_us(ts) // 1000) AS t FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY CASE status WHEN 'pending' THEN 2 WHEN 'running' THEN 1 ELSE 0 END, t, event_id) AS rn FROM e)
    SELECT r.scan_id, status, t AS since_ms, s.started AS started_ms FROM r
    LEFT JOIN (SELECT scan_id, min(t) AS started FROM e WHERE status = 'running' GROUP BY 1) s USING (scan_id) WHERE rn = 1""",
)
def scan_lifecycle(spark, sf):
    return ev.lifecycle(_status_events(d.table(spark, sf, "events")))


@query(
    "daily_trend",
    f"WITH {v.findings()} SELECT date_trunc('day', created_at) AS day, count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning FROM findings GROUP BY 1",
)
def daily_trend(spark, sf):
    return ev.daily_counts(d.findings(spark, sf))


@query(
    "daily_trend_stream",
    """WITH w AS (SELECT date_trunc('day', ts) AS day, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS critical, count(*) FILTER (WHERE event_type = 'click') AS warning FROM events GROUP BY 1) SELECT * FROM w""",
)
def daily_trend_stream(spark, sf):
    e = d.table_stream(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("created_at"),
        F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "click", "warning").otherwise("info").alias("severity"),
    )
    return run_updates(ev.daily_counts(e), "daily", ["day"])


LIFE_SQL = """e AS (SELECT event_id // 4 AS scan_id, event_id, ['pending', 'running', 'completed', 'failed', 'running'][event_id * 7 % 5 + 1] AS status, (epoch_us(ts) // 1000) AS t FROM events),
    g AS (SELECT scan_id, min((t, event_id)) FILTER (status = 'pending') AS p, min((t, event_id)) FILTER (status = 'running') AS r0,
      min((t, event_id, status)) FILTER (status IN ('completed', 'failed')) AS f FROM e GROUP BY 1),
    h AS (SELECT *, CASE WHEN f IS NULL OR (r0[1], r0[2]) < (f[1], f[2]) THEN r0 END AS r FROM g),
    tr AS (SELECT scan_id, 'pending' AS status, p[1] AS at_ms FROM h WHERE p IS NOT NULL AND (r IS NULL OR p < r) AND (f IS NULL OR p < (f[1], f[2]))
      UNION ALL SELECT scan_id, 'running', r[1] FROM h WHERE r IS NOT NULL
      UNION ALL SELECT scan_id, CASE WHEN late THEN 'failed' ELSE f[3] END, CASE WHEN late THEN r[1] + 900000 ELSE f[1] END
        FROM (SELECT *, coalesce({late}, false) AS late FROM h) WHERE late OR f IS NOT NULL)"""
# A batch looks up to the last event; a timer fires behind the watermark, or is outrun by a later end.
PASSED_SQL = LIFE_SQL.replace("{late}", "r[1] + 900000 <= (SELECT max(t) FROM e) AND (f IS NULL OR f[1] > r[1] + 900000)")
TIMER_SQL = LIFE_SQL.replace("{late}", "f[1] > r[1] + 900000 OR (f IS NULL AND r[1] + 900000 < (SELECT max(t) FROM e) - 3 * 86400000)")


def _transitions(spark, sf, name):
    minima = run_updates(ev.status_minima(_status_events(d.table_stream(spark, sf, "events"))), name, ["scan_id", "day"])
    return ev.transitions(minima, minima.agg(F.max("last_ms")).first()[0] or 0)


@query("scan_lifecycle_stream", f"WITH {PASSED_SQL} SELECT scan_id, status, at_ms FROM tr")
def scan_lifecycle_stream(spark, sf):
    return _transitions(spark, sf, "lifecycle")


@query("scan_timeouts_stream", f"WITH {TIMER_SQL} SELECT scan_id, status, at_ms FROM tr")
def scan_timeouts_stream(spark, sf):
    """Stuck scans fail by their timers, in the trigger in which the watermark passes their deadline."""
    return lifetimes(_status_events(d.table_stream(spark, sf, "events")), "lifetimes", watermark="3 days", remember="20 days")


@query("completion_notices_stream", f"WITH {PASSED_SQL} SELECT scan_id, 'scheduled_scan' AS type, '/scans/' || scan_id AS link FROM tr WHERE status = 'completed'")
def completion_notices_stream(spark, sf):
    return ev.completion_notices(_transitions(spark, sf, "notices"))


@query(
    "cached_lookups_stream",
    """SELECT CAST(user_id AS VARCHAR) AS key, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01 00:00:00') AS window_start, count(*) AS lookups, count(*) - 1 AS hits FROM events GROUP BY 1, 2""",
)
def cached_lookups_stream(spark, sf):
    return run_updates(ev.lookup_windows(_requests(spark, sf, True), "6 hours"), "lookups", ["key", "window_start"])


@query(
    "quota_sliding_window_stream",
    """WITH x AS (SELECT user_id, ts, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w FROM events)
    SELECT CAST(user_id AS VARCHAR) AS key, w AS window_start, count(*) AS n, count(*) > CASE WHEN user_id % 4 = 0 THEN 20 ELSE 5 END AS rejected FROM x GROUP BY user_id, w""",
)
def quota_sliding_window_stream(spark, sf):
    windows = ev.sliding_quota_stream(_requests(spark, sf, True), window="2 days", slide="1 day")
    return run_updates(windows, "sliding", ["key", "window_start"])


@query(
    "cache_entries_stream",
    """WITH RECURSIVE m AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1
      UNION ALL SELECT e.user_id, min(e.ts) FROM m JOIN events e ON e.user_id = m.user_id AND e.ts > m.ts + INTERVAL 6 HOUR GROUP BY e.user_id),
    n AS (SELECT e.user_id, e.ts, max(m.ts) AS loaded FROM events e JOIN m ON m.user_id = e.user_id AND m.ts <= e.ts GROUP BY e.event_id, e.user_id, e.ts)
    SELECT CAST(user_id AS VARCHAR) AS key, loaded AS loaded_at, count(*) AS lookups, count(*) - 1 AS hits FROM n GROUP BY 1, 2""",
)
def cache_entries_stream(spark, sf):
    return lk.cached(_requests(spark, sf, True), "cache-entries", "6 hours", "30 days")
