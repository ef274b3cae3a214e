"""Streaming jobs run to the end of the events table, each beside its batch definition."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelore.catalog.base import Tables, query
from tracelore.catalog.events import CANON, ROOTED_SQL, TREE_SQL, WINDOWS_SQL, micros
from tracelore.catalog.recall import n
from tracelore.operators import windows
from tracelore.session import work_dir
from tracelore.sources.adapters import stream_view
from tracelore.streaming import jobs


def source(t: Tables, name: str):
    return stream_view(t.spark, jobs.read_folder(t.spark, t.folder, "events.parquet"), "events", name)


def places(t: Tables, name: str) -> tuple[str, str]:
    root = work_dir(t.spark, name)
    return f"{root}/out", f"{root}/state"


@query("stream_ingest", rows="R1", uses="raw_payload", oracle=f"""WITH {CANON}
SELECT DISTINCT 'cli:s' || session_id || ':' || event_name || ':' || substr(sha1(body), 1, 16) AS event_id FROM canon""")
def stream_ingest(t: Tables):
    out, state = places(t, "ingest")
    jobs.run_to_end(jobs.ingest_stream(source(t, "raw_payload").select("payload", "received_at"), "cli", out, state))
    return t.spark.read.parquet(out).select("event_id")


@query("stream_chain", rows="R2", uses="session_event", oracle="""
SELECT session_id, event_id, lag(event_id) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS prev_event_id FROM session_event""")
def stream_chain(t: Tables):
    out, state = places(t, "chain")
    jobs.run_to_end(jobs.chain_stream(source(t, "session_event"), out, state))
    return t.spark.read.parquet(out).select("session_id", "event_id", "prev_event_id")


@query("stream_windows", rows="R3", uses="session_event", oracle=f"WITH {WINDOWS_SQL} SELECT session_id, CAST(window_no AS BIGINT) AS window_no, event_id FROM win")
def stream_windows(t: Tables):
    out, state = places(t, "windows")
    jobs.run_to_end(jobs.windows_stream(source(t, "session_event"), out, state))
    return t.spark.read.parquet(out).select("session_id", "window_no", "event_id")


@query("stream_tree_windows", rows="R3", uses="session session_event", recursive=True, oracle=f"WITH {TREE_SQL}, {ROOTED_SQL} SELECT root AS session_id, window_no, event_id FROM twin")
def stream_tree_windows(t: Tables):
    out, state = places(t, "tree-windows")
    tops = windows.roots(t.session.select(F.col("parent_session_id").alias("parent"), F.col("session_id").alias("child")))
    jobs.run_to_end(jobs.windows_stream(source(t, "session_event"), out, state, tops=tops))
    return t.spark.read.parquet(out).select("session_id", "window_no", "event_id")


@query("stream_fixes", rows="R7 J2", uses="session_event", oracle=f"""WITH {WINDOWS_SQL},
 fails AS (SELECT * FROM win WHERE tool_error AND NOT is_interrupt AND k % 6 > 1),
 good AS (SELECT * FROM win WHERE event_name = 'PostToolUse' AND NOT (tool_error AND NOT is_interrupt))
SELECT f.event_id AS failed_id, min_by(g.event_id, g.ts) AS fix_id FROM fails f LEFT JOIN good g
 ON g.window_id = f.window_id AND g.tool_name = f.tool_name AND (g.ts, g.event_id) > (f.ts, f.event_id) GROUP BY f.event_id""")
def stream_fixes(t: Tables):
    out, state = places(t, "fixes")
    jobs.run_to_end(jobs.fixes_stream(source(t, "session_event"), out, state))
    return t.spark.read.parquet(f"{out}_fixes").select("failed_id", "fix_id")


def _touched(t: Tables, kind: str):
    """Activity with its source: odd numbers come from one client, others from another, some say nothing."""
    out, state = places(t, "sessions")
    k = F.col("k")
    rows = source(t, "session_event").withColumn("source", F.when(k % 3 == 0, F.lit(None)).when(k % 2 == 1, "cli").otherwise("web"))
    jobs.run_to_end(jobs.sessions_stream(rows, out, state))
    return jobs.read_touched(t.spark, out, kind)


TOUCH_SQL = """ touch AS (SELECT *, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 2 = 1 THEN 'cli' ELSE 'web' END AS source FROM session_event)"""


@query("stream_sessions", rows="R4", uses="session_event", oracle=f"""WITH {TOUCH_SQL}
SELECT session_id, epoch_us(min(ts)) AS created_at, epoch_us(max(ts)) AS last_activity_at, min_by(user_id, (ts, event_id)) AS user_id, min_by(project_id, (ts, event_id)) AS project_id FROM touch GROUP BY 1""")
def stream_sessions(t: Tables):
    return _touched(t, "session").select(
        F.col("id").cast("long").alias("session_id"), micros("created_at"), micros("last_activity_at"), F.col("user_id").cast("long").alias("user_id"), F.col("project_id").cast("long").alias("project_id"))


def _touched_sql(kind: str) -> str:
    return f"""WITH {TOUCH_SQL}
SELECT {kind}_id, epoch_us(min(ts)) AS created_at, epoch_us(max(ts)) AS last_activity_at, min_by(source, (ts, event_id)) FILTER (WHERE source IS NOT NULL) AS source,
 max_by(source, (ts, event_id)) FILTER (WHERE source IS NOT NULL) AS last_source FROM touch GROUP BY 1"""


@query("stream_projects", rows="R4 T18", uses="session_event", oracle=_touched_sql("project"))
def stream_projects(t: Tables):
    return _touched(t, "project").select(F.col("id").cast("long").alias("project_id"), micros("created_at"), micros("last_activity_at"), "source", "last_source")


@query("stream_users", rows="R4 T18", uses="session_event", oracle=_touched_sql("user"))
def stream_users(t: Tables):
    return _touched(t, "user").select(F.col("id").cast("long").alias("user_id"), micros("created_at"), micros("last_activity_at"), "source", "last_source")


@query("stream_links", rows="R5", uses="session_event injection", oracle="""
SELECT i.injection_id, i.learning_id, max_by(e.event_id, e.ts) AS event_id FROM injection i JOIN session_event e
 ON e.session_id = i.session_id AND e.event_name = i.hook_event AND e.ts BETWEEN i.injected_at - INTERVAL 120 SECOND AND i.injected_at
 AND (i.prompt IS NULL OR i.prompt = e.prompt) GROUP BY 1, 2""")
def stream_links(t: Tables):
    out, state = places(t, "links")
    jobs.run_to_end(jobs.link_stream(source(t, "injection"), source(t, "session_event"), out, state))
    return jobs.read_links(t.spark, out)


@query("stream_inject_once", rows="R6", uses="session_event", oracle="""
SELECT session_id, substr(sha1(prompt), 1, 16) AS content_sha, count(DISTINCT prompt) AS n FROM session_event WHERE prompt IS NOT NULL GROUP BY 1, 2""")
def stream_inject_once(t: Tables):
    out, state = places(t, "once")
    rows = source(t, "session_event").filter("prompt IS NOT NULL").select(
        "session_id", F.lit("base").alias("prompt_name"), F.lit("context").alias("target"), F.col("prompt").alias("content"), "ts"
    )
    jobs.run_to_end(jobs.inject_once_stream(rows, out, state))
    return t.spark.read.parquet(out).groupBy("session_id", "content_sha").agg(F.count("*").alias("n")).select("session_id", "content_sha", n("n"))
