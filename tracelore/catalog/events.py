"""Events, windows, tool calls, corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelore.catalog.base import Tables, query
from tracelore.functions import text as tx
from tracelore.functions import tools as tl
from tracelore.operators import corpus, dialog, enrichment, events, pairing, windows
from tracelore.operators.segments import top_per_key
from tracelore.session import cut


def micros(name: str):
    return F.unix_micros(name).alias(name)


# The windows every bounded job works on, in the check's words.
WINDOWS_SQL = """
 numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS g,
        sum(CASE WHEN event_name = 'Stop' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS i
      FROM session_event),
 stops AS (SELECT session_id, i, LEAST(min(g - 200 * i) OVER (PARTITION BY session_id ORDER BY i), 0) + 200 * i AS hi
      FROM numbered WHERE event_name = 'Stop'),
 spans AS (SELECT session_id, i AS window_no, hi, coalesce(lag(hi) OVER (PARTITION BY session_id ORDER BY i), 0) AS lo FROM stops),
 win AS (SELECT n.*, s.window_no, CAST(n.session_id AS VARCHAR) || ':' || CAST(s.window_no AS VARCHAR) AS window_id
      FROM numbered n JOIN spans s ON s.session_id = n.session_id AND n.g > s.lo AND n.g <= s.hi)
"""
PAIRS_SQL = WINDOWS_SQL + """,
 calls AS (SELECT *, CASE WHEN event_name = 'PostToolUse' THEN 1 ELSE 0 END AS post FROM win WHERE event_name IN ('PreToolUse', 'PostToolUse')),
 counted AS (SELECT *, coalesce(sum(post) OVER w, 0) AS f, coalesce(sum(1 - post) OVER w, 0) AS j
      FROM calls WINDOW w AS (PARTITION BY window_id, tool_name, tool_input ORDER BY ts, post, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 placed AS (SELECT *, CASE WHEN post = 1 THEN f ELSE j + max(CASE WHEN post = 0 THEN f - j END) OVER (
      PARTITION BY window_id, tool_name, tool_input ORDER BY ts, post, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS n FROM counted),
 pairs AS (SELECT a.window_id, a.event_id AS pre_event_id, a.ts AS pre_ts, b.event_id AS post_event_id, b.ts AS post_ts,
        a.session_id, a.tool_name, a.tool_input, coalesce(a.turn_id, b.turn_id) AS turn_id, b.tool_response, b.tool_error
      FROM (SELECT * FROM placed WHERE post = 0) a LEFT JOIN (SELECT * FROM placed WHERE post = 1) b
        ON a.window_id = b.window_id AND a.tool_name = b.tool_name AND a.tool_input = b.tool_input AND a.n = b.n)
"""
BLANK = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def sql_trunc(expr: str, limit: int) -> str:
    flat = f"trim(regexp_replace({expr}, '{BLANK}', ' ', 'g'))"
    return f"(CASE WHEN length({flat}) > {limit} THEN rtrim(substr({flat}, 1, {limit - 3})) || '...' ELSE {flat} END)"


def windowed(t: Tables):
    """Window membership is a narrow table, written once and read by every window job; each job takes the event columns it needs."""
    members = t.shared("windows", lambda: windows.membership(t.session_event))
    return windows.in_windows(t.session_event, members)


# --- ingest ----------------------------------------------------------------------

CANON = """
 canon AS (SELECT *, '{"agent_id":' || CASE WHEN k % 9 = 0 THEN '"sub' || k || '"' ELSE 'null' END
   || ',"error":' || CASE WHEN tool_error THEN '"failure ' || k || '"' ELSE 'null' END
   || ',"hook_event_name":"' || CASE WHEN tool_error THEN 'PostToolUseFailure' ELSE event_name END
   || '","is_interrupt":' || CASE WHEN is_interrupt THEN 'true' ELSE 'false' END
   || ',"last_assistant_message":' || coalesce('"' || last_assistant_message || '"', 'null')
   || ',"prompt":' || coalesce('"' || prompt || '"', 'null')
   || ',"session_id":"s' || session_id || '"'
   || ',"tool_input":' || coalesce(replace(replace(tool_input, '": "', '":"'), '", "', '","'), 'null')
   || ',"tool_name":' || coalesce('"' || tool_name || '"', 'null')
   || ',"turn":' || k || '}' AS body FROM raw_payload)
"""


@query("ingest_events", rows="S1 S2 S3 P4 P5 P6", uses="raw_payload", oracle=f"""WITH {CANON}
SELECT 'cli:s' || session_id || ':' || event_name || ':' || substr(sha1(body), 1, 16) AS event_id,
       event_name, 's' || session_id AS session_id, tool_name,
       CASE WHEN k % 9 = 0 THEN 'sub' || k ELSE 's' || session_id END AS owner_session_id,
       CASE WHEN k % 9 = 0 THEN 'subagent' ELSE 'main' END AS agent_kind,
       CASE WHEN k % 9 = 0 THEN 'sub' || k ELSE 's' || session_id END AS agent_id,
       CASE WHEN k % 9 = 0 THEN 's' || session_id END AS parent_session_id,
       CASE WHEN tool_error THEN 'PostToolUseFailure' END AS source_event,
       CASE WHEN tool_error THEN true END AS tool_error,
       is_interrupt,
       CASE WHEN tool_error THEN '{{"content":[{{"type":"text","text":"failure ' || k || '"}}],"isError":true}}' END AS tool_response,
       CASE WHEN prompt IS NULL THEN NULL WHEN k % 7 = 0 THEN 'task-notification' WHEN k % 7 = 1 THEN 'agent-message' ELSE 'user' END AS prompt_origin,
       epoch_us(received_at) AS ts
FROM canon""")
def ingest_events(t: Tables):
    return events.ingest(t.raw_payload.select("payload", "received_at"), "cli").select(
        "event_id", "event_name", "session_id", "tool_name", "owner_session_id", "agent_kind", "agent_id",
        "parent_session_id", "source_event", "tool_error", "is_interrupt", "tool_response", "prompt_origin", micros("ts"),
    )


@query("append_events", rows="S4 S2", uses="raw_payload", oracle=f"""WITH {CANON},
 keyed AS (SELECT 'cli:s' || session_id || ':' || event_name || ':' || substr(sha1(body), 1, 16) AS event_id, received_at FROM canon),
 log AS (SELECT DISTINCT event_id FROM keyed WHERE received_at < TIMESTAMP '2024-01-08 00:00:00')
SELECT event_id, min(epoch_us(received_at)) AS ts FROM keyed
WHERE event_id NOT IN (SELECT event_id FROM log) GROUP BY event_id""")
def append_events(t: Tables):
    rows = events.ingest(t.raw_payload.select("payload", "received_at"), "cli").select("event_id", "ts")
    log = rows.filter(F.col("ts") < F.lit("2024-01-08").cast("timestamp")).select("event_id").distinct()
    return events.append_new(rows, log).select("event_id", micros("ts"))


@query("dialog_extraction", rows="S5", oracle="""
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role,
       regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text
FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''""")
def dialog_extraction(t: Tables):
    entries = dialog.dialog_entries(snapshots(t), ["conv_id"])
    # A conversation is one snapshot, so its records are few.
    n = F.expr("row_number() OVER (PARTITION BY conv_id ORDER BY pos)")
    return entries.select("conv_id", n.cast("long").alias("n"), "role", "text")


def snapshots(t: Tables, upto: int | None = None):
    """One JSON-lines snapshot per conversation, the dialect by parity of its id."""
    rows = t.conversations if upto is None else t.conversations.filter(F.col("turn") <= upto)
    block = F.struct(F.lit("text").alias("type"), F.col("text"))
    one = F.to_json(F.struct(F.col("turn").cast("string").alias("timestamp"), F.struct("role", F.array(block).alias("content")).alias("message")))
    two = F.to_json(
        F.struct(
            F.col("turn").cast("string").alias("timestamp"), F.lit("response_item").alias("type"),
            F.struct(F.lit("message").alias("type"), "role", F.array(block).alias("content")).alias("payload"),
        )
    )
    line = F.when(F.col("conv_id") % 2 == 0, one).otherwise(two)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("conv_id").agg(lines.alias("lines")).select(
        "conv_id", F.concat(F.array_join("lines", "\n"), F.lit("\nnot a record\n")).alias("snapshot")
    )


@query("window_assistant_texts", rows="W8", oracle="""
WITH said AS (SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE trim(text) <> ''),
 known AS (SELECT conv_id, max_by(text, turn) AS text FROM said WHERE role = 'assistant' GROUP BY conv_id)
SELECT s.conv_id, s.text FROM said s WHERE role = 'assistant' AND turn > 1
 AND NOT EXISTS (SELECT 1 FROM known k WHERE k.conv_id = s.conv_id AND k.text = s.text)""")
def window_assistant_texts(t: Tables):
    shape = lambda df, n: df.select(
        "conv_id", F.lit("main").alias("transcript_path"), F.timestamp_seconds(F.lit(n)).alias("ts"), F.lit(n).alias("event_id"),
        F.regexp_replace("snapshot", "\nnot a record\n$", "").alias("snapshot"),
    )
    snaps = shape(snapshots(t, 1), 1).unionByName(shape(snapshots(t), 2))
    said = t.conversations.filter("role = 'assistant'").withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).filter("text <> ''")
    known = said.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    return dialog.window_assistant_texts(snaps, known, "conv_id").select("conv_id", "text")


@query("event_chain", rows="W1", uses="session_event", oracle="""
SELECT event_id, session_id, lag(event_id) OVER w AS prev_event_id, lead(event_id) OVER w AS next_event_id,
 row_number() OVER w = 1 AS is_first, lead(event_id) OVER w IS NULL AS is_latest
FROM session_event WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)""")
def event_chain(t: Tables):
    return events.event_chain(t.session_event.select("event_id", "session_id", "ts")).select(
        "event_id", "session_id", "prev_event_id", "next_event_id", "is_first", "is_latest"
    )


@query("subagent_sessions", rows="G13", uses="raw_payload", oracle=f"""WITH {CANON}
SELECT 's' || session_id AS parent_session_id, 'sub' || k AS session_id, min(epoch_us(received_at)) AS created_at,
 max(epoch_us(received_at)) AS updated_at, count(*) AS n_events
FROM canon WHERE k % 9 = 0 GROUP BY 1, 2""")
def subagent_sessions(t: Tables):
    rows = cut(events.ingest(t.raw_payload.select("payload", "received_at"), "cli"))
    return events.subagent_sessions(rows).select("parent_session_id", "session_id", micros("created_at"), micros("updated_at"), "n_events")


@query("session_upsert", rows="T18", uses="session_event", oracle="""
SELECT 'project' AS kind, CAST(project_id AS VARCHAR) AS key, epoch_us(min(ts)) AS created_at, epoch_us(max(ts)) AS last_activity_at, min_by(event_name, event_id) AS owner FROM session_event GROUP BY project_id
UNION ALL SELECT 'session', CAST(session_id AS VARCHAR), epoch_us(min(ts)), epoch_us(max(ts)), CAST(min_by(user_id, event_id) AS VARCHAR) FROM session_event GROUP BY session_id
UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), epoch_us(min(ts)), epoch_us(max(ts)), min_by(event_name, event_id) FROM session_event GROUP BY user_id""")
def session_upsert(t: Tables):
    touches = t.session_event.select("project_id", "session_id", "user_id", F.col("event_name").alias("source"), "ts", "event_id")
    out = events.merge_sessions(None, touches)

    def shape(kind: str, key: str, owner: str):
        return out[kind].select(
            F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), micros("created_at"), micros("last_activity_at"),
            F.col(owner).cast("string").alias("owner"),
        )

    return shape("project", "project_id", "source").unionByName(shape("session", "session_id", "user_id")).unionByName(shape("user", "user_id", "source"))


@query("session_upsert_again", rows="T18", uses="session_event", oracle="""
WITH early AS (SELECT * FROM session_event WHERE event_id % 2 = 0), late AS (SELECT * FROM session_event WHERE event_id % 2 = 1),
 k AS (SELECT 'project' AS kind, CAST(project_id AS VARCHAR) AS key, ts, event_id, event_name AS source, event_id % 2 AS part FROM session_event
   UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), ts, event_id, event_name, event_id % 2 FROM session_event)
SELECT kind, key, epoch_us(min(ts)) AS created_at, epoch_us(max(ts)) AS last_activity_at, min_by(source, (part, ts, event_id)) AS source, max_by(source, (part, ts, event_id)) AS last_source FROM k GROUP BY 1, 2
UNION ALL SELECT 'session', CAST(session_id AS VARCHAR), epoch_us(min(ts)), epoch_us(max(ts)), CAST(min_by(user_id, (event_id % 2, ts, event_id)) AS VARCHAR), NULL FROM session_event GROUP BY session_id""")
def session_upsert_again(t: Tables):
    """A second batch over the snapshots of a first: even event ids came before odd ones."""
    touches = t.session_event.select("project_id", "session_id", "user_id", F.col("event_name").alias("source"), "ts", "event_id")
    before = events.merge_sessions(None, touches.filter("event_id % 2 = 0"))
    out = events.merge_sessions(before, touches.filter("event_id % 2 = 1"))
    parts = [
        out[kind].select(F.lit(kind).alias("kind"), F.col(f"{kind}_id").cast("string").alias("key"), micros("created_at"), micros("last_activity_at"), F.col(first).cast("string").alias("source"),
                         (F.col("last_source") if kind != "session" else F.lit(None).cast("string")).alias("last_source"))
        for kind, first in (("project", "source"), ("user", "source"), ("session", "user_id"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("prompt_injection_log", rows="T19", uses="session_event", oracle="""
SELECT session_id, substr(sha1(prompt), 1, 16) AS content_sha, count(*) AS injection_count, epoch_us(min(ts)) AS first_at,
 epoch_us(max(ts)) AS last_at, min_by(event_id, ts) AS injected_by, max(length(prompt)) AS char_count
FROM session_event WHERE prompt IS NOT NULL GROUP BY session_id, prompt""")
def prompt_injection_log(t: Tables):
    rows = t.session_event.filter("prompt IS NOT NULL").select(
        "session_id", F.lit("base").alias("prompt_name"), F.lit("context").alias("target"), F.col("prompt").alias("content"),
        "ts", F.col("event_id").alias("injection_id"),
    )
    return events.injection_prompt_log(rows).select(
        "session_id", "content_sha", "injection_count", micros("first_at"), micros("last_at"), "injected_by", F.col("char_count").cast("long").alias("char_count")
    )


# --- windows ---------------------------------------------------------------------

@query("stop_windows", rows="R3 S6 P3", uses="session_event", oracle=f"""WITH {WINDOWS_SQL}
SELECT n.event_id, CAST(w.window_no AS BIGINT) AS window_no FROM numbered n LEFT JOIN win w ON w.event_id = n.event_id""")
def stop_windows(t: Tables):
    return windows.stop_windows(t.session_event).select("event_id", "window_no")


TREE_SQL = """
 tree AS (SELECT session_id AS ancestor, session_id AS node, 0 AS depth FROM session
   UNION ALL SELECT s.parent_session_id, t.node, t.depth + 1 FROM tree t JOIN session s ON s.session_id = t.ancestor WHERE s.parent_session_id IS NOT NULL)
"""


def _tops(t: Tables):
    return windows.roots(t.session.select(F.col("parent_session_id").alias("parent"), F.col("session_id").alias("child")))


ROOTED_SQL = """
 top AS (SELECT node, max_by(ancestor, depth) AS root FROM tree GROUP BY node),
 rooted AS (SELECT e.event_id, e.ts, e.event_name, e.session_id, coalesce(t.root, e.session_id) AS root FROM session_event e LEFT JOIN top t ON t.node = e.session_id),
 tnum AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY ts, event_id) AS g,
   sum(CASE WHEN event_name = 'Stop' AND session_id = root THEN 1 ELSE 0 END) OVER (PARTITION BY root ORDER BY ts, event_id) AS i FROM rooted),
 tstop AS (SELECT root, i, LEAST(min(g - 200 * i) OVER (PARTITION BY root ORDER BY i), 0) + 200 * i AS hi FROM tnum WHERE event_name = 'Stop' AND session_id = root),
 tspan AS (SELECT root, i AS window_no, hi, coalesce(lag(hi) OVER (PARTITION BY root ORDER BY i), 0) AS lo FROM tstop),
 twin AS (SELECT n.root, n.session_id, n.event_id, CAST(s.window_no AS BIGINT) AS window_no FROM tnum n JOIN tspan s ON s.root = n.root AND n.g > s.lo AND n.g <= s.hi)
"""


@query("tree_stop_windows", rows="S6 R3", uses="session session_event", recursive=True, oracle=f"WITH {TREE_SQL}, {ROOTED_SQL} SELECT root AS root_session_id, session_id, window_no, event_id FROM twin")
def tree_stop_windows(t: Tables):
    return windows.tree_windows(t.session_event, _tops(t)).filter("window_no IS NOT NULL").select("root_session_id", "session_id", "window_no", "event_id")


@query("window_ledger", rows="S8 S9 P3", uses="session_event", oracle=f"""WITH {WINDOWS_SQL},
 d AS (SELECT window_id, session_id, project_id, count(*) AS event_count, epoch_us(min(ts)) AS started_at, epoch_us(max(ts)) AS ended_at,
   substr(sha1(string_agg(CAST(event_id AS VARCHAR), chr(10) ORDER BY ts, event_id)), 1, 16) AS digest FROM win GROUP BY window_id, session_id, project_id)
SELECT window_id, event_count, started_at, ended_at,
 'processing:' || project_id || ':' || session_id || ':turn:' || digest AS processing_id,
 'Processed ' || event_count || ' turn events and produced 0 learning actions and 0 observations.' AS summary FROM d""")
def window_ledger(t: Tables):
    digests = windows.work_windows(windows.window_digest(windowed(t), ["window_id", "session_id", "project_id"]))
    ledger, _ = windows.processing_ledger(digests, "turn", None, ["window_id"], {"llm_status": F.lit("called")})
    return ledger.select("window_id", "event_count", micros("started_at"), micros("ended_at"), "processing_id", "summary")


@query("window_ledger_events", rows="S8", uses="session_event", oracle=f"""WITH {WINDOWS_SQL},
 d AS (SELECT window_id, 'processing:' || project_id || ':' || session_id || ':turn:' ||
   substr(sha1(string_agg(CAST(event_id AS VARCHAR), chr(10) ORDER BY ts, event_id)), 1, 16) AS processing_id FROM win GROUP BY window_id, session_id, project_id)
SELECT d.processing_id, CAST(w.event_id AS VARCHAR) AS event_id FROM win w JOIN d USING (window_id)""")
def window_ledger_events(t: Tables):
    digests = windows.work_windows(windows.window_digest(windowed(t), ["window_id", "session_id", "project_id"]))
    return windows.processing_ledger(digests, "turn", None, ["window_id"], {"llm_status": F.lit("called")})[1]


def _tree(t: Tables):
    return windows.closure(t.session.select(F.col("parent_session_id").alias("parent"), F.col("session_id").alias("child")))


@query("session_closure", rows="J3", uses="session", recursive=True, oracle=f"WITH {TREE_SQL} SELECT ancestor, node, depth FROM tree")
def session_closure(t: Tables):
    return _tree(t).select("ancestor", "node", "depth")


@query("session_roots", rows="J3", uses="session", recursive=True, oracle=f"""WITH {TREE_SQL}
SELECT node, max_by(ancestor, depth) AS root FROM tree GROUP BY node""")
def session_roots(t: Tables):
    return windows.roots(t.session.select(F.col("parent_session_id").alias("parent"), F.col("session_id").alias("child")))


def _scan_sql(limit: int) -> str:
    return f"""WITH {TREE_SQL},
 todo AS (SELECT * FROM session_event e WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.project_id = e.project_id AND l.event_id = e.event_id))
SELECT t.ancestor AS origin_session_id, e.event_id, row_number() OVER (PARTITION BY t.ancestor ORDER BY e.ts, e.event_id) AS position
FROM todo e JOIN tree t ON t.node = e.session_id
QUALIFY position <= {limit}"""


@query("unprocessed_events", rows="S6", uses="session session_event ledger", recursive=True, oracle=_scan_sql(200))
def unprocessed_events(t: Tables):
    return windows.unprocessed(t.session_event, _tree(t), t.ledger, 200).select("origin_session_id", "event_id", F.col("position").cast("long").alias("position"))


@query("unenriched_events", rows="S7", uses="session session_event ledger", recursive=True, oracle=_scan_sql(400))
def unenriched_events(t: Tables):
    return windows.unprocessed(t.session_event, _tree(t), t.ledger, 400).select("origin_session_id", "event_id", F.col("position").cast("long").alias("position"))


@query("echo_links", rows="J4 J5", uses="session learning injected_in produced", recursive=True, oracle=f"""WITH {TREE_SQL}
SELECT p.learning_id, p.session_id, p.kind, EXISTS (
  SELECT 1 FROM tree t JOIN injected_in i ON i.session_id = t.node
  WHERE t.ancestor = p.session_id AND i.learning_id = p.learning_id AND i.first_injected_at <= p.at) AS echo FROM produced p""")
def echo_links(t: Tables):
    links = t.produced.select("learning_id", "session_id", "kind", "at")
    echoes = windows.echo_pairs(links, _tree(t), t.injected_in).withColumn("echo", F.lit(True))
    return links.join(echoes, ["learning_id", "session_id", "at"], "left").select(
        "learning_id", "session_id", "kind", F.coalesce("echo", F.lit(False)).alias("echo")
    )


@query("shortlist_flags", rows="J5", uses="session learning injected_in neighbour", recursive=True, oracle=f"""WITH {TREE_SQL}
SELECT n.candidate_id, n.existing_id, EXISTS (SELECT 1 FROM tree t JOIN injected_in i ON i.session_id = t.node
  WHERE t.ancestor = c.session_id AND i.learning_id = n.existing_id AND i.first_injected_at <= c.created_at) AS injected_this_session
FROM neighbour n JOIN learning c ON c.id = n.candidate_id""")
def shortlist_flags(t: Tables):
    rows = t.neighbour.join(t.learning.select(F.col("id").alias("candidate_id"), "session_id", F.col("created_at").alias("at")), "candidate_id").select(
        "candidate_id", "existing_id", F.col("existing_id").alias("learning_id"), "session_id", "at"
    )
    return windows.flag_injected(rows, _tree(t), t.injected_in).select("candidate_id", "existing_id", "injected_this_session")


@query("injection_links", rows="J8", uses="session_event injection", oracle="""
SELECT i.injection_id, i.learning_id, max_by(e.event_id, e.ts) AS event_id FROM injection i JOIN session_event e
 ON e.session_id = i.session_id AND e.event_name = i.hook_event AND e.ts BETWEEN i.injected_at - INTERVAL 120 SECOND AND i.injected_at
 AND (i.prompt IS NULL OR i.prompt = e.prompt) GROUP BY 1, 2""")
def injection_links(t: Tables):
    return windows.link_injections(t.injection, t.session_event).select("injection_id", "learning_id", "event_id")


@query("injection_backfill", rows="J9", uses="session_event injection", oracle="""
WITH links AS (SELECT i.learning_id, max(e.ts) AS event_ts FROM injection i JOIN session_event e
 ON e.session_id = i.session_id AND e.event_name = i.hook_event AND e.ts BETWEEN i.injected_at - INTERVAL 120 SECOND AND i.injected_at
 AND (i.prompt IS NULL OR i.prompt = e.prompt) GROUP BY i.injection_id, i.learning_id),
 late AS (SELECT DISTINCT i.learning_id, e.session_id, e.event_id, e.ts FROM injection i JOIN session_event e
 ON e.session_id = i.session_id AND e.event_name = i.hook_event AND i.injected_at BETWEEN e.ts - INTERVAL 120 SECOND AND e.ts)
SELECT learning_id, session_id, event_id FROM late a WHERE NOT EXISTS (SELECT 1 FROM links l
 WHERE l.learning_id = a.learning_id AND l.event_ts BETWEEN a.ts - INTERVAL 120 SECOND AND a.ts)""")
def injection_backfill(t: Tables):
    links = windows.link_injections(t.injection, t.session_event)
    return windows.backfill_links(t.injection, t.session_event, links).select("learning_id", "session_id", "event_id")


# --- tool calls ------------------------------------------------------------------

@query("pair_tool_calls", rows="J1", uses="session_event", oracle=f"WITH {PAIRS_SQL} SELECT window_id, pre_event_id, post_event_id FROM pairs")
def pair_tool_calls(t: Tables):
    return pairing.pair_tool_calls(windowed(t), "window_id").select("window_id", "pre_event_id", "post_event_id")


@query("pair_tool_calls_by_id", rows="J1", uses="session_event", oracle=f"""WITH {WINDOWS_SQL},
 n AS (SELECT *, row_number() OVER (PARTITION BY window_id, k, event_name ORDER BY ts, event_id) AS r FROM win WHERE event_name IN ('PreToolUse', 'PostToolUse'))
SELECT a.window_id, a.event_id AS pre_event_id, b.event_id AS post_event_id FROM n a LEFT JOIN n b
 ON b.event_name = 'PostToolUse' AND a.window_id = b.window_id AND a.k = b.k AND a.r = b.r WHERE a.event_name = 'PreToolUse'""")
def pair_tool_calls_by_id(t: Tables):
    rows = windowed(t).withColumn("tool_use_id", F.concat(F.lit("u"), F.col("k").cast("string")))
    return pairing.pair_tool_calls(rows, "window_id").select("window_id", "pre_event_id", "post_event_id")


ERR = "CASE WHEN k % 6 = 0 THEN 'connection refused by host ' || k WHEN k % 6 = 1 THEN 'Request timed out' ELSE 'syntax error near token ' || k % 13 END"


@query("pair_tool_calls_mixed", rows="J1", uses="session_event", oracle=f"""WITH {PAIRS_SQL},
 n AS (SELECT *, row_number() OVER (PARTITION BY window_id, k, event_name ORDER BY ts, event_id) AS r FROM win WHERE event_name IN ('PreToolUse', 'PostToolUse') AND k % 5 < 2)
SELECT a.window_id, a.event_id AS pre_event_id, b.event_id AS post_event_id FROM n a LEFT JOIN n b
 ON b.event_name = 'PostToolUse' AND a.window_id = b.window_id AND a.k = b.k AND a.r = b.r WHERE a.event_name = 'PreToolUse'
UNION ALL SELECT p.window_id, pre_event_id, post_event_id FROM pairs p JOIN win w ON w.event_id = p.pre_event_id WHERE w.k % 5 >= 2""")
def pair_tool_calls_mixed(t: Tables):
    # Calls of two of the five tools carry ids, so most windows mix both sorts.
    use = F.when(F.col("k") % 5 < 2, F.concat(F.lit("u"), F.col("k").cast("string")))
    return pairing.pair_tool_calls(windowed(t).withColumn("tool_use_id", use), "window_id").select("window_id", "pre_event_id", "post_event_id")


@query("durable_failures", rows="P7 P8 X4 X5", uses="session_event", oracle=f"""
SELECT event_id, CASE WHEN tool_name LIKE 'mcp__memory__%' THEN substr(tool_name, 14) ELSE tool_name END AS tool_key, {ERR} AS error_text
FROM session_event WHERE tool_error AND NOT is_interrupt AND k % 6 > 1""")
def durable_failures(t: Tables):
    return pairing.failures(t.session_event).select("event_id", "tool_key", "error_text")


@query("failed_calls", rows="P8 P9", uses="session_event", oracle="""
SELECT event_id, tool_error AND NOT is_interrupt AS failed,
 CASE WHEN tool_error THEN false ELSE true END AS succeeded
FROM session_event WHERE event_name = 'PostToolUse'""")
def failed_calls(t: Tables):
    failed = tl.is_failed_call(F.col("is_interrupt"), F.col("tool_error"), F.col("tool_response"))
    return t.session_event.filter("event_name = 'PostToolUse'").select(
        "event_id", failed.alias("failed"), tl.result_success(F.col("tool_response"), F.col("tool_error")).alias("succeeded")
    )


@query("fix_for_failure", rows="J2 D2 R7", uses="session_event", oracle=f"""WITH {WINDOWS_SQL},
 fails AS (SELECT * FROM win WHERE tool_error AND NOT is_interrupt AND k % 6 > 1),
 good AS (SELECT * FROM win WHERE event_name = 'PostToolUse' AND NOT (tool_error AND NOT is_interrupt))
SELECT f.event_id AS failed_id, min_by(g.event_id, g.ts) AS fix_id FROM fails f LEFT JOIN good g
 ON g.window_id = f.window_id AND g.tool_name = f.tool_name AND (g.ts, g.event_id) > (f.ts, f.event_id) GROUP BY f.event_id""")
def fix_for_failure(t: Tables):
    # All inputs of one tool differ in a digit here, so every later success resembles.
    return pairing.fix_for_failure(windowed(t), "window_id").select("failed_id", "fix_id")


def _enriched(t: Tables):
    return enrichment.enrich(windowed(t), "window_id")


#: Who acts, for the check of actor fields: one event in nine is a subagent's; a prompt names its agent, transcript and parent.
ACTOR_SQL = """
 who AS (SELECT event_id, CASE WHEN k % 9 = 0 THEN 'sub' || k WHEN event_name = 'UserPromptSubmit' THEN 'agent' || k % 5 END AS agent_id,
   CASE WHEN event_name = 'UserPromptSubmit' AND k % 2 = 0 THEN 'rollout' || k END AS agent_transcript_id, CASE WHEN k % 9 = 0 THEN 's' || session_id END AS parent_session_id,
   CASE WHEN k % 9 = 0 THEN 'subagent' ELSE 'main' END AS agent_kind, k % 9 = 0 AS is_subagent FROM session_event)
"""


def _with_actors(t: Tables):
    sub, asks, k = F.col("k") % 9 == 0, F.col("event_name") == "UserPromptSubmit", F.col("k").cast("string")
    return windowed(t).withColumns({
        "agent_id": F.when(sub, F.concat(F.lit("sub"), k)).when(asks, F.concat(F.lit("agent"), (F.col("k") % 5).cast("string"))),
        "agent_transcript_id": F.when(asks & (F.col("k") % 2 == 0), F.concat(F.lit("rollout"), k)),
        "parent_session_id": F.when(sub, F.concat(F.lit("s"), F.col("session_id").cast("string"))),
        "agent_kind": F.when(sub, "subagent").otherwise("main"), "is_subagent": sub,
    })


CALLS_SQL = PAIRS_SQL + f""",
 turnp AS (SELECT window_id, coalesce(turn_id, '') AS tk, max_by(prompt, (ts, event_id)) AS prompt, max_by(event_id, (ts, event_id)) AS pid, max(ts) AS pts FROM win WHERE event_name = 'UserPromptSubmit' GROUP BY 1, 2),
 lastp AS (SELECT window_id, max_by(prompt, (ts, event_id)) AS prompt, max_by(event_id, (ts, event_id)) AS pid, max(ts) AS pts FROM win WHERE event_name = 'UserPromptSubmit' GROUP BY 1),
 call AS (SELECT p.*, coalesce(a.prompt, l.prompt) AS prompt, coalesce(a.pid, l.pid) AS prompt_event_id, coalesce(a.pts, l.pts) AS prompt_ts,
   'turn:' || session_id || ':' || coalesce(p.turn_id, 'unknown') AS turn_node_id,
   'tool-call:' || session_id || ':' || substr(sha1(pre_event_id || chr(10) || tool_name || chr(10) || tool_input), 1, 16) AS call_id,
   row_number() OVER (PARTITION BY p.window_id ORDER BY pre_ts, pre_event_id) AS ord,
   CASE tool_name WHEN 'Bash' THEN 'shell' WHEN 'Edit' THEN 'filesystem_write' WHEN 'Write' THEN 'filesystem_write' ELSE 'mcp' END AS tool_kind,
   CASE WHEN tool_name LIKE 'mcp%' THEN 'mcp' END AS tool_namespace,
   CASE WHEN tool_name = 'Bash' THEN 'cat' WHEN tool_name LIKE '%get_context' THEN 'cypher_query' ELSE '' END AS operation,
   CASE tool_name WHEN 'Bash' THEN 'read repository file context' WHEN 'mcp__memory__project_get_context' THEN 'recall scoped project memory'
     WHEN 'mcp__memory__project_add_learning' THEN 'persist durable project context' ELSE 'edit repository files' END AS intent,
   CASE tool_name WHEN 'Bash' THEN 0.82 WHEN 'mcp__memory__project_get_context' THEN 0.9 WHEN 'mcp__memory__project_add_learning' THEN 0.92 ELSE 0.82 END AS confidence
   FROM pairs p LEFT JOIN turnp a ON a.window_id = p.window_id AND a.tk = coalesce(p.turn_id, '') LEFT JOIN lastp l ON l.window_id = p.window_id)
"""


@query("enriched_calls", rows="G12 W3 J6 P10 X6", uses="session_event", oracle=f"""WITH {CALLS_SQL}
SELECT call_id, window_id, turn_node_id, CAST(ord AS BIGINT) AS ord, tool_kind, tool_namespace, operation, intent, CAST(confidence AS DOUBLE) AS confidence, prompt_event_id,
 coalesce(json_extract_string(tool_input, '$.command'), json_extract_string(tool_input, '$.query'), tool_input) AS input_summary,
 intent || ' in response to the active request: ' || coalesce({sql_trunc('prompt', 180)}, 'current session task') AS observable_rationale
FROM call""")
def enriched_calls(t: Tables):
    return _enriched(t)["tool_call"].select(
        "call_id", "window_id", "turn_node_id", F.col("order").cast("long").alias("ord"), "tool_kind", "tool_namespace", "operation",
        "intent", "confidence", "prompt_event_id", "input_summary", "observable_rationale",
    )


@query("enriched_turns", rows="G12 J6", uses="session_event", oracle=f"""WITH {CALLS_SQL}
SELECT window_id, turn_node_id, min_by({sql_trunc('prompt', 1200)}, ord) FILTER (WHERE prompt IS NOT NULL) AS prompt, min_by(prompt_event_id, ord) FILTER (WHERE prompt_event_id IS NOT NULL) AS prompt_event_id,
 epoch_us(min_by(coalesce(prompt_ts, pre_ts), ord)) AS first_seen_at, count(*) AS call_count FROM call GROUP BY 1, 2""")
def enriched_turns(t: Tables):
    return _enriched(t)["turn"].select("window_id", "turn_node_id", "prompt", "prompt_event_id", micros("first_seen_at"), "call_count")


@query("enriched_actors", rows="G12", uses="session_event", oracle=f"""WITH {CALLS_SQL}, {ACTOR_SQL}
SELECT c.call_id, coalesce(w.agent_id, p.agent_id) AS agent_id, coalesce(w.agent_transcript_id, p.agent_transcript_id) AS agent_transcript_id,
 coalesce(w.parent_session_id, p.parent_session_id) AS parent_session_id, w.agent_kind, w.is_subagent FROM call c JOIN who w ON w.event_id = c.pre_event_id LEFT JOIN who p ON p.event_id = c.prompt_event_id""")
def enriched_actors(t: Tables):
    return enrichment.enrich(_with_actors(t), "window_id")["tool_call"].select("call_id", *enrichment.ACTOR)


@query("enriched_turn_actors", rows="G12", uses="session_event", oracle=f"""WITH {CALLS_SQL}, {ACTOR_SQL},
 acts AS (SELECT c.window_id, c.turn_node_id, c.ord, coalesce(w.agent_id, p.agent_id) AS agent_id, coalesce(w.parent_session_id, p.parent_session_id) AS parent_session_id, w.agent_kind
   FROM call c JOIN who w ON w.event_id = c.pre_event_id LEFT JOIN who p ON p.event_id = c.prompt_event_id)
SELECT window_id, turn_node_id, agent_id, parent_session_id, agent_kind FROM acts QUALIFY row_number() OVER (PARTITION BY window_id, turn_node_id ORDER BY ord) = 1""")
def enriched_turn_actors(t: Tables):
    return enrichment.enrich(_with_actors(t), "window_id")["turn"].select("window_id", "turn_node_id", "agent_id", "parent_session_id", "agent_kind")


@query("enriched_results", rows="G12 P9 X6", uses="session_event", oracle=f"""WITH {CALLS_SQL}
SELECT 'tool-result:' || call_id AS result_id, post_event_id, {sql_trunc('tool_response', 500)} AS summary,
 CAST(length(tool_response) AS BIGINT) AS response_chars, NOT tool_error AS succeeded FROM call WHERE post_event_id IS NOT NULL""")
def enriched_results(t: Tables):
    return _enriched(t)["tool_result"].select("result_id", "post_event_id", "summary", F.col("response_chars").cast("long").alias("response_chars"), "succeeded")


@query("enriched_rationales", rows="G12", uses="session_event", oracle=f"""WITH {CALLS_SQL}
SELECT 'tool-rationale:' || call_id AS rationale_id, intent, CAST(confidence AS DOUBLE) AS confidence FROM call""")
def enriched_rationales(t: Tables):
    return _enriched(t)["rationale"].select("rationale_id", "intent", "confidence")


RESOURCES_SQL = CALLS_SQL + f""",
 res AS (SELECT window_id, turn_node_id, ord, call_id, 'resource:file:src/part' || regexp_extract(tool_input, 'part([0-9]+)', 1) || '.py' AS resource_id, 0.85 AS confidence FROM call WHERE tool_name = 'Bash'
  UNION ALL SELECT window_id, turn_node_id, ord, call_id, 'resource:file:notes.md', 0.85 FROM call WHERE tool_name = 'Bash'
  UNION ALL SELECT window_id, turn_node_id, ord, call_id, 'resource:cypher:' || substr(sha1(json_extract_string(tool_input, '$.query')), 1, 16), 0.9 FROM call WHERE tool_name LIKE '%get_context'
  UNION ALL SELECT window_id, turn_node_id, ord, call_id, 'resource:path:' || substr(sha1(json_extract_string(tool_input, '$.path')), 1, 16), 0.8 FROM call WHERE json_extract_string(tool_input, '$.path') IS NOT NULL
  UNION ALL SELECT window_id, turn_node_id, ord, call_id, 'resource:url:' || substr(sha1(json_extract_string(tool_input, '$.url')), 1, 16), 0.8 FROM call WHERE json_extract_string(tool_input, '$.url') IS NOT NULL)
"""


@query("enriched_resources", rows="G12 P11", uses="session_event", oracle=f"""WITH {RESOURCES_SQL}
SELECT call_id, resource_id, CAST(confidence AS DOUBLE) AS confidence FROM res
UNION ALL SELECT call_id, 'evidence:' || call_id, CAST(0.7 AS DOUBLE) FROM call WHERE post_event_id IS NOT NULL""")
def enriched_resources(t: Tables):
    return _enriched(t)["resource"].select("call_id", "resource_id", "confidence")


@query("call_order_edges", rows="W3", uses="session_event", oracle=f"""WITH {CALLS_SQL}
SELECT from_id, call_id AS to_id FROM (SELECT call_id, lag(call_id) OVER (PARTITION BY window_id, turn_node_id ORDER BY ord) AS from_id FROM call) x WHERE from_id IS NOT NULL""")
def call_order_edges(t: Tables):
    return _enriched(t)["follows"].select("from_id", "to_id")


@query("call_dependencies", rows="J7", uses="session_event", oracle=f"""WITH {RESOURCES_SQL}
SELECT a.call_id AS from_id, b.call_id AS to_id, string_agg(a.resource_id, ',' ORDER BY a.resource_id) AS resource_ids
FROM res a JOIN res b ON a.window_id = b.window_id AND a.turn_node_id = b.turn_node_id AND a.resource_id = b.resource_id AND b.ord < a.ord GROUP BY 1, 2""")
def call_dependencies(t: Tables):
    return _enriched(t)["depends_on"].select("from_id", "to_id", F.array_join("resource_ids", ",").alias("resource_ids"))


@query("enrichment_summary", rows="A14", uses="session_event", oracle=f"""WITH {RESOURCES_SQL},
 n AS (SELECT window_id, count(*) AS event_count FROM win GROUP BY 1),
 c AS (SELECT window_id, count(*) AS calls, count(DISTINCT turn_node_id) AS turns, count(post_event_id) AS evidence FROM call GROUP BY 1),
 r AS (SELECT window_id, count(*) AS named FROM res GROUP BY 1)
SELECT n.window_id, coalesce(calls, 0) AS calls, coalesce(turns, 0) AS turns, coalesce(named, 0) + coalesce(evidence, 0) AS resources,
 'Enriched ' || event_count || ' turn events into ' || coalesce(calls, 0) || ' tool calls, ' || coalesce(turns, 0) || ' turns, ' || coalesce(calls, 0) || ' rationales, and ' || (coalesce(named, 0) + coalesce(evidence, 0)) || ' resources.' AS summary
FROM n LEFT JOIN c USING (window_id) LEFT JOIN r USING (window_id)""")
def enrichment_summary(t: Tables):
    digests = windows.window_digest(windowed(t), ["window_id"])
    return enrichment.enrichment_summary(_enriched(t), digests, "window_id").select("window_id", "calls", "turns", "resources", "summary")


ENTRIES_SQL = PAIRS_SQL + f""",
 fails AS (SELECT * FROM win WHERE tool_error AND NOT is_interrupt AND k % 6 > 1),
 good AS (SELECT * FROM win WHERE event_name = 'PostToolUse' AND NOT (tool_error AND NOT is_interrupt)),
 fix AS (SELECT f.event_id, min_by(g.tool_input, (g.ts, g.event_id)) AS retry_input FROM fails f JOIN good g
   ON g.window_id = f.window_id AND g.tool_name = f.tool_name AND (g.ts, g.event_id) > (f.ts, f.event_id) GROUP BY f.event_id),
 entry AS (SELECT e.window_id, e.event_id, e.ts, CASE WHEN prompt IS NOT NULL OR last_assistant_message IS NOT NULL THEN 0
   WHEN tool_error AND NOT is_interrupt AND k % 6 > 1 THEN 1 ELSE 2 END AS priority,
   'Event: ' || event_name
   || coalesce(chr(10) || CASE WHEN k % 7 = 0 THEN 'background_task_notification' WHEN k % 7 = 1 THEN 'subagent_report' ELSE 'prompt' END || ': ' || trim(prompt), '')
   || coalesce(chr(10) || 'last_assistant_message: ' || last_assistant_message, '')
   || coalesce(chr(10) || 'tool_name: ' || tool_name || chr(10) || 'tool_input: ' || tool_input, '')
   || CASE WHEN event_name = 'PreToolUse' THEN chr(10) || 'tool_result: none recorded in this window' ELSE '' END
   || CASE WHEN tool_error AND NOT is_interrupt AND k % 6 <= 1 THEN chr(10) || 'tool_error: [transient failure elided]' ELSE '' END
   || CASE WHEN tool_error AND NOT is_interrupt AND k % 6 > 1 THEN chr(10) || 'tool_key: ' || CASE WHEN tool_name LIKE 'mcp__memory__%' THEN substr(tool_name, 14) ELSE tool_name END
        || chr(10) || 'tool_error: ' || {ERR} ELSE '' END
   || coalesce(chr(10) || 'later_call_to_same_tool_succeeded_with_input: ' || fix.retry_input, '') AS text
   FROM win e LEFT JOIN fix ON fix.event_id = e.event_id
   WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.pre_event_id = e.event_id AND p.post_event_id IS NOT NULL))
"""


@query("window_corpus", rows="W7", uses="session_event", oracle=f"""WITH {ENTRIES_SQL}
SELECT window_id, string_agg(text, chr(10) ORDER BY ts, CAST(event_id AS VARCHAR)) AS corpus, count(*) AS n_entries FROM entry GROUP BY 1""")
def window_corpus(t: Tables):
    entries = corpus.corpus_entries(windowed(t), "window_id")
    return corpus.fit_budget(entries, "window_id").select("window_id", "corpus", F.col("n_entries").cast("long").alias("n_entries"))


@query("window_corpus_tight", rows="W7", uses="session_event", recursive=True, oracle=f"""WITH {ENTRIES_SQL},
 total AS (SELECT window_id, count(*) AS n, sum(length(text)) + count(*) - 1 AS chars FROM entry GROUP BY 1),
 q AS (SELECT e.*, t.n, row_number() OVER (PARTITION BY e.window_id ORDER BY priority, ts DESC, CAST(event_id AS VARCHAR) DESC) AS r FROM entry e JOIN total t USING (window_id) WHERE t.chars > 400),
 walk AS (SELECT window_id, CAST(0 AS BIGINT) AS r, CAST(length('[' || n || ' events elided]') AS BIGINT) AS spent, -1 AS full_at, CAST(0 AS BIGINT) AS kept FROM total WHERE chars > 400
   UNION ALL SELECT w.window_id, q.r,
     CASE WHEN (w.full_at = -1 OR w.full_at = q.priority) AND w.spent + length(q.text) + 1 <= 400 THEN w.spent + length(q.text) + 1 ELSE w.spent END,
     CASE WHEN w.full_at = -1 AND w.spent + length(q.text) + 1 > 400 THEN q.priority ELSE w.full_at END,
     CASE WHEN (w.full_at = -1 OR w.full_at = q.priority) AND w.spent + length(q.text) + 1 <= 400 THEN w.kept + 1 ELSE w.kept END
   FROM walk w JOIN q ON q.window_id = w.window_id AND q.r = w.r + 1)
SELECT window_id, n AS n_entries, CASE WHEN chars <= 400 THEN n ELSE (SELECT max(kept) FROM walk w WHERE w.window_id = t.window_id) END AS n_kept FROM total t""")
def window_corpus_tight(t: Tables):
    entries = corpus.corpus_entries(windowed(t), "window_id")
    return corpus.fit_budget(entries, "window_id", 400).select(
        "window_id", F.col("n_entries").cast("long").alias("n_entries"), F.col("n_kept").cast("long").alias("n_kept")
    )


# --- scalars ---------------------------------------------------------------------

@query("truncated_text", rows="X1", oracle=f"SELECT doc_id, {sql_trunc('text', 160)} AS short FROM documents")
def truncated_text(t: Tables):
    return t.documents.select("doc_id", tx.truncate(F.col("text"), 160).alias("short"))


@query("keyword_terms", rows="X2", oracle="""
WITH tok AS (SELECT doc_id, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]{3,}') AS l FROM documents) x),
 firsts AS (SELECT doc_id, term, min(pos) AS pos FROM tok GROUP BY 1, 2)
SELECT doc_id, string_agg(term, ' ' ORDER BY pos) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM firsts) y WHERE r <= 16 GROUP BY doc_id""")
def keyword_terms(t: Tables):
    return t.documents.select("doc_id", F.array_join(tx.keyword_terms(F.col("text")), " ").alias("terms")).filter("terms <> ''")


@query("label_ids", rows="X3", uses="learning", oracle="""
SELECT id, trim(regexp_replace(lower(task_pattern), '[^a-z0-9]+', ' ', 'g')) AS normalized,
 'taskpattern:' || project_id || ':' || substr(sha1(project_id || chr(10) || trim(regexp_replace(lower(task_pattern), '[^a-z0-9]+', ' ', 'g'))), 1, 16) AS pattern_id,
 'task-' || label AS slug FROM learning""")
def label_ids(t: Tables):
    normalized = tx.normalize_label(F.col("task_pattern"))
    return t.learning.select(
        "id", normalized.alias("normalized"), tx.pattern_id(F.col("project_id"), normalized).alias("pattern_id"),
        tx.slugify(F.col("task_pattern")).alias("slug"),
    )


@query("age_labels", rows="X7", uses="session_event", oracle="""
WITH d AS (SELECT event_id, greatest(epoch(TIMESTAMP '2024-01-15 00:00:00') - floor(epoch(ts)), 0) AS s FROM session_event)
SELECT event_id, CASE WHEN s < 3600 THEN CAST(greatest(1, floor(s / 60)) AS BIGINT) || 'm ago' WHEN s < 172800 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ago'
 ELSE CAST(floor(s / 86400) AS BIGINT) || 'd ago' END AS age FROM d""")
def age_labels(t: Tables):
    return t.session_event.select("event_id", tx.age_label(F.col("ts"), F.lit("2024-01-15").cast("timestamp")).alias("age"))


@query("parsed_instants", rows="X8", oracle="""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN epoch_us(ts) ELSE epoch_us(ts) - 7200000000 END AS at FROM events""")
def parsed_instants(t: Tables):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    kind = F.col("event_id") % 3
    stamp = F.when(kind == 0, F.concat(F.lit("bad "), text)).when(kind == 1, text).otherwise(F.concat(text, F.lit("+02:00")))
    return t.events.select("event_id", F.unix_micros(tx.parse_instant(stamp)).alias("at"))


@query("month_steps", rows="X9", oracle="""
SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) + to_months(CAST(o_orderkey % 30 AS INTEGER)) AS DATE) AS first_day FROM orders""")
def month_steps(t: Tables):
    return t.orders.select("o_orderkey", tx.add_months_to_first(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 30).cast("int")).alias("first_day"))


@query("nested_learning_ids", rows="P18", uses="session_event", oracle="""
SELECT event_id, 'learning:a:' || k || CASE WHEN k % 2 = 0 THEN '' ELSE ',learning:b:' || (k + 1) END AS ids FROM session_event WHERE tool_name IS NOT NULL""")
def nested_learning_ids(t: Tables):
    from tracelore.operators.transitions import nested_learning_ids as extract

    inner = F.concat(F.lit('{"id":"learning:a:'), F.col("k").cast("string"), F.lit('","text":"note"}'))
    block = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), inner.alias("text"))).alias("content")))
    both = F.concat(
        F.lit('{"result": ['), inner, F.lit(', {"id": "other:1", "id2": 3}, {"deep": {"id": "learning:b:'),
        (F.col("k") + 1).cast("string"), F.lit('"}}, '), inner, F.lit("]}"),
    )
    rows = t.session_event.filter("tool_name IS NOT NULL").select(
        "event_id", F.when(F.col("k") % 2 == 0, block).otherwise(both).alias("response")
    )
    return rows.select("event_id", F.array_join(extract(F.col("response")), ",").alias("ids"))


@query("recent_events_page", rows="W11", uses="session_event", oracle="""
SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS rank FROM session_event
WHERE ts < TIMESTAMP '2024-01-15 00:00:00' OR (ts = TIMESTAMP '2024-01-15 00:00:00' AND event_id < 5000) QUALIFY rank <= 20""")
def recent_events_page(t: Tables):
    cursor = F.lit("2024-01-15").cast("timestamp")
    older = t.session_event.filter((F.col("ts") < cursor) | ((F.col("ts") == cursor) & (F.col("event_id") < 5000)))
    return top_per_key(older, ["session_id"], [F.col("ts").desc(), F.col("event_id").desc()], 20).select(
        "session_id", "event_id", F.col("rank").cast("long").alias("rank")
    )
