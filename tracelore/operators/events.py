"""Lifecycle events: payload to typed row, identity, routing, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelore import params
from tracelore.functions.text import collapse, hard_cap, prompt_origin, sha16
from tracelore.operators.segments import HOUR, SEG, SLICE_ROWS, laid_out, neighbours

# Event families.
FAILURE_EVENT = "PostToolUseFailure"
SUBAGENT_EVENTS = ("SubagentStart", "SubagentStop")
NEUTRAL_EVENTS = ("SessionStart", "SessionEnd")
CAPTURE_ONLY_EVENTS = (
    "InstructionsLoaded", "UserPromptExpansion", "PermissionDenied", "TaskCreated",
    "TaskCompleted", "PostCompact", "PostModelSwitch",
)
INJECTION_EVENTS = ("SessionStart", "UserPromptSubmit")
SPAWN_TOOL = "spawn_agent"

# Scalar payload fields kept as they are, capped at 8000, capped at 1000.
PLAIN_FIELDS = (
    "cwd", "permission_mode", "tool_name", "tool_use_id", "prompt", "expansion_type", "command_name",
    "command_source", "model", "source", "turn_id", "last_assistant_message", "agent_transcript_path",
    "task_id", "task_subject", "teammate_name", "trigger", "from_model", "to_model", "requested_model",
    "file_path", "memory_type", "load_reason", "trigger_file_path", "parent_file_path",
    "notification_type", "transcript_path",
)
LONG_FIELDS = ("compact_summary", "custom_instructions", "command_args", "task_description", "message")
ERROR_FIELDS = ("error", "error_details", "reason")
AGENT_FIELDS = (
    "agent_id", "agent_path", "subagent_id", "subagent_path", "parent_session_id", "main_session_id",
    "parent_agent_id", "parent_agent_path", "agent_kind", "agent_type", "subagent_type",
)

_TASK = "array<struct<type:string,status:string,name:string,agent_type:string,server:string,tool:string,description:string,command:string>>"
_CRON = "array<struct<schedule:string,recurring:boolean,prompt:string>>"
PAYLOAD_SCHEMA = ", ".join(
    [f"{f} string" for f in ("session_id", "hook_event_name", "source_event", "tool_input", "tool_response", "effort", "transcript")]
    + [f"{f} string" for f in (*PLAIN_FIELDS, *LONG_FIELDS, *ERROR_FIELDS, *AGENT_FIELDS)]
    + ["is_interrupt boolean", "tool_error boolean", "stop_hook_active boolean", "is_subagent boolean"]
    + [f"background_tasks {_TASK}", f"session_crons {_CRON}"]
)


def _filled(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def canonical_payload(payload: Column) -> Column:
    """JSON text with sorted keys and no spacing: equal content, equal text."""
    return F.to_json(F.try_parse_json(payload))


def _listed(entries: Column, line) -> Column:
    """At most 20 one-line entries plus a count of the rest; null when empty."""
    lines = F.transform(entries, lambda e: hard_cap(collapse(line(e)), params.MAX_LINE_CHARS))
    more = F.concat(F.lit("... and "), (F.size(lines) - params.MAX_LISTED).cast("string"), F.lit(" more"))
    capped = F.when(
        F.size(lines) > params.MAX_LISTED, F.concat(F.slice(lines, 1, params.MAX_LISTED), F.array(more))
    ).otherwise(lines)
    return F.when(F.size(lines) > 0, capped)


def _task_line(task: Column) -> Column:
    head = F.concat(
        F.coalesce(_filled(task["type"]), F.lit("task")), F.lit(" ("),
        F.coalesce(_filled(task["status"]), F.lit("unknown")), F.lit(")"),
    )
    served = F.nullif(F.concat_ws("/", _filled(task["server"]), _filled(task["tool"])), F.lit(""))
    who = F.coalesce(_filled(task["name"]), _filled(task["agent_type"]), served)
    what = F.coalesce(_filled(task["description"]), _filled(task["command"]))
    return F.concat_ws(": ", head, F.nullif(F.concat_ws(" · ", who, what), F.lit("")))


def _cron_line(cron: Column) -> Column:
    return F.concat(
        F.coalesce(_filled(cron["schedule"]), F.lit("?")),
        F.when(cron["recurring"], " (recurring): ").otherwise(" (once): "),
        F.coalesce(cron["prompt"], F.lit("")),
    )


def normalize_failures(events: DataFrame) -> DataFrame:
    """A failed-call event becomes an ordinary post-call row marked as an error."""
    failed = F.coalesce(F.col("event_name") == FAILURE_EVENT, F.lit(False))
    envelope = F.to_json(
        F.struct(
            F.array(F.struct(F.lit("text").alias("type"), F.coalesce("error", F.lit("")).alias("text"))).alias("content"),
            F.lit(True).alias("isError"),
        )
    )
    return events.withColumns(
        {
            "event_name": F.when(failed, "PostToolUse").otherwise(F.col("event_name")),
            "source_event": F.when(failed, FAILURE_EVENT).otherwise(F.col("source_event")),
            "tool_error": F.when(failed, F.lit(True)).otherwise(F.col("tool_error")),
            "is_interrupt": F.when(failed, F.coalesce("is_interrupt", F.lit(False))).otherwise(F.col("is_interrupt")),
            "tool_response": F.when(failed, F.coalesce("tool_response", envelope)).otherwise(F.col("tool_response")),
        }
    )


def classify_actor(events: DataFrame) -> DataFrame:
    """Main agent or subagent, with the resolved agent and parent session ids."""
    session = _filled(F.col("session_id"))
    transcript = F.nullif(
        F.regexp_extract(
            F.element_at(F.split(F.coalesce("transcript_path", F.lit("")), "/"), -1),
            r"(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\.jsonl$", 1,
        ),
        F.lit(""),
    )
    explicit = F.coalesce(*[_filled(F.col(c)) for c in ("agent_id", "agent_path", "subagent_id", "subagent_path")])
    parent = F.coalesce(*[_filled(F.col(c)) for c in ("parent_session_id", "main_session_id")])
    child_transcript = F.coalesce(transcript != session, F.lit(False))
    child_agent = F.coalesce(explicit != session, F.lit(False))
    sub = (
        F.coalesce(F.col("event_name").isin(*SUBAGENT_EVENTS), F.lit(False))
        | child_transcript
        | child_agent
        | F.coalesce(F.lower(F.trim("agent_kind")) == "subagent", F.lit(False))
        | F.coalesce(F.col("is_subagent"), F.lit(False))
    )
    owner = F.coalesce(parent, session)
    return events.withColumns(
        {
            "agent_transcript_id": transcript,
            "agent_type": F.coalesce(_filled(F.col("agent_type")), _filled(F.col("subagent_type"))),
            "agent_id": F.when(sub, F.coalesce(explicit, F.when(child_transcript, transcript))).otherwise(
                F.coalesce(explicit, transcript, session)
            ),
            "parent_session_id": F.when(sub & (owner != "unknown"), owner),
            "parent_agent_id": F.coalesce(_filled(F.col("parent_agent_id")), _filled(F.col("parent_agent_path"))),
            "agent_kind": F.when(sub, "subagent").otherwise("main"),
            "is_subagent": sub,
        }
    )


def route(events: DataFrame) -> DataFrame:
    """``owner_session_id``: markers stay with the parent, a subagent's own events go
    to its session. Session start and end carry no project."""
    marker = F.col("event_name").isin(*SUBAGENT_EVENTS)
    own = F.col("is_subagent") & F.col("agent_id").isNotNull()
    return events.withColumn(
        "owner_session_id", F.when(marker, F.col("session_id")).when(own, F.col("agent_id")).otherwise(F.col("session_id"))
    ).withColumn(
        "project_id", F.when(~F.col("event_name").isin(*NEUTRAL_EVENTS), F.col("project_id"))
    )


def ingest(raw: DataFrame, client: str, payload: str = "payload", received: str = "received_at") -> DataFrame:
    """Raw payloads (``payload``, ``received_at``, optional ``project_id``, ``user_id``,
    ``harness_pid``) to flat, capped, classified and routed event rows."""
    extra = {c: (F.col(c) if c in raw.columns else F.lit(None).cast("string")) for c in ("project_id", "user_id", "harness_pid")}
    parsed = raw.select(
        F.col(received).alias("ts"), F.col(payload).alias("__raw"),
        *[v.alias(k) for k, v in extra.items()], F.from_json(payload, PAYLOAD_SCHEMA).alias("p"),
    )
    flat = parsed.select("ts", "__raw", *extra, "p.*").withColumns(
        {
            "session_id": F.coalesce(_filled(F.col("session_id")), F.lit("unknown")),
            "event_name": F.coalesce(_filled(F.col("hook_event_name")), F.lit("unknown")),
        }
    )
    flat = classify_actor(normalize_failures(flat))
    stop = F.col("event_name") == "Stop"
    digest = F.substring(
        F.sha1(F.concat_ws("\n", F.coalesce(canonical_payload(F.col("__raw")), F.col("__raw")), F.col("harness_pid")).cast("binary")), 1, 16
    )
    spawned = F.when(
        (F.col("event_name") == "PostToolUse") & F.col("tool_name").endswith(SPAWN_TOOL),
        _filled(F.get_json_object("tool_response", "$.agent_id")),
    )
    rows = flat.withColumns(
        {
            "client": F.lit(client),
            "event_id": F.concat_ws(":", F.lit(client), F.col("session_id"), F.col("event_name"), digest),
            "effort_level": F.coalesce(F.get_json_object("effort", "$.level"), F.col("effort")),
            "tool_response": hard_cap(F.col("tool_response"), params.MAX_RESPONSE_CHARS),
            "prompt_origin": F.when(
                (F.col("event_name") == "UserPromptSubmit") & _filled(F.col("prompt")).isNotNull(), prompt_origin(F.col("prompt"))
            ),
            "error": F.when(F.col("tool_name").isNull(), F.col("error")),
            "background_tasks": F.when(stop, _listed(F.col("background_tasks"), _task_line)),
            "session_crons": F.when(stop, _listed(F.col("session_crons"), _cron_line)),
            "transcript": F.when(~F.col("event_name").isin(*CAPTURE_ONLY_EVENTS), F.col("transcript")),
            "spawned_subagent_id": spawned,
        }
    )
    rows = rows.withColumns({f: hard_cap(F.col(f), params.MAX_FIELD_CHARS) for f in LONG_FIELDS})
    rows = rows.withColumns({f: hard_cap(F.col(f), params.MAX_ERROR_CHARS) for f in ERROR_FIELDS})
    drop = ("__raw", "effort", "hook_event_name", "agent_path", "subagent_id", "subagent_path", "main_session_id",
            "parent_agent_path", "subagent_type")
    return route(rows.drop(*drop))


def unreadable(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows whose payload is no JSON object, for a reject table; ``ingest`` keeps them as unknown events that are
    told apart by their text."""
    return raw.filter(F.coalesce(F.schema_of_variant(F.try_parse_json(payload)), F.lit("")).substr(1, 6) != "OBJECT")


def append_new(events: DataFrame, log: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows of ``events`` not in ``log`` yet, one per key (the first to arrive)."""
    first = events.groupBy(key).agg(F.min_by(F.struct(*[c for c in events.columns if c != key]), "ts").alias("__row"))
    return first.join(log.select(key), key, "left_anti").select(key, "__row.*").select(*events.columns)


def event_chain(events: DataFrame, session: str = "session_id", width: int = HOUR, most: int = SLICE_ROWS) -> DataFrame:
    """FIRST, NEXT and LATEST along each session, by time and id."""
    rows = laid_out(events, [session], ["ts", "event_id"], width=width, most=most)
    linked = neighbours(rows, [session], ["ts", "event_id"], F.col(SEG), "event_id").drop(SEG)
    return linked.withColumns(
        {"is_first": F.col("prev_event_id").isNull(), "is_latest": F.col("next_event_id").isNull()}
    )


def subagent_sessions(events: DataFrame) -> DataFrame:
    """One row per (parent, child) session with the events that triggered, started
    and ended the child."""
    links = events.select(
        F.col("session_id").alias("parent_session_id"),
        F.when(F.col("event_name").isin(*SUBAGENT_EVENTS), F.col("agent_id"))
        .when(F.col("owner_session_id") != F.col("session_id"), F.col("owner_session_id"))
        .alias("own_child"),
        "spawned_subagent_id", "agent_type", "client", "ts", "event_id", "event_name", "agent_transcript_id",
    )
    own = links.filter(F.col("own_child") != F.col("parent_session_id")).withColumn("child", F.col("own_child")).withColumn("spawn", F.lit(False))
    spawned = links.filter(F.col("spawned_subagent_id").isNotNull()).withColumn("child", F.col("spawned_subagent_id")).withColumn("spawn", F.lit(True))
    at = F.struct("ts", "event_id")
    return own.unionByName(spawned).groupBy("parent_session_id", F.col("child").alias("session_id")).agg(
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
        F.min_by("client", F.when(F.col("client").isNotNull(), at)).alias("client"),
        F.min_by("agent_type", F.when(F.col("agent_type").isNotNull(), at)).alias("agent_type"),
        F.max_by("event_id", F.when(F.col("spawn"), at)).alias("triggered_by"),
        F.max_by("event_id", F.when(F.col("event_name") == "SubagentStart", at)).alias("started_at"),
        F.max_by("event_id", F.when(F.col("event_name") == "SubagentStop", at)).alias("ended_at"),
        F.count("*").alias("n_events"),
    )


def merge_sessions(state: DataFrame | dict[str, DataFrame] | None, touches: DataFrame) -> dict[str, DataFrame]:
    """Project, session and user rows after ``touches`` (project_id, session_id,
    user_id, source, ts): first source and first owner stay, activity moves forward. ``state`` holds the earlier snapshots by kind, or
    the sessions' alone; its rows are all kept, touched or not."""

    def fold(key: str, keep: dict[str, str], old: DataFrame | None = None) -> DataFrame:
        rows = touches.filter(F.col(key).isNotNull())
        return rows.groupBy(key).agg(
            F.min("ts").alias("created_at"),
            F.max("ts").alias("last_activity_at"),
            *[F.min_by(src, F.when(F.col(src).isNotNull(), F.struct("ts", "event_id"))).alias(out) for out, src in keep.items()],
            *([F.max_by("source", F.when(F.col("source").isNotNull(), F.struct("ts", "event_id"))).alias("last_source")] if key != "session_id" else []),
        )

    out = {
        "project": fold("project_id", {"source": "source"}),
        "session": fold("session_id", {"user_id": "user_id", "project_id": "project_id"}),
        "user": fold("user_id", {"source": "source"}),
    }
    if state is None:
        return out
    # What an earlier snapshot says first stays: its owner, project and first source. The last source is the touches'.
    for kind, before in (state if isinstance(state, dict) else {"session": state}).items():
        key = f"{kind}_id"
        old, new = before.alias("old"), out[kind].alias("new")
        first = ("user_id", "project_id") if kind == "session" else ("source",)
        out[kind] = old.join(new, key, "full_outer").select(
            key,
            F.least("old.created_at", "new.created_at").alias("created_at"),
            F.greatest("old.last_activity_at", "new.last_activity_at").alias("last_activity_at"),
            *[F.coalesce(f"old.{c}", f"new.{c}").alias(c) for c in first],
            *([F.coalesce("new.last_source", "old.last_source").alias("last_source")] if kind != "session" else []),
        )
    return out


def injection_prompt_log(injections: DataFrame) -> DataFrame:
    """One row per (session, prompt name, content hash, target): first, last, count.
    Only the first firing of a row injects."""
    keyed = injections.withColumn("content_sha", sha16(F.col("content")))
    return keyed.groupBy("session_id", "prompt_name", "content_sha", "target").agg(
        F.count("*").alias("injection_count"),
        F.min("ts").alias("first_at"),
        F.max("ts").alias("last_at"),
        F.min_by("injection_id", F.struct("ts", "injection_id")).alias("injected_by"),
        F.max(F.length("content")).alias("char_count"),
    )
