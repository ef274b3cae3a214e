"""Turns, tool calls, results, rationales, resources and their edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelore.functions.text import sha16, truncate
from tracelore.functions.tools import (
    command_of, command_tokens, first_word, input_summary, looks_like_path, result_success,
    result_summary, tool_id, tool_intent, tool_kind, tool_namespace,
)
from tracelore.operators.pairing import POST, PRE, pair_tool_calls
from tracelore.session import stored

MAX_TEXT = 1200
_RES = "array<struct<id:string,type:string,name:string,value:string,confidence:double>>"
# Input keys read as resources, in this order.
RESOURCE_KEYS = ("path", "file", "uri", "url", "ref_id")

#: Who acted, as ``classify_actor`` resolves it. A call takes the first three from its prompt where its own event has none.
ACTOR = ("agent_id", "agent_transcript_id", "parent_session_id", "agent_kind", "is_subagent")
FROM_PROMPT = ACTOR[:3]


def _resource(id_: Column, kind: str, value: Column, confidence: float, name: Column | None = None) -> Column:
    return F.struct(
        id_.alias("id"), F.lit(kind).alias("type"), (truncate(value, 120) if name is None else name).alias("name"),
        value.alias("value"), F.lit(confidence).alias("confidence"),
    )


def with_input_facts(calls: DataFrame, tool_input: Column) -> DataFrame:
    """Add what is read from an input, each part by one parse: ``__raw``, ``__command``, ``__tokens``, ``__verb``, ``__asked`` and a field ``__in_<key>`` per
    resource key. Columns that later expressions name several times stand in a step of their own, so that they are not written out anew at every mention."""
    read = calls.withColumn("__raw", tool_input)
    raw = F.col("__raw")
    read = read.withColumns({"__command": command_of(raw), "__asked": F.get_json_object(raw, "$.query"), **{f"__in_{key}": F.get_json_object(raw, f"$.{key}") for key in RESOURCE_KEYS}})
    tokens = F.when(F.col("__command") == "", F.array().cast("array<string>")).otherwise(command_tokens(F.col("__command")))
    return read.withColumn("__tokens", tokens).withColumn("__verb", first_word(F.col("__tokens")))


def with_resources(calls: DataFrame) -> DataFrame:
    """Add ``resources``: at most five that a call (with ``with_input_facts``) names: command paths, a query, path-like fields;
    first mention of an id wins."""
    none, tokens, asked = F.array().cast(_RES), F.col("__tokens"), F.col("__asked")
    words = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(0)))
    paths = F.slice(F.filter(words, looks_like_path), 1, 5)
    files = F.transform(paths, lambda p: _resource(F.concat(F.lit("resource:file:"), p), "file", p, 0.85, p))
    found = [
        files.cast(_RES),
        F.when(
            F.trim(F.coalesce(asked, F.lit(""))) != "",
            F.array(_resource(F.concat(F.lit("resource:cypher:"), sha16(asked)), "cypher_query", asked, 0.9)),
        ).otherwise(none),
    ]
    for key in RESOURCE_KEYS:
        value = F.col(f"__in_{key}")
        found.append(
            F.when(
                F.trim(F.coalesce(value, F.lit(""))) != "",
                F.array(_resource(F.concat(F.lit(f"resource:{key}:"), sha16(value)), key, value, 0.8)),
            ).otherwise(none)
        )
    every = calls.withColumn("__every", F.concat(*found)).withColumn("__every_id", F.transform("__every", lambda r: r["id"]))
    first = F.filter("__every", lambda r, i: F.array_position("__every_id", r["id"]) == i + 1)
    return every.withColumn("resources", F.slice(first, 1, 5)).drop("__every", "__every_id")


def enrich(events: DataFrame, window: str) -> dict[str, DataFrame]:
    """Six tables from the events of bounded windows (``window`` plus session_id, project_id):
    turn, tool_call, tool_result, rationale, resource, and the edges follows / depends_on. Actor columns that the events
    have are carried to turns (of the first call), calls, results and rationales."""
    actor = [c for c in ACTOR if c in events.columns]
    asked_by = [c for c in FROM_PROMPT if c in events.columns]
    pre_cols = ["tool_name", "tool_input", "tool_use_id", "turn_id", "session_id", "project_id", *actor]
    # Calls, their results and the prompts are taken from the events one after another.
    events = stored(events.select(window, "event_id", "event_name", "ts", "prompt", "tool_response", "tool_error", *pre_cols), "events")
    pairs = pair_tool_calls(events, window)
    pre = events.filter(F.col("event_name") == PRE).select(F.col("event_id").alias("pre_event_id"), *pre_cols)
    post = events.filter(F.col("event_name") == POST).select(
        F.col("event_id").alias("post_event_id"), F.col("turn_id").alias("post_turn"), "tool_response", "tool_error"
    )
    calls = pairs.join(pre, "pre_event_id").join(post, "post_event_id", "left")
    calls = calls.withColumn("turn_id", F.coalesce("turn_id", "post_turn"))

    prompts = events.filter((F.col("event_name") == "UserPromptSubmit") & (F.coalesce("prompt", F.lit("")) != ""))
    at = F.struct("ts", "event_id")
    ref = F.struct("prompt", F.col("event_id").alias("prompt_event_id"), F.col("ts").alias("prompt_ts"), *[F.col(c).alias(f"prompt_{c}") for c in asked_by])
    by_turn = prompts.groupBy(window, F.coalesce("turn_id", F.lit("")).alias("__turn")).agg(F.max_by(ref, at).alias("__own"), F.max(at).alias("__at"))
    last = by_turn.groupBy(window).agg(F.max_by("__own", "__at").alias("__last"))
    by_turn = by_turn.drop("__at")
    calls = calls.withColumn("__turn", F.coalesce("turn_id", F.lit(""))).join(by_turn, [window, "__turn"], "left").join(last, window, "left")
    calls = calls.withColumn("__ref", F.coalesce("__own", "__last")).select(
        *[c for c in calls.columns if c not in ("__own", "__last", "__turn", *asked_by)],
        *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__ref.prompt_{c}")).alias(c) for c in asked_by],
        F.col("__ref.prompt").alias("prompt"), "__ref.prompt_event_id", "__ref.prompt_ts",
    )

    name = F.coalesce(F.nullif(F.col("tool_name"), F.lit("")), F.lit("unknown"))
    sid = F.col("session_id").cast("string")
    used = F.coalesce("tool_use_id", F.lit(""))
    calls = calls.withColumns(
        {
            "tool_name": name,
            "turn_node_id": F.concat_ws(":", F.lit("turn"), sid, F.coalesce("turn_id", F.lit("unknown"))),
            "order": F.row_number().over(Window.partitionBy(window).orderBy("pre_ts", "pre_event_id")),
        }
    )
    calls = calls.withColumn(
        "call_id",
        F.concat_ws(
            ":", F.lit("tool-call"), sid,
            F.when(used != "", used).otherwise(sha16(F.col("pre_event_id"), F.col("tool_name"), F.col("tool_input"))),
        ),
    )
    # Six tables are cut from this one; pair it once. What only some tables tell of a call is read from its columns where it is told.
    calls = stored(calls, "calls")
    name = F.col("tool_name")
    read = with_input_facts(calls, F.coalesce("tool_input", F.lit("")))
    facets = read.withColumns(
        {
            "tool_id": tool_id(name),
            "tool_kind": tool_kind(name),
            "tool_namespace": tool_namespace(name),
            "operation": F.when(F.col("__verb") != "", F.col("__verb")).otherwise(
                F.when(F.coalesce("__asked", F.lit("")) != "", "cypher_query").otherwise("")
            ),
            "input_summary": input_summary(F.col("__raw"), F.col("__command"), F.col("__asked")),
            "rule": tool_intent(name, F.col("__verb")),
        }
    )
    asked = F.when(F.coalesce("prompt", F.lit("")) != "", truncate(F.col("prompt"), 180)).otherwise("current session task")
    facets = facets.withColumns(
        {
            "intent": F.col("rule.intent"), "expected_output": F.col("rule.expected_output"),
            "confidence": F.col("rule.confidence"),
            "observable_rationale": truncate(
                F.concat(F.col("rule.intent"), F.lit(" in response to the active request: "), asked), MAX_TEXT
            ),
        }
    ).drop("rule", *[c for c in read.columns if c.startswith("__")])

    keys = [window, "turn_node_id"]
    tool_call = facets.drop("tool_response", "tool_error", "post_turn")
    first = F.struct("order")
    turn = calls.groupBy(*keys).agg(
        F.min_by("session_id", first).alias("session_id"),
        F.min_by(truncate(F.col("prompt"), MAX_TEXT), first).alias("prompt"),
        F.min_by("prompt_event_id", first).alias("prompt_event_id"),
        F.min_by(F.coalesce("prompt_ts", "pre_ts"), first).alias("first_seen_at"),
        F.count("*").alias("call_count"),
        *[F.min_by(c, first).alias(c) for c in actor],
    )
    answered = calls.filter(F.col("post_event_id").isNotNull())
    result = answered.select(
        window, F.concat(F.lit("tool-result:"), "call_id").alias("result_id"), "call_id", "post_event_id",
        result_summary(F.col("tool_response")).alias("summary"),
        F.length(F.coalesce("tool_response", F.lit(""))).alias("response_chars"),
        result_success(F.col("tool_response"), F.col("tool_error")).alias("succeeded"),
        F.col("post_ts").alias("created_at"), *actor,
    )
    rationale = facets.select(
        window, F.concat(F.lit("tool-rationale:"), "call_id").alias("rationale_id"), "call_id", "intent",
        "expected_output", "observable_rationale", "confidence", *actor,
    )
    evidence = answered.filter(F.coalesce("tool_response", F.lit("")) != "").select(
        window, "turn_node_id", "order", "call_id", F.concat(F.lit("evidence:"), "call_id").alias("resource_id"),
        F.lit("tool_response").alias("type"), F.concat("tool_name", F.lit(" response")).alias("name"),
        result_summary(F.col("tool_response")).alias("value"), F.lit(0.7).alias("confidence"),
    )
    named = with_resources(read).select(window, "turn_node_id", "order", "call_id", F.explode("resources").alias("r")).select(
        window, "turn_node_id", "order", "call_id", F.col("r.id").alias("resource_id"), "r.type", "r.name", "r.value", "r.confidence"
    )
    along = Window.partitionBy(*keys).orderBy("order")
    follows = calls.select(*keys, F.lag("call_id").over(along).alias("from_id"), F.col("call_id").alias("to_id")).filter(
        F.col("from_id").isNotNull()
    )
    # Both sides come from one bounded window, so the pairs per resource are few.
    now, then = named.alias("now"), named.alias("then")
    depends = now.join(then, [*keys, "resource_id"]).filter(F.col("then.order") < F.col("now.order")).groupBy(
        *keys, F.col("now.call_id").alias("from_id"), F.col("then.call_id").alias("to_id")
    ).agg(F.array_sort(F.collect_set("resource_id")).alias("resource_ids"))
    return {
        "turn": turn, "tool_call": tool_call, "tool_result": result, "rationale": rationale,
        "resource": evidence.unionByName(named), "follows": follows, "depends_on": depends,
    }


def enrichment_summary(tables: dict[str, DataFrame], digests: DataFrame, window: str, mode: str = "turn") -> DataFrame:
    """Counts and the summary line per window; windows without calls count zero."""

    def counted(name: str, out: str) -> DataFrame:
        return tables[name].groupBy(window).agg(F.count("*").alias(out))

    rows = digests
    for name, out in (("turn", "turns"), ("tool_call", "calls"), ("rationale", "rationales"), ("resource", "resources")):
        rows = rows.join(counted(name, out), window, "left").withColumn(out, F.coalesce(out, F.lit(0)))
    return rows.withColumn(
        "summary",
        F.format_string(
            f"Enriched %d {mode} events into %d tool calls, %d turns, %d rationales, and %d resources.",
            "event_count", "calls", "turns", "rationales", "resources",
        ),
    )
