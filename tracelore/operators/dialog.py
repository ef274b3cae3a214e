"""Conversation text out of transcript snapshots (JSON lines, two record dialects)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECORD = (
    "timestamp string, type string, message struct<role:string,content:string>, "
    "payload struct<type:string,role:string,content:string,message:string,text:string>"
)
_BLOCKS = "array<struct<type:string,text:string>>"
_TEXT_TYPES = ("text", "output_text", "input_text")


def _blocks(content: Column) -> Column:
    return F.when(F.ltrim(content).startswith("["), F.from_json(content, _BLOCKS))


def _joined(content: Column, allow_plain: bool) -> Column:
    blocks = _blocks(content)
    texts = F.transform(
        F.filter(blocks, lambda b: b["type"].isin(*_TEXT_TYPES) & (F.trim(F.coalesce(b["text"], F.lit(""))) != "")),
        lambda b: b["text"],
    )
    joined = F.array_join(texts, "\n")
    text = F.when(blocks.isNotNull(), joined)
    return text.otherwise(content) if allow_plain else text


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def dialog_entries(snapshots: DataFrame, keys: list[str], snapshot: str = "snapshot") -> DataFrame:
    """(keys, pos, role, entry_ts, text): user and assistant text in record order. Tool
    results, other records and unreadable lines give nothing."""
    lines = snapshots.select(*keys, F.posexplode(F.split(F.col(snapshot), "\r?\n")).alias("pos", "line")).filter(
        F.trim("line") != ""
    )
    rec = lines.select(*keys, "pos", F.from_json("line", RECORD).alias("r"))
    message, payload = F.col("r.message"), F.col("r.payload")
    said = _strip(_joined(message["content"], True))
    blocks = _blocks(message["content"])
    holds_result = F.coalesce(F.exists(blocks, lambda b: b["type"] == "tool_result"), F.lit(False))
    first = F.when(message["role"] == "assistant", F.struct(F.lit("assistant").alias("role"), said.alias("text"))).when(
        (message["role"] == "user") & ~holds_result, F.struct(F.lit("user").alias("role"), said.alias("text"))
    )
    item = (F.col("r.type") == "response_item") & (payload["type"] == "message") & payload["role"].isin("user", "assistant")
    note = (F.col("r.type") == "event_msg") & payload["type"].isin("agent_message", "user_message")
    second = F.when(item, F.struct(payload["role"].alias("role"), _strip(_joined(payload["content"], False)).alias("text"))).when(
        note,
        F.struct(
            F.when(payload["type"] == "agent_message", "assistant").otherwise("user").alias("role"),
            _strip(F.coalesce(payload["message"], payload["text"], F.lit(""))).alias("text"),
        ),
    )
    entry = F.when(message.isNotNull(), first).otherwise(second)
    return rec.select(
        *keys, "pos", entry.alias("e"), F.coalesce(F.col("r.timestamp"), F.lit("")).alias("entry_ts")
    ).filter(F.coalesce(F.col("e.text"), F.lit("")) != "").select(*keys, "pos", F.col("e.role").alias("role"), "entry_ts", F.col("e.text").alias("text"))


def window_assistant_texts(snapshots: DataFrame, known: DataFrame, window: str) -> DataFrame:
    """What the assistant wrote during a window. ``snapshots``: (window, transcript_path, ts,
    event_id, snapshot); ``known``: (window, text) already in the corpus.

    Per transcript: the last snapshot minus the first one when it extends it, else what
    follows the last user message.
    """
    at = F.struct("ts", "event_id")
    groups = snapshots.groupBy(window, "transcript_path").agg(
        F.min_by("snapshot", at).alias("first"), F.max_by("snapshot", at).alias("last"),
        F.count("*").alias("n"), F.min("ts").alias("group_ts"),
    )
    grows = (F.col("n") > 1) & F.col("last").startswith(F.col("first"))
    keys = [window, "transcript_path"]
    pieces = groups.withColumn("grows", grows).withColumn(
        "snapshot", F.when(grows, F.expr("substring(last, length(first) + 1)")).otherwise(F.col("last"))
    )
    entries = dialog_entries(pieces.select(*keys, "grows", "group_ts", "snapshot"), [*keys, "grows", "group_ts"])
    # One transcript's new part belongs to one window, which bounds this frame.
    whole = Window.partitionBy(*keys)
    entries = entries.withColumn("__last_user", F.max(F.when(F.col("role") == "user", F.col("pos"))).over(whole))
    fresh = entries.filter(
        (F.col("role") == "assistant") & (F.col("grows") | (F.col("pos") > F.coalesce("__last_user", F.lit(-1))))
    ).drop("__last_user")
    return fresh.join(known.select(window, F.trim("text").alias("text")), [window, "text"], "left_anti")
