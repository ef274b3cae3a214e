"""Ordered operators give the same rows whether keys are cut by time or by density; window membership; actors."""

import pytest
from pyspark.sql import functions as F

from tracelore.operators import audit, enrichment, events, pairing, windows


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def busy(spark):
    """One session with most events, all in two seconds, and small ones."""
    base = spark.range(1200).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 6 > 0, F.lit(1)).otherwise(2 + F.col("id") % 5).alias("session_id"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.pmod(F.xxhash64("id"), F.lit(2_000_000))).alias("ts"),
        F.when(F.col("id") % 40 == 7, "Stop").when(F.col("id") % 3 == 0, "PreToolUse").when(F.col("id") % 3 == 1, "PostToolUse").otherwise("UserPromptSubmit").alias("event_name"),
        F.lit(None).cast("string").alias("tool_use_id"), F.concat(F.lit("tool"), F.col("id") % 2).alias("tool_name"), F.lit("{}").alias("tool_input"),
    )
    return base.cache()


def test_chain_windows_and_versions(spark, busy):
    many = 10**9
    for most in (50,):
        assert rows_of(events.event_chain(busy, most=most)) == rows_of(events.event_chain(busy, most=many))
        assert rows_of(windows.stop_windows(busy, 30, most=most)) == rows_of(windows.stop_windows(busy, 30, most=many))
        writes = busy.select(F.col("session_id").cast("string").alias("name"), "ts", F.col("event_id").alias("write_id"), (F.col("event_id") % 3).cast("string").alias("content"))
        assert rows_of(audit.prompt_versions(writes, most=most)) == rows_of(audit.prompt_versions(writes, most=many))


def test_pairing_of_a_busy_group(spark, busy):
    calls = busy.filter(F.col("event_name").isin("PreToolUse", "PostToolUse"))
    keys = ["session_id", "tool_name"]
    few, many, bounded = (pairing.pair_without_ids(calls, keys, most=m) for m in (40, 10**9, None))
    assert rows_of(few) == rows_of(many) == rows_of(bounded)


def test_membership_is_narrow_and_complete(spark, busy):
    members = windows.membership(busy, 30)
    assert members.columns == ["event_id", "session_id", "window_no", "window_order", "window_id"]
    want = windows.stop_windows(busy, 30).filter("window_no is not null").select("event_id", "window_no")
    assert rows_of(windows.in_windows(busy, members).select("event_id", "window_no")) == rows_of(want)
    order = {r["event_id"]: (r["session_id"], r["window_order"]) for r in members.collect()}
    timed = sorted(busy.collect(), key=lambda r: (r["session_id"], r["ts"], r["event_id"]))
    for a, b in zip(timed, timed[1:]):
        if a["session_id"] == b["session_id"] and a["event_id"] in order and b["event_id"] in order:
            assert order[a["event_id"]][1] < order[b["event_id"]][1]
    plan = windows.in_windows(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), members).select("event_id", "window_id")._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan


def test_calls_take_their_actor_from_event_or_prompt(spark):

    rows = [("p", "UserPromptSubmit", 34, None, None, "Run a diagnostic command.", "sub-1", "rollout-1", "main-1", "subagent", True),
            ("a", "PreToolUse", 47, "Bash", '{"command": "pwd"}', None, None, "", "other", "subagent", True),
            ("b", "PostToolUse", 48, "Bash", '{"command": "pwd"}', None, "x", "y", "z", "main", False)]
    df = spark.createDataFrame(
        [(e, n, s, t, i, p, a, tr, pa, k, sub) for e, n, s, t, i, p, a, tr, pa, k, sub in rows],
        "event_id string, event_name string, s int, tool_name string, tool_input string, prompt string, agent_id string, agent_transcript_id string, parent_session_id string, agent_kind string, is_subagent boolean",
    ).selectExpr("*", "timestamp_seconds(1781690800 + s) ts", "'w' window_id", "'main-1' session_id", "1 project_id", "'turn' turn_id", "cast(null as string) tool_use_id",
                 "case when event_id = 'b' then '/home' end tool_response", "false tool_error")
    tables = enrichment.enrich(df, "window_id")
    for name in ("turn", "tool_call", "tool_result", "rationale"):
        got = tables[name].select(*enrichment.ACTOR).collect()
        assert [tuple(r) for r in got] == [("sub-1", "rollout-1", "other", "subagent", True)], name
    assert "agent_id" not in enrichment.enrich(df.drop(*enrichment.ACTOR), "window_id")["tool_call"].columns
