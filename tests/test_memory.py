from datetime import datetime

from pyspark.sql import functions as F

from tracelore.functions import text as tx
from tracelore.functions import tools as tl
from tracelore.functions.embedding import embed
from tracelore.operators import accounts, audit, events, transitions as tr


def test_resolution_precedence(spark):
    cases = {  # verdicts, restates -> outcome, consistency
        "clean": ([], None, "approved", "clean"),
        "won": ([("x", "new")], None, "approved", "superseded_conflicts"),
        "open": ([("x", "unclear")], None, "approved", "ambiguous_kept_both"),
        "again": ([("x", "new")], "y", "already_learned", "already_learned"),
        "veto": ([("x", "existing"), ("y", "new")], "y", "rejected", "vetoed"),
        "ghost": ([("nobody", "existing")], "nobody", "approved", "clean"),
    }
    cand = spark.createDataFrame([(c,) for c in cases], "id string")
    near = spark.createDataFrame([(c, e) for c in cases for e in ("x", "y")], "candidate_id string, existing_id string")
    contra = spark.createDataFrame([(c, e, w) for c, (v, _, _, _) in cases.items() for e, w in v], "candidate_id string, existing_id string, winner string")
    same = spark.createDataFrame([(c, s) for c, (_, s, _, _) in cases.items() if s], "candidate_id string, existing_id string")
    got = {r.candidate_id: r for r in tr.resolve(cand, near, contra, same).collect()}
    for c, (_, _, outcome, consistency) in cases.items():
        assert (got[c].outcome, got[c].consistency) == (outcome, consistency)
    assert got["veto"].superseded == [] and got["veto"].vetoed_by == ["x"] and got["veto"].restates is None
    assert got["won"].superseded == ["x"] and got["again"].superseded == []


def test_a_superseded_row_takes_no_verdict(spark):
    rows = [("a", ["b"]), ("b", ["a", "c"]), ("c", ["d"]), ("d", [])]
    res = spark.createDataFrame(rows, "candidate_id string, superseded array<string>")
    assert {r.candidate_id for r in tr.applied_in_order(res, F.col("candidate_id")).collect()} == {"a", "c"}


def test_replies(spark):
    rows = [("p", '{"verdict": "PASS", "category": "x", "reason": "fine"}'), ("f", '```json\n{"verdict": "block", "category": "secret", "reason": "key"}\n```'), ("n", "no verdict"), ("u", '{"verdict": "later"}')]
    got = {r.candidate_id: (r.verdict, r.category) for r in tr.safety_rows(spark.createDataFrame(rows, "candidate_id string, reply string")).collect()}
    assert got == {"p": ("pass", "other"), "f": ("block", "secret"), "n": (None, None), "u": (None, None)}


def test_nested_ids(spark):
    rows = [
        ('{"content": [{"type": "text", "text": "{\\"id\\": \\"learning:p:1\\", \\"x\\": {\\"id\\": \\"learning:p:2\\"}}"}]}', ["learning:p:1", "learning:p:2"]),
        ('[{"id": "learning:a"}, {"id": "other"}, {"id": "learning:a"}]', ["learning:a"]),
        ('{"text": "he quoted \\"id\\": \\"learning:z\\" in prose", "id": "learning:q"}', ["learning:q"]),
        ("learning: plain text", []),
    ]
    df = spark.createDataFrame(rows, "r string, want array<string>")
    assert all(r.got == r.want for r in df.withColumn("got", tr.nested_learning_ids(F.col("r"))).collect())


def test_scalars(spark):
    one = spark.range(1)

    def value(col):
        return one.select(col.alias("v")).first().v

    assert value(tx.truncate(F.lit("a  b\n" + "c" * 50), 10)) == "a b ccc..."
    assert value(tx.truncate(F.lit("abcdef  ghij klm"), 11)) == "abcdef g..."
    assert value(tx.prompt_origin(F.lit("  <task-notification> done"))) == "task-notification"
    assert value(tx.prompt_origin(F.lit("<div> hi"))) == "user"
    assert value(tx.normalize_label(F.lit("  Hook-Pipeline  Debug!"))) == "hook pipeline debug"
    assert value(tx.slugify(F.lit("!!"))) == "default"
    assert value(tl.tool_key(F.lit("mcp__a_b__read_x"))) == "read_x" and value(tl.tool_key(F.lit("Bash"))) == "Bash"
    assert value(tl.tool_key(F.lit(" "))) is None
    assert value(tl.is_transient(F.lit("Error: request   timed out"))) and not value(tl.is_transient(F.lit("unknown option --timeout")))
    assert value(tl.failure_text(F.lit('{"result": {"content": [{"text": " a "}, {"content": ["b", {"message": "c"}]}]}}'))) == "a b c"
    assert value(tl.failure_text(F.lit("plain\n  text"), 8)) == "plain..."
    assert value(tl.result_success(F.lit("Process exited with code 1"))) is False
    assert value(tl.result_success(F.lit("Process exited with code 0"))) is True
    assert value(tl.result_success(F.lit("who knows"))) is None
    now = F.lit("2024-01-03 00:00:00").cast("timestamp")
    ages = {"2024-01-02 23:59:50": "1m ago", "2024-01-02 21:00:00": "3h ago", "2024-01-01 00:00:00": "2d ago"}
    for at, label in ages.items():
        assert value(tx.age_label(F.lit(at).cast("timestamp"), now)) == label


def test_ingest_routes_subagents_and_lists_background_work(spark):
    payloads = [
        '{"session_id": "s", "hook_event_name": "SubagentStart", "agent_id": "c"}',
        '{"session_id": "s", "hook_event_name": "PreToolUse", "agent_id": "c", "tool_name": "Bash"}',
        '{"session_id": "s", "hook_event_name": "Stop", "background_tasks": [{"type": "shell", "status": "running", "command": "make"}], "session_crons": []}',
        '{"session_id": "s", "hook_event_name": "PreToolUse", "transcript_path": "/x/0123abcd-0123-0123-0123-0123456789ab.jsonl"}',
    ]
    raw = spark.createDataFrame([(p, datetime(2024, 1, 1, 0, i)) for i, p in enumerate(payloads)], "payload string, received_at timestamp")
    rows = events.ingest(raw, "cli").orderBy("ts").collect()
    assert [r.owner_session_id for r in rows] == ["s", "c", "s", "0123abcd-0123-0123-0123-0123456789ab"]
    assert [r.is_subagent for r in rows] == [True, True, False, True]
    assert rows[2].background_tasks == ["shell (running): make"] and rows[2].session_crons is None
    links = events.subagent_sessions(events.ingest(raw, "cli")).filter("session_id = 'c'").first()
    assert links.started_at is not None and links.ended_at is None


def test_unreadable_payloads_keep_their_own_ids(spark):
    raw = spark.createDataFrame([(p, datetime(2024, 1, 1)) for p in ("not json", "{broken", "[1]", '{"session_id": "s", "hook_event_name": "Stop"}')], "payload string, received_at timestamp")
    assert events.ingest(raw, "cli").select("event_id").distinct().count() == 4
    assert {r.payload for r in events.unreadable(raw).collect()} == {"not json", "{broken", "[1]"}


def test_embedder_failures_leave_nulls(spark):
    def provider(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("down")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(1, "aa"), (2, " "), (3, "bad"), (4, "dddd")], "id long, text string").coalesce(1)
    got = {r.id: r.embedding for r in embed(df, "text", provider, batch=1).collect()}
    assert got == {1: [2.0], 2: None, 3: None, 4: [4.0]}


def test_accounts(spark):
    usage = spark.createDataFrame(
        [(1, "a", "2024-01-01", 5.0, 1.0, 10.0), (1, "a", "2024-02-01", 0.0, 2.0, 10.0), (2, "b", "2024-01-01", 3.0, 1.0, 0.0)],
        "account_id long, sku string, month string, mau double, monthly_revenue double, contracted_seats double",
    ).withColumn("month", F.col("month").cast("date"))
    latest = {(r.account_id, r.sku): r.utilization for r in accounts.latest_usage(usage).collect()}
    assert latest == {(1, "a"): 0.0, (2, "b"): None}
    acc = spark.createDataFrame([(1, "steady", 80, "2024-03-01"), (2, "steady", 80, "2025-03-01")], "account_id long, trajectory string, health_score long, renewal_date string").withColumn("renewal_date", F.col("renewal_date").cast("date"))
    risk = accounts.renewal_risk(acc, usage, F.lit("2024-02-01").cast("date")).collect()
    assert [(r.account_id, r.reasons) for r in risk] == [(1, "falling+dead_line")]


def test_memory_texts_are_gathered_once(spark):
    """Neither the look-up nor the skills join the documents again."""
    from tracelore.catalog import REGISTRY, Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    out = REGISTRY["memory_vectors"].run(t)
    assert not [f for f in out.inputFiles() + t.skill.inputFiles() if "documents" in f]


def test_lines_of_a_pack_may_be_told_once_for_a_project(spark):
    """A project's facts are given once and reach every request of it, as if they were given to each."""
    asks = spark.createDataFrame([(i, i % 2, 7, f"P{i % 2}") for i in range(6)], "request_id long, project_id long, user_id long, project_name string")
    facts = spark.createDataFrame([(1, r, "fact", None, "approved", 0.5, f"text  {r}") for r in (1, 2)], "project_id long, rank int, kind string, resolved boolean, status string, confidence double, text string")
    notes = asks.select("request_id", F.lit(0).alias("blocked"), F.lit(0).alias("pending_skills"), F.lit(0).alias("episodes"))
    at = F.lit("2024-02-01").cast("timestamp")
    each = asks.select("request_id", "project_id").join(facts, "project_id")
    one, many = (audit.context_packs(asks, None, None, part, None, None, notes, at, **by).orderBy("request_id").collect() for part, by in ((facts, {"by": {"f": "project_id"}}), (each, {})))
    assert one == many and [r.context != "" for r in one] == [False, True] * 3 and "text 1\n- [approved, confidence 0.50] text 2" in one[1].context
