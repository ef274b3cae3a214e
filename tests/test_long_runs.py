"""No rule stops at a fixed number of rounds, rows or minutes, and no transition loses a column."""

import os
from datetime import datetime, timedelta

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tracelore.operators import skills, transitions as tr, windows
from tracelore.session import work_dir
from tracelore.streaming import jobs

T0 = datetime(2024, 1, 1)


def test_a_chain_of_200_supersessions_settles(spark):
    rows = [(i, [i + 1]) for i in range(200)] + [(1000, [1002]), (1001, [1002]), (1002, [1003]), (1003, [])]
    res = spark.createDataFrame(rows, "candidate_id long, superseded array<long>")
    got = {r.candidate_id for r in tr.applied_in_order(res, F.col("candidate_id")).collect()}
    assert got == set(range(0, 200, 2)) | {1000, 1001, 1003}


def test_rows_with_two_open_superseders_settle_in_few_rounds(spark, monkeypatch):
    from tracelore.operators import graph

    rows = [(i, [i + 1, i + 2]) for i in range(200)]
    res = spark.createDataFrame(rows, "candidate_id long, superseded array<long>")
    want, applied = set(), {}
    for i in range(200):
        applied[i] = not any(applied.get(j, False) for j in (i - 1, i - 2))
        want |= {i} if applied[i] else set()
    cuts = []
    for module in (graph, tr):
        plain = module.cut
        monkeypatch.setattr(module, "cut", lambda df, plain=plain: cuts.append(1) or plain(df))
    assert {r.candidate_id for r in tr.applied_in_order(res, F.col("candidate_id")).collect()} == want
    assert len(cuts) < 30  # a round of the groups is one, so 200 rows take far fewer than 200
    short = res.filter("candidate_id < 14")
    assert {r.candidate_id for r in tr.applied_in_order(short, F.col("candidate_id"), settle_rows=3).collect()} == {i for i in want if i < 14}


def test_a_tree_of_70_levels(spark):
    edges = spark.createDataFrame([(i, i - 1 if i else None) for i in range(70)], "child long, parent long")
    got = {(r.ancestor, r.node): r.depth for r in windows.closure(edges).collect()}
    assert len(got) == 70 * 71 // 2 and got[0, 69] == 69 and got[3, 3] == 0
    assert {r.root for r in windows.roots(edges).collect()} == {0}
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "child long, parent long")
    assert len(windows.closure(circle).collect()) == 9


def test_a_group_of_300_members_does_not_hide_its_errors(spark):
    learnings = spark.createDataFrame(
        [(i, "s", "t", "sig", 1000 - i, False, "error", "approved", "x") for i in range(310)],
        "id long, session_id string, tool_key string, error_signature string, support_count long, resolved boolean, kind string, status string, text string",
    )
    groups = spark.createDataFrame([("g", "p")], "group_id string, pattern_id string")
    members = spark.createDataFrame([("g", i) for i in range(300)], "group_id string, learning_id long")
    links = spark.createDataFrame([("p", "s")], "pattern_id string, session_id string")
    none = spark.createDataFrame([], "session_id string, tool_error boolean, tool_name string, is_interrupt boolean, tool_response string, ts timestamp, event_id long")
    rows = skills.error_context(groups, members, links, learnings, none).collect()
    assert len(rows) == 6


STATE = (
    "id string, created_at timestamp, updated_at timestamp, text string, task_pattern string, kind string, tool_key string, error_signature string, resolved boolean, project_id long, scope string, "
    "user_id long, status string, support_count long, echo_count long, confidence double, consolidated boolean, compiled_at timestamp, embedding array<double>, reviewed_by string, "
    "consistency_status string, consistency_checked_at timestamp, safety_status string, blocked_reason string, rejected_reason string, salience double"
)


def row(i, status="candidate", **over):
    base = dict(
        id=i, created_at=T0, updated_at=T0, text=f"text {i}", task_pattern="task", kind="error", tool_key="Bash", error_signature="sig", resolved=True, project_id=1, scope="project", user_id=7, status=status,
        support_count=2, echo_count=1, confidence=0.5, consolidated=False, compiled_at=None, embedding=[1.0], reviewed_by="human", consistency_status="clean", consistency_checked_at=T0,
        safety_status="passed", blocked_reason="old block", rejected_reason="old reason", salience=0.25,
    ) | over
    return tuple(base.values())


def by_id(df):
    return {r.id: r.asDict() for r in df.collect()}


def test_transitions_in_a_row_keep_the_snapshot(spark):
    state = spark.createDataFrame([row("a"), row("b", "approved"), row("c", "approved"), row("d")], STATE)
    columns = state.columns
    first = by_id(state)

    at = "at timestamp, echo boolean, confidence double"
    creates = spark.createDataFrame(
        [("a", "new a", None, None, None, None, None, None, "user", None, T0, True, 0.9), ("n", "new n", "p", "fact", None, None, None, 2, "user", 3, T0, False, 0.3)],
        f"id string, text string, task_pattern string, kind string, tool_key string, error_signature string, resolved boolean, project_id long, scope string, user_id long, {at}",
    )
    s1 = tr.upsert_learnings(state, creates)
    assert s1.columns == columns
    got = by_id(s1)
    assert {k: v for k, v in got["b"].items()} == first["b"]
    assert got["a"]["embedding"] == [1.0] and got["a"]["salience"] == 0.25 and got["a"]["echo_count"] == 2 and got["a"]["tool_key"] == "Bash" and got["a"]["confidence"] == 0.5
    assert got["n"]["status"] == "candidate" and got["n"]["support_count"] == 1

    updates = spark.createDataFrame(
        [("b", "one", None, None, None, T0 + timedelta(1), False, 0.6), ("b", "two", "Edit", "other", False, T0 + timedelta(2), False, 0.4), ("b", None, None, None, None, T0 + timedelta(3), True, 0.99)],
        f"id string, text string, tool_key string, error_signature string, resolved boolean, {at}",
    )
    s2 = tr.update_learnings(s1, updates)
    assert s2.columns == [*columns, "demoted"] and s2.count() == 5
    b = by_id(s2)["b"]
    assert (b["text"], b["tool_key"], b["error_signature"], b["resolved"], b["support_count"], b["echo_count"], b["confidence"]) == ("two", "Edit", "other", False, 4, 2, 0.6)
    assert b["status"] == "candidate" and b["reviewed_by"] is None and b["demoted"] and b["salience"] == 0.25

    applied = spark.createDataFrame(
        [("a", "approved", "superseded_conflicts", ["c"], [], [], None, "passed", None), ("d", "blocked", None, [], [], [], None, "blocked", "secret: key"), ("b", "approved", "clean", ["c"], [], [], None, "passed", None),
         ("n", "already_learned", "already_learned", [], [], [], "b", "passed", None)],
        "candidate_id string, outcome string, consistency string, superseded array<string>, vetoed_by array<string>, unclear array<string>, restates string, safety_status string, safety_reason string",
    )
    echoes = spark.createDataFrame([("n", "b")], "candidate_id string, existing_id string")
    order = F.when(F.col("candidate_id") == "a", 9).otherwise(1)
    s3 = tr.apply_resolutions(s2, applied, echoes, F.lit(T0 + timedelta(5)), order)["learning"]
    assert set(columns) <= set(s3.columns)
    got = by_id(s3)
    assert got["c"]["status"] == "rejected" and got["c"]["rejected_reason"] == "superseded_by:a" and got["c"]["consistency_status"] == "clean" and got["c"]["embedding"] is None
    assert got["d"]["blocked_reason"] == "secret: key" and got["a"]["blocked_reason"] == "old block" and got["b"]["echo_count"] == 3
    again = tr.apply_resolutions(s3, applied, echoes, F.lit(T0), order)["learning"]
    assert by_id(again) == by_id(s3.withColumn("echo_gain", F.lit(0).cast("long")))  # nobody is a candidate any more

    decisions = spark.createDataFrame([("a", "reject", None, None)], "id string, action string, edited_text string, conflict_id string")
    s4 = tr.human_decisions(s3, spark.createDataFrame([], "from_id string, to_id string"), decisions)["learning"]
    assert s4.columns == s3.columns
    got = by_id(s4)
    assert got["a"]["rejected_reason"] == "human_review" and got["c"] == by_id(s3)["c"] and got["b"]["reviewed_by"] is None

    adds = spark.createDataFrame([(1, 7, "project", "fresh fact", "error", None, None, None, 0.7, None, T0)], "project_id long, user_id long, scope string, text string, kind string, tool_key string, error_signature string, resolved boolean, confidence double, task_pattern string, at timestamp")
    s5 = tr.add_learnings(s4, adds)
    assert s5.count() == 6 and s5.columns == s4.columns
    new = next(i for i in by_id(s5) if i.startswith("learning:"))
    s6 = tr.add_learnings(s5.withColumn("tool_key", F.when(F.col("id") == new, F.lit("kept")).otherwise(F.col("tool_key"))), adds)
    assert by_id(s6)[new]["tool_key"] == "kept" and by_id(s6)[new]["support_count"] == 2 and by_id(s6)["a"] == got["a"]


def test_activation_brings_content(spark):
    skill = spark.createDataFrame([("s", "candidate", 1, "old", True, [1.0]), ("t", "approved", 4, "stays", True, [2.0])], "skill_id string, status string, version long, content string, needs_revision boolean, embedding array<double>")
    version = spark.createDataFrame([("v1", "s", 2, "second", "pending", None, T0, [9.0]), ("v2", "s", 3, "third", "pending", None, T0 + timedelta(1), None)], "version_id string, skill_id string, version long, content string, outcome string, safety_status string, created_at timestamp, embedding array<double>")
    routes = spark.createDataFrame([("v1", "s", 2, T0, "activate", None), ("v2", "s", 3, T0 + timedelta(1), "activate", None)], "version_id string, skill_id string, version long, created_at timestamp, route string, reason string")
    sources = spark.createDataFrame([("v2", "x")], "version_id string, learning_id string")
    learn = spark.createDataFrame([("x", False, None), ("y", True, "other")], "id string, consolidated boolean, compiled_skill_id string")
    out = skills.apply_routes(routes, version, skill, sources, learn, F.lit(T0))
    got = {r.skill_id: (r.status, r.version, r.content, r.needs_revision) for r in out["skills"].collect()}
    assert got == {"s": ("approved", 3, "third", False), "t": ("approved", 4, "stays", True)}
    assert {r.id: r.compiled_skill_id for r in out["learning"].collect()} == {"x": "s", "y": "other"}


def files(spark, folder, batches, schema):
    """One file per batch, oldest first."""
    os.makedirs(folder)
    for n, rows in enumerate(batches):
        pq.write_table(spark.createDataFrame(rows, schema).toArrow(), f"{folder}/{n}.parquet")
        os.utime(f"{folder}/{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))


def test_late_rows_are_stored(spark):
    root = work_dir(spark, "late").removeprefix("file:")
    schema = "session_id long, content string, prompt_name string, target string, ts timestamp"
    batches = [[(1, f"c{n}-{i}", "base", "context", T0 + timedelta(hours=12 * n)) for i in range(5)] for n in range(25)]
    batches.append([(1, "late", "base", "context", T0 - timedelta(days=60)), (1, "c0-0", "base", "context", T0 - timedelta(days=90)), (1, "c24-1", "base", "context", T0)])
    files(spark, f"{root}/in", batches, schema)
    stream = jobs.read_folder(spark, f"{root}/in", "*.parquet", per_trigger=1)
    jobs.run_to_end(jobs.inject_once_stream(stream, f"{root}/out", f"{root}/state"))
    rows = spark.read.parquet(f"{root}/out").select("content").collect()
    assert len(rows) == 126 and len({r.content for r in rows}) == 126


def test_links_of_either_order_and_any_delay(spark):
    root = work_dir(spark, "sides").removeprefix("file:")
    inj = "session_id long, hook_event string, injected_at timestamp, prompt string, injection_id long, learning_id long"
    evt = "session_id long, event_name string, ts timestamp, prompt string, event_id long"
    name = "UserPromptSubmit"
    files(spark, f"{root}/i", [[(1, name, T0 + timedelta(seconds=60), None, 1, 1)], [(2, name, T0, None, 2, 1)], [(1, name, T0 + timedelta(seconds=90), "p", 3, 1)]], inj)
    files(spark, f"{root}/e", [[(3, name, T0, "q", 9)], [(1, name, T0, "p", 10)], [(1, name, T0 + timedelta(days=9), "p", 11), (2, name, T0 - timedelta(seconds=119), "p", 12), (2, name, T0 - timedelta(seconds=121), "p", 13)]], evt)
    read = lambda side: jobs.read_folder(spark, f"{root}/{side}", "*.parquet", per_trigger=1)
    jobs.run_to_end(jobs.link_stream(read("i"), read("e"), f"{root}/out", f"{root}/state"))
    got = {(r.injection_id, r.event_id) for r in jobs.read_links(spark, f"{root}/out").collect()}
    assert got == {(1, 10), (2, 12), (3, 10)}


def test_a_human_approval_brings_content_and_compiles(spark):
    accepted = spark.createDataFrame(
        [("p1", 1, "create", None, "deploy", "f1", T0, "Deploy", "how", "steps", ["x", "y", "x"], ["e"]), ("p2", 1, "ignore", None, None, "f2", T0, None, None, None, ["z"], [])],
        "proposal_id string, project_id long, action string, skill_id string, slug string, fingerprint string, at timestamp, name string, description string, content string, derived_from array<string>, informed_by array<string>",
    )
    versions = spark.createDataFrame([], "skill_id string")
    out = skills.write_proposals(accepted, versions, versions)
    made = out["versions"].first()
    assert (made.version_id, made.name, made.content, made.outcome) == ("skill:1:deploy:v1", "Deploy", "steps", "pending")
    assert {(r.learning_id, r.kind) for r in out["provenance"].collect()} == {("x", "DERIVED_FROM"), ("y", "DERIVED_FROM"), ("e", "INFORMED_BY")}

    skill = spark.createDataFrame([("skill:1:deploy", "candidate", None, True, None), ("other", "candidate", "old", True, [1.0])], "skill_id string, status string, content string, needs_revision boolean, embedding array<double>")
    pending = out["versions"].withColumn("embedding", F.array(F.lit(2.0)))
    learn = spark.createDataFrame([("x", False), ("q", False)], "id string, consolidated boolean")
    acts = spark.createDataFrame([("skill:1:deploy", "edit_approve", "better steps"), ("other", "approve", None)], "skill_id string, action string, edited_content string")
    derived = spark.createDataFrame([], "skill_id string, learning_id string")
    got = skills.human_skill_decisions(acts, skill, pending, derived, out["provenance"].filter("kind = 'DERIVED_FROM'").select("version_id", "learning_id"), learn, F.lit(T0))
    rows = {r.skill_id: r for r in got["skills"].collect()}
    assert (rows["skill:1:deploy"].status, rows["skill:1:deploy"].content, rows["skill:1:deploy"].name, rows["skill:1:deploy"].embedding) == ("approved", "better steps", "Deploy", [2.0])
    assert (rows["other"].status, rows["other"].content, rows["other"].embedding) == ("candidate", "old", [1.0])  # nothing is pending there
    assert {r.id: r.compiled_skill_id for r in got["learning"].collect()} == {"x": "skill:1:deploy", "q": None}


def test_tree_windows_in_many_batches_equal_one(spark):
    parents = {3: 0, 4: 0, 5: 4, 6: 1}
    edges = spark.createDataFrame([(c, parents.get(c)) for c in range(7)], "child long, parent long")
    tops = windows.roots(edges)
    rows = [(i % 7, i, T0 + timedelta(minutes=i), "Stop" if i % 11 == 0 else "PostToolUse") for i in range(300)]
    schema = "session_id long, event_id long, ts timestamp, event_name string"
    batch = {(r.event_id, r.window_no) for r in windows.tree_windows(spark.createDataFrame(rows, schema), tops, 9).filter("window_no is not null").collect()}
    top = {0: 0, 3: 0, 4: 0, 5: 0, 1: 1, 6: 1, 2: 2}
    waiting, number, want = {}, {}, set()
    for session, event, _, name in rows:
        root = top[session]
        waiting.setdefault(root, []).append(event)
        if name == "Stop" and session == root:
            number[root] = number.get(root, 0) + 1
            want |= {(e, number[root]) for e in waiting[root][:9]}
            waiting[root] = waiting[root][9:]
    assert batch == want
    folder = work_dir(spark, "tree").removeprefix("file:")
    files(spark, f"{folder}/in", [rows[i: i + 60] for i in range(0, 300, 60)], schema)
    stream = jobs.read_folder(spark, f"{folder}/in", "*.parquet", per_trigger=1)
    jobs.run_to_end(jobs.windows_stream(stream, f"{folder}/out", f"{folder}/state", 9, tops))
    assert {(r.event_id, r.window_no) for r in spark.read.parquet(f"{folder}/out").collect()} == want
