"""Shell words, key constraints, prompt snapshots, snapshots of projects and users."""

import shlex
from datetime import datetime

from pyspark.sql import functions as F

from tracelore.functions.tools import command_tokens
from tracelore.operators import audit, events
from tracelore.operators.transitions import constraint_report
from tracelore.sources.keys import MODEL_KEYS

COMMANDS = [
    "cat src/part1.py --verbose", "echo 'it is' \"a \\\"b\\\" c\"", "a'b c'd\"e f\"g", "x\\ y z", "''", "a '' b", "  lead  and\ttabs\nlines ", "open 'quote here", 'open "quote \\" x', "end with \\",
    "grep -r \"it's\" 'say \"hi\"' .", "\"back \\\\ slash \\n stays\"", "'no \\ escapes'", "", "é 'ü ö' \U0001F600", "a\\'b c", "echo $(ls | wc) > out.txt; rm -rf x",
]


def shell(command):
    try:
        return shlex.split(command)
    except ValueError:
        return command.split()


def test_shell_words(spark):
    many = COMMANDS + ["w'" + "x" * 5000 + "' " + " ".join(f"'q {i}'\\ {i}" for i in range(800))]
    df = spark.createDataFrame([(c,) for c in many], "c string").select("c", command_tokens(F.col("c")).alias("t"))
    for row in df.collect():
        assert row["t"] == shell(row["c"]), row["c"][:60]


def test_one_row_per_violated_constraint(spark):
    def ids(*values):
        return spark.createDataFrame([(v,) for v in values], "id string")

    got = {r["constraint"]: (r["n_keys"], r["n_rows"], r["missing"], r["first_key"]) for r in constraint_report({
        "Learning.id": ids("a", "b", "a", "c", "c", "c"), "Skill.id": ids("a", "b"), "Turn.id": ids("x", None), "Account.slug": ids("s", "s", None, None), "Tool.id": ids()}).collect()}
    assert got == {"Learning.id": (2, 5, 0, "a"), "Turn.id": (0, 1, 1, None), "Account.slug": (1, 4, 2, "s")}
    assert len(MODEL_KEYS) == len(set(MODEL_KEYS)) == 29


def test_prompt_snapshot_archives_and_folds(spark):
    at, now = datetime(2026, 1, 1), F.lit("2026-06-16 12:00:00").cast("timestamp")
    prompts = spark.createDataFrame([("default", "old", 1, None, at, None), ("calm", "same", 4, "seed", at, None)], "name string, content string, version long, last_source string, created_at timestamp, updated_at timestamp")
    versions = spark.createDataFrame([], "id string, name string, version long, content string, source string, created_at timestamp, is_current boolean, archived_at timestamp, model string, session_id string, folded_count long, supersedes long")
    updates = spark.createDataFrame([("default", "You are the refined agent.", "m", "session-1")], "name string, content string, model string, session_id string")
    folds = spark.createDataFrame([("default", "abc"), ("default", "def"), ("default", "gone"), ("calm", "xyz")], "name string, learning_id string")
    facts = spark.createDataFrame([("abc", "candidate", False), ("def", "approved", False), ("xyz", "approved", False)], "id string, status string, consolidated boolean")
    out = audit.snapshot_prompts(prompts, versions, updates, folds, facts, now)
    history = {r["id"]: r for r in out["versions"].collect()}
    assert set(history) == {"default:v1", "default:v2"}
    assert (history["default:v1"].content, history["default:v1"].is_current, history["default:v1"].source) == ("old", False, "seed") and history["default:v1"].archived_at
    assert (history["default:v2"].is_current, history["default:v2"].folded_count, history["default:v2"].supersedes, history["default:v2"].session_id) == (True, 3, 1, "session-1")
    state = {r["name"]: (r.content, r.version, r.last_source) for r in out["prompts"].collect()}
    assert state == {"default": ("You are the refined agent.", 2, "consolidation"), "calm": ("same", 4, "seed")}
    flags = {r.id: (r.status, r.consolidated, r.consolidated_prompt_version, r.last_consolidated_model) for r in out["learnings"].collect()}
    assert flags == {"abc": ("candidate", True, 2, "m"), "def": ("approved", True, 2, "m"), "xyz": ("approved", False, None, None)}
    assert {tuple(r) for r in out["edges"].collect()} == {("default:v2", "abc"), ("default:v2", "def")}
    # Again over its own result: version 2 is archived as it is, version 3 is current.
    again = audit.snapshot_prompts(out["prompts"], out["versions"], updates.withColumn("content", F.lit("third")), folds.limit(0), facts, now)
    assert {(r["version"], r["is_current"], r["source"]) for r in again["versions"].collect()} == {(1, False, "seed"), (2, False, "consolidation"), (3, True, "consolidation")}


def test_earlier_projects_and_users_stay(spark):
    rows = [("p", "s", "u", "web", datetime(2026, 1, 2), 2), ("q", "s2", "u", None, datetime(2026, 1, 3), 3)]
    touches = spark.createDataFrame(rows, "project_id string, session_id string, user_id string, source string, ts timestamp, event_id long")
    old = spark.createDataFrame([("p", datetime(2026, 1, 1), datetime(2026, 1, 1), "cli", "cli"), ("gone", datetime(2025, 1, 1), datetime(2025, 1, 1), "cli", "cli")], "project_id string, created_at timestamp, last_activity_at timestamp, source string, last_source string")
    out = events.merge_sessions({"project": old}, touches)["project"].collect()
    assert {(r.project_id, r.source, r.last_source, r.created_at.day, r.last_activity_at.day) for r in out} == {("p", "cli", "web", 1, 2), ("gone", "cli", "cli", 1, 1), ("q", None, None, 3, 3)}


def test_each_text_is_embedded_once(spark):
    from tracelore.functions import embedding as emb

    def vectors(texts):
        assert len(texts) == len(set(texts)) and not {"old", " "} & set(texts)
        return [None if x == "no vector" else [float(len(x))] for x in texts]

    def rows(schema, *values):
        return spark.createDataFrame(list(values), schema)

    texts = emb.memory_texts(
        rows("id long, text string", (1, "same"), (2, "same"), (3, "old"), (4, " "), (5, "no vector"), (6, None)), rows("id long, title string, narrative string", (7, "same", None), (8, "a", "b")),
        rows("id long, text string", (9, "same")), rows("skill_id string, name string, description string, content string", ("s", "n", "", "c")))
    store = spark.createDataFrame([(emb_key, [9.0]) for emb_key in [__import__("hashlib").sha256(b"old").hexdigest()]], "text_key string, embedding array<float>")
    full = emb.fill_store(store, texts.repartition(1), vectors)
    got = {(r["kind"], r["id"]): r["embedding"] for r in emb.look_up(texts, full).collect()}
    assert got == {("learning", "1"): [4.0], ("learning", "2"): [4.0], ("learning", "3"): [9.0], ("learning", "4"): None, ("learning", "5"): None, ("learning", "6"): None,
                   ("observation", "7"): [4.0], ("observation", "8"): [3.0], ("pattern", "9"): [4.0], ("skill", "s"): [3.0]}
    assert full.count() == 4
    assert emb.fill_store(full, texts.filter("text <> 'no vector'"), lambda texts: 1 / 0).count() == 4
