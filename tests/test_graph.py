from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tracelore.operators import graph, patterns, recall

NOW = datetime(2024, 6, 1)


def hours(n):
    return NOW - timedelta(hours=n)


def test_seed_weights_age_by_sessions(spark):
    learn = spark.createDataFrame([("a", 1, hours(200)), ("b", 1, hours(5)), ("c", 1, None), ("old", 1, hours(4320))], "id string, project_id long, created_at timestamp")
    edits = spark.createDataFrame(
        [("a", "PRODUCED_LEARNING", hours(25), False), ("a", "UPDATED_LEARNING", hours(1), False), ("a", "UPDATED_LEARNING", hours(1), True), ("b", "UPDATED_LEARNING", hours(2), False)],
        "learning_id string, kind string, at timestamp, echo boolean",
    )
    none = spark.createDataFrame([], "learning_id string, at timestamp, echo boolean")
    starts = spark.createDataFrame([(1, hours(h)) for h in (30, 20, 10)], "project_id long, created_at timestamp")
    got = {r.id: round(r.bias, 9) for r in graph.seed_weights(learn, edits, none, starts).collect()}
    assert got == {"a": round(2 * 0.9**2 + 1, 9), "b": 3.0, "old": round(2 * 0.9**3, 9)}


def test_group_edges(spark):
    rows = [(1, "g", m) for m in "abc"] + [(1, "h", "a")] + [(1, "big", f"n{i}") for i in range(60)] + [(1, "u", "a"), (1, "u", "zz")]
    nodes = spark.createDataFrame([(1, m) for m in "abc"] + [(1, f"n{i}") for i in range(60)], "project_id long, node string")
    got = {(r.a, r.b): r.w for r in graph.group_edges(spark.createDataFrame(rows, "project_id long, group_id string, member string"), nodes).collect()}
    assert got == {("a", "b"): 0.5, ("a", "c"): 0.5, ("b", "c"): 0.5}


def test_groups_of_any_size_are_paired_whole(spark, monkeypatch):
    """Without a limit the members of every group meet, however many chunks they are dealt over, and each pair once."""
    sizes = {"g": 2, "h": 1, "big": 60, "large": 131}
    rows = [(1, g, f"n{i:03d}") for g, n in sizes.items() for i in range(n)] + [(2, "g", "n000"), (1, "big", "unknown")]
    nodes = spark.createDataFrame([(p, f"n{i:03d}") for p in (1, 2) for i in range(140)], "project_id long, node string")
    groups = spark.createDataFrame(rows + rows[:9], "project_id long, group_id string, member string")
    want = Counter()
    for n in sizes.values():
        want.update({(1, f"n{i:03d}", f"n{j:03d}"): 1 / (n - 1) for j in range(n) for i in range(j)})
    for most in (1024, 25):
        monkeypatch.setattr(graph, "PAIR_ROWS", most)
        got = graph.group_edges(groups, nodes, max_size=None).collect()
        assert len(got) == len(want) and all(abs(r.w - want[r.project_id, r.a, r.b]) < 1e-9 for r in got)


def test_pagerank(spark):
    nodes = ["seed", "hop1", "hop2", "island"]
    edges = [("seed", "hop1", 2.0), ("hop1", "hop2", 0.5)]
    n = spark.createDataFrame([(1, x) for x in nodes] + [(2, "quiet")], "project_id long, node string")
    e = spark.createDataFrame([(1, *x) for x in edges], "project_id long, a string, b string, w double")
    s = spark.createDataFrame([(1, "seed", 3.0), (1, "island", 1.0)], "project_id long, id string, bias double")
    scores = graph.personalized_pagerank(n, e, s)
    got = {r.node: r.score for r in scores.collect()}
    # By hand: s = 0.375 + 0.4 h, h = 0.5 s + 0.5 t, t = 0.1 h, and half of 1/4 stays on the island.
    want = {"seed": 0.475, "hop1": 0.25, "hop2": 0.025, "island": 0.125, "quiet": 0.0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    norm = {r.node: r.salience for r in graph.normalize(scores).collect()}
    assert norm["seed"] == 1.0 and norm["quiet"] == 0.0


def test_prune_and_components(spark):
    rows = [(1, "a", "hub", 0.9), (1, "b", "hub", 0.8), (1, "c", "hub", 0.7), (1, "c", "d", 0.66)]
    edges = spark.createDataFrame(rows, "project_id long, source string, target string, similarity double")
    kept = {(r.source, r.target) for r in graph.prune_edges(edges, 1).collect()}
    assert kept == {("a", "hub"), ("b", "hub"), ("c", "hub"), ("c", "d")}
    chain = spark.createDataFrame([(1, f"n{i:02d}", f"n{i + 1:02d}", 1.0) for i in range(12)] + [(1, "x", "y", 1.0)], edges.schema)
    roots = {r.node: r.root for r in graph.connected_components(chain).collect()}
    assert set(roots.values()) == {"n00", "x"} and roots["n12"] == "n00" and roots["y"] == "x"


def test_review_batches(spark):
    members = [("a", 0, True, 1), ("b", 0, False, 1), ("e", 2, False, 5), ("f", 2, False, 5), ("c", 1, True, 9), ("d", 1, True, 9), ("s", 3, False, 9)]
    m = spark.createDataFrame([(1, *x) for x in members], "project_id long, node string, community long, reviewed boolean, learning_count long")
    e = spark.createDataFrame([(1, "a", "b", 0.9), (1, "e", "f", 0.9), (1, "c", "d", 0.9)], "project_id long, source string, target string, similarity double")
    got = {}
    for r in graph.review_batches(m, e).orderBy("batch", "position").collect():
        got.setdefault(r.batch, []).append(r.node)
    assert list(got.values()) == [["e", "f"], ["b", "a"]]


def test_label_lookup_follows_tombstones(spark):
    rows = [("p1", "live one", "active", None), ("p2", "old two", "merged", "p3"), ("p3", "old three", "merged", "p1"), ("p4", "loop", "merged", "p5"), ("p5", "loop b", "merged", "p4"), ("p6", "lost", "merged", "gone")]
    p = spark.createDataFrame([(1, *x) for x in rows], "project_id long, id string, normalized string, status string, merged_into string")
    a = spark.createDataFrame([(1, "p1", "nick")], "project_id long, id string, label string")
    got = {r.label: r.pattern_id for r in patterns.label_lookup(p, a).collect()}
    assert got == {"live one": "p1", "nick": "p1", "old two": "p1", "old three": "p1"}


def test_votes_by_products_equal_votes_over_edges(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 6))
    rows = [(i, 0 if i % 4 else 1 + i % 3, [float(x) for x in centres[i % 4] + 0.4 * rng.normal(size=6)]) for i in range(90)]
    rows += [(100 + i, 0, [0.0] * 6 if i == 0 else rows[1][2]) for i in range(12)] + [(200, 0, None), (201, 0, [1.0, 2.0]), (202, 9, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, project_id long, embedding array<float>").withColumn("status", F.lit("active"))
    key = lambda found: sorted((r.project_id, r.node, r.label) for r in found.collect())
    want = key(graph.vote_communities(recall.pattern_edges(df, 0.3), 3))
    assert len(want) > 90 and max(Counter((p, label) for p, _, label in want).values()) > 8
    for chunk in (8, 4096):
        assert key(graph.vote_by_products(df, 0.3, 3, chunk=chunk)) == want


def test_a_vote_tells_one_line_per_node_whatever_the_pairs():
    same = pd.DataFrame({"project_id": 1, "__dim": 2, "__qc": 0, "__rc": "many:0", "node": range(300), "vec": [[1.0, 2.0]] * 300})
    told = pd.DataFrame({"project_id": 1, "__dim": 2, "__qc": 0, "__rc": "many:0", "r_node": range(300), "label": range(300), "r_vec": [[1.0, 2.0]] * 300})
    lines = graph.voter(0.3)(same, told)
    assert lines["node"].tolist() == list(range(300)) and lines["label"].tolist() == [1] + [0] * 299
