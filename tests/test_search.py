import math
import random
import re

import numpy as np

from tracelore.functions.text import keyword_terms, tokens
from tracelore.operators import blocks, keyword, recall, similarity
from pyspark.sql import functions as F


def vectors(spark, n, dims=6, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, 0 if i % 3 == 0 else i % 4, [float(x) for x in rng.normal(size=dims)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, g long, embedding array<float>")


def cosine(a, b):
    a, b = np.array(a, dtype=np.float32).astype(float), np.array(b, dtype=np.float32).astype(float)
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


def test_nearest_is_exact_whatever_the_blocks(spark):
    rows, df = vectors(spark, 60)
    want = {}
    for i, g, v in rows:
        hits = sorted(((-round(cosine(v, w), 6), j) for j, h, w in rows if h == g and j != i))[:4]
        want[i] = [j for _, j in hits]
    for block in (5, 4096):
        got = similarity.nearest(df, df, ["g"], 4, query_id="id", query_vec="embedding", skip_self=True, block_rows=block).collect()
        found = {}
        for r in sorted(got, key=lambda r: r["rank"]):
            found.setdefault(r.q_id, []).append(r.r_id)
        assert found == want


def test_pairs_at_the_floor_count(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [0.8, 0.6]), (3, 0, [0.0, 1.0]), (4, 1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, g long, embedding array<float>")
    got = {(r.source, r.target) for r in similarity.pairs_above(df, ["g"], 0.8, block_rows=1).collect()}
    assert got == {(1, 2)}


def test_unequal_dimensions_never_meet(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0, 0.0])], "id long, g long, embedding array<float>")
    assert similarity.pairs_above(df, ["g"], -1.0).isEmpty()


def test_keyword_bound_loses_nothing(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(12)]
    weight = [2 ** (12 - i) for i in range(12)]
    docs = [(i, 0 if i % 3 == 0 else 1, " ".join(rng.choices(words, weight, k=rng.randint(3, 14)))) for i in range(90)]
    asks = [(1000 + i, i % 2, " ".join(rng.choices(words, k=4))) for i in range(20)]
    d = spark.createDataFrame(docs, "id long, g long, text string")
    q = spark.createDataFrame(asks, "request_id long, g long, query string")
    terms = keyword.query_terms(q, "request_id", "query", ["g"])
    key = lambda rows: sorted((r.q_id, r["rank"], r.r_id, round(r.score, 6)) for r in rows)
    whole = keyword.KeywordIndex(d, "id", "text", ["g"])
    plain = whole.top(terms, 5).collect()
    assert whole.work["read"] == whole.work["all"]
    for block in (1, 3):
        index = keyword.KeywordIndex(d, "id", "text", ["g"], block=block)
        assert key(index.top(terms, 5).collect()) == key(plain)
        assert index.work["read"] < index.work["all"]
    # Against the formula.
    toks = {i: (g, t.split()) for i, g, t in docs}
    avg = sum(len(t) for _, t in toks.values()) / len(toks)
    df = {w: sum(w in t for _, t in toks.values()) for w in words}

    def score(query, i):
        t = toks[i][1]
        return sum(
            math.log(1 + (len(toks) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avg))
            for w in dict.fromkeys(query.split()) if w in t
        )

    for rid, g, text in asks:
        want = sorted(((-round(score(text, i), 6), i) for i in toks if toks[i][0] == g and score(text, i) > 0))[:5]
        assert [r.r_id for r in sorted(plain, key=lambda r: r["rank"]) if r.q_id == rid] == [i for _, i in want]


def test_common_terms_are_hardly_read(spark):
    """A word that all rows share pairs with a few blocks of them, and the filters count in the bound."""
    rng = random.Random(8)
    docs = [(i, 0, "common " * rng.randint(1, 3) + f"rare{i % 40} filler{i % 7}", "live" if i % 2 else "dead") for i in range(2000)]
    d = spark.createDataFrame(docs, "id long, g long, text string, state string")
    q = spark.createDataFrame([(i, 0, f"common rare{i} filler{i % 7}") for i in range(30)], "request_id long, g long, query string")
    terms = keyword.query_terms(q, "request_id", "query", ["g"])
    few, whole = (keyword.KeywordIndex(d, "id", "text", ["g"], ["state"], block=b) for b in (16, 4096))
    key = lambda rows: sorted((r.q_id, r["rank"], r.r_id, round(r.score, 6)) for r in rows)
    keep = F.col("state") == "live"
    allow = lambda pairs: pairs.filter((F.col("q_id") + F.col("doc_id")) % 3 != 0)
    for args in ((3, keep, None, True), (5, keep, allow, False)):
        assert key(few.top(terms, *args).collect()) == key(whole.top(terms, *args).collect())
    assert few.work["read"] < 0.25 * few.work["all"]


def test_terms(spark):
    row = spark.range(1).select(keyword_terms(F.lit("The cat, the CAT and ab a-dog42!")).alias("k"), tokens(F.lit("x yz abc")).alias("t")).first()
    assert row.k == ["the", "cat", "and", "dog42"] and row.t == ["abc"]


def test_a_search_writes_no_line_per_query_and_posting(spark, monkeypatch):
    """Rows that share all words with all queries: what a search writes follows queries and hits, not their product."""
    d = spark.range(1200).selectExpr("id", "id % 1 as g", "concat('alpha beta gamma delta word', id % 50) as text")
    index = keyword.KeywordIndex(d, "id", "text", ["g"], block=4)
    written, plain = [], keyword.stored

    def counted(df, name):
        out = plain(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(keyword, "stored", counted)
    terms = keyword.query_terms(d.filter("id < 200").selectExpr("id as request_id", "g", "text as query"), "request_id", "query", ["g"])
    hits = index.top(terms, 3, skip_self=True, allow=lambda pairs: pairs.filter("(q_id + doc_id) % 5 > 0"))
    assert hits.count() == 600 and hits.filter("q_id = r_id or (q_id + r_id) % 5 = 0").isEmpty()
    assert max(written) <= 200 * 6 * 4


def test_words_and_ids_of_a_search_are_not_sent_through_the_driver(spark, monkeypatch):
    plans = []

    def recorded(df, name):
        out = keep(df, name)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    keep = keyword.stored
    monkeypatch.setattr(keyword, "stored", recorded)
    docs = spark.createDataFrame([(i, 0, f"common word{i % 7} other{i % 3}") for i in range(60)], "id long, g long, text string")
    asks = spark.createDataFrame([(100 + i, 0, 7, f"common word{i}") for i in range(5)], "request_id long, g long, session_id long, query string")
    served = spark.createDataFrame([(7, i) for i in range(0, 60, 2)], "session_id long, r_id long")
    allow = lambda pairs: recall.drop_served(pairs, asks, served, "doc_id")
    found = keyword.KeywordIndex(docs, "id", "text", ["g"]).top(keyword.query_terms(asks, "request_id", "query", ["g"]), 5, allow=allow)
    got = found.collect()
    assert len(got) == 25 and all(r.r_id % 2 for r in got)
    joins = [line for plan in [*plans, found._jdf.queryExecution().executedPlan().toString()] for line in plan.splitlines() if "Join" in line]
    assert any("term#" in line for line in joins) and any("q_id#" in line for line in joins) and any("__session#" in line for line in joins)
    assert [line for line in joins if "Broadcast" in line and any(c in line for c in ("[term#", "[q_id#", "[__session#"))] == []


def test_hits_and_visits_of_a_vector_search_are_not_sent_through_the_driver(spark, monkeypatch, tmp_path):
    """Files small enough to be broadcast: what has a line per query, hit or row is joined by a shuffle all the same."""
    plans = []

    def recorded(df, name):
        out = keep(df, name)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    keep = blocks.stored
    for module in (blocks, similarity):
        monkeypatch.setattr(module, "stored", recorded)
    monkeypatch.setattr(similarity.nearest, "__defaults__", (*similarity.nearest.__defaults__[:-1], 16))
    vectors = [(i, 7, i % 10, [float(i % 7), float(i % 11), 1.0], "approved" if i % 3 else "rejected", "project", False, i / 120, f"common word{i % 7}") for i in range(120)]
    spark.createDataFrame(
        vectors, "id long, project_id long, user_id long, embedding array<double>, status string, scope string, consolidated boolean, confidence double, text string"
    ).withColumn("task_pattern", F.lit("Task")).withColumn("session_id", F.lit(1)).write.parquet(f"{tmp_path}/facts")
    facts = spark.read.parquet(f"{tmp_path}/facts")
    asks = facts.selectExpr("id as request_id", "project_id", "user_id", "session_id", "text as query", "embedding as vector")
    hits = recall.hybrid(asks, facts, ["project_id"], 5, branches=["vector"], salience=facts.selectExpr("id", "confidence as salience"), weight=0.1)
    plans.append(hits._jdf.queryExecution().executedPlan().toString())
    assert hits.count() > 300
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line]
    assert any("SortMergeJoin" in line and "r_id#" in line for line in joins) and any("SortMergeJoin" in line and "q_id#" in line for line in joins)
    assert [line for line in joins if "Broadcast" in line and re.search(r"\b(q_id|r_id|id)#", line.split("]")[0])] == []
