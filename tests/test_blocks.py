"""The block index against plain search, and what it leaves out."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelore.operators import graph, similarity
from tracelore.operators.blocks import SLICE_ROWS, BlockIndex, best_in_rows, multiplier


def clustered(spark, n, clusters, dims=16, seed=1, spread=0.05):
    """Rows around a few directions, a group with most of them, a third of that group one and the same vector, and a zero vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    rows = []
    for i in range(n):
        v = centres[i % clusters] + spread * rng.normal(size=dims) if i % 3 else centres[0]
        rows.append((i, "big" if i % 10 else "small", [float(x) for x in v] if i != 77 else [0.0] * dims))
    rows.append((n, "big", None))
    return rows, spark.createDataFrame(rows, "id long, g string, embedding array<float>").repartition(4)


def plain(rows, k, floor=None, keyed=True):
    out = {}
    live = [(i, g, np.array(v, np.float32).astype(float)) for i, g, v in rows if v is not None]
    unit = {i: v / (np.linalg.norm(v) or 1) for i, _, v in live}
    for i, g, _ in live:
        hits = [(-round(float(unit[i] @ unit[j]), 6), j) for j, h, _ in live if j != i and (g == h or not keyed)]
        out[i] = [j for s, j in sorted(hits)[:k] if floor is None or -s >= floor]
    return out


@pytest.mark.parametrize("keys", [["g"], []])
def test_nearest_through_blocks(spark, keys):
    rows, df = clustered(spark, 400, 12)
    got = similarity.nearest(df, df, keys, 5, query_id="id", query_vec="embedding", skip_self=True, block_rows=30).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["q_id"], r["rank"])):
        found.setdefault(r["q_id"], []).append(r["r_id"])
    want = plain(rows, 5, keyed=bool(keys))
    # Copies and the zero vector tie by cosine to six places, so only the cosines must agree there.
    assert found == want


def test_blocks_are_bounded_and_few_are_visited(spark):
    _, df = clustered(spark, 1500, 40, seed=2)
    big = df.filter("g = 'big'")
    index = BlockIndex(big, ["g"], block_rows=60)
    sizes = [r["n"] for r in index.blocks.collect()]
    assert max(sizes) <= 60 and sum(sizes) == big.filter("embedding is not null").count()
    asked = big.filter("id % 7 = 1 and id <> 77")
    hits = index.nearest(asked, ["g"], 3, "id", "embedding", skip_self=True)
    assert hits.count() == 3 * asked.filter("embedding is not null").count()
    assert 0 < index.work["visited"] < 0.3 * index.work["grid"]


def test_pairs_through_blocks(spark):
    _, df = clustered(spark, 300, 10, seed=3)
    plain_pairs = {(r["source"], r["target"]): round(r["similarity"], 6) for r in similarity.pairs_above(df, ["g"], 0.9).collect()}
    cut_pairs = {(r["source"], r["target"]): round(r["similarity"], 6) for r in similarity.pairs_above(df, ["g"], 0.9, block_rows=25).collect()}
    assert plain_pairs and plain_pairs == cut_pairs


def test_pruning_inside_the_products(spark):
    _, df = clustered(spark, 260, 6, seed=4, spread=0.3)
    rows = df.withColumn("project_id", F.col("g"))
    for block in (25, 4096):
        every = similarity.pairs_above(df, ["g"], 0.5, block_rows=block)
        few = similarity.pairs_above(df, ["g"], 0.5, block_rows=block, per_end=3)
        edges = [p.join(rows.select(F.col("id").alias("source"), "project_id"), "source") for p in (every, few)]
        kept = [{(r["source"], r["target"]) for r in graph.prune_edges(e, 3).collect()} for e in edges]
        assert kept[0] == kept[1] and few.count() < every.count()


def test_boosted_search_through_blocks(spark):
    rng = np.random.default_rng(6)
    _, df = clustered(spark, 300, 8, seed=6, spread=0.4)
    boost = {i: float(rng.random()) for i in range(301)}
    asked = df.filter("id % 11 = 1")

    def best(block):
        found = {}
        for r in similarity.nearest_boosted(asked, df, ["g"], 4, 0.1, 0.5, "id", "id", "embedding", block_rows=block).collect():
            found.setdefault(r["q_id"], []).append((-round(r["cos"] * (1 + 0.5 * boost[r["r_id"]]), 6), r["r_id"]))
        return {q: sorted(v)[:4] for q, v in found.items()}

    assert best(20) == best(4096)


def test_best_in_rows_breaks_ties_by_id():
    score = np.array([[1.0, 1.0, 0.5, 1.0], [0.0, 0.0, 0.0, 0.0]])
    qi, ri = best_in_rows(score, np.array([[True, True, True, True], [True, False, True, True]]), np.array([9, 3, 1, 5]), 2)
    assert list(zip(qi.tolist(), ri.tolist())) == [(0, 1), (0, 3), (1, 2), (1, 3)]


def test_a_product_is_held_a_few_rows_at_a_time():
    """Two blocks of 2500 rows: 50 MB of cosines, and several times that in what is picked from them, are never held at once."""
    rng = np.random.default_rng(5)
    q, r = rng.normal(size=(2500, 8)), rng.normal(size=(2500, 8))
    left, right = pd.DataFrame({"q_id": range(2500), "q_vec": list(q)}), pd.DataFrame({"r_id": range(2500), "r_vec": list(r)})
    heights = []

    def pick(cos, q_ids, r_ids):
        heights.append(len(cos))
        return best_in_rows(np.round(cos, 6), q_ids[:, None] != r_ids[None, :], r_ids, 3)

    tracemalloc.start()
    got = multiplier(pick)(left, right)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(heights) <= SLICE_ROWS and sum(heights) == 2500 and most < 50e6
    cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (r / np.linalg.norm(r, axis=1, keepdims=True)).T
    np.fill_diagonal(cos, -np.inf)
    best = np.argsort(-cos, axis=1)[:, :3]
    assert got["q_id"].tolist() == np.repeat(range(2500), 3).tolist() and got["r_id"].tolist() == best.ravel().tolist()
    np.testing.assert_allclose(got["cos"], np.take_along_axis(cos, best, 1).ravel())
