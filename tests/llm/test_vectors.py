"""Vector links against brute force on the given vectors and on odd ones."""

import math

import numpy as np

from tracelore.llm import vector_links as v

FOLDER = "/root/testdata/sf0.001"


def brute(rows, threshold=v.THRESHOLD):
    """rows: (vec_id, label, vector) -> list of (vec_id, n_links, component_id)."""
    def fine(label, x):
        return label is not None and x is not None and len(x) and all(c is not None and math.isfinite(c) for c in x) and any(x)

    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = {}
    for i, (_, label, x) in enumerate(rows):
        if fine(label, x):
            keys.setdefault((label, len(x)), []).append(i)
    for at in keys.values():
        m = np.array([rows[i][2] for i in at], dtype=np.float64)
        m /= np.abs(m).max(axis=1, keepdims=True)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        s = m @ m.T >= threshold
        for a, i in enumerate(at):
            for b, j in enumerate(at):
                if a != b and s[a, b]:
                    n[i] += 1
                    parent[find(i)] = find(j)
    low = {}
    for i, (d, _, _) in enumerate(rows):
        r = find(i)
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return sorted(str((d, n[i], low[find(i)])) for i, (d, _, _) in enumerate(rows))


def got(df):
    return sorted(str((r["vec_id"], r["n_links"], r["component_id"])) for r in v.vector_links(df).collect())


def test_given(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    out = v.vector_links(df).collect()
    assert sorted(str((r["vec_id"], r["n_links"], r["component_id"])) for r in out) == brute([(r["vec_id"], r["label"], r["embedding"]) for r in df.collect()])
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


def test_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 0, [1.0, 0.0]), (2, 0, [2.0, 0.0]), (3, 0, [1.0, 0.1]), (4, 1, [1.0, 0.0]), (5, None, [1.0, 0.0]), (6, 0, None), (7, 0, [0.0, 0.0]), (8, 0, [nan, 1.0]), (9, 0, [inf, 1.0]),
        (10, 0, [None, 1.0]), (11, 0, []), (12, 0, [1.0, 0.0, 0.0]), (None, 0, [0.0, 1.0]), (13, 0, [0.0, 1.0]), (None, 2, [1.0]), (1, 0, [1.0, 0.0]), (14, 0, [-0.0, 1.0]), (15, 0, [1e-30, 1e-38]), (16, 0, [1e38, 1.0]),
    ]
    df = spark.createDataFrame([(a, b, c) for a, b, c in rows], "vec_id long, label int, embedding array<float>").selectExpr("*", "'x' as cid", "'y' as n_links", "1 as m")
    assert got(df) == brute([(r["vec_id"], r["label"], r["embedding"]) for r in df.collect()])
    assert v.vector_links(df.limit(0)).count() == 0


def test_cut_cells(spark, monkeypatch):
    """Families of near copies in cells and chunks far smaller than the families; few links may be missed, none invented."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    rows = [(i, int(i % 2), (base[i % 12] + rng.normal(scale=0.06, size=16)).tolist()) for i in range(400)] + [(i, 0, rng.normal(size=16).tolist()) for i in range(400, 700)]
    monkeypatch.setattr(v, "CELL", 60)
    monkeypatch.setattr(v, "CHUNK", 40)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = {eval(x)[0]: eval(x)[1] for x in brute(rows)}
    have = {r["vec_id"]: r["n_links"] for r in v.vector_links(df).collect()}
    assert all(have[i] <= want[i] for i in want)
    assert sum(have.values()) >= 0.97 * sum(want.values())


def test_recall_notices_a_loss(spark):
    rows = [(i, 0, 1, 1, [1.0, i / 1000]) for i in range(20)]
    distinct = spark.createDataFrame([(a, b, 2, c, e) for a, b, c, _, e in rows], "cid long, label int, dim int, m long, embedding array<double>")
    none = spark.createDataFrame([], "a long, b long, n long")
    full = spark.createDataFrame([(i, i, 19) for i in range(20)], "a long, b long, n long")
    assert v.recall(distinct, none, 0.93) == 0.0 and v.recall(distinct, full, 0.93) == 1.0


def test_robust_pruning():
    x = np.array([[1.0, 0.0], [0.999, 0.045], [0.99, 0.14], [0.0, 1.0]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = v.robust_pruned(x, degree=3, alpha=1.2)
    assert near[0, 1] and not near[0, 0] and near.sum(axis=1).max() <= 3
    assert not near[3, 0]  # the nearer ones stand for it


def test_floor_holds_at_every_width(spark, monkeypatch):
    """An index that loses all small pairs: neither its width nor a large group of near copies with many links lets it pass."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=32)
    rows = [(i, 0, (base + rng.normal(scale=0.01, size=32)).tolist()) for i in range(200)]
    for i in range(200, 500, 2):
        x = rng.normal(size=32)
        rows += [(i, 0, x.tolist()), (i + 1, 0, (x + rng.normal(scale=0.01, size=32)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    whole, widths = v.index_links, []

    def lossy(distinct, threshold, overlap, beam):
        widths.append(overlap)
        return whole(distinct, threshold, overlap, beam).filter("n >= 100 or a <> b")

    monkeypatch.setattr(v, "index_links", lossy)
    monkeypatch.setattr(v, "BLOCK", 150)
    assert got(df) == brute(rows)
    assert widths == [3, 6, 12, 24]


def test_audit_without_enough_links_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, 0, rng.normal(size=24).tolist()) for i in range(600)]
    rows += [(600 + i, 0, [x + 0.001 for x in rows[i][2]]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    monkeypatch.setattr(v, "AUDIT", 8)
    monkeypatch.setattr(v, "DRAWN", 64, raising=False)
    monkeypatch.setattr(v, "index_links", lambda distinct, *_: distinct.selectExpr("cid as a", "cid as b", "m as n").limit(0))
    assert got(df) == brute(rows)


def test_centres_sample_large_labels_only(spark, monkeypatch):
    rows = [(i, 0 if i < 400 else 1 + i // 10, 2, 1, [1.0, i / 5000]) for i in range(3000)]
    distinct = spark.createDataFrame(rows, "cid long, label int, dim int, m long, embedding array<double>")
    frame, collected = type(distinct), []
    collect = frame.collect

    def spy(df):
        out = collect(df)
        collected.append(len(out))
        return out

    monkeypatch.setattr(frame, "collect", spy)
    assert list(v.fit_centres(distinct)) == [("0", 2)]
    assert max(collected) == 400
