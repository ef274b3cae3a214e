"""Embedding near-duplicates over a robust-pruned flat graph.

Vectors with the same label and values are one node with a count. Each label's nodes are dealt to their ``OVERLAP`` nearest
centres (spherical k-means on a bounded sample); a cell larger than ``CHUNK`` is cut into chunks. Every chunk builds a
robust-pruned graph; a node's adjacency lists from its overlapping cells are united. In each cell all nodes are
queries: a beam search walks greedily from the chunk's medoids (and from the query's own node where it is in the chunk), then expands
every node in range to its neighbours until nothing new is in range. Chunk pairs of a cell are searched once, and a pair found in
several cells counts in the first they share. Similarities are double-precision cosines of the stored vectors, so what is
reported is exact; what may be missed is measured: ``audit`` draws queries until ``AUDIT`` of them have links by brute force, and
the index is rebuilt with a wider overlap and beam while ``recall`` over those is below ``FLOOR``. Where the widest is still below,
or so few nodes have links that the audit can't judge, all products of a label's vectors are made.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with
nothing; vectors of unlike length never link; repeated rows count as other vectors; a null vec_id is no smallest id unless its
component has no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelore.llm.base import hash_share, publish
from tracelore.llm.components import Groups, components

THRESHOLD = 0.93
#: Nodes for which a centre is made, and at most in a chunk.
CELL, CHUNK = 384, 768
OVERLAP = 3
#: Vectors that centres are fitted on, and centres in all: about so many reach the driver and the tasks.
SAMPLE, MAX_CENTRES = 20_000, 4096
DEGREE, ALPHA, BEAM, MEDOIDS = 24, 1.2, 32, 8
#: Queries with links in the recall audit, and the recall below which the index is widened.
AUDIT, FLOOR = 64, 0.97
#: Queries that the audit draws at most, and nodes for which a block of exact products is made.
DRAWN, BLOCK = 4096, 2048


def nodes(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, label, dim, cid, embedding): cid hashes label and values, null where the vector links with nothing. A 64-bit
    collision would take two vectors for copies; below a billion vectors that is unlikely."""
    v = F.col("embedding")
    fine = F.col("label").isNotNull() & F.coalesce(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)
    )
    plain = F.transform(v, lambda x: x.cast("double") + F.lit(0.0))
    return vectors.select("vec_id", "label", plain.alias("embedding")).withColumn("fine", fine).select(
        "vec_id", F.when(F.col("fine"), F.col("label")).alias("label"), F.when(F.col("fine"), F.size("embedding")).alias("dim"),
        F.when(F.col("fine"), F.xxhash64("label", "embedding")).alias("cid"), F.when(F.col("fine"), F.col("embedding")).alias("embedding"),
    )


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centres(x: np.ndarray, k: int) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(4):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
    return c


def fit_centres(distinct: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Centres of each (label, dim) with more than ``CELL`` nodes; others are one cell."""
    large = distinct.groupBy("label", "dim").count().filter(F.col("count") > CELL).orderBy(F.desc("count"), "label", "dim").limit(MAX_CENTRES // 2).collect()
    if not large:
        return {}
    total = sum(r["count"] for r in large)
    share = min(1.0, SAMPLE / total)
    # Only vectors of the pairs that get centres come to the driver.
    kept = distinct.sparkSession.createDataFrame([(r["label"], r["dim"]) for r in large], distinct.select("label", "dim").schema)
    rows = distinct.join(kept, ["label", "dim"], "left_semi").filter(hash_share("cid", seed=3) < share).select(F.col("label").cast("string").alias("label"), "dim", "cid", "embedding").orderBy("cid").collect()
    picked: dict[tuple[str, int], list] = {}
    for r in rows:
        picked.setdefault((r["label"], r["dim"]), []).append(r["embedding"])
    scale = min(1.0, MAX_CENTRES / (total / CELL + len(large)))
    return {
        key: _centres(_unit(picked[key]), max(2, int(-(-r["count"] // CELL) * scale)))
        for r in large if len(picked.get(key := (str(r["label"]), r["dim"]), ())) > 1
    }


def _assign(centres: dict[tuple[str, int], np.ndarray], overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells: list[list[int]] = [[0]] * len(pdf)
            for key, at in pdf.groupby([pdf["label"].astype(str), "dim"]).indices.items():
                c = centres.get((key[0], int(key[1])))
                if c is not None:
                    sims = _unit(pdf["embedding"].iloc[at]) @ c.T
                    order = np.argsort(-sims, axis=1, kind="stable")[:, :overlap]
                    for row, own in zip(at, order, strict=True):
                        cells[row] = sorted(own.tolist())
            yield pdf.assign(cells=cells)

    return run


def robust_pruned(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Boolean adjacency: each node takes its nearest candidate, drops the candidates that are nearer to that one by the factor
    alpha than to itself, and goes on, ``degree`` times at most. All nodes go in step."""
    d = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ x.T)))
    np.fill_diagonal(d, np.inf)
    open_ = np.isfinite(d)
    out = np.zeros_like(open_)
    each = np.arange(len(x))
    for _ in range(min(degree, len(x) - 1)):
        best = np.where(open_, d, np.inf).argmin(axis=1)
        some = open_[each, best]
        if not some.any():
            break
        out[each[some], best[some]] = True
        open_[each, best] = False
        open_ &= ~((alpha * d[best] <= d) & some[:, None])
    return out


def _graph(pdf: pd.DataFrame) -> pd.DataFrame:
    ids = pdf["cid"].to_numpy()
    near = robust_pruned(_unit(pdf["embedding"]))
    return pd.DataFrame({"cid": ids, "near": [ids[row].tolist() for row in near]})


def medoids(x: np.ndarray, count: int = MEDOIDS) -> np.ndarray:
    """The node nearest to the mean, then nodes farthest from those chosen."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    far = x @ x[chosen[0]]
    for _ in range(min(count, len(x)) - 1):
        chosen.append(int(far.argmin()))
        far = np.maximum(far, x @ x[chosen[-1]])
    return np.array(chosen)


def range_search(q: np.ndarray, x: np.ndarray, near: np.ndarray, starts: np.ndarray, threshold: float, beam: int = BEAM) -> np.ndarray:
    """Boolean (queries, nodes): nodes found with cosine >= threshold. ``starts``: (queries, nodes) entry points. All queries go in step."""
    seen, spent = starts.copy(), np.zeros_like(starts)
    sims = np.full(seen.shape, -2.0)

    def look(new: np.ndarray) -> None:
        a, b = np.nonzero(new)
        for i in range(0, len(a), 1 << 15):
            s = slice(i, i + (1 << 15))
            sims[a[s], b[s]] = np.einsum("ij,ij->i", q[a[s]], x[b[s]])

    look(seen)
    step = near.astype(np.float32)
    live = np.arange(len(q))
    beam = min(beam, x.shape[0])
    while len(live):
        s = np.where(seen[live], sims[live], -2.0)
        bar = np.partition(s, -beam, axis=1)[:, -beam]
        s[spent[live]] = -2.0
        best = s.argmax(axis=1)
        go = s[np.arange(len(live)), best] >= np.maximum(bar, -1.5)
        live, best = live[go], best[go]
        spent[live, best] = True
        new = near[best] & ~seen[live]
        full = np.zeros_like(seen)
        full[live] = new
        look(full)
        seen[live] |= new
    spent[:] = False
    while True:
        grow = (sims >= threshold) & ~spent
        rows = np.nonzero(grow.any(axis=1))[0]
        if not len(rows):
            return sims >= threshold
        spent[rows] |= grow[rows]
        new = ((grow[rows].astype(np.float32) @ step) > 0) & ~seen[rows]
        full = np.zeros_like(seen)
        full[rows] = new
        look(full)
        seen |= full


def _search(threshold: float, beam: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cell, i, j = key[2:]
        graph = pdf[pdf["in_graph"]]
        ask = graph if i == j else pdf[~pdf["in_graph"]]
        if not len(ask) or len(graph) + len(ask) * (i != j) < 2:
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype({"a": "int64", "b": "int64", "n": "int64"})
        x, q = _unit(graph["embedding"]), _unit(ask["embedding"])
        at = {c: k for k, c in enumerate(graph["cid"])}
        near = np.zeros((len(x), len(x)), dtype=bool)
        for k, to in enumerate(graph["near"]):
            local = [at[c] for c in to if c in at]
            near[k, local] = near[local, k] = True
        starts = np.zeros((len(q), len(x)), dtype=bool)
        starts[:, medoids(x)] = True
        if i == j:
            np.fill_diagonal(starts, True)
        hit = range_search(q, x, near, starts, threshold, beam)
        if i == j:
            hit |= hit.T
            np.fill_diagonal(hit, False)
        rows, cols = np.nonzero(hit)
        # A pair counts in the smallest cell that both are in.
        mine, theirs = ask["cells"].tolist(), graph["cells"].tolist()
        if len(rows):
            sets_a, sets_b = [set(c) for c in mine], [set(c) for c in theirs]
            first = np.array([min(sets_a[a] & sets_b[b]) == cell for a, b in zip(rows, cols, strict=True)])
            rows, cols = rows[first], cols[first]
        a_ids, b_ids = ask["cid"].to_numpy(), graph["cid"].to_numpy()
        a_n, b_n = ask["m"].to_numpy(), graph["m"].to_numpy()
        links = np.zeros(len(a_ids), dtype=np.int64)
        np.add.at(links, rows, b_n[cols])
        out = [(a_ids, a_ids, links)]
        if i != j:
            back = np.zeros(len(b_ids), dtype=np.int64)
            np.add.at(back, cols, a_n[rows])
            out.append((b_ids, b_ids, back))
        chain = _chains(a_ids[rows], b_ids[cols])
        out.append((chain[:, 0], chain[:, 1], np.zeros(len(chain), dtype=np.int64)))
        res = pd.DataFrame({"a": np.concatenate([o[0] for o in out]), "b": np.concatenate([o[1] for o in out]), "n": np.concatenate([o[2] for o in out])})
        return res[(res["n"] > 0) | (res["a"] != res["b"])]

    return run


def _chains(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Links that chain each group of linked ids, two per member at most."""
    groups = Groups()
    for u, v in zip(a.tolist(), b.tolist(), strict=True):
        groups.join(u, v)
    return np.array(groups.chains(), dtype=np.int64).reshape(-1, 2)


def index_links(distinct: DataFrame, threshold: float, overlap: int, beam: int) -> DataFrame:
    """(a, b, n): a = b: a node's number of linked vectors found in one task; a <> b: chains through linked nodes."""
    centres = fit_centres(distinct)
    kind = distinct.schema["label"].dataType.simpleString()
    dealt = distinct.mapInPandas(_assign(centres, overlap), f"cid long, label {kind}, dim int, m long, embedding array<double>, cells array<int>")
    members = publish(dealt.withColumn("cell", F.explode("cells")), "cells")
    sizes = publish(members.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("k")), "cell-sizes")
    placed = members.join(sizes, ["label", "dim", "cell"]).withColumn("i", F.pmod(F.xxhash64("cid", "cell"), F.col("k")).cast("int"))
    near = placed.groupBy("label", "dim", "cell", "i").applyInPandas(_graph, "cid long, near array<long>")
    united = publish(near.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "adjacency")
    known = placed.join(united, "cid")
    key = ["label", "dim", "cell"]
    tree = known.select(*key, "i", F.explode(F.sequence("i", F.col("k") - 1)).alias("j"), "cid", "m", "embedding", "cells", "near", F.lit(True).alias("in_graph"))
    none = F.lit(None).cast("array<bigint>")
    asks = placed.filter("k > 1").select(*key, F.explode(F.sequence(F.lit(0), F.col("i"))).alias("g"), F.col("i").alias("j"), "cid", "m", "embedding", "cells", none.alias("near"), F.lit(False).alias("in_graph")).filter("g < j").withColumnRenamed("g", "i")
    return publish(tree.unionByName(asks).groupBy(*key, "i", "j").applyInPandas(_search(threshold, beam), "a long, b long, n long"), "vector-links")


def audit(distinct: DataFrame, threshold: float, queries: int = AUDIT) -> DataFrame | None:
    """(cid, want): nodes drawn by hash that have links, with all their links by brute force. More are drawn until ``queries`` of
    them have links or the table is drawn whole; None where ``DRAWN`` nodes hold fewer."""
    total = distinct.count()
    drawn = queries
    while True:
        asked = distinct.filter(hash_share("cid", seed=5) < min(1.0, drawn / max(1, total))).select(F.col("label").cast("string").alias("label"), "dim", "cid", "embedding").collect()
        want = publish(_links_of(distinct, asked, threshold), "audit")
        if drawn >= total or want.count() >= queries:
            return want
        if drawn >= DRAWN:
            return None
        drawn = min(DRAWN, 8 * drawn)


def _links_of(distinct: DataFrame, asked: list, threshold: float) -> DataFrame:
    by: dict[tuple[str, int], list] = {}
    for r in asked:
        by.setdefault((r["label"], r["dim"]), []).append(r)
    ready = {k: (_unit([r["embedding"] for r in v]), np.array([r["cid"] for r in v])) for k, v in by.items()}

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, n = [], []
            for key, at in pdf.groupby([pdf["label"].astype(str), "dim"]).indices.items():
                if (key[0], int(key[1])) in ready:
                    q, names = ready[key[0], int(key[1])]
                    for i in range(0, len(at), CHUNK):
                        part = pdf.iloc[at[i: i + CHUNK]]
                        hit = (q @ _unit(part["embedding"]).T >= threshold) & (names[:, None] != part["cid"].to_numpy()[None, :])
                        links = hit @ part["m"].to_numpy()
                        ids += names[links > 0].tolist()
                        n += links[links > 0].tolist()
            yield pd.DataFrame({"cid": pd.Series(ids, dtype="int64"), "want": pd.Series(n, dtype="int64")})

    return distinct.mapInPandas(compare, "cid long, want long").groupBy("cid").agg(F.sum("want").alias("want"))


def recall(distinct: DataFrame, found: DataFrame, threshold: float, queries: int = AUDIT, want: DataFrame | None = None) -> float:
    """Mean share of its links that an audited node (``want``, by default drawn here) has in ``found``. Nodes are taken by the power
    of two of their links and the lowest mean counts, so a large group of near copies doesn't hide the loss of small pairs."""
    if want is None and (want := audit(distinct, threshold, queries)) is None:
        return 0.0
    have = found.filter("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("have"))
    share = F.least("want", F.coalesce("have", F.lit(0))) / F.col("want")
    row = want.join(have, "cid", "left").groupBy(F.floor(F.log2("want"))).agg(F.avg(share).alias("mean")).agg(F.min("mean").alias("least")).first()
    return 1.0 if row["least"] is None else float(row["least"])


def _components(hit: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray) -> np.ndarray:
    """Chains through the linked ids of a block of products."""
    out = []
    seen = np.zeros(len(a_ids), dtype=bool)
    open_cols = np.ones(len(b_ids), dtype=bool)
    for r in np.nonzero(hit.any(axis=1))[0]:
        if seen[r]:
            continue
        rows, ids = np.array([r]), []
        while len(rows):
            seen[rows] = True
            cols = np.nonzero(hit[rows].any(axis=0) & open_cols)[0]
            open_cols[cols] = False
            ids += [a_ids[rows], b_ids[cols]]
            rows = np.nonzero(hit[:, cols].any(axis=1) & ~seen)[0]
        chain = np.unique(np.concatenate(ids))
        out.append(np.column_stack([chain[:-1], chain[1:]]))
    return np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)


def _products(threshold: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key[2:]
        x = pdf[pdf["part"] == i]
        y = x if i == j else pdf[pdf["part"] == j]
        a_ids, b_ids = x["cid"].to_numpy(), y["cid"].to_numpy()
        if len(x) and len(y):
            hit = _unit(x["embedding"]) @ _unit(y["embedding"]).T >= threshold
        else:
            hit = np.zeros((len(x), len(y)), dtype=bool)
        if i == j:
            hit |= hit.T
            np.fill_diagonal(hit, False)
        links = [(a_ids, hit @ y["m"].to_numpy())]
        if i != j:
            links.append((b_ids, hit.T @ x["m"].to_numpy()))
        chain = _components(hit, a_ids, b_ids)
        ids, n = np.concatenate([k for k, _ in links]), np.concatenate([k for _, k in links])
        res = pd.DataFrame({"a": np.concatenate([ids, chain[:, 0]]), "b": np.concatenate([ids, chain[:, 1]]), "n": np.concatenate([n, np.zeros(len(chain), dtype=np.int64)])})
        return res[(res["n"] > 0) | (res["a"] != res["b"])]

    return run


def exact_links(distinct: DataFrame, threshold: float) -> DataFrame:
    """As ``index_links``, by the products of all pairs of a label's blocks: nothing is missed, work grows with the square of a label."""
    sizes = publish(distinct.groupBy("label", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k")), "label-sizes")
    placed = distinct.join(sizes, ["label", "dim"]).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("label", "dim", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "cid", "m", "embedding")
    return publish(dealt.groupBy("label", "dim", "i", "j").applyInPandas(_products(threshold), "a long, b long, n long"), "vector-links")


def all_links(distinct: DataFrame, threshold: float) -> DataFrame:
    """Links of the narrowest index that passes the audit, or exact ones where none does or the audit finds too few links to judge."""
    want = audit(distinct, threshold)
    overlap, beam = OVERLAP, BEAM
    while want is not None and overlap <= 8 * OVERLAP:
        found = index_links(distinct, threshold, overlap, beam)
        if recall(distinct, found, threshold, want=want) >= FLOOR:
            return found
        overlap, beam = 2 * overlap, 2 * beam
    return exact_links(distinct, threshold)


def vector_links(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, label, embedding)."""
    rows = nodes(vectors)
    grouped = rows.filter("cid is not null").groupBy("cid").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.count("*").alias("m"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("low"))
    stored = publish(grouped, "vectors")
    distinct = stored.drop("low")
    found = all_links(distinct, threshold)
    counts = found.filter("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    roots = components(found.filter("a <> b")).withColumnRenamed("node", "cid")
    named = stored.select("cid", "m", "low").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    known = publish(named.join(lowest, "root").join(counts, "cid", "left").select("cid", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"), "vector-components")
    out = rows.select("vec_id", "cid").join(known, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
