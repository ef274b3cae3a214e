"""Exact vector search: nearest rows per query and all pairs above a floor.

Queries and rows meet inside a group (project, scope, ...; no key is one group). The rows of a small group are one block, and a
group's product is one task that emits only what qualifies. A group beyond a block, which may hold a third of all rows, is cut
into blocks of rows that lie close together (``blocks.BlockIndex``), of which a query visits only those that can still matter. No
pair that fails is ever emitted, no row is left out, and no task grows with its group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelore.operators.blocks import SLACK, BlockIndex, best_in_rows, multiplier
from tracelore.operators.segments import top_per_key
from tracelore.session import shuffled, stored

BLOCK_ROWS = 4096


def _sides(rows: DataFrame, keys: Sequence[str], row_vec: str, block_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of the groups of one block, rows of larger groups or None). The larger groups, at most rows / block_rows of them, are a
    small table that is written first, so that the split costs no shuffle of vectors."""
    shaped = rows.filter(F.size(row_vec) > 0).withColumn("__dim", F.size(row_vec))
    group = [*keys, "__dim"]
    sizes = shaped.groupBy(*group).agg(F.count("*").alias("__n")).filter(F.col("__n") > block_rows)
    large = stored(sizes.select(*group), "large-groups")
    if large.isEmpty():
        return shaped, None
    return shaped.join(large, group, "left_anti"), shaped.join(large, group, "left_semi").drop("__dim")


def _product(queries: DataFrame, rows: DataFrame, keys: Sequence[str], query_id: str, row_id: str, query_vec: str, row_vec: str, block_rows: int, pick: Callable) -> DataFrame:
    """What ``pick`` takes from the products of small groups; a group's queries are dealt over chunks of at most ``block_rows``."""
    group = [*keys, "__dim"]
    q = queries.filter(F.size(query_vec) > 0).withColumn("__dim", F.size(query_vec))
    # At most queries / block_rows lines.
    sizes = F.broadcast(q.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(block_rows)).alias("__chunks")).filter("__chunks > 1"))
    left, right = [f"q_{i}" for i in range(len(group) + 1)], [f"r_{i}" for i in range(len(group) + 1)]
    q = q.join(sizes, group, "left").withColumn("__chunk", F.pmod(F.xxhash64(query_id), F.coalesce("__chunks", F.lit(1))))
    r = rows.join(sizes, group, "left").withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__chunks", F.lit(1)) - 1)))
    q = q.select(*[F.col(c).alias(a) for c, a in zip([*group, "__chunk"], left)], F.col(query_id).alias("q_id"), F.col(query_vec).alias("q_vec"))
    r = r.select(*[F.col(c).alias(a) for c, a in zip([*group, "__chunk"], right)], F.col(row_id).alias("r_id"), F.col(row_vec).alias("r_vec"))
    types = {**dict(q.dtypes), **dict(r.dtypes)}
    return q.groupBy(*left).cogroup(r.groupBy(*right)).applyInPandas(multiplier(pick), f"q_id {types['q_id']}, r_id {types['r_id']}, cos double")


def nearest(
    queries: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    k: int,
    query_id: str = "request_id",
    row_id: str = "id",
    query_vec: str = "vector",
    row_vec: str = "embedding",
    floor: float | None = None,
    skip_self: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(q_id, r_id, cos, rank): the ``k`` most similar rows per query within ``keys``,
    ordered by cosine to six places, then id. ``floor`` drops what lies below it first."""

    def pick(cos, q_ids, r_ids):
        allowed = np.ones(cos.shape, dtype=bool) if floor is None else cos >= floor
        if skip_self:
            allowed &= q_ids[:, None] != r_ids[None, :]
        return best_in_rows(np.round(cos, 6), allowed, r_ids, k)

    small, large = _sides(rows, keys, row_vec, block_rows)
    hits = _product(queries, small, keys, query_id, row_id, query_vec, row_vec, block_rows, pick)
    if large is not None:
        index = BlockIndex(large, keys, row_id, row_vec, block_rows)
        hits = hits.unionByName(index.nearest(queries, keys, k, query_id, query_vec, floor, skip_self).drop("rank"))
    return top_per_key(hits, ["q_id"], [F.round("cos", 6).desc(), F.col("r_id").asc()], k)


def nearest_boosted(
    queries: DataFrame, rows: DataFrame, keys: Sequence[str], k: int, floor: float, weight: float,
    query_id: str = "request_id", row_id: str = "id", query_vec: str = "vector", row_vec: str = "embedding", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(q_id, r_id, cos): all rows above the floor that may be among the ``k`` best by cosine times (1 + weight x boost), boosts from 0 to
    1. One that stays below the k-th plain cosine even with a full boost cannot be."""
    bar = (1.0 + floor) / 2.0

    def pick(cos, q_ids, r_ids):
        near = np.round((1.0 + cos) / 2.0, 7) >= bar
        if cos.shape[1] > k:
            last = np.partition(cos, -k, axis=1)[:, -k][:, None]
            near &= (cos * (1.0 + weight) >= last - SLACK) | (last <= 0)
        return np.nonzero(near)

    small, large = _sides(rows, keys, row_vec, block_rows)
    hits = _product(queries, small, keys, query_id, row_id, query_vec, row_vec, block_rows, pick)
    if large is not None:
        index = BlockIndex(large, keys, row_id, row_vec, block_rows)
        best = index.nearest(queries, keys, k, query_id, query_vec)
        last = best.filter((F.col("rank") == k) & (F.col("cos") > 0)).select("q_id", ((F.col("cos") - SLACK) / (1.0 + weight)).alias("last"))
        bars = queries.select(F.col(query_id).alias("q_id")).join(shuffled(last), "q_id", "left").select("q_id", F.greatest(F.lit(floor - SLACK), F.coalesce("last", F.lit(-2.0))).alias("bar"))
        hits = hits.unionByName(index.reaching(queries, keys, query_id, query_vec, bars, pick))
    return hits


def pairs_above(
    rows: DataFrame,
    keys: Sequence[str],
    floor: float,
    row_id: str = "id",
    row_vec: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    per_end: int | None = None,
) -> DataFrame:
    """(source, target, similarity) for every pair source < target of a group whose
    (1 + cosine) / 2, rounded to seven places, clears the floor. With ``per_end`` only pairs that may be among
    so many best of either end are told: a product keeps the best of each of its rows, so a dense group costs rows times ``per_end``."""
    bar = (1.0 + floor) / 2.0

    def pick(cos, q_ids, r_ids):
        good = (np.round((1.0 + cos) / 2.0, 7) >= bar) & (q_ids[:, None] != r_ids[None, :])
        return np.nonzero(good) if per_end is None else best_in_rows(np.round(cos, 6), good, r_ids, per_end)

    small, large = _sides(rows, keys, row_vec, block_rows)
    hits = _product(rows, small, keys, row_id, row_id, row_vec, row_vec, block_rows, pick)
    if large is not None:
        hits = hits.unionByName(BlockIndex(large, keys, row_id, row_vec, block_rows).pairs(floor, pick))
    if per_end is not None:
        hits = hits.select(F.least("q_id", "r_id").alias("q_id"), F.greatest("q_id", "r_id").alias("r_id"), "cos").dropDuplicates(["q_id", "r_id"])
    return hits.filter("q_id < r_id").select(F.col("q_id").alias("source"), F.col("r_id").alias("target"), F.col("cos").alias("similarity"))
