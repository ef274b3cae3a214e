"""A metric block index: exact vector search that leaves out blocks that cannot matter.

Rows of a group (project, scope, ...; or no key at all) are cut into blocks of at most ``block_rows`` rows that lie close together:
cells that are too large are divided around up to ``FANOUT`` centres, again and again, so a group of any size takes a number of rounds in the
logarithm of its size, and every piece of work is one bounded block. Each block keeps its centre and its radius (the widest angle
to a row). By the triangle inequality of angles no row of a block has a cosine to a query above
cos(angle to the centre - radius). A query visits the block with the best bound first, then a few more, then all whose bound reaches the
k-th cosine found; the others are never multiplied. On data without clusters all blocks are visited, which is the
full grid; nothing is ever left out of a result.

``BlockIndex.work`` counts what was done: pairs of query and block multiplied, and the pairs of the full grid.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelore.operators.segments import top_per_key
from tracelore.session import shuffled, stored

FANOUT = 32
#: Rows per centre that a cell's centres are fitted on.
PER_CENTRE = 32
FIT_ROUNDS = 6
#: A cell that is still too large after so many divisions is cut by hash.
LEVELS = 12
#: Blocks visited before the bounds of all others are weighed, by round.
FIRST_VISITS = (1, 8)
#: Cosines are compared to six places, so a bound this much lower may still tie.
SLACK = 2e-6
#: Rows of one side multiplied at a time. A product holds so many rows times a block, whatever ``pick`` makes of it.
SLICE_ROWS = 256


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Rows scaled to length one; a zero row stays zero."""
    matrix = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def best_in_rows(score: np.ndarray, allowed: np.ndarray, r_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` highest scores among the allowed, ties to the smaller id."""
    ranked = np.where(allowed, score, -np.inf)
    if ranked.shape[1] > k:
        last = np.partition(ranked, -k, axis=1)[:, -k][:, None]
        allowed = allowed & (ranked >= last)
    qi, ri = np.nonzero(allowed)
    place = np.empty(len(r_ids), dtype=np.int64)
    place[np.argsort(r_ids, kind="stable")] = np.arange(len(r_ids))
    order = np.lexsort((place[ri], -ranked[qi, ri], qi))
    qi, ri = qi[order], ri[order]
    first = np.searchsorted(qi, qi)
    near = np.arange(len(qi)) - first < k
    return qi[near], ri[near]


def _centres(unit: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` centres on the unit sphere: far-apart rows, then a few rounds of means."""
    centres = unit[:1]
    near = unit @ centres[0]
    while len(centres) < n:
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-9:
            break
        centres = np.vstack([centres, unit[far]])
        near = np.maximum(near, unit @ unit[far])
    for _ in range(FIT_ROUNDS if len(centres) > 1 else 0):
        at = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def _chunks(rows: DataFrame, group: Sequence[str], most: int) -> DataFrame:
    """(group, __chunks): ceil(n / most) for groups beyond ``most``. At most rows / ``most`` lines, so it may be sent to all tasks at any size."""
    return F.broadcast(rows.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(most)).alias("__chunks")).filter("__chunks > 1"))


def in_chunks(rows: DataFrame, group: Sequence[str], id_col: str, most: int, name: str) -> DataFrame:
    """Add ``name``, which deals the rows of a group over ceil(n / most) chunks by the id's hash."""
    return rows.join(_chunks(rows, group, most), list(group), "left").withColumn(name, F.pmod(F.xxhash64(id_col), F.coalesce("__chunks", F.lit(1)))).drop("__chunks")


def per_chunk(rows: DataFrame, other: DataFrame, group: Sequence[str], most: int, name: str) -> DataFrame:
    """``rows`` once for every chunk into which ``in_chunks`` deals ``other``'s rows of their group. A null in the group meets nothing."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__chunks", F.lit(1)) - 1))
    return rows.dropna(subset=list(group)).join(_chunks(other, group, most), list(group), "left").withColumn(name, every).drop("__chunks")


class BlockIndex:
    """Blocks over the rows of ``rows`` with equal ``keys`` and dimension; rows without a vector are left out."""

    def __init__(self, rows: DataFrame, keys: Sequence[str], row_id: str = "id", row_vec: str = "embedding", block_rows: int = 4096):
        self.block_rows = block_rows
        self.group = [f"__k{i}" for i in range(len(keys))] + ["__dim"]
        self.work = {"visited": 0, "grid": 0}
        base = self._shaped(rows, keys, row_id, row_vec, "r_id", "r_vec")
        self.members = self._divided(base)
        self.blocks = stored(self._described(), "blocks")

    def _shaped(self, rows: DataFrame, keys: Sequence[str], row_id: str, row_vec: str, new_id: str, new_vec: str) -> DataFrame:
        return rows.filter(F.size(row_vec) > 0).select(
            *[F.col(k).alias(g) for k, g in zip(keys, self.group)], F.size(row_vec).alias("__dim"), F.col(row_id).alias(new_id), F.col(row_vec).alias(new_vec)
        ).dropna(subset=self.group[:-1])

    # --- building -------------------------------------------------------------
    def _divided(self, base: DataFrame) -> DataFrame:
        group, cell = self.group, [*self.group, "__block"]
        open_ = base.withColumn("__block", F.lit(""))
        done = None
        for level in range(LEVELS + 1):
            open_ = stored(open_, "cells")
            sizes = open_.groupBy(*cell).agg(F.count("*").alias("__n"))
            large = stored(sizes.filter(F.col("__n") > self.block_rows), "large-cells")
            small = open_.join(large.select(*cell), cell, "left_anti")
            done = small if done is None else done.unionByName(small)
            if large.isEmpty():
                return stored(done.select(*group, "__block", "r_id", "r_vec"), "members") if level else done
            open_ = self._split(open_.join(large, cell), large, level)
        raise AssertionError("cut by hash at the last level")

    def _split(self, rows: DataFrame, large: DataFrame, level: int) -> DataFrame:
        """Each cell's rows around its centres; a cell whose sample is one point, and any at the last level, is cut by hash."""
        cell, most = [*self.group, "__block"], self.block_rows
        types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        cell_schema = ", ".join(f"`{c}` {types[c]}" for c in cell)
        wanted = F.least(F.lit(FANOUT), F.greatest(F.lit(2), F.ceil(F.col("__n") * 2 / most)))
        by_hash = F.concat("__block", F.lit("#"), F.pmod(F.xxhash64("r_id", F.lit(level)), F.ceil(F.col("__n") * 2 / most)).cast("string"))
        if level == LEVELS - 1:
            return rows.withColumn("__block", by_hash).drop("__n")
        drawn = top_per_key(rows.withColumn("__wanted", wanted), cell, [F.xxhash64("r_id", F.lit(level)).asc(), F.col("r_id").asc()], FANOUT * PER_CENTRE, "__rank")

        def fit(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("__rank")
            centres = _centres(unit_rows(part["r_vec"]), int(part["__wanted"].iloc[0]))
            if len(centres) < 2:
                return pd.DataFrame(columns=[*cell, "__child", "__centre"])
            return pd.DataFrame({**{c: [part[c].iloc[0]] * len(centres) for c in cell}, "__child": range(len(centres)), "__centre": list(centres)})

        centres = stored(drawn.drop("__n").groupBy(*cell).applyInPandas(fit, f"{cell_schema}, __child int, __centre array<double>"), "centres")
        divided = centres.select(*cell).distinct()
        rest = rows.join(divided, cell, "left_anti").withColumn("__block", by_hash).drop("__n")
        rows = rows.join(divided, cell, "left_semi").withColumn("__chunk", F.pmod(F.xxhash64("r_id"), F.ceil(F.col("__n") / most)))
        chunks = large.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("__n") / most) - 1)))
        given = centres.join(chunks.select(*cell, "__chunk"), cell)
        new = [f"c_{c}" for c in [*cell, "__chunk"]]
        given = given.select(*[F.col(c).alias(n) for c, n in zip([*cell, "__chunk"], new)], "__child", "__centre")
        out = [*cell, "r_id", "r_vec"]

        def assign(part: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
            if part.empty:
                return part[out]
            child = np.argmax(unit_rows(part["r_vec"]) @ np.vstack(around["__centre"]).T, axis=1)
            names = around["__child"].to_numpy()[child].astype(str)
            return part.assign(__block=[f"{b}/{c}" for b, c in zip(part["__block"], names)])[out]

        moved = rows.groupBy(*cell, "__chunk").cogroup(given.groupBy(*new)).applyInPandas(assign, ", ".join(f"`{c}` {types[c]}" for c in out))
        return moved.unionByName(rest.select(*out))

    def _described(self) -> DataFrame:
        cell = [*self.group, "__block"]
        types = {f.name: f.dataType.simpleString() for f in self.members.schema.fields}

        def describe(part: pd.DataFrame) -> pd.DataFrame:
            unit = unit_rows(part["r_vec"])
            zero = ~unit.any(axis=1)
            mean = unit.sum(axis=0)
            length = np.linalg.norm(mean)
            centre = mean / length if length > 1e-12 else unit[0]
            widest = math.pi if zero.all() or not centre.any() else float(np.arccos(np.clip((unit[~zero] @ centre).min(), -1, 1)))
            return pd.DataFrame({**{c: [part[c].iloc[0]] for c in cell}, "centre": [centre], "radius": [widest], "has_zero": [bool(zero.any())], "n": [len(part)]})

        schema = ", ".join(f"`{c}` {types[c]}" for c in cell) + ", centre array<double>, radius double, has_zero boolean, n long"
        return self.members.groupBy(*cell).applyInPandas(describe, schema)

    # --- searching ------------------------------------------------------------
    def _pairs(self, queries: DataFrame, pick: Callable[[np.ndarray, pd.DataFrame], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """(group, q_id, __block, bound) of the pairs ``pick(bound, queries)`` takes from the grid of query chunks and block-table chunks."""
        group = self.group
        asked = per_chunk(in_chunks(queries, group, "q_id", self.block_rows, "__qc"), self.blocks, group, self.block_rows, "__bc")
        table = per_chunk(in_chunks(self.blocks, group, "__block", self.block_rows, "__bc"), queries, group, self.block_rows, "__qc")
        grid = [*group, "__qc", "__bc"]
        new = [f"b_{c}" for c in grid]
        table = table.select(*[F.col(c).alias(n) for c, n in zip(grid, new)], "__block", "centre", "radius", "has_zero")
        types = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
        schema = ", ".join(f"`{c}` {types[c]}" for c in group) + f", q_id {types['q_id']}, __block string, bound double"

        def bound(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame(columns=[*group, "q_id", "__block", "bound"])
            units, centres, radius, zero = unit_rows(left["q_vec"]), np.vstack(right["centre"]).T, right["radius"].to_numpy(), right["has_zero"].to_numpy()
            taken = []
            for at in range(0, len(units), SLICE_ROWS):
                unit = units[at:at + SLICE_ROWS]
                best = np.cos(np.clip(np.arccos(np.clip(unit @ centres, -1, 1)) - radius, 0, math.pi))
                best = np.where(zero, np.maximum(best, 0), best)
                best[~unit.any(axis=1)] = 0.0
                qi, bi = pick(best, left.iloc[at:at + SLICE_ROWS])
                taken.append((qi + at, bi, best[qi, bi]))
            qi, bi, reached = (np.concatenate(x) for x in zip(*taken))
            return pd.DataFrame({**{c: left[c].to_numpy()[qi] for c in group}, "q_id": left["q_id"].to_numpy()[qi], "__block": right["__block"].to_numpy()[bi], "bound": reached})

        return asked.groupBy(*grid).cogroup(table.groupBy(*new)).applyInPandas(bound, schema)

    def _visit(self, queries: DataFrame, pairs: DataFrame, pick: Callable) -> DataFrame:
        """(q_id, r_id, cos) that ``pick(cos, q_ids, r_ids)`` takes from the products of the pairs' blocks."""
        group, cell = self.group, [*self.group, "__block"]
        asked = pairs.select(*cell, "q_id").join(shuffled(queries.select(*group, "q_id", "q_vec")), [*group, "q_id"])
        # A line per block; the rows of blocks that no query visits stay where they are.
        visited = self.members.join(F.broadcast(pairs.select(*cell).distinct()), cell, "left_semi")
        rows = per_chunk(visited, asked, cell, self.block_rows, "__chunk")
        asked = in_chunks(asked, cell, "q_id", self.block_rows, "__chunk")
        left, right = [f"q{c}" for c in [*cell, "__chunk"]], [f"r{c}" for c in [*cell, "__chunk"]]
        asked = asked.select(*[F.col(c).alias(n) for c, n in zip([*cell, "__chunk"], left)], "q_id", "q_vec")
        rows = rows.select(*[F.col(c).alias(n) for c, n in zip([*cell, "__chunk"], right)], "r_id", "r_vec")
        types = {**dict(asked.dtypes), **dict(rows.dtypes)}
        return asked.groupBy(*left).cogroup(rows.groupBy(*right)).applyInPandas(multiplier(pick), f"q_id {types['q_id']}, r_id {types['r_id']}, cos double")

    def _queries(self, queries: DataFrame, keys: Sequence[str], query_id: str, query_vec: str) -> DataFrame:
        asked = self._shaped(queries, keys, query_id, query_vec, "q_id", "q_vec")
        return stored(asked.join(self.blocks.select(*self.group).distinct(), self.group, "left_semi"), "queries")

    def _count(self, pairs: DataFrame) -> None:
        self.work["visited"] += pairs.count()

    def _count_grid(self, asked: DataFrame) -> None:
        per = self.blocks.groupBy(*self.group).agg(F.count("*").alias("b"))
        self.work["grid"] += asked.groupBy(*self.group).count().join(per, self.group).agg(F.coalesce(F.sum(F.col("count") * F.col("b")), F.lit(0))).first()[0]

    def nearest(
        self, queries: DataFrame, keys: Sequence[str], k: int, query_id: str = "request_id", query_vec: str = "vector",
        floor: float | None = None, skip_self: bool = False,
    ) -> DataFrame:
        """(q_id, r_id, cos, rank) as ``similarity.nearest`` gives them."""

        def pick(cos, q_ids, r_ids):
            allowed = np.ones(cos.shape, dtype=bool) if floor is None else cos >= floor
            if skip_self:
                allowed &= q_ids[:, None] != r_ids[None, :]
            return best_in_rows(np.round(cos, 6), allowed, r_ids, k)

        asked = self._queries(queries, keys, query_id, query_vec)
        self._count_grid(asked)
        # No k-th hit yet: everything from the floor up is open. Blocks are taken by bound; those of earlier rounds are in ``seen``.
        low = -2.0 if floor is None else floor - SLACK
        asked = asked.withColumn("bar", F.lit(low))
        hits, seen = None, None
        for first in (*FIRST_VISITS, None):
            limited = first
            def reach(bound, left, limited=limited):  # noqa: E306
                open_ = bound >= left["bar"].to_numpy()[:, None]
                return np.nonzero(open_) if limited is None else best_in_rows(bound, open_, np.arange(bound.shape[1]), limited)

            pairs = self._pairs(asked, reach)
            if first is not None:
                pairs = top_per_key(pairs, [*self.group, "q_id"], [F.col("bound").desc(), F.col("__block").asc()], first, "__rank").drop("__rank")
            if seen is not None:
                pairs = pairs.join(shuffled(seen), [*self.group, "q_id", "__block"], "left_anti")
            pairs = stored(pairs.drop("bound"), "visits")
            self._count(pairs)
            found = self._visit(asked, pairs, pick)
            hits = found if hits is None else hits.unionByName(found)
            hits = stored(top_per_key(hits, ["q_id"], [F.round("cos", 6).desc(), F.col("r_id").asc()], k), "hits")
            last = hits.filter(F.col("rank") == k).select("q_id", (F.col("cos") - SLACK).alias("__last"))
            if first is not None:
                asked = asked.join(shuffled(last), "q_id", "left").withColumn("bar", F.greatest(F.lit(low), F.coalesce("__last", F.lit(low)))).drop("__last")
                seen = pairs if seen is None else seen.unionByName(pairs)
                hits = hits.drop("rank")
        return hits

    def reaching(self, queries: DataFrame, keys: Sequence[str], query_id: str, query_vec: str, bars: DataFrame, pick: Callable) -> DataFrame:
        """(q_id, r_id, cos) taken by ``pick`` from all blocks whose bound reaches the query's ``bar`` in ``bars`` (q_id, bar)."""
        asked = self._queries(queries, keys, query_id, query_vec)
        self._count_grid(asked)
        asked = asked.join(shuffled(bars), "q_id")
        pairs = stored(self._pairs(asked, lambda bound, left: np.nonzero(bound >= left["bar"].to_numpy()[:, None])).drop("bound"), "visits")
        self._count(pairs)
        return self._visit(asked, pairs, pick)

    def near_blocks(self, floor: float) -> DataFrame:
        """(group, a, b): pairs of blocks, a <= b by name, that may hold rows with a cosine of ``floor`` or more to each other."""
        group = self.group
        left = in_chunks(self.blocks, group, "__block", self.block_rows, "__qc").drop("n")
        right = left.select(*group, *[F.col(c).alias(f"o{c}") for c in ("__block", "centre", "radius", "has_zero")], F.col("__qc").alias("__bc"))
        left, right = (per_chunk(side, self.blocks, group, self.block_rows, name) for side, name in ((left, "__bc"), (right, "__qc")))
        grid = [*group, "__qc", "__bc"]
        new = [f"b_{c}" for c in grid]
        right = right.select(*[F.col(c).alias(n) for c, n in zip(grid, new)], "o__block", "ocentre", "oradius", "ohas_zero")
        types = {f.name: f.dataType.simpleString() for f in left.schema.fields}

        def bound(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
            if one.empty or two.empty:
                return pd.DataFrame(columns=[*group, "a", "b"])
            angle = np.arccos(np.clip(np.vstack(one["centre"]) @ np.vstack(two["ocentre"]).T, -1, 1))
            best = np.cos(np.clip(angle - one["radius"].to_numpy()[:, None] - two["oradius"].to_numpy(), 0, math.pi))
            zero = one["has_zero"].to_numpy()[:, None] | two["ohas_zero"].to_numpy()
            names = one["__block"].to_numpy(), two["o__block"].to_numpy()
            ai, bi = np.nonzero((np.where(zero, np.maximum(best, 0), best) >= floor - SLACK) & (names[0][:, None] <= names[1]))
            return pd.DataFrame({**{c: one[c].to_numpy()[ai] for c in group}, "a": names[0][ai], "b": names[1][bi]})

        schema = ", ".join(f"`{c}` {types[c]}" for c in group) + ", a string, b string"
        return left.groupBy(*grid).cogroup(right.groupBy(*new)).applyInPandas(bound, schema)

    def pairs(self, floor: float, pick: Callable) -> DataFrame:
        """(q_id, r_id, cos) taken by ``pick`` from the products of all block pairs that may reach ``floor``."""
        group, side = self.group, [*self.group, "a", "b"]
        near = stored(self.near_blocks(floor), "near-blocks")
        self._count(near)
        per = self.blocks.groupBy(*group).agg(F.count("*").alias("b"))
        self.work["grid"] += per.agg(F.coalesce(F.sum(F.expr("b * (b + 1) div 2")), F.lit(0))).first()[0]
        one = self.members.withColumnRenamed("__block", "a").join(near, [*group, "a"])
        two = self.members.withColumnRenamed("__block", "b").join(near, [*group, "b"])
        left, right = [f"q{c}" for c in side], [f"r{c}" for c in side]
        one = one.select(*[F.col(c).alias(n) for c, n in zip(side, left)], F.col("r_id").alias("q_id"), F.col("r_vec").alias("q_vec"))
        two = two.select(*[F.col(c).alias(n) for c, n in zip(side, right)], "r_id", "r_vec")
        types = {**dict(one.dtypes), **dict(two.dtypes)}
        return one.groupBy(*left).cogroup(two.groupBy(*right)).applyInPandas(multiplier(pick, same=(len(side) - 2, len(side) - 1)), f"q_id {types['q_id']}, r_id {types['r_id']}, cos double")


def multiplier(pick: Callable, same: tuple[int, int] | None = None) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The product of two blocks, of which ``pick(cos, q_ids, r_ids)`` says what to emit, a few rows at a time: ``pick`` sees whole rows. With ``same``, the
    places of the blocks' names in the keys, pairs of two different blocks are told both ways round."""

    def taken(q_unit: np.ndarray, r_unit: np.ndarray, q_ids: np.ndarray, r_ids: np.ndarray) -> pd.DataFrame:
        parts = []
        for at in range(0, len(q_ids), SLICE_ROWS):
            cos = q_unit[at:at + SLICE_ROWS] @ r_unit.T
            qi, ri = pick(cos, q_ids[at:at + SLICE_ROWS], r_ids)
            parts.append((q_ids[qi + at], r_ids[ri], cos[qi, ri]))
        return pd.DataFrame(dict(zip(("q_id", "r_id", "cos"), (np.concatenate(x) for x in zip(*parts)))))

    def multiply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"q_id": left["q_id"][:0], "r_id": right["r_id"][:0], "cos": np.array([], dtype=float)})
        q_ids, r_ids = left["q_id"].to_numpy(), right["r_id"].to_numpy()
        q_unit, r_unit = unit_rows(left["q_vec"]), unit_rows(right["r_vec"])
        out = taken(q_unit, r_unit, q_ids, r_ids)
        if same is not None and left.iloc[0, same[0]] != left.iloc[0, same[1]]:
            out = pd.concat([out, taken(r_unit, q_unit, r_ids, q_ids)])
        return out

    return multiply
