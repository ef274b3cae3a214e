"""Connected components of an edge table, in rounds of joins and aggregates.

Every round each node takes the smallest grand-parent around it and passes it to its parent, so rounds grow with the
logarithm of a component's size. A node of many edges is a key of skew-splittable joins and of map-side combined minima
only. State is written to the shared folder each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelore.llm.base import publish


class Groups:
    """Union-find over the links found in one task."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def chains(self) -> list[tuple[int, int]]:
        """A chain of links through each group, so that no member has more than two."""
        members: dict[int, list[int]] = {}
        for x in sorted(self.parent):
            members.setdefault(self.find(x), []).append(x)
        return [pair for m in members.values() for pair in zip(m, m[1:], strict=False)]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node reachable. Edges may repeat, point either way
    or to their own start; null ends are left out."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    both = publish(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    state = publish(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("root")), "roots")
    while True:
        up = state.select(F.col("node").alias("root"), F.col("root").alias("grand"))
        seen = publish(state.join(up, "root").select("node", "root", "grand"), "roots")
        near = both.join(seen.select(F.col("node").alias("v"), "grand"), "v").groupBy(F.col("u").alias("node")).agg(F.min("grand").alias("low"))
        told = seen.join(near, "node")
        offers = told.select("node", F.least("root", "grand", "low").alias("root")).unionByName(told.select(F.col("root").alias("node"), "low").withColumnRenamed("low", "root"))
        nxt = publish(offers.groupBy("node").agg(F.min("root").alias("root")), "roots")
        if nxt.join(state, ["node", "root"], "left_anti").isEmpty():
            return state
        state = nxt
