"""The label-merge pass: similarity edges, pruning, communities, what to review, what to mark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelore import params
from tracelore.operators import graph, patterns as pt, recall
from tracelore.session import cut


def review_pass(patterns: DataFrame, floor: float = params.PATTERN_EDGE_FLOOR, budget: int = params.REVIEW_BUDGET) -> dict[str, DataFrame]:
    """Edges, communities, review batches and the ids to mark reviewed afterwards."""
    edges = cut(graph.prune_edges(recall.pattern_edges(patterns, floor, per_end=params.EDGE_TOP_K)))
    groups = graph.component_index(graph.connected_components(edges))
    members = groups.join(patterns.select(F.col("id").alias("node"), "reviewed", "learning_count"), "node")
    batches = cut(graph.review_batches(members, edges, budget))
    marked = pt.reviewed_after_pass(patterns, edges, batches.select(F.col("node").alias("id")))
    return {"edges": edges, "communities": groups, "batches": batches, "marked": marked}
