"""Relatedness graphs, personalised PageRank, components, communities, pruning.

All projects are computed together: (project, node) is the join key, so one large
project spreads over all tasks. Iterations keep their state in checkpoint files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelore import params
from tracelore.operators.blocks import SLICE_ROWS, in_chunks, per_chunk, unit_rows
from tracelore.operators.segments import HOUR, running_sums, time_slice, top_per_key
from tracelore.session import bucketed, cut, shuffled, stored


def seed_weights(
    learnings: DataFrame, edits: DataFrame, restatements: DataFrame, root_sessions: DataFrame,
    decay: float = params.SALIENCE_DECAY,
) -> DataFrame:
    """(project_id, id, bias): every touch of a fact counts weight * decay ** (root sessions of
    the project started after it). ``edits``: (learning_id, kind, at, echo); ``restatements``:
    (learning_id, at, echo). Echoes count nothing; a fact no run produced counts its creation."""
    heard = ~F.coalesce("echo", F.lit(False))
    edits = edits.filter(heard & F.col("at").isNotNull()).select(
        F.col("learning_id").alias("id"), "at",
        F.when(F.col("kind") == "PRODUCED_LEARNING", params.CREATE_TOUCH_WEIGHT).otherwise(params.UPDATE_TOUCH_WEIGHT).alias("w"),
        (F.col("kind") == "PRODUCED_LEARNING").alias("made"),
    )
    again = restatements.filter(heard & F.col("at").isNotNull()).select(
        F.col("learning_id").alias("id"), "at", F.lit(params.UPDATE_TOUCH_WEIGHT).alias("w"), F.lit(False).alias("made")
    )
    made = edits.filter("made").select("id").distinct()
    born = learnings.join(made, "id", "left_anti").filter("created_at IS NOT NULL").select(
        "id", F.col("created_at").alias("at"), F.lit(params.CREATE_TOUCH_WEIGHT).alias("w"), F.lit(False).alias("made")
    )
    touches = edits.unionByName(again).unionByName(born).join(learnings.select("id", "project_id"), "id").select(
        "project_id", F.col("at").alias("ts"), F.lit(1).alias("late"), "id", "w"
    )
    starts = root_sessions.select(
        "project_id", F.col("created_at").alias("ts"), F.lit(0).alias("late"),
        F.lit(None).cast(dict(touches.dtypes)["id"]).alias("id"), F.lit(0.0).alias("w"),
    )
    # Sessions started up to a touch = running count over both, sessions first at equal times.
    merged = running_sums(
        touches.unionByName(starts), ["project_id"], ["ts", "late", "id"], time_slice(F.col("ts"), HOUR),
        {"upto": (F.col("late") == 0).cast("int")},
    )
    total = root_sessions.groupBy("project_id").agg(F.count("*").alias("__total"))
    aged = merged.filter("late = 1").join(total, "project_id", "left").withColumn(
        "after", F.coalesce("__total", F.lit(0)) - F.col("upto")
    )
    return aged.groupBy("project_id", "id").agg(F.sum(F.col("w") * F.pow(F.lit(decay), F.col("after"))).alias("bias")).filter("bias > 0")


#: Members of a group in one chunk. Two chunks are paired in one place.
PAIR_ROWS = 1024


def group_pairs(groups: DataFrame, nodes: DataFrame, weight: float = params.GROUP_EDGE_WEIGHT, max_size: int | None = params.MAX_GROUP_SIZE) -> DataFrame:
    """(project_id, a, b, w), a line for every group that two members share: each two members of a group of n get weight / (n - 1). Groups beyond ``max_size``
    add nothing; with None every group counts, and its members are dealt over chunks, so no group is paired by one task."""
    key = ["project_id", "group_id"]
    members = groups.join(nodes.select("project_id", F.col("node").alias("member")), ["project_id", "member"], "left_semi").select(*key, "member").distinct()
    if max_size is None:
        members = stored(members, "members")
    sizes = members.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1" if max_size is None else F.col("n").between(2, max_size))
    kept = members.join(sizes, key)
    left, right, on = kept.withColumnRenamed("member", "a"), kept.select(*key, F.col("member").alias("b")), key
    if max_size is None:
        left = per_chunk(in_chunks(left, key, "a", PAIR_ROWS, "__a"), members, key, PAIR_ROWS, "__b")
        right = shuffled(per_chunk(in_chunks(right, key, "b", PAIR_ROWS, "__b"), members, key, PAIR_ROWS, "__a"))
        on = [*key, "__a", "__b"]
    return left.join(right, on).filter("a < b").select("project_id", "a", "b", (F.lit(weight) / (F.col("n") - 1)).alias("w"))


def group_edges(
    groups: DataFrame, nodes: DataFrame, weight: float = params.GROUP_EDGE_WEIGHT, max_size: int | None = params.MAX_GROUP_SIZE
) -> DataFrame:
    """(project_id, a, b, w): what two members get from all their groups."""
    return merge_edges(group_pairs(groups, nodes, weight, max_size))


def similarity_edges(pairs: DataFrame, nodes: DataFrame, weight: float = params.SIMILAR_EDGE_WEIGHT) -> DataFrame:
    """Undirected, one fixed weight, both ends known."""
    ends = pairs.filter("source <> target").select(
        "project_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")
    ).distinct()
    known = nodes.select("project_id", "node")
    return (
        ends.join(known.select("project_id", F.col("node").alias("a")), ["project_id", "a"], "left_semi")
        .join(known.select("project_id", F.col("node").alias("b")), ["project_id", "b"], "left_semi")
        .select("project_id", "a", "b", F.lit(weight).alias("w"))
    )


def merge_edges(*parts: DataFrame) -> DataFrame:
    """Weights of the same pair add up."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked.groupBy("project_id", "a", "b").agg(F.sum("w").alias("w"))


def relatedness(
    learnings: DataFrame, origins: DataFrame, skill_members: DataFrame, pairs: DataFrame, max_size: int | None = params.MAX_GROUP_SIZE
) -> DataFrame:
    """Facts from one root session, in one live skill, of one error signature, or similar. Groups beyond ``max_size`` add nothing (None: all count).
    ``origins``: (id, root); ``skill_members``: (skill_id, id)."""
    nodes = learnings.select("project_id", F.col("id").alias("node"))
    own = learnings.select("project_id", F.col("id").alias("member"), "kind", "error_signature")
    by_root = own.join(origins.select(F.col("id").alias("member"), F.concat(F.lit("r"), F.col("root").cast("string")).alias("group_id")), "member")
    by_skill = own.join(skill_members.select(F.col("id").alias("member"), F.concat(F.lit("s"), F.col("skill_id").cast("string")).alias("group_id")), "member")
    by_error = own.filter((F.col("kind") == "error") & F.col("error_signature").isNotNull()).withColumn("group_id", F.concat(F.lit("e"), F.col("error_signature")))
    by_root, by_skill, by_error = (g.select("project_id", "group_id", "member") for g in (by_root, by_skill, by_error))
    # All sorts of groups are paired together and their weights added up once.
    return merge_edges(group_pairs(by_root.unionByName(by_skill).unionByName(by_error), nodes, max_size=max_size), similarity_edges(pairs, nodes))


def personalized_pagerank(
    nodes: DataFrame,
    edges: DataFrame,
    seeds: DataFrame,
    damping: float = params.DAMPING,
    max_iterations: int = params.MAX_ITERATIONS,
    tolerance: float = params.TOLERANCE,
) -> DataFrame:
    """(project_id, node, score): weighted, undirected power iteration, every project until its
    own L1 change drops below ``tolerance``. A node without edges keeps its restart share; a
    project without seeds scores zero."""
    key = ["project_id", "node"]
    given = seeds.select("project_id", F.col("id").alias("node"), "bias").filter("bias > 0").join(nodes.select(*key), key, "left_semi")
    totals = given.groupBy("project_id").agg(F.sum("bias").alias("__total"))
    restart = given.join(totals, "project_id").select(*key, (F.col("bias") / F.col("__total")).alias("restart"))
    state = nodes.select(*key).join(restart, key, "left").select(*key, F.coalesce("restart", F.lit(0.0)).alias("restart"))
    state = cut(state.select("*", F.col("restart").alias("score"), F.lit(True).alias("active")))

    known = edges.filter("w > 0").select("project_id", "a", "b", "w")
    both = known.unionByName(known.select("project_id", F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    strength = both.groupBy("project_id", "a").agg(F.sum("w").alias("__s"))
    # The edges lie in buckets of their start and stay there: a round deals out the state and the contributions alone.
    steps = bucketed(
        both.join(strength, ["project_id", "a"]).select(
            "project_id", F.col("a").alias("node"), F.col("b").alias("__to"), (F.col("w") / F.col("__s")).alias("share")
        ), key, "steps",
    )
    for done in range(1, max_iterations + 1):
        moved = (
            state.filter("active AND score > 0").join(steps, key)
            .groupBy("project_id", F.col("__to").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("__in"))
        )
        fresh = (1.0 - damping) * F.col("restart") + damping * F.coalesce("__in", F.lit(0.0))
        nxt = cut(
            state.join(moved, key, "left").select(
                *key, "restart", F.when(F.col("active"), fresh).otherwise(F.col("score")).alias("score"),
                F.when(F.col("active"), F.abs(fresh - F.col("score"))).alias("__change"),
            )
        )
        moving = nxt.groupBy("project_id").agg(F.sum("__change").alias("__d")).filter(F.col("__d") >= tolerance)
        moving = moving.select("project_id", F.lit(True).alias("active"))
        state = nxt.drop("__change").join(moving, "project_id", "left").withColumn("active", F.coalesce("active", F.lit(False)))
        # A settled project keeps its scores, so looking for the end now and then is enough.
        if done % 4 == 0 and moving.isEmpty():
            break
    return state.select(*key, "score")


def normalize(scores: DataFrame, key: str = "node", out: str = "salience") -> DataFrame:
    """Divide by the project's top score, clip at zero, six places; all zero if the top is not positive."""
    top = scores.groupBy("project_id").agg(F.max("score").alias("__top"))
    value = F.when(F.col("__top") > 0, F.round(F.greatest("score", F.lit(0.0)) / F.col("__top"), 6)).otherwise(0.0)
    return scores.join(top, "project_id").select("project_id", key, value.alias(out))


def skill_salience(members: DataFrame, salience: DataFrame) -> DataFrame:
    """Sum of member salience per skill, normalised. ``members``: (project_id, skill_id, id)."""
    total = members.join(salience.select(F.col("node").alias("id"), "salience"), "id", "left").groupBy("project_id", "skill_id").agg(
        F.sum(F.coalesce("salience", F.lit(0.0))).alias("score")
    )
    return normalize(total, "skill_id")


# --- components and communities --------------------------------------------------

def connected_components(edges: DataFrame) -> DataFrame:
    """(project_id, node, root), root the smallest id reached. Every round each node takes the
    smallest grand-parent around it and tells its parent, then paths are halved, so rounds
    grow with the logarithm of the component size. A hub is only ever a groupBy-min key."""
    base = edges.select("project_id", F.col("source").alias("u"), F.col("target").alias("v"))
    both = cut(base.unionByName(base.select("project_id", F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    state = cut(both.select("project_id", F.col("u").alias("node"), F.col("u").alias("root")).distinct())
    while True:
        up = state.select("project_id", F.col("node").alias("root"), F.col("root").alias("grand"))
        seen = state.join(up, ["project_id", "root"]).select("project_id", "node", "root", "grand")
        near = both.join(seen.select("project_id", F.col("node").alias("v"), "grand"), ["project_id", "v"]).groupBy(
            "project_id", F.col("u").alias("node")
        ).agg(F.min("grand").alias("low"))
        told = seen.join(near, ["project_id", "node"])
        offers = told.select("project_id", "node", F.least("root", "grand", "low").alias("root")).unionByName(
            told.select("project_id", F.col("root").alias("node"), F.col("low").alias("root"))
        )
        nxt = cut(offers.groupBy("project_id", "node").agg(F.min("root").alias("root")))
        changed = not nxt.join(state, ["project_id", "node", "root"], "left_anti").isEmpty()
        state = nxt
        if not changed:
            return state


def component_index(components: DataFrame, segment: Column | None = None) -> DataFrame:
    """Add ``community``: 0, 1, ... per project in the order of the smallest member."""
    heads = components.select("project_id", "root").distinct()
    part = F.floor(F.col("root") / 100_000) if segment is None else segment
    numbered = running_sums(heads, ["project_id"], ["root"], part, {"community": F.lit(1)})
    return components.join(numbered.withColumn("community", F.col("community") - 1), ["project_id", "root"])


def vote_communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Weighted label voting for a fixed number of rounds: a node takes the label with the
    largest similarity sum around it, the smaller label among equals. Gives finer groups
    than components; not comparable with a modularity method."""
    base = edges.select("project_id", F.col("source").alias("u"), F.col("target").alias("v"), "similarity")
    both = cut(base.unionByName(base.select("project_id", F.col("v").alias("u"), F.col("u").alias("v"), "similarity")))
    labels = cut(both.select("project_id", F.col("u").alias("node"), F.col("u").alias("label")).distinct())
    for _ in range(rounds):
        votes = both.join(labels.select("project_id", F.col("node").alias("v"), "label"), ["project_id", "v"]).groupBy(
            "project_id", "u", "label"
        ).agg(F.round(F.sum("similarity"), 6).alias("weight"))
        best = votes.groupBy("project_id", F.col("u").alias("node")).agg(
            F.min(F.struct((-F.col("weight")).alias("w"), "label")).alias("b")
        )
        labels = cut(best.select("project_id", "node", F.col("b.label").alias("label")))
    return labels


def vote_by_products(
    rows: DataFrame, floor: float, rounds: int = 5, row_id: str = "id", row_vec: str = "embedding", chunk: int = 4096,
) -> DataFrame:
    """``vote_communities`` over all pairs of a project's ``rows`` that clear ``floor`` as in ``pairs_above``, without writing the pairs, whose number is the
    square of a project's rows. A round multiplies the project's nodes, chunk by chunk, with chunks of whole labels and tells each node's best of them; a
    label of more than ``chunk`` members has chunks of its own, and tells one sum per node and chunk. So a round writes two lines per node and chunk at most."""
    group = ["project_id", "__dim"]
    base = rows.filter(F.size(row_vec) > 0).select("project_id", F.size(row_vec).alias("__dim"), F.col(row_id).alias("node"), F.col(row_vec).alias("vec"))
    base = stored(base.dropna(subset=["project_id"]), "voters")
    labels = base.select(*group, "node", F.col("node").alias("label"))
    for _ in range(rounds):
        labels = cut(_vote(base, labels, group, floor, chunk))
    return labels.select("project_id", "node", "label")


def _vote(base: DataFrame, labels: DataFrame, group: Sequence[str], floor: float, chunk: int) -> DataFrame:
    sizes = labels.groupBy(*group, "label").agg(F.count("*").alias("__n"))
    large = sizes.filter(F.col("__n") > chunk)
    named = labels.join(shuffled(large), [*group, "label"], "left").join(base.select("node", *group, "vec"), [*group, "node"])
    dealt = named.groupBy(*group).agg(F.ceil(F.count(F.when(F.col("__n").isNull(), 1)) / F.lit(chunk)).alias("__chunks"))
    own = F.concat_ws(":", F.lit("one"), F.col("label").cast("string"), F.pmod(F.xxhash64("node"), F.ceil(F.col("__n") / F.lit(chunk))).cast("string"))
    many = F.concat_ws(":", F.lit("many"), F.pmod(F.xxhash64("label"), F.col("__chunks")).cast("string"))
    told = named.join(dealt, list(group)).select(
        *group, F.col("node").alias("r_node"), "label", F.col("vec").alias("r_vec"), F.when(F.col("__n").isNull(), many).otherwise(own).alias("__rc")
    )
    chunks = told.select(*group, "__rc").distinct()
    told = per_chunk(told, named, group, chunk, "__qc")
    asked = in_chunks(named.select(*group, "node", "vec"), group, "node", chunk, "__qc").join(chunks, list(group))
    grid = [*group, "__qc", "__rc"]
    left, right = [f"q{i}" for i in range(len(grid))], [f"r{i}" for i in range(len(grid))]
    asked = asked.select(*[F.col(c).alias(n) for c, n in zip(grid, left)], "node", "vec")
    told = told.select(*[F.col(c).alias(n) for c, n in zip(grid, right)], "r_node", "label", "r_vec")
    types = {**dict(asked.dtypes), **dict(told.dtypes)}
    schema = f"project_id {types['q0']}, __dim {types['q1']}, node {types['node']}, label {types['label']}, weight double"
    votes = asked.groupBy(*left).cogroup(told.groupBy(*right)).applyInPandas(voter(floor), schema)
    best = votes.groupBy(*group, "node", "label").agg(F.round(F.sum("weight"), 6).alias("weight")).groupBy(*group, "node").agg(
        F.min(F.struct((-F.col("weight")).alias("w"), "label")).alias("b")
    )
    return best.select(*group, "node", F.col("b.label").alias("label"))


def voter(floor: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The best label of a chunk for each node of another: the largest sum to six places, the smaller label among equals. A chunk of one label tells its sum as it is."""
    bar = (1.0 + floor) / 2.0

    def vote(asked: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        names = ["project_id", "__dim", "node", "label", "weight"]
        if asked.empty or told.empty:
            return pd.DataFrame(columns=names)
        told = told.sort_values("label", kind="stable")
        q_unit, r_unit = unit_rows(asked["vec"]), unit_rows(told["r_vec"])
        q_ids, r_ids = asked["node"].to_numpy(), told["r_node"].to_numpy()
        labels, starts = np.unique(told["label"].to_numpy(), return_index=True)
        parts = []
        for at in range(0, len(q_ids), SLICE_ROWS):
            cos = q_unit[at:at + SLICE_ROWS] @ r_unit.T
            good = (np.round((1.0 + cos) / 2.0, 7) >= bar) & (q_ids[at:at + SLICE_ROWS, None] != r_ids)
            weight = np.add.reduceat(np.where(good, cos, 0.0), starts, axis=1)
            seen = np.logical_or.reduceat(good, starts, axis=1)
            best = np.argmax(np.where(seen, np.round(weight, 6), -np.inf), axis=1)
            qi = np.flatnonzero(seen.any(axis=1))
            parts.append((q_ids[qi + at], labels[best[qi]], weight[qi, best[qi]]))
        node, label, weight = (np.concatenate(x) for x in zip(*parts))
        return pd.DataFrame({"project_id": asked.iloc[0, 0], "__dim": asked.iloc[0, 1], "node": node, "label": label, "weight": weight}, columns=names)

    return vote


def prune_edges(edges: DataFrame, k: int = params.EDGE_TOP_K) -> DataFrame:
    """Keep an edge that is among the ``k`` strongest of either end; ties by (source, target)."""
    ends = edges.withColumn("end", F.explode(F.array("source", "target")))
    order = [F.round("similarity", 6).desc(), F.col("source").asc(), F.col("target").asc()]
    return top_per_key(ends, ["project_id", "end"], order, k).drop("end", "rank").dropDuplicates(["project_id", "source", "target"])


def review_batches(
    members: DataFrame, edges: DataFrame, budget: int = params.REVIEW_BUDGET, max_size: int = params.MAX_COMMUNITY_SIZE
) -> DataFrame:
    """(project_id, batch, position, node): communities worth a review. ``members``: (project_id,
    node, community, reviewed, learning_count). Unreviewed members first, then the best
    connected; communities with the most unreviewed, then the most learnings."""
    where = members.select("project_id", F.col("node"), "community")
    inside = edges.join(where.withColumnsRenamed({"node": "source", "community": "cs"}), ["project_id", "source"]).join(
        where.withColumnsRenamed({"node": "target", "community": "ct"}), ["project_id", "target"]
    ).filter("cs = ct")
    degree = inside.withColumn("node", F.explode(F.array("source", "target"))).groupBy("project_id", "node").agg(
        F.sum("similarity").alias("degree")
    )
    stats = members.groupBy("project_id", "community").agg(
        F.count("*").alias("n"), F.count_if(~F.col("reviewed")).alias("unreviewed"),
        F.sum("learning_count").alias("learnings"), F.min("node").alias("first"),
    ).filter("n >= 2 AND unreviewed > 0")
    order = [F.col("unreviewed").desc(), F.col("learnings").desc(), F.col("first").asc()]
    # Rank by size of the first ``max_size`` members, as a reviewer would see them.
    ranked_members = top_per_key(
        members.join(stats.select("project_id", "community"), ["project_id", "community"], "left_semi").join(
            degree, ["project_id", "node"], "left"
        ),
        ["project_id", "community"],
        [F.col("reviewed").asc(), F.round(F.coalesce("degree", F.lit(0.0)), 6).desc(), F.col("node").asc()], max_size, "position",
    )
    shown = ranked_members.groupBy("project_id", "community").agg(
        F.count_if(~F.col("reviewed")).alias("unreviewed"), F.sum("learning_count").alias("learnings"), F.min("node").alias("first")
    )
    chosen = top_per_key(shown, ["project_id"], order, budget, "batch").select("project_id", "community", "batch")
    return ranked_members.join(chosen, ["project_id", "community"]).select("project_id", "batch", "position", "community", "node")
