"""Recall: filtered vector and keyword branches, rank fusion, gating, fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelore import params
from tracelore.functions.text import keyword_terms
from tracelore.operators.keyword import KeywordIndex, query_terms
from tracelore.operators.similarity import nearest, nearest_boosted, pairs_above
from tracelore.operators.segments import top_per_key
from tracelore.session import shuffled


def live(statuses: Sequence[str] = params.LIVE_STATUSES, include_consolidated: bool = False) -> Column:
    """Live-memory predicate."""
    alive = F.col("status").isin(*statuses)
    return alive if include_consolidated else alive & ~F.coalesce("consolidated", F.lit(False))


def served_in_session(learnings: DataFrame, injected: DataFrame) -> DataFrame:
    """(session_id, r_id): facts injected into a session or first produced in it. Requests of a
    session whose context was cleared or compacted go without it."""
    given = injected.select("session_id", F.col("learning_id").alias("r_id"))
    return given.unionByName(learnings.select("session_id", F.col("id").alias("r_id"))).distinct()


def drop_served(pairs: DataFrame, requests: DataFrame, served: DataFrame, row_id: str = "r_id") -> DataFrame:
    """Pairs (q_id, row) whose request's session has had the row are dropped: an anti-join on
    (session, row), never a list of all requests of a session times all it was served."""
    asked = requests.select(F.col("request_id").alias("q_id"), F.col("session_id").alias("__session"))
    gone = served.select(F.col("session_id").alias("__session"), F.col("r_id").alias(row_id))
    return pairs.join(shuffled(asked), "q_id").join(shuffled(gone), ["__session", row_id], "left_anti").drop("__session")


def rank_pool(limit: int, weight: float) -> int:
    return limit * params.SALIENCE_POOL if weight > 0 else limit


def renumber(hits: DataFrame, k: int) -> DataFrame:
    """Ranks 1..n again after a filter."""
    return top_per_key(hits.drop("rank"), ["q_id"], [F.round("cos", 6).desc(), F.col("r_id").asc()], k)


def vector_branch(
    requests: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    limit: int,
    keep: Column | None = None,
    floor: float | None = None,
    barred: DataFrame | None = None,
    pair_filter: Column | None = None,
    attrs: Sequence[str] = ("status",),
    skip_self: bool = True,
) -> DataFrame:
    """The ``limit`` nearest rows per request first; status, floor, session and user filters
    after, so fewer may remain; then ranks are renumbered."""
    hits = nearest(requests, rows, keys, limit, skip_self=skip_self)
    if floor is not None:
        hits = hits.filter(F.col("cos") >= floor)
    if keep is not None or pair_filter is not None:
        hits = hits.join(shuffled(rows.select(F.col("id").alias("r_id"), *attrs)), "r_id")
        if pair_filter is not None:
            hits = hits.join(
                shuffled(requests.select(F.col("request_id").alias("q_id"), F.col("user_id").alias("q_user_id"))), "q_id"
            ).filter(pair_filter)
        if keep is not None:
            hits = hits.filter(keep)
        hits = hits.select("q_id", "r_id", "cos", "rank")
    if barred is not None:
        hits = drop_served(hits, requests, barred).select("q_id", "r_id", "cos", "rank")
    return renumber(hits, limit)


def fuse(branches: dict[str, DataFrame], salience: DataFrame | None = None, weight: float = 0.0) -> DataFrame:
    """Reciprocal-rank fusion of ranked branches (q_id, r_id, rank), then the salience boost."""
    stacked = None
    for source, branch in branches.items():
        part = branch.select("q_id", "r_id", "rank", F.lit(source).alias("source"))
        stacked = part if stacked is None else stacked.unionByName(part)
    fused = stacked.groupBy("q_id", "r_id").agg(
        F.sum(F.lit(1.0) / (F.lit(float(params.RRF_K)) + F.col("rank"))).alias("score"),
        F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"),
    )
    if salience is None or weight == 0:
        return fused
    boost = salience.select(F.col("id").alias("r_id"), "salience")
    return fused.join(shuffled(boost), "r_id", "left").withColumn(
        "score", F.col("score") * (1.0 + weight * F.coalesce("salience", F.lit(0.0)))
    ).drop("salience")


def order_hits(fused: DataFrame, rows: DataFrame, limit: int, approved_first: bool = True) -> DataFrame:
    """Approved rows before candidates whatever the score, then score, confidence, id."""
    attrs = [c for c in ("status", "confidence") if c in rows.columns]
    hits = fused.join(shuffled(rows.select(F.col("id").alias("r_id"), *attrs)), "r_id")
    order = [F.round("score", 9).desc()]
    if approved_first:
        order.insert(0, F.when(F.col("status") == "approved", 0).otherwise(1).asc())
    if "confidence" in attrs:
        order.append(F.coalesce("confidence", F.lit(0.0)).desc())
    return top_per_key(hits, ["q_id"], [*order, F.col("r_id").asc()], limit)


def index_text() -> Column:
    """What the text index covers: the text and its task pattern."""
    return F.concat_ws(" ", "text", "task_pattern")


def owner_of(scope: Column, user_id: Column, project_id: Column) -> Column:
    """Whose facts are searched together: a user's for user scope, a project's otherwise."""
    return F.when(scope == "user", user_id.cast("string")).otherwise(project_id.cast("string"))


def learning_index(learnings: DataFrame) -> KeywordIndex:
    """The one text index over facts that all searches share: keyed by scope and owner, filtered by project, status and flag."""
    rows = learnings.withColumn("__text", index_text()).withColumn("owner", owner_of(F.col("scope"), F.col("user_id"), F.col("project_id")))
    rows = rows.withColumn("consolidated", F.coalesce("consolidated", F.lit(False)))
    return KeywordIndex(rows, "id", "__text", ["scope", "owner"], ["project_id", "status", "consolidated"])


def searched(requests: DataFrame, gated: bool = False) -> DataFrame:
    """(q_id, searched): whether a search could run at all. Without a vector and without words, and under a floor without a vector, there
    is no signal, which a caller tells apart from a search that found nothing."""
    signal = F.size(F.coalesce("vector", F.array().cast("array<float>"))) > 0
    if not gated:
        signal = signal | (F.size(keyword_terms(F.col("query"))) > 0)
    return requests.select(F.col("request_id").alias("q_id"), signal.alias("searched"))


def recall_project(
    requests: DataFrame, learnings: DataFrame, limit: int = 5, floor: float = params.RECALL_FLOOR,
    barred: DataFrame | None = None, salience: DataFrame | None = None, weight: float = 0.0,
) -> DataFrame:
    """Gated recall at prompt time: vector only, no fallback."""
    rows = learnings.filter((F.col("scope") == "project") & ~F.col("consolidated"))
    pool = rank_pool(limit, weight)
    hits = vector_branch(
        requests, rows, ["project_id"], pool, keep=F.col("status").isin(*params.LIVE_STATUSES), floor=floor, barred=barred
    )
    return order_hits(fuse({"vector": hits}, salience, weight), rows, limit)


def recall_user(
    requests: DataFrame, learnings: DataFrame, limit: int = 5, floor: float = params.RECALL_FLOOR,
    barred: DataFrame | None = None,
) -> DataFrame:
    """The same over user facts of all projects; the owner filter comes after the limit."""
    rows = learnings.filter((F.col("scope") == "user") & ~F.col("consolidated"))
    hits = vector_branch(
        requests, rows, [], limit,
        keep=F.col("status").isin(*params.LIVE_STATUSES), floor=floor, barred=barred,
        pair_filter=F.col("user_id") == F.col("q_user_id"), attrs=("status", "user_id"),
    )
    return order_hits(fuse({"vector": hits}), rows, limit)


def hybrid(
    requests: DataFrame, learnings: DataFrame, keys: Sequence[str], limit: int, *,
    scope: str = "project", barred: DataFrame | None = None, include_consolidated: bool = False,
    salience: DataFrame | None = None, weight: float = 0.0, branches: Sequence[str] = ("vector", "keyword"),
    skip_self: bool = True, index: KeywordIndex | None = None,
) -> DataFrame:
    """Vector and keyword search over learnings fused by rank. For user scope give
    ``keys=["user_id"]``: the keyword branch filters the owner before its limit, the vector
    branch after. ``index`` is the stored ``learning_index``; without one it is built."""
    rows = learnings.filter(F.col("scope") == scope)
    if not include_consolidated:
        rows = rows.filter(~F.coalesce("consolidated", F.lit(False)))
    pool = rank_pool(limit, weight)
    alive = F.col("status").isin(*params.LIVE_STATUSES)
    parts: dict[str, DataFrame] = {}
    if "vector" in branches:
        if scope == "user":
            parts["vector"] = vector_branch(
                requests, rows, [], pool, keep=alive,
                barred=barred, pair_filter=F.col("user_id") == F.col("q_user_id"), attrs=("status", "user_id"), skip_self=skip_self,
            )
        else:
            parts["vector"] = vector_branch(requests, rows, keys, pool, keep=alive, barred=barred, skip_self=skip_self)
    if "keyword" in branches:
        words = index or learning_index(learnings)
        keep = (F.col("scope") == scope) & (alive if include_consolidated else alive & ~F.col("consolidated"))
        owner = owner_of(F.lit(scope), F.col("user_id"), F.col("project_id"))
        terms = query_terms(requests.withColumn("scope", F.lit(scope)).withColumn("owner", owner), "request_id", "query", ["scope", "owner"])
        allow = None if barred is None else lambda pairs: drop_served(pairs, requests, barred, "doc_id")
        parts["keyword"] = words.top(terms, pool, keep, allow, skip_self)
    return order_hits(fuse(parts, salience, weight), rows, limit)


def recency_fallback(learnings: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Approved first, then the most recently used, changed or created."""
    latest = [c for c in ("last_used_at", "updated_at", "created_at") if c in learnings.columns]
    return top_per_key(
        learnings.filter(live()), keys,
        [F.when(F.col("status") == "approved", 0).otherwise(1).asc(), F.coalesce(*latest).desc(), F.col("id").asc()], limit,
    )


def context_hits(requests: DataFrame, hits: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Search hits per request; requests without any take the fallback of their key."""
    found = hits.select(F.col("q_id").alias("request_id"), F.col("r_id").alias("id"), "rank", F.lit("search").alias("via"))
    none = requests.join(shuffled(found.select("request_id").distinct()), "request_id", "left_anti")
    filler = none.select("request_id", key).join(fallback.select(key, "id", "rank"), key).select(
        "request_id", "id", "rank", F.lit("recency").alias("via")
    )
    return found.unionByName(filler)


def mark_retrieved(learnings: DataFrame, given: DataFrame, at: Column) -> DataFrame:
    """The facts after an on-demand pull that gave (request_id, id): use and retrieval counts go up by the number of requests that got the
    fact, both times move to ``at``; counters a fact lacks start at 0, facts not given stay as they are."""
    counts = given.select("request_id", "id").distinct().groupBy("id").agg(F.count("*").alias("__given"))
    marked = learnings.join(shuffled(counts), "id", "left")
    served = F.col("__given").isNotNull()
    for name in ("use_count", "retrieval_count"):
        before = F.coalesce(name, F.lit(0)) if name in learnings.columns else F.lit(0)
        marked = marked.withColumn(name, before + F.coalesce("__given", F.lit(0)))
    for name in ("last_used_at", "last_retrieved_at"):
        before = F.col(name) if name in learnings.columns else F.lit(None).cast("timestamp")
        marked = marked.withColumn(name, F.when(served, at).otherwise(before))
    return marked.drop("__given")


def recent_listing(requests: DataFrame, rows: DataFrame, row_id: str, key: str, latest: Column, limit: int) -> DataFrame:
    """(q_id, r_id, rank): requests without words to search for list the newest rows of their key instead. The
    newest rows are taken per key first, so a busy key costs ``limit`` rows per request."""
    silent = requests.filter(F.trim(F.coalesce("query", F.lit(""))) == "").select(F.col("request_id").alias("q_id"), key)
    newest = top_per_key(rows, [key], [latest.desc(), F.col(row_id).asc()], limit).select(key, F.col(row_id).alias("r_id"), "rank")
    return silent.join(newest, key).select("q_id", "r_id", "rank")


def suggest_skills(
    requests: DataFrame, skills: DataFrame, limit: int = 5, floor: float = params.SKILL_FLOOR, weight: float = 0.0,
) -> DataFrame:
    """Live skills of the request's project above the floor, by cosine times salience, then slug."""
    rows = skills.filter((F.col("status") == "approved") & F.col("slug").isNotNull())
    hits = nearest_boosted(requests, rows, ["project_id"], limit, floor, weight, row_id="skill_id")
    hits = hits.join(rows.select(F.col("skill_id").alias("r_id"), "slug", "salience"), "r_id").withColumn(
        "ranked", F.col("cos") * (1.0 + weight * F.coalesce("salience", F.lit(0.0)))
    )
    return top_per_key(hits, ["q_id"], [F.round("ranked", 6).desc(), F.col("slug").asc()], limit)


def text_index(rows: DataFrame, row_id: str, text: Column, keys: Sequence[str], attrs: Sequence[str] = ()) -> KeywordIndex:
    """A stored text index over skills or episodes."""
    return KeywordIndex(rows.withColumn("id", F.col(row_id)).withColumn("__text", text), "id", "__text", keys, attrs)


def search(
    requests: DataFrame, rows: DataFrame, row_id: str, text: Column, keys: Sequence[str], limit: int, *,
    keep: Column | None = None, salience: bool = False, weight: float = 0.0, has_vectors: bool = True, index: KeywordIndex | None = None,
) -> DataFrame:
    """Hybrid search over skills or episodes: status after the limit on the vector side and
    before it on the keyword side; score order only. ``index`` is the stored ``text_index`` of the rows."""
    base = rows.withColumn("id", F.col(row_id)).withColumn("__text", text)
    pool = rank_pool(limit, weight)
    parts: dict[str, DataFrame] = {}
    if has_vectors:
        attrs = ("status",) if keep is not None else ()
        parts["vector"] = vector_branch(requests, base, keys, pool, keep=keep, attrs=attrs, skip_self=False)
    words = index or text_index(rows, row_id, text, keys, ["status"] if keep is not None else [])
    parts["keyword"] = words.top(query_terms(requests, "request_id", "query", keys), pool, keep)
    boost = base.select("id", "salience") if salience else None
    return order_hits(fuse(parts, boost, weight), base.select("id"), limit, approved_first=False)


def gate_neighbours(
    candidates: DataFrame, learnings: DataFrame, k: int = params.GATE_TOP_K, branches: Sequence[str] = ("vector", "keyword"),
    index: KeywordIndex | None = None,
) -> DataFrame:
    """What a candidate is judged against: live rows of its project and scope (and user).
    The vector limit is k + 1 because the candidate finds itself."""
    asked = candidates.select(
        F.col("id").alias("request_id"), "project_id", "scope", "user_id", F.col("text").alias("query"), F.col("embedding").alias("vector")
    )
    keys = ["project_id", "scope"]
    alive = F.col("status").isin(*params.LIVE_STATUSES)
    same_person = (F.col("scope") == "project") | (F.col("user_id") == F.col("q_user_id"))
    parts: dict[str, DataFrame] = {}
    if "vector" in branches:
        raw = nearest(asked, learnings, keys, k + 1).filter(F.col("q_id") != F.col("r_id"))
        attrs = learnings.select(F.col("id").alias("r_id"), "status", "scope", "user_id")
        who = asked.select(F.col("request_id").alias("q_id"), F.col("user_id").alias("q_user_id"))
        parts["vector"] = renumber(
            raw.join(shuffled(attrs), "r_id").join(shuffled(who), "q_id").filter(alive & same_person).select("q_id", "r_id", "cos", "rank"), k + 1
        )
    if "keyword" in branches:
        owner = owner_of(F.col("scope"), F.col("user_id"), F.col("project_id"))
        terms = query_terms(asked.withColumn("owner", owner).withColumn("q_project_id", F.col("project_id")), "request_id", "query", ["scope", "owner", "q_project_id"])
        words = index or learning_index(learnings)
        parts["keyword"] = words.top(terms, k, alive, skip_self=True, same=["project_id"])
    fused = fuse(parts)
    return top_per_key(fused, ["q_id"], [F.round("score", 9).desc(), F.col("r_id").asc()], k)


def similar_pairs(
    learnings: DataFrame, k: int = params.SIMILAR_TOP_K, floor: float = params.SIMILAR_FLOOR
) -> DataFrame:
    """(project_id, source, target): the nearest neighbours of approved project facts."""
    rows = learnings.filter((F.col("status") == "approved") & (F.col("scope") == "project"))
    hits = nearest(
        rows, rows, ["project_id"], k, query_id="id", query_vec="embedding", floor=floor, skip_self=True
    )
    return hits.join(shuffled(rows.select(F.col("id").alias("q_id"), "project_id")), "q_id").select(
        "project_id", F.col("q_id").alias("source"), F.col("r_id").alias("target"), F.col("cos").alias("similarity")
    )


def pattern_edges(patterns: DataFrame, floor: float = params.PATTERN_EDGE_FLOOR, per_end: int | None = None) -> DataFrame:
    """(project_id, source, target, similarity) between live patterns of a project; with ``per_end`` at least those among
    so many strongest of either end, which is all that pruning keeps."""
    rows = patterns.filter(F.coalesce("status", F.lit("active")) == "active")
    return pairs_above(rows, ["project_id"], floor, per_end=per_end).join(
        rows.select(F.col("id").alias("source"), "project_id"), "source"
    ).select("project_id", "source", "target", "similarity")

