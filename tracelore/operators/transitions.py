"""Memory state transitions: pure functions (snapshot, decisions) -> next snapshot.

Decisions of any judge, model or person are tables. Each batch is applied with joins on
the learning id; nothing is looped over row by row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelore import params
from tracelore.functions.replies import confidence, flag, ids_in_json, reply_object
from tracelore.functions.text import collapse, learning_id, learning_namespace, truncate
from tracelore.functions.tools import tool_key
from tracelore.operators.graph import connected_components
from tracelore.operators.segments import top_per_key
from tracelore.session import cut

# State domains.
SAFETY_CATEGORIES = ("injection", "privilege", "secret", "other")
WINNERS = ("new", "existing", "unclear")
OBSERVATION_TYPES = ("change", "bugfix", "feature", "refactor", "discovery", "decision", "problem")
DEAD = ("rejected", "already_learned", "blocked")

ACTIONS_SCHEMA = (
    "learnings array<struct<action:string,existing_id:string,text:string,scope:string,kind:string,confidence:string,"
    "task_pattern:string,tool_key:string,error_signature:string,resolved:string,reason:string>>"
)
OBSERVATIONS_SCHEMA = "observations array<struct<type:string,title:string,facts:array<string>,narrative:string>>"
JUDGE_SCHEMA = "contradictions array<struct<existing_id:string,winner:string,reason:string>>, already_learned_of string"
SAFETY_SCHEMA = "verdict string, category string, reason string"


def _filled(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def nested_learning_ids(response: Column, prefix: str = "learning:") -> Column:
    """Distinct ids with ``prefix`` held by an ``id`` key anywhere in a response, first seen first, JSON
    inside JSON strings included. What prose quotes is no id."""
    held = F.coalesce(response, F.lit(""))
    return F.when(held.contains(prefix), ids_in_json(held, F.lit(prefix))).otherwise(F.array().cast("array<string>"))


# --- replies to rows -------------------------------------------------------------

def extraction_rows(replies: DataFrame, limit: int = 3) -> DataFrame:
    """Learning actions of every window's reply (window_id, project_id, user_id, reply): sound
    creates and updates only, cleaned, the first ``limit`` of a window."""
    items = replies.select(
        "window_id", "project_id", "user_id", F.posexplode(reply_object(F.col("reply"), ACTIONS_SCHEMA)["learnings"]).alias("pos", "i")
    )
    action = F.lower(F.coalesce("i.action", F.lit("")))
    text = truncate(F.coalesce("i.text", F.lit("")))
    existing = F.coalesce(F.trim("i.existing_id"), F.lit(""))
    stated = F.lower(F.trim(F.coalesce("i.scope", F.lit(""))))
    scope = F.when(stated != "", F.when(stated.isin("project", "user"), stated).otherwise("project")).when(
        existing.startswith("learning:user:"), "user"
    ).otherwise("project")
    told = F.lower(F.trim(F.coalesce("i.kind", F.lit(""))))
    create = action == "create"
    kind = F.when(told.isin("fact", "error"), told).when(create, "fact")
    pattern = collapse(F.coalesce("i.task_pattern", F.lit("")))
    pattern = F.when((pattern != "") & (F.length(pattern) <= 60) & (F.size(F.split(pattern, " ")) <= 6), pattern)
    error = F.coalesce(kind == "error", F.lit(False))
    rows = items.filter(action.isin("create", "update") & F.when(create, text != "").otherwise(existing != "")).select(
        "window_id", "project_id", "user_id", "pos", action.alias("action"), F.nullif(text, F.lit("")).alias("text"), scope.alias("scope"),
        F.when(create, learning_id(learning_namespace(F.col("project_id"), scope, F.col("user_id")), text)).otherwise(existing).alias("id"),
        kind.alias("kind"), pattern.alias("task_pattern"), confidence(F.col("i.confidence")).alias("confidence"),
        F.when(error, tool_key(F.col("i.tool_key"))).alias("tool_key"),
        F.when(error, F.nullif(truncate(F.coalesce("i.error_signature", F.lit("")), 300), F.lit(""))).alias("error_signature"),
        F.when(error, F.coalesce(flag(F.col("i.resolved")), F.when(create, F.lit(False)))).alias("resolved"),
        F.col("i.reason").alias("reason"),
    )
    return top_per_key(rows, ["window_id"], [F.col("pos").asc()], limit)


def observation_rows(replies: DataFrame, limit: int = 3) -> DataFrame:
    """Timeline entries of every window's reply (window_id, project_id, session_id, digest, reply)."""
    items = replies.select(
        "window_id", "project_id", "session_id", "digest",
        F.posexplode(reply_object(F.col("reply"), OBSERVATIONS_SCHEMA)["observations"]).alias("pos", "i"),
    )
    said = F.lower(F.trim(F.coalesce("i.type", F.lit(""))))
    facts = F.transform(F.filter(F.coalesce("i.facts", F.array().cast("array<string>")), lambda f: F.trim(f) != ""), lambda f: truncate(f, 300))
    rows = items.withColumn("title", truncate(F.coalesce("i.title", F.lit("")), 200)).filter("title <> ''").select(
        "window_id", "project_id", "session_id", "digest", "pos", "title",
        F.when(said.isin(*OBSERVATION_TYPES), said).otherwise("change").alias("type"),
        F.slice(facts, 1, 6).alias("facts"), F.nullif(truncate(F.coalesce("i.narrative", F.lit("")), 1000), F.lit("")).alias("narrative"),
    )
    kept = top_per_key(rows, ["window_id"], [F.col("pos").asc()], limit)
    return kept.withColumn(
        "id", F.concat_ws(":", F.lit("observation"), F.col("project_id").cast("string"), F.col("session_id").cast("string"), "digest", (F.col("rank") - 1).cast("string"))
    )


def safety_rows(replies: DataFrame) -> DataFrame:
    """(candidate_id, verdict, category, reason); an unusable reply has a null verdict: deferred."""
    parsed = replies.withColumn("r", reply_object(F.col("reply"), SAFETY_SCHEMA))
    verdict = F.lower(F.trim("r.verdict"))
    category = F.lower(F.trim("r.category"))
    usable = F.when(verdict.isin("pass", "block"), verdict)
    return parsed.select(
        "candidate_id", usable.alias("verdict"),
        F.when(usable.isNotNull(), F.when(category.isin(*SAFETY_CATEGORIES), category).otherwise("other")).alias("category"),
        F.when(usable.isNotNull(), F.substring(F.coalesce("r.reason", F.lit("")), 1, 280)).alias("reason"),
    )


def judge_rows(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contradictions: candidate_id, existing_id, winner, reason, pos), (restated: candidate_id,
    existing_id). An unusable reply finds nothing."""
    parsed = replies.withColumn("r", reply_object(F.col("reply"), JUDGE_SCHEMA))
    items = parsed.select("candidate_id", F.posexplode("r.contradictions").alias("pos", "i"))
    winner = F.lower(F.trim(F.coalesce(_filled(F.col("i.winner")), F.lit("new"))))
    found = items.filter(_filled(F.col("i.existing_id")).isNotNull()).select(
        "candidate_id", F.trim("i.existing_id").alias("existing_id"),
        F.when(winner.isin(*WINNERS), winner).otherwise("unclear").alias("winner"),
        F.substring(F.coalesce("i.reason", F.lit("")), 1, 280).alias("reason"), "pos",
    )
    restated = parsed.filter(_filled(F.col("r.already_learned_of")).isNotNull()).select(
        "candidate_id", F.trim("r.already_learned_of").alias("existing_id")
    )
    return found, restated


def overlay(df: DataFrame, columns: list[str], written: dict[str, Column]) -> DataFrame:
    """A snapshot's columns in their order, the written ones replaced, then those it didn't have. Whatever
    a transition does not write stays."""
    return df.select(
        *[written[c].alias(c) if c in written else F.col(c) for c in columns], *[v.alias(c) for c, v in written.items() if c not in columns]
    )


def _old(state: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in state.columns else F.lit(None).cast(kind)


# --- the gate --------------------------------------------------------------------

def resolve(candidates: DataFrame, neighbours: DataFrame, contradictions: DataFrame, restated: DataFrame) -> DataFrame:
    """(candidate_id, outcome, consistency, superseded, vetoed_by, unclear, restates). A veto
    beats a restatement, which beats a win, which beats an undecided conflict; ids the
    candidate was not judged against are ignored. At most the gate's 15 neighbours can be
    named per candidate, so the lists are short."""
    valid = neighbours.select("candidate_id", "existing_id").filter("candidate_id <> existing_id").distinct()
    hits = contradictions.join(valid, ["candidate_id", "existing_id"], "left_semi")
    same = restated.join(valid, ["candidate_id", "existing_id"], "left_semi").groupBy("candidate_id").agg(F.min("existing_id").alias("restates"))

    def named(winner: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("winner") == winner, F.col("existing_id"))))

    lists = hits.groupBy("candidate_id").agg(named("existing").alias("vetoed_by"), named("new").alias("superseded"), named("unclear").alias("unclear"))
    empty = F.array().cast(dict(lists.dtypes)["superseded"])
    rows = candidates.select(F.col("id").alias("candidate_id")).join(lists, "candidate_id", "left").join(same, "candidate_id", "left")
    rows = rows.select("candidate_id", "restates", *[F.coalesce(c, empty).alias(c) for c in ("vetoed_by", "superseded", "unclear")])
    veto, again, won, open_ = (F.size("vetoed_by") > 0, F.col("restates").isNotNull(), F.size("superseded") > 0, F.size("unclear") > 0)
    outcome = F.when(veto, "rejected").when(again, "already_learned").otherwise("approved")
    consistency = (
        F.when(veto, "vetoed").when(again, "already_learned").when(won, "superseded_conflicts").when(open_, "ambiguous_kept_both").otherwise("clean")
    )
    live = outcome == "approved"
    return rows.select(
        "candidate_id", outcome.alias("outcome"), consistency.alias("consistency"),
        F.when(live, F.col("superseded")).otherwise(empty).alias("superseded"),
        F.when(veto, F.col("vetoed_by")).otherwise(empty).alias("vetoed_by"),
        F.when(live, F.col("unclear")).otherwise(empty).alias("unclear"),
        F.when(~veto, F.col("restates")).alias("restates"),
    )


def block(resolutions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Safety first: a blocked candidate takes no other verdict, one without a verdict is
    deferred (left out), the rest are stamped as passed."""
    rows = resolutions.join(verdicts.filter("verdict IS NOT NULL"), "candidate_id")
    stop = F.col("verdict") == "block"
    reason = F.when(F.coalesce("reason", F.lit("")) != "", F.concat_ws(": ", "category", "reason")).otherwise(F.col("category"))
    empty = F.slice("superseded", 1, 0)
    return rows.select(
        "candidate_id",
        F.when(stop, "blocked").otherwise(F.col("outcome")).alias("outcome"),
        F.when(~stop, F.col("consistency")).alias("consistency"),
        *[F.when(stop, empty).otherwise(F.col(c)).alias(c) for c in ("superseded", "vetoed_by", "unclear")],
        F.when(~stop, F.col("restates")).alias("restates"),
        F.when(stop, "blocked").otherwise("passed").alias("safety_status"),
        F.when(stop, reason).alias("safety_reason"),
    )


#: Rows connected by supersession that one task settles in order.
SETTLE_ROWS = 20_000


def _settled_groups(links: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(fates of the rows in groups of at most ``most``, links of larger groups). A group is what links connect; its rows are settled in one pass along the
    order. Finding the groups takes rounds in the logarithm of their size, however many superseders a row has."""
    groups = connected_components(links.select(F.lit(0).alias("project_id"), F.col("by").alias("source"), F.col("candidate_id").alias("target")))
    sizes = groups.groupBy("root").agg(F.count("*").alias("__n"))
    named = groups.join(sizes, "root").select(F.col("node").alias("candidate_id"), "root", "__n")
    placed = cut(links.join(named, "candidate_id"))
    kind = dict(links.dtypes)["candidate_id"]

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        applied: dict = {}
        # Superseders come first along the order, and one without its own superseders takes effect.
        for row, by in part.sort_values(["__at", "candidate_id"]).groupby(["__at", "candidate_id"], sort=False)["by"]:
            applied[row[1]] = not any(applied.get(b, True) for b in by)
        return pd.DataFrame({"candidate_id": list(applied), "applied": list(applied.values())})

    small = placed.filter(F.col("__n") <= most).groupBy("root").applyInPandas(settle, f"candidate_id {kind}, applied boolean")
    return small, placed.filter(F.col("__n") > most).select(*links.columns)


def applied_in_order(resolutions: DataFrame, order: Column, settle_rows: int = SETTLE_ROWS) -> DataFrame:
    """Rows whose verdict takes effect when the batch is applied in order: a row that an applied
    earlier row supersedes is skipped, and so supersedes nothing itself.

    Rows that supersession connects form groups; a group of at most ``settle_rows`` rows is settled in one task. In larger ones
    the rule settles from the front: a row with one open superseder is the opposite of it, and such links are followed in
    doubling steps; rows with several open superseders settle one level a round. The loop ends when no row is open,
    which the order guarantees.
    """
    rows = cut(resolutions.withColumn("__at", order))
    hits = rows.select(F.col("candidate_id").alias("by"), F.col("__at").alias("__by_at"), F.explode("superseded").alias("candidate_id"))
    links = cut(
        hits.join(rows.select("candidate_id", "__at"), "candidate_id").filter("__by_at < __at").select("by", "candidate_id", "__at").distinct()
    )
    if links.isEmpty():
        return rows.drop("__at")
    small, links = _settled_groups(links, settle_rows)
    fates = cut(small)
    links = cut(links.select("by", "candidate_id"))
    same = rows.select(F.col("candidate_id").alias("to")).schema["to"].dataType
    # applied: settled or not; else, with ``to``, equal to that row's fate (flip false) or its opposite (flip true).
    state = cut(rows.join(fates, "candidate_id", "left").select("candidate_id", "applied", F.lit(None).cast(same).alias("to"), F.lit(False).alias("flip")))
    while True:
        known = links.join(state.select(F.col("candidate_id").alias("by"), "applied"), "by").groupBy("candidate_id").agg(
            F.bool_or(F.coalesce("applied", F.lit(False))).alias("hit"),
            F.count_if(F.col("applied").isNull()).alias("open"), F.max(F.when(F.col("applied").isNull(), F.col("by"))).alias("only"),
        )
        open_ = F.coalesce("open", F.lit(0))
        settled = F.when(F.col("applied").isNotNull(), F.col("applied")).when(F.coalesce("hit", F.lit(False)), False).when(open_ == 0, True)
        lone = settled.isNull() & (open_ == 1) & F.col("to").isNull()
        state = state.join(known, "candidate_id", "left").select(
            "candidate_id", settled.alias("applied"), F.when(lone, F.col("only")).otherwise(F.col("to")).alias("to"), F.when(lone, True).otherwise(F.col("flip")).alias("flip")
        )
        state = cut(state)
        far = state.select(F.col("candidate_id").alias("to"), F.col("applied").alias("__fate"), F.col("to").alias("__to"), F.col("flip").alias("__flip"))
        state = cut(state.join(far, "to", "left").select(
            "candidate_id", F.coalesce("applied", F.col("__fate") != F.col("flip")).alias("applied"), F.coalesce("__to", "to").alias("to"),
            F.when(F.col("__to").isNotNull(), F.col("flip") != F.col("__flip")).otherwise(F.col("flip")).alias("flip"),
        ))
        if state.filter("applied IS NULL").isEmpty():
            return rows.join(state.filter("applied").select("candidate_id"), "candidate_id", "left_semi").drop("__at")


def apply_resolutions(learnings: DataFrame, applied: DataFrame, echoes: DataFrame, now: Column, order: Column | None = None) -> dict[str, DataFrame]:
    """State and edges after the applied verdicts. ``echoes``: (candidate_id, existing_id) pairs
    whose restatement only repeats an injection."""
    open_ = learnings.filter("status = 'candidate'").select(F.col("id").alias("candidate_id"))
    applied = applied.join(open_, "candidate_id", "left_semi")
    mine = applied.select(F.col("candidate_id").alias("id"), *[F.col(c).alias(f"__{c}") for c in ("outcome", "consistency", "safety_status", "safety_reason")])
    last = applied.withColumn("__at", F.col("candidate_id") if order is None else order)
    lost = last.select(F.explode("superseded").alias("id"), F.col("candidate_id").alias("__by"), "__at").groupBy("id").agg(F.max_by("__by", "__at").alias("__by"))
    folds = applied.filter("restates IS NOT NULL").select("candidate_id", F.col("restates").alias("existing_id")).join(
        echoes.select("candidate_id", "existing_id", F.lit(True).alias("__echo")), ["candidate_id", "existing_id"], "left"
    ).withColumn("echo", F.coalesce("__echo", F.lit(False))).drop("__echo")
    gains = reinforce(folds, learnings)
    state = learnings.join(mine, "id", "left").join(lost, "id", "left").join(gains, "id", "left")
    status = F.when(F.col("__by").isNotNull(), "rejected").otherwise(F.coalesce("__outcome", "status"))
    judged, echoed = F.col("__outcome").isNotNull(), F.coalesce("__echoes", F.lit(0))
    state = overlay(state, learnings.columns, {
        "status": status,
        "embedding": F.when(status.isin(*DEAD) & (judged | F.col("__by").isNotNull()), None).otherwise(F.col("embedding")),
        "support_count": F.coalesce("support_count", F.lit(0)) + F.coalesce("__support", F.lit(0)),
        "echo_count": F.coalesce(_old(learnings, "echo_count", "long"), F.lit(0)) + echoed,
        "echo_gain": echoed,
        "confidence": F.greatest(F.col("confidence"), F.coalesce("__confidence", F.col("confidence"))),
        "consistency_status": F.coalesce("__consistency", _old(learnings, "consistency_status")),
        "safety_status": F.coalesce("__safety_status", _old(learnings, "safety_status")),
        "blocked_reason": F.when(F.col("__outcome") == "blocked", F.col("__safety_reason")).otherwise(_old(learnings, "blocked_reason")),
        "rejected_reason": F.when(F.col("__by").isNotNull(), F.concat(F.lit("superseded_by:"), F.col("__by").cast("string"))).otherwise(_old(learnings, "rejected_reason")),
        "consistency_checked_at": F.when(judged & F.col("__consistency").isNotNull(), now).otherwise(_old(learnings, "consistency_checked_at", "timestamp")),
    })

    def edge(kind: str, column: str) -> DataFrame:
        return applied.select(F.lit(kind).alias("kind"), F.col("candidate_id").alias("from_id"), F.explode(column).alias("to_id"), F.lit(False).alias("echo"))

    edges = edge("SUPERSEDES", "superseded").unionByName(edge("CONTRADICTED_BY", "vetoed_by")).unionByName(edge("CONTRADICTS", "unclear")).unionByName(
        folds.select(F.lit("ALREADY_LEARNED_FROM").alias("kind"), F.col("candidate_id").alias("from_id"), F.col("existing_id").alias("to_id"), "echo")
    )
    return {"learning": state, "edges": edges}


def reinforce(folds: DataFrame, learnings: DataFrame) -> DataFrame:
    """(id, __support, __echoes, __confidence) a canonical fact gains from restatements."""
    conf = learnings.select(F.col("id").alias("candidate_id"), F.coalesce("confidence", F.lit(0.0)).alias("__c"))
    return folds.join(conf, "candidate_id").groupBy(F.col("existing_id").alias("id")).agg(
        F.count_if(~F.col("echo")).alias("__support"), F.count_if("echo").alias("__echoes"),
        F.max(F.when(~F.col("echo"), F.col("__c"))).alias("__confidence"),
    )


def sweep(learnings: DataFrame, tried: DataFrame, limit: int = params.SWEEP_LIMIT) -> DataFrame:
    """Open candidates of both scopes, oldest first, those just tried left out."""
    rows = learnings.filter("status = 'candidate' AND text IS NOT NULL AND scope IN ('project', 'user')").join(
        tried.select("id"), "id", "left_anti"
    )
    return top_per_key(rows, ["project_id"], [F.coalesce("updated_at", "created_at").asc(), F.col("id").asc()], limit)


# --- writes ----------------------------------------------------------------------

def upsert_learnings(state: DataFrame, creates: DataFrame) -> DataFrame:
    """Create or restate: ``creates`` (id, text, task_pattern, kind, tool_key, error_signature,
    resolved, confidence, project_id, scope, user_id, at, echo). Several writes of one id in a
    batch fold into one: the last text wins, filled fields stick, non-echo writes support. All
    other columns of the state stay; an ``embedding`` in ``creates`` replaces the old one."""
    at = F.col("at")

    def last_filled(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), at)).alias(f"n_{name}")

    fresh_vector = "embedding" in creates.columns
    batch = creates.groupBy("id").agg(
        *[last_filled(c) for c in ("embedding",) if fresh_vector],
        F.min("at").alias("n_created_at"), F.max("at").alias("n_updated_at"),
        F.max_by("text", at).alias("n_text"), F.max_by("task_pattern", at).alias("n_task_pattern"),
        *[last_filled(c) for c in ("kind", "tool_key", "error_signature", "resolved", "project_id")],
        F.min_by("scope", at).alias("n_scope"), F.min_by("user_id", at).alias("n_user_id"),
        F.count_if(~F.col("echo")).alias("n_support"), F.count_if("echo").alias("n_echo"),
        F.max(F.when(~F.col("echo"), F.col("confidence"))).alias("n_confidence"),
    )
    j = state.join(batch, "id", "full_outer")
    hit = F.col("n_text").isNotNull()
    written = {
        "created_at": F.coalesce("created_at", "n_created_at"), "updated_at": F.coalesce("n_updated_at", "updated_at"),
        "text": F.coalesce("n_text", "text"), "task_pattern": F.when(hit, F.col("n_task_pattern")).otherwise(F.col("task_pattern")),
        "kind": F.coalesce("n_kind", "kind", F.lit("fact")), "tool_key": F.coalesce("n_tool_key", "tool_key"),
        "error_signature": F.coalesce("n_error_signature", "error_signature"), "resolved": F.coalesce("n_resolved", "resolved"),
        "project_id": F.coalesce("n_project_id", "project_id"), "scope": F.coalesce("scope", "n_scope"),
        "user_id": F.coalesce("user_id", "n_user_id"), "status": F.coalesce("status", F.lit("candidate")),
        "support_count": F.coalesce("support_count", F.lit(0)) + F.coalesce("n_support", F.lit(0)),
        "echo_count": F.coalesce("echo_count", F.lit(0)) + F.coalesce("n_echo", F.lit(0)),
        "confidence": F.greatest("confidence", "n_confidence"),
        "consolidated": F.when(hit, F.col("compiled_at").isNotNull()).otherwise(F.coalesce("consolidated", F.lit(False))),
    }
    if fresh_vector:
        written["embedding"] = F.coalesce("n_embedding", _old(state, "embedding", creates.schema["embedding"].dataType.simpleString()))
    return overlay(j, state.columns, written)


def owned(updates: DataFrame, learnings: DataFrame, owners: DataFrame) -> DataFrame:
    """Updates that may be applied: to a user fact, or to a fact the writing project owns.
    ``owners``: (project_id, learning_id)."""
    known = updates.join(learnings.select("id", F.col("scope").alias("__scope")), "id")
    mine = known.join(owners.select(F.col("learning_id").alias("id"), "project_id", F.lit(True).alias("__own")), ["id", "project_id"], "left")
    return mine.filter((F.col("__scope") == "user") | F.coalesce("__own", F.lit(False))).drop("__scope", "__own")


UPDATABLE = ("text", "task_pattern", "kind", "tool_key", "error_signature", "resolved", "summary")


def update_learnings(state: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates (id, at, echo, confidence and any of ``UPDATABLE``), folded per id in the order of ``at``: the last filled
    value of a field overwrites, non-echo updates support. New text on an approved fact is an
    unreviewed claim: back to candidate, review and consistency cleared."""
    fields = [c for c in UPDATABLE if c in updates.columns]
    at, real = F.col("at"), ~F.coalesce("echo", F.lit(False))
    told = updates.join(state.select("id", F.col("text").alias("__text")), "id")
    batch = told.groupBy("id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"u_{c}") for c in fields], F.max("at").alias("u_at"),
        F.count_if(real).alias("u_real"), F.count_if(~real).alias("u_echo"), F.max(F.when(real, F.col("confidence"))).alias("u_confidence"),
        F.coalesce(F.bool_or(F.col("text") != F.col("__text")), F.lit(False)).alias("u_changed"),
    )
    j = state.join(batch, "id", "left")
    hit = F.col("u_at").isNotNull()
    demoted = F.coalesce(hit & (F.col("status") == "approved") & F.col("u_changed"), F.lit(False))
    gone = [c for c in ("reviewed_by", "reviewed_at", "consistency_status", "consistency_checked_at") if c in state.columns]
    kinds = dict(updates.dtypes)
    return overlay(j, state.columns, {
        **{c: F.coalesce(f"u_{c}", _old(state, c, kinds[c])) for c in fields},
        "status": F.when(demoted, "candidate").otherwise(F.col("status")),
        "support_count": F.coalesce("support_count", F.lit(0)) + F.coalesce("u_real", F.lit(0)),
        "echo_count": F.coalesce(_old(state, "echo_count", "long"), F.lit(0)) + F.coalesce("u_echo", F.lit(0)),
        "confidence": F.when(F.col("u_confidence") > F.coalesce("confidence", F.lit(0.0)), F.col("u_confidence")).otherwise(F.col("confidence")),
        "updated_at": F.coalesce("u_at", "updated_at"),
        "consolidated": F.when(hit, F.col("compiled_at").isNotNull() if "compiled_at" in state.columns else F.lit(False)).otherwise(F.col("consolidated")),
        **{c: F.when(~demoted, F.col(c)) for c in gone}, "demoted": demoted,
    })


def add_learnings(state: DataFrame, submissions: DataFrame) -> DataFrame:
    """Direct adds (project_id, user_id, scope, text, kind, tool_key, error_signature, resolved,
    confidence, task_pattern, at): content id, candidate unless already approved, an error
    stays an error, best confidence, support counted per write; filled fields stick. Returns the whole snapshot."""
    scope = F.when(F.lower(F.trim("scope")) == "user", "user").otherwise("project")
    rows = submissions.withColumn("text", truncate(F.coalesce("text", F.lit("")))).filter("text <> ''").withColumn("scope", scope)
    error = F.coalesce(F.lower(F.trim("kind")) == "error", F.lit(False))
    rows = rows.withColumns(
        {
            "id": learning_id(learning_namespace(F.col("project_id"), F.col("scope"), F.col("user_id")), F.col("text")),
            "kind": F.when(error, "error").otherwise("fact"),
            "tool_key": F.when(error, tool_key(F.col("tool_key"))),
            "error_signature": F.when(error, F.nullif(truncate(F.coalesce("error_signature", F.lit("")), 300), F.lit(""))),
            "resolved": F.when(error, F.coalesce("resolved", F.lit(False))),
            "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.6)))),
        }
    )
    at = F.col("at")
    batch = rows.groupBy("id").agg(
        F.min("at").alias("created_at"), F.max("at").alias("updated_at"), F.first("text").alias("text"), F.first("scope").alias("scope"),
        F.min_by("user_id", at).alias("n_user_id"), F.max_by("project_id", at).alias("project_id"),
        F.bool_or(F.col("kind") == "error").alias("n_error"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"n_{c}") for c in ("tool_key", "error_signature", "resolved", "task_pattern")],
        F.max("confidence").alias("n_confidence"), F.count("*").alias("n_writes"),
    )
    batch = batch.select("id", *[F.col(c).alias(c if c.startswith("n_") else f"n_{c}") for c in batch.columns if c != "id"])
    j = state.join(batch, "id", "full_outer")
    hit = F.col("n_writes").isNotNull()
    stick = {c: F.coalesce(f"n_{c}", _old(state, c, dict(batch.dtypes)[f"n_{c}"])) for c in ("tool_key", "error_signature", "resolved", "task_pattern", "text", "scope", "project_id", "updated_at")}
    return overlay(j, state.columns, {
        **stick,
        "user_id": F.coalesce("user_id", "n_user_id"), "created_at": F.coalesce("created_at", "n_created_at"),
        "status": F.when(hit & ~F.coalesce(F.col("status") == "approved", F.lit(False)), "candidate").otherwise(F.col("status")),
        "kind": F.when(F.coalesce("n_error", F.lit(False)), "error").otherwise(F.coalesce("kind", F.lit("fact"))),
        "confidence": F.greatest("confidence", "n_confidence"),
        "support_count": F.coalesce("support_count", F.lit(0)) + F.coalesce("n_writes", F.lit(0)),
    })


def bootstrap_learnings(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Seed load: content id, approved, best confidence of old and new; text over 500 fails. Returns the whole snapshot."""
    checked = rows.withColumn("text", F.when(F.length("text") <= params.LEARNING_TEXT_CAP, F.col("text")).otherwise(
        F.raise_error(F.lit("seed learning longer than 500 characters")).cast("string")
    ))
    keyed = checked.withColumn("id", learning_id(F.col("project_id").cast("string"), F.col("text")))
    batch = keyed.groupBy("id").agg(F.first("text").alias("n_text"), F.first("project_id").alias("n_project_id"), F.max("confidence").alias("n_confidence"))
    j = state.join(batch, "id", "full_outer")
    hit = F.col("n_text").isNotNull()
    return overlay(j, state.columns, {
        "text": F.coalesce("n_text", _old(state, "text")), "project_id": F.coalesce("n_project_id", _old(state, "project_id", dict(batch.dtypes)["n_project_id"])),
        "status": F.when(hit, "approved").otherwise(_old(state, "status")), "confidence": F.greatest("confidence", "n_confidence"),
    })


def human_decisions(learnings: DataFrame, conflicts: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """approve, keep_both, edit_approve, reject, keep_new, keep_existing. ``conflicts``: (from_id,
    to_id); ``decisions``: (id, action, edited_text, conflict_id), one per id."""
    d = decisions.select("id", "action", "edited_text", "conflict_id")
    touched = conflicts.join(d.select(F.col("id").alias("from_id"), "action", "conflict_id"), "from_id").filter(
        F.col("conflict_id").isNull() | ~F.col("action").isin("keep_new", "keep_existing") | (F.col("to_id") == F.col("conflict_id"))
    )
    losers = touched.filter("action = 'keep_new'").groupBy(F.col("to_id").alias("id")).agg(F.max("from_id").alias("__by"))
    approve = F.col("action").isin("approve", "keep_both", "edit_approve", "keep_new")
    kill = F.col("action").isin("reject", "keep_existing")
    j = learnings.join(d, "id", "left").join(losers, "id", "left")
    status = F.when(F.col("__by").isNotNull(), "rejected").when(approve, "approved").when(kill, "rejected").otherwise(F.col("status"))
    reason = F.when(F.col("__by").isNotNull(), F.concat(F.lit("human_superseded_by:"), F.col("__by").cast("string"))).when(
        F.col("action") == "reject", "human_review").when(F.col("action") == "keep_existing", "human_kept_existing")
    state = overlay(j, learnings.columns, {
        "status": status, "text": F.when(F.col("action") == "edit_approve", truncate(F.col("edited_text"))).otherwise(F.col("text")),
        "embedding": F.when(F.col("__by").isNotNull() | kill, None).otherwise(F.col("embedding")),
        "reviewed_by": F.when(F.col("action").isNotNull(), "human").otherwise(_old(learnings, "reviewed_by")),
        "consistency_status": F.when(approve, "human_reviewed").otherwise(_old(learnings, "consistency_status")),
        "rejected_reason": F.when(status == "rejected", F.coalesce(reason, _old(learnings, "rejected_reason"))).otherwise(F.when(F.col("action").isNull(), _old(learnings, "rejected_reason"))),
    })
    made = touched.filter("action IN ('keep_new', 'keep_existing')").select(
        F.when(F.col("action") == "keep_new", "SUPERSEDES").otherwise("CONTRADICTED_BY").alias("kind"), "from_id", "to_id"
    )
    left = conflicts.join(touched.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")
    return {"learning": state, "edges": made, "conflicts": left}


def flag_stale(rejected: DataFrame, learnings: DataFrame, skills: DataFrame, derived: DataFrame) -> dict[str, DataFrame]:
    """Skills and profiles that lost a source. ``rejected``: (id); ``learnings`` after the decision."""
    hit = derived.join(rejected.select(F.col("id").alias("learning_id")), "learning_id", "left_semi").groupBy("skill_id").agg(
        F.max("learning_id").alias("because")
    )
    dead = derived.join(learnings.filter("status = 'rejected'").select(F.col("id").alias("learning_id")), "learning_id", "left_semi").groupBy(
        "skill_id"
    ).agg(F.count("*").alias("stale_source_count"))
    skill = skills.filter("status IN ('candidate', 'approved')").join(hit, "skill_id").join(dead, "skill_id", "left").select(
        "skill_id", F.lit(True).alias("needs_revision"), F.coalesce("stale_source_count", F.lit(0)).alias("stale_source_count"),
        F.concat(F.lit("source learning "), F.col("because").cast("string"), F.lit(" was rejected or superseded")).alias("revision_reason"),
    )
    profile = learnings.join(rejected.select("id"), "id", "left_semi").filter(
        "scope = 'user' AND status = 'rejected' AND consolidated_at IS NOT NULL AND unfolded_at IS NULL"
    ).groupBy("user_id").agg(F.max("id").alias("because")).select(
        "user_id", F.concat(F.lit("folded user fact "), F.col("because").cast("string"), F.lit(" was rejected or superseded")).alias("revision_reason")
    )
    return {"skill": skill, "profile": profile}


def usage_counters(serves: DataFrame) -> DataFrame:
    """Tallies per fact from the append-only serve log (id, via inject|retrieve, at)."""
    inject = F.col("via") == "inject"
    return serves.groupBy("id").agg(
        F.count_if(inject).alias("inject_count"), F.count_if(~inject).alias("retrieval_count"), F.count("*").alias("use_count"),
        F.max(F.when(inject, F.col("at"))).alias("last_injected_at"), F.max(F.when(~inject, F.col("at"))).alias("last_retrieved_at"),
        F.max("at").alias("last_used_at"),
    )


def link_written_learnings(events: DataFrame, learnings: DataFrame, tool_suffix: str = "project_add_learning") -> dict[str, DataFrame]:
    """Links from successful calls of the add-learning tool: (learning_id, session_id, at), and
    the first owner of facts that have none."""
    calls = events.filter(
        (F.col("event_name") == "PostToolUse") & F.lower("tool_name").contains(tool_suffix)
        & ~F.coalesce("tool_error", F.lit(False)) & ~F.coalesce("is_interrupt", F.lit(False))
    )
    named = calls.select("session_id", "user_id", "ts", F.explode(nested_learning_ids(F.col("tool_response"))).alias("learning_id"))
    known = named.join(learnings.select(F.col("id").alias("learning_id"), F.col("user_id").alias("__owner")), "learning_id")
    links = known.groupBy("learning_id", "session_id").agg(F.min("ts").alias("at"))
    owners = known.groupBy("learning_id").agg(
        F.coalesce(F.max("__owner"), F.min_by("user_id", "ts")).alias("user_id"), F.max_by("session_id", "ts").alias("last_source_session_id")
    )
    return {"links": links, "owners": owners}


def recall_flags(learnings: DataFrame, skills: DataFrame, derived: DataFrame, now: Column) -> DataFrame:
    """Derive compiled_at, compiled_skill_id and consolidated where the flag is missing."""
    live = derived.join(skills.filter("status = 'approved'").select("skill_id"), "skill_id", "left_semi").groupBy(
        F.col("learning_id").alias("id")
    ).agg(F.min("skill_id").alias("__skill"), F.min("created_at").alias("__since"))
    unset = F.col("consolidated").isNull()
    folded = F.coalesce((F.col("consolidated_at").isNotNull()) & (F.coalesce("updated_at", "created_at") <= F.col("consolidated_at")), F.lit(False))
    return learnings.join(live, "id", "left").withColumns(
        {
            "compiled_at": F.when(unset & F.col("__skill").isNotNull(), F.coalesce("compiled_at", "__since", now)).otherwise(F.col("compiled_at")),
            "compiled_skill_id": F.when(unset & F.col("__skill").isNotNull(), F.coalesce("compiled_skill_id", "__skill")).otherwise(F.col("compiled_skill_id")),
            "consolidated": F.when(unset, F.col("__skill").isNotNull() | folded).otherwise(F.col("consolidated")),
        }
    ).drop("__skill", "__since")


def constraint_report(keys: dict[str, DataFrame]) -> DataFrame:
    """(constraint, n_keys, n_rows, missing, first_key): one row per violated constraint, from one aggregate over all tables together. ``keys`` maps a
    constraint's name to its table's key column, the only column given. Keys meet by their hash with the constraint, so a wide key is never sorted;
    the keys of hashes that occur twice are told apart in a second step over those alone."""
    stack = None
    for name, df in keys.items():
        part = df.select(F.lit(name).alias("constraint"), df[df.columns[0]].cast("string").alias("key"))
        stack = part if stack is None else stack.unionByName(part)
    stack = stack.withColumn("hash", F.xxhash64("key"))
    twice = stack.groupBy("constraint", "hash").agg(F.count("*").alias("n"), F.bool_or(F.col("key").isNull()).alias("null_")).filter("n > 1 OR null_")
    rows = stack.join(twice.select("constraint", "hash"), ["constraint", "hash"]).groupBy("constraint", "key").agg(F.count("*").alias("n")).filter("n > 1 OR key IS NULL")
    return rows.groupBy("constraint").agg(
        F.count_if(F.col("key").isNotNull()).alias("n_keys"), F.sum("n").alias("n_rows"), F.coalesce(F.max(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.min("key").alias("first_key")
    )


def key_violations(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table, key, n) for every duplicated or missing key."""
    parts = [
        df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).filter("n > 1 OR key IS NULL").select(
            F.lit(name).alias("table"), "key", "n"
        )
        for name, (df, key) in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


