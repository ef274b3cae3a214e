"""Skills: what may be distilled, groups and their rank, proposals and their fate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelore import params
from tracelore.functions.text import clip, slugify, truncate
from tracelore.functions.tools import failure_text, is_transient
from tracelore.functions.vectors import unit
from tracelore.operators.segments import top_per_key

# What a skill text must contain, and its limits.
REQUIRED_SECTIONS = ("## When to use", "## Procedure", "## Pitfalls")
MAX_CONTENT = 4000
MAX_DESCRIPTION = 300
CURATED_ERRORS, RAW_FAILURES, RAW_SCAN, EXCERPT = 6, 4, 40, 300
LIVE_SKILLS = ("candidate", "approved")


def eligible_learnings(learnings: DataFrame, skills: DataFrame, derived: DataFrame, pending_sources: DataFrame, limit: int = 200) -> DataFrame:
    """Approved project facts with a pattern, in no live or proposed skill and no pending
    version; the best ``limit`` of a project, which bounds every group built from them."""
    taken = derived.join(skills.filter(F.col("status").isin(*LIVE_SKILLS)).select("skill_id"), "skill_id", "left_semi").select(F.col("learning_id").alias("id"))
    rows = learnings.filter("scope = 'project' AND status = 'approved' AND task_pattern IS NOT NULL")
    rows = rows.join(taken, "id", "left_anti").join(pending_sources.select(F.col("learning_id").alias("id")), "id", "left_anti")
    return top_per_key(
        rows, ["project_id"], [F.coalesce("confidence", F.lit(0.0)).desc(), F.coalesce("updated_at", "created_at").desc(), F.col("id").asc()], limit
    )


def anchors(skills: DataFrame, derived: DataFrame) -> DataFrame:
    """(learning_id, skill_ids): facts live skills were derived from."""
    live = skills.filter("status = 'approved'").select("skill_id")
    return derived.join(live, "skill_id").groupBy("learning_id").agg(F.array_sort(F.collect_set("skill_id")).alias("skill_ids"))


def pattern_groups(eligible: DataFrame, anchor_skills: DataFrame, tags: DataFrame, min_cluster: int = params.SKILL_MIN_CLUSTER) -> DataFrame:
    """One row per pattern with eligible members: a patch group of the one skill its anchors
    belong to, set aside when they belong to several, a create group when there is none and
    enough members. Members are the project's eligible facts, 200 at most."""
    tagged = tags.select("learning_id", "pattern_id")
    own = tagged.join(eligible.select(F.col("id").alias("learning_id"), "project_id", "confidence"), "learning_id")
    own = own.join(anchor_skills.select("learning_id"), "learning_id", "left_anti")
    groups = own.groupBy("project_id", "pattern_id").agg(
        F.array_sort(F.collect_list("learning_id")).alias("members"), F.sum(F.coalesce("confidence", F.lit(0.0))).alias("confidence")
    )
    held = tagged.join(anchor_skills, "learning_id").select("pattern_id", F.explode("skill_ids").alias("skill_id")).groupBy("pattern_id").agg(
        F.min("skill_id").alias("skill_id"), F.count_distinct("skill_id").alias("__skills")
    )
    rows = groups.join(held, "pattern_id", "left").withColumn("n", F.size("members")).withColumn("__skills", F.coalesce("__skills", F.lit(0)))
    kind = F.when(F.col("__skills") > 1, "several").when(F.col("__skills") == 1, "patch").when(F.col("n") >= min_cluster, "create")
    return rows.withColumns(
        {
            "kind": kind,
            "skill_id": F.when(F.col("__skills") == 1, F.col("skill_id")),
            "fingerprint": fingerprint(F.col("members")),
        }
    ).filter("kind IS NOT NULL").drop("__skills")


def fingerprint(members: Column) -> Column:
    ids = F.array_sort(F.transform(members, lambda m: m.cast("string")))
    return F.substring(F.sha1(F.array_join(ids, "\n").cast("binary")), 1, 16)


def cohesion(groups: DataFrame, vectors: DataFrame) -> DataFrame:
    """(group_id, cohesion): mean pairwise cosine, 1 with fewer than two vectors. On unit
    vectors the pair sum is (|sum u|^2 - n) / 2, so no pair is formed. ``groups``:
    (group_id, member); ``vectors``: (id, embedding)."""
    units = groups.join(vectors.select(F.col("id").alias("member"), unit(F.col("embedding")).alias("u")), "member").filter("u IS NOT NULL")
    counts = units.groupBy("group_id").agg(F.count("*").alias("n"))
    length = units.select("group_id", F.posexplode("u").alias("pos", "x")).groupBy("group_id", "pos").agg(F.sum("x").alias("s")).groupBy(
        "group_id"
    ).agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    mean = (F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    rows = groups.select("group_id").distinct().join(counts, "group_id", "left").join(length, "group_id", "left")
    return rows.select("group_id", F.when(F.coalesce("n", F.lit(0)) >= 2, mean).otherwise(F.lit(1.0)).alias("cohesion"))


def rank_groups(groups: DataFrame, cohesions: DataFrame, stale: DataFrame) -> DataFrame:
    """Patches of stale skills, patches, creates; then size, cohesion, confidence, id."""
    rows = groups.filter("kind <> 'several'").join(cohesions.withColumnRenamed("group_id", "pattern_id"), "pattern_id").join(
        stale.select("skill_id", F.lit(True).alias("__stale")).distinct(), "skill_id", "left"
    )
    tier = F.when(F.col("kind") != "patch", 2).when(F.coalesce("__stale", F.lit(False)), 0).otherwise(1)
    order = [F.col("tier").asc(), F.col("n").desc(), F.round("cohesion", 6).desc(), F.round("confidence", 6).desc(), F.col("pattern_id").asc()]
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(*order))
    return rows.withColumn("tier", tier).withColumn("rank", place).drop("__stale")


def refused_fingerprints(versions: DataFrame, audits: DataFrame) -> DataFrame:
    """(project_id, fingerprint) of rejected or blocked versions and ignored proposals."""
    out = versions.filter("outcome IN ('rejected', 'blocked') AND fingerprint IS NOT NULL").select("project_id", "fingerprint")
    return out.union(audits.filter("fingerprint IS NOT NULL").select("project_id", "fingerprint")).distinct()


def digest_failures(rows: DataFrame, covered: DataFrame, cap: int = RAW_FAILURES) -> DataFrame:
    """Per group the newest distinct (tool, error head) of durable failures of tools no curated
    error covers. ``rows``: (group_id, tool_name, tool_response, ts), a short scan per group;
    ``covered``: (group_id, key)."""
    named = rows.filter(F.trim(F.coalesce("tool_name", F.lit(""))) != "")
    free = named.alias("r").join(
        covered.filter("key <> ''").alias("c"),
        (F.col("r.group_id") == F.col("c.group_id")) & F.lower(F.col("r.tool_name")).contains(F.lower(F.col("c.key"))), "left_anti",
    )
    texts = free.withColumn("__t", failure_text(F.col("tool_response")))
    texts = texts.withColumn("excerpt", clip(F.when(F.col("__t") != "", F.col("__t")).otherwise(truncate(F.col("tool_response"), EXCERPT)), EXCERPT))
    kept = texts.filter((F.coalesce("excerpt", F.lit("")) != "") & ~is_transient(F.col("excerpt")))
    heads = kept.groupBy("group_id", F.lower("tool_name").alias("__tool"), F.lower(F.substring("excerpt", 1, 120)).alias("__head")).agg(
        F.max(F.struct("ts", "tool_name", "excerpt")).alias("x")
    ).select("group_id", "x.ts", F.col("x.tool_name").alias("tool_key"), F.col("x.excerpt").alias("error_signature"))
    return top_per_key(heads, ["group_id"], [F.col("ts").desc(), F.col("tool_key").asc(), F.col("error_signature").asc()], cap)


def error_context(groups: DataFrame, members: DataFrame, links: DataFrame, learnings: DataFrame, events: DataFrame) -> DataFrame:
    """Failures known from the sessions of a group's pattern: up to six approved error facts by
    support (members left out, but still covering their tool), then up to four digests of the
    last forty other failed calls. ``groups``: (group_id, pattern_id); ``members``: (group_id,
    learning_id); ``links``: (pattern_id, session_id)."""
    where = groups.join(links, "pattern_id").select("group_id", "session_id").distinct()
    errors = learnings.filter("kind = 'error' AND status = 'approved'")
    found = where.join(errors, "session_id").select(
        "group_id", "id", "tool_key", F.coalesce("error_signature", "text").alias("error_signature"), "support_count", "resolved"
    ).dropDuplicates(["group_id", "id"])
    own = members.select("group_id", F.col("learning_id").alias("id"), F.lit(True).alias("__own"))
    sizes = members.groupBy("group_id").agg(F.count("*").alias("__own_n"))
    order = [F.coalesce("support_count", F.lit(0)).desc(), F.col("id").asc()]
    # As far as the six best may lie behind the group's own members.
    window = found.withColumn("__r", F.row_number().over(Window.partitionBy("group_id").orderBy(*order))).join(sizes, "group_id", "left").filter(
        F.col("__r") <= CURATED_ERRORS + F.coalesce("__own_n", F.lit(0))
    )
    covered = window.filter("tool_key IS NOT NULL").select("group_id", F.col("tool_key").alias("key")).distinct()
    curated = top_per_key(window.join(own, ["group_id", "id"], "left").filter("__own IS NULL"), ["group_id"], order, CURATED_ERRORS)
    failed = events.filter("tool_error AND tool_name IS NOT NULL AND NOT coalesce(is_interrupt, false)")
    # The newest forty of a group are among the newest forty of each of its sessions, so that is all that a session hands up, to
    # however many groups; both steps keep forty rows per key and task before they shuffle.
    newest = [F.col("ts").desc(), F.col("tool_name").asc(), F.col("tool_response").asc()]
    own_newest = failed.select("session_id", "tool_name", "tool_response", "ts").join(where.select("session_id").distinct(), "session_id", "left_semi").distinct()
    handed = top_per_key(own_newest, ["session_id"], newest, RAW_SCAN, "__s").drop("__s")
    scan = where.join(handed, "session_id").drop("session_id").distinct()
    scan = top_per_key(scan, ["group_id"], newest, RAW_SCAN, "__s")
    raw = digest_failures(scan, covered)
    return curated.select("group_id", F.lit("learning").alias("kind"), F.col("id").cast("string").alias("id"), "tool_key", "error_signature", "rank").unionByName(
        raw.select("group_id", F.lit("raw_failure").alias("kind"), F.lit(None).cast("string").alias("id"), "tool_key", "error_signature", "rank")
    )


def check_proposals(proposals: DataFrame, groups: DataFrame, inventory: DataFrame) -> DataFrame:
    """(proposal_id, slug, reason): reason null when sound, else the first failing rule.
    ``proposals``: (proposal_id, group_id, action, target_slug, name, description, content,
    derived_from, informed_by, known_failures); ``groups``: (group_id, project_id, kind,
    skill_id, members); ``inventory``: (skill_id, project_id, slug)."""
    p = proposals.join(groups.select("group_id", "project_id", F.col("kind").alias("g_kind"), F.col("skill_id").alias("g_skill"), "members"), "group_id", "left")
    own = inventory.select(F.col("skill_id").alias("g_skill"), F.col("slug").alias("g_slug"))
    fresh = slugify(truncate(F.coalesce("name", F.lit("")), 80))
    p = p.join(own, "g_skill", "left").withColumn("__slug", fresh)
    used = inventory.select("project_id", F.col("slug").alias("__slug"), F.lit(True).alias("__used")).distinct()
    p = p.join(used, ["project_id", "__slug"], "left")
    action = F.lower(F.trim(F.coalesce("action", F.lit(""))))
    content = F.trim(F.coalesce("content", F.lit("")))
    missing = None
    for section in REQUIRED_SECTIONS:
        gone = ~content.contains(section)
        missing = gone if missing is None else missing | gone
    create = action == "create"
    # What each rule says, in the order they are tried.
    reason = (
        F.when(~action.isin("create", "update", "ignore"), "unknown action")
        .when(action == "ignore", None)
        .when((F.col("g_kind") == "patch") & (action != "update"), "this group targets an existing skill; action must be update or ignore")
        .when((F.col("g_kind") == "create") & ~create, "this group has no target skill; action must be create or ignore")
        .when(F.coalesce(F.size("derived_from"), F.lit(0)) <= 0, "derived_from must be a non-empty list of learning labels")
        .when(F.size(F.array_except("derived_from", "members")) > 0, "derived_from contains unknown entries")
        .when(F.size(F.array_except(F.coalesce("informed_by", F.array().cast("array<string>")), "known_failures")) > 0, "informed_by contains unknown labels")
        .when(content == "", "content is required for create/update")
        .when(F.length(content) > MAX_CONTENT, f"content exceeds {MAX_CONTENT} characters")
        .when(missing, "content is missing required sections")
        .when(create & (F.size(F.array_distinct("derived_from")) < 2), "a new skill must fold at least two learnings")
        .when(create & ((F.trim(F.coalesce("name", F.lit(""))) == "") | (F.trim(F.coalesce("description", F.lit(""))) == "")), "name and description are required for create")
        .when(create & F.coalesce("__used", F.lit(False)), "slug collides with an existing skill")
        .when(~create & F.col("g_slug").isNull(), "update group has no resolvable target skill")
        .when(~create & (F.trim(F.coalesce("target_slug", F.lit(""))) != F.col("g_slug")), "target_skill_slug does not name the group's skill")
    )
    return p.select("proposal_id", F.when(create, F.col("__slug")).otherwise(F.col("g_slug")).alias("slug"), reason.alias("reason"))


def inventory(skills: DataFrame, versions: DataFrame) -> DataFrame:
    pending = versions.filter("outcome = 'pending'").select("skill_id", F.lit(True).alias("has_pending")).distinct()
    vers = versions.filter("outcome = 'accepted'").groupBy("skill_id").agg(F.max("version").alias("version"))
    return skills.filter(F.col("status").isin(*LIVE_SKILLS)).join(pending, "skill_id", "left").join(vers, "skill_id", "left").select(
        "skill_id", "project_id", "slug", "status", F.coalesce("version", F.lit(0)).alias("version"),
        F.coalesce("needs_revision", F.lit(False)).alias("needs_revision"), F.coalesce("has_pending", F.lit(False)).alias("has_pending"),
    )


def skill_with_sources(skills: DataFrame, derived: DataFrame, learnings: DataFrame, informed: DataFrame) -> DataFrame:
    """Live skills with how many sources they have, which were rejected, and the errors that
    informed them; a warning when one is due for revision. Rejected sources and informing
    errors are lists; a distilled skill folds at most a group's 200 facts."""
    known = derived.join(learnings.select(F.col("id").alias("learning_id"), "status"), "learning_id")
    src = known.groupBy("skill_id").agg(
        F.count("*").alias("n_sources"), F.array_sort(F.collect_set("learning_id")).alias("derived_from"),
        F.array_sort(F.collect_set(F.when(F.col("status") == "rejected", F.col("learning_id")))).alias("stale_sources"),
    )
    inf = informed.join(learnings.select(F.col("id").alias("learning_id"), F.coalesce("error_signature", "text").alias("title")), "learning_id").groupBy(
        "skill_id"
    ).agg(F.array_sort(F.collect_set("title")).alias("informed_by"))
    warn = F.when(F.coalesce("needs_revision", F.lit(False)), "sources changed; verify before use")
    return skills.filter("status = 'approved'").join(src, "skill_id", "left").join(inf, "skill_id", "left").withColumn("warning", warn)


def skill_source_rows(skills: DataFrame, derived: DataFrame, learnings: DataFrame, informed: DataFrame) -> DataFrame:
    """(skill_id, kind, value, status) of the live skills, one row per source and per error that informed them, for skills of any
    number of either: kind is ``source`` with the fact's id and status, or ``informed_by`` with the error's title."""
    alive = skills.filter("status = 'approved'").select("skill_id")
    sources = derived.join(learnings.select(F.col("id").alias("learning_id"), "status"), "learning_id").select(
        "skill_id", F.lit("source").alias("kind"), F.col("learning_id").cast("string").alias("value"), "status")
    errors = informed.join(learnings.select(F.col("id").alias("learning_id"), F.coalesce("error_signature", "text").alias("value")), "learning_id").select(
        "skill_id", F.lit("informed_by").alias("kind"), "value", F.lit(None).cast("string").alias("status"))
    return sources.unionByName(errors).filter("value IS NOT NULL").join(alive, "skill_id", "left_semi").distinct()


def review_queue(skills: DataFrame, versions: DataFrame, sources: DataFrame, learnings: DataFrame, limit: int = 20) -> DataFrame:
    """Pending versions, oldest first, with every source's present status; ``missing`` when the
    source is gone. The live content is shown for updates only. ``sources``: (version_id, learning_id)."""
    live = skills.filter(F.col("status").isin(*LIVE_SKILLS)).select("skill_id", "slug", F.col("content").alias("__content"))
    rows = versions.filter("outcome = 'pending'").join(live, "skill_id")
    top = top_per_key(rows, ["project_id"], [F.col("created_at").asc(), F.col("version_id").asc()], limit)
    named = sources.join(top.select("version_id"), "version_id", "left_semi").join(
        learnings.select(F.col("id").alias("learning_id"), F.col("status").alias("__s")), "learning_id", "left"
    )
    listed = named.groupBy("version_id").agg(
        F.array_sort(F.collect_list(F.struct("learning_id", F.coalesce("__s", F.lit("missing")).alias("status")))).alias("derived_from")
    )
    return top.join(listed, "version_id", "left").select(
        "project_id", "rank", "version_id", "skill_id", "slug", "proposal_action", F.coalesce("safety_status", F.lit("unscreened")).alias("safety_status"),
        F.when(F.col("proposal_action") == "update", F.col("__content")).alias("current_content"), "derived_from",
    )


CONTENT = ("name", "description", "content", "embedding")
SOURCES = {"derived_from": "DERIVED_FROM", "informed_by": "INFORMED_BY"}


def write_proposals(accepted: DataFrame, versions: DataFrame, skills: DataFrame) -> dict[str, DataFrame]:
    """Sound proposals to rows: creates upsert a candidate skill, both add a pending version
    numbered after the existing ones, ignores become audit rows. ``accepted``: (proposal_id,
    project_id, action, skill_id (updates), slug, fingerprint, at, and where given name, description, content,
    embedding, which the version carries, and derived_from, informed_by, lists of learning ids that become
    provenance rows (version_id, skill_id, learning_id, kind))."""
    carried = [c for c in CONTENT if c in accepted.columns]
    skill_id = F.when(F.col("action") == "create", F.concat_ws(":", F.lit("skill"), F.col("project_id").cast("string"), "slug")).otherwise(F.col("skill_id").cast("string"))
    rows = accepted.withColumn("skill_id", skill_id)
    count = versions.groupBy(F.col("skill_id").cast("string").alias("skill_id")).agg(F.count("*").alias("__n"))
    todo = rows.filter("action <> 'ignore'").join(count, "skill_id", "left")
    # A run proposes twice per project at most, so a skill gets few new versions at once.
    nth = F.expr("row_number() OVER (PARTITION BY skill_id ORDER BY at, proposal_id)")
    made = todo.withColumn("version", F.coalesce("__n", F.lit(0)) + nth).select(
        F.concat(F.col("skill_id"), F.lit(":v"), F.col("version").cast("string")).alias("version_id"), "skill_id", "project_id", "version",
        F.col("action").alias("proposal_action"), "fingerprint", F.lit("pending").alias("outcome"), "proposal_id", *carried,
        *[c for c in SOURCES if c in accepted.columns],
    )
    # A proposal's lists hold members of one group, which is bounded.
    none = made.select("version_id", "skill_id", F.lit(None).cast("string").alias("learning_id"), F.lit("").alias("kind")).limit(0)
    origin = [
        made.select("version_id", "skill_id", F.explode(F.array_distinct(c).cast("array<string>")).alias("learning_id"), F.lit(kind).alias("kind"))
        for c, kind in SOURCES.items() if c in accepted.columns
    ]
    made = made.drop(*SOURCES)
    new = rows.filter("action = 'create'").groupBy("skill_id", "project_id", "slug").agg(F.min("at").alias("created_at")).withColumn("status", F.lit("candidate"))
    audit = rows.filter("action = 'ignore'").groupBy(
        F.concat_ws(":", F.lit("skillaudit"), F.col("project_id").cast("string"), "fingerprint").alias("audit_id"), "project_id", "fingerprint"
    ).agg(F.max("at").alias("updated_at"))
    provenance = none
    for part in origin:
        provenance = part if provenance is none else provenance.unionByName(part)
    return {"versions": made, "skills": new, "audits": audit, "provenance": provenance}


def route_proposals(versions: DataFrame, skills: DataFrame, verdicts: DataFrame, mode: str = "auto") -> DataFrame:
    """(version_id, skill_id, route): activate, queue, block or defer every pending version. A
    version screened before is not judged again."""
    live = skills.filter(F.col("status").isin(*LIVE_SKILLS)).select("skill_id", F.col("status").alias("skill_status"))
    rows = versions.filter("outcome = 'pending'").join(live, "skill_id").join(verdicts, "version_id", "left")
    go = "queue" if mode == "human" else "activate"
    route = F.when(F.col("safety_status") == "passed", go).when(F.col("verdict") == "block", "block").when(F.col("verdict") == "pass", go).otherwise("defer")
    reason = F.when(route == "block", F.concat_ws(": ", "category", F.nullif(F.col("reason"), F.lit(""))))
    return rows.select("version_id", "skill_id", "project_id", "version", "skill_status", "created_at", route.alias("route"), reason.alias("reason"))


def compiled(learnings: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Learnings that a live version draws on are marked as compiled into its skill; the rest stay. ``sources``: (learning_id, skill_id)."""
    used = sources.groupBy(F.col("learning_id").alias("id")).agg(F.max("skill_id").alias("__skill"))
    had = [F.col(c) for c in ("compiled_skill_id",) if c in learnings.columns]
    since = [F.col(c) for c in ("compiled_at",) if c in learnings.columns]
    return learnings.join(used, "id", "left").withColumns(
        {
            "consolidated": F.col("consolidated") | F.col("__skill").isNotNull(),
            "compiled_skill_id": F.coalesce("__skill", *had),
            "compiled_at": F.coalesce(*since, F.when(F.col("__skill").isNotNull(), now)),
        }
    ).drop("__skill")


def apply_routes(routes: DataFrame, versions: DataFrame, skills: DataFrame, sources: DataFrame, learnings: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Effects of routing: activated versions become the skill's content and compile their
    sources, passed ones stay pending, blocked creates become tombstones. Several activations
    of one skill apply oldest first, so the last one stays."""
    r = routes.select("version_id", "route", F.col("reason").alias("__reason"))
    v = versions.join(r, "version_id", "left").withColumns(
        {
            "outcome": F.when(F.col("route") == "activate", "accepted").when(F.col("route") == "block", "blocked").otherwise(F.col("outcome")),
            "safety_status": F.when(F.col("route").isin("activate", "queue"), "passed").when(F.col("route") == "block", "blocked").otherwise(F.col("safety_status")),
            "safety_reason": F.coalesce("__reason", F.col("safety_reason") if "safety_reason" in versions.columns else F.lit(None).cast("string")),
        }
    ).drop("route", "__reason")
    at = F.struct("created_at", "version_id")
    kinds = dict(versions.dtypes)
    content = [c for c in ("version", "name", "description", "content", "embedding") if c in kinds]
    chosen = routes.select("version_id", "skill_id", "route", "created_at").join(versions.select("version_id", *content), "version_id")
    fate = chosen.groupBy("skill_id").agg(
        F.max_by("version", F.when(F.col("route") == "activate", at)).alias("__live"),
        *[F.max_by(c, F.when(F.col("route") == "activate", at)).alias(f"__to_{c}") for c in content],
        F.bool_or(F.col("route") == "block").alias("__blocked"),
    )
    s = skills.join(fate, "skill_id", "left")
    live = F.col("__live").isNotNull()
    dead = ~live & F.coalesce("__blocked", F.lit(False)) & (F.col("status") == "candidate")
    s = s.withColumns(
        {
            "status": F.when(live, "approved").when(dead, "blocked").otherwise(F.col("status")),
            **{c: F.coalesce(f"__to_{c}", F.col(c) if c in skills.columns else F.lit(None).cast(kinds[c])) for c in content},
            "needs_revision": F.when(live, F.lit(False)).otherwise(F.col("needs_revision")),
        }
    ).withColumn("embedding", F.when(dead, None).otherwise(F.col("embedding"))).drop("__live", "__blocked", *[f"__to_{c}" for c in content])
    done = compiled(learnings, sources.join(routes.filter("route = 'activate'").select("version_id", "skill_id"), "version_id"), now)
    return {"versions": v, "skills": s, "learning": done}


def human_skill_decisions(
    decisions: DataFrame, skills: DataFrame, versions: DataFrame, derived: DataFrame,
    sources: DataFrame | None = None, learnings: DataFrame | None = None, now: Column | None = None,
) -> dict[str, DataFrame]:
    """approve, edit_approve, reject (newest pending version), retire. An approved version's name, description, content and
    embedding become the skill's, an edit (``edited_content``) before the version's own; with ``sources``
    (version_id, learning_id) and ``learnings`` the version's sources are compiled. Returns skills, versions,
    freed (skill_id of rejected candidates, whose source links go), recalled (learning_id no
    other live skill serves any more) and learning. ``decisions``: (skill_id, action)."""
    newest = versions.filter("outcome = 'pending'").groupBy("skill_id").agg(F.max("version").alias("__v"))
    d = decisions.join(skills.select("skill_id", "status"), "skill_id").join(newest, "skill_id", "left")
    ok = d.filter(F.when(F.col("action") == "retire", F.col("status") == "approved").otherwise(F.col("__v").isNotNull()))
    yes = F.col("action").isin("approve", "edit_approve")
    carried = [c for c in CONTENT if c in versions.columns]
    taken = versions.select("skill_id", F.col("version").alias("__v"), *[F.col(c).alias(f"__to_{c}") for c in carried])
    edited = ["edited_content"] if "edited_content" in decisions.columns else []
    s = skills.join(ok.select("skill_id", "action", "__v", *edited).join(taken, ["skill_id", "__v"], "left"), "skill_id", "left")
    brought = {c: F.when(yes, F.col(f"__to_{c}")) for c in carried}
    if edited:
        brought["content"] = F.when(yes, F.coalesce(F.when(F.col("action") == "edit_approve", F.col("edited_content")), brought.get("content")))
    status = F.when(yes, "approved").when(F.col("action") == "retire", "retired").when(
        (F.col("action") == "reject") & (F.col("status") == "candidate"), "rejected"
    ).otherwise(F.col("status"))
    after = s.select(
        *[c for c in skills.columns if c not in ("status", "needs_revision", "embedding", "version", *brought)], status.alias("status"),
        *[F.coalesce(v, *[F.col(c) for c in (c,) if c in skills.columns]).alias(c) for c, v in brought.items() if c != "embedding"],
        F.when(yes, F.lit(False)).when(F.col("action") == "retire", None).otherwise(F.col("needs_revision")).alias("needs_revision"),
        F.when(status.isin("retired", "rejected") & F.col("action").isNotNull(), None).otherwise(
            F.coalesce(brought["embedding"], "embedding") if "embedding" in brought else F.col("embedding")
        ).alias("embedding"),
        F.coalesce(F.when(yes, F.col("__v")), *[F.col(c) for c in ("version",) if c in skills.columns]).alias("version"),
    )
    settled = ok.filter("action <> 'retire'").select("skill_id", F.col("__v").alias("version"), F.when(F.col("action") == "reject", "rejected").otherwise("accepted").alias("__o"))
    v = versions.join(settled, ["skill_id", "version"], "left").withColumn("outcome", F.coalesce("__o", "outcome")).drop("__o")
    freed = ok.filter("action = 'reject' AND status = 'candidate'").select("skill_id")
    still = derived.join(after.filter("status = 'approved'").select("skill_id"), "skill_id", "left_semi").select("learning_id")
    back = derived.join(ok.filter("action = 'retire'").select("skill_id"), "skill_id", "left_semi").select("learning_id").distinct().join(still, "learning_id", "left_anti")
    out = {"skills": after, "versions": v, "freed": freed, "recalled": back}
    if sources is not None and learnings is not None:
        live = ok.filter(yes).select("skill_id", F.col("__v").alias("version")).join(versions.select("skill_id", "version", "version_id"), ["skill_id", "version"])
        out["learning"] = compiled(learnings, sources.join(live, "version_id"), now)
    return out


def live_catalogue(skills: DataFrame, limit: int = 20) -> DataFrame:
    """Slugs of live skills, most recently used first."""
    used = [c for c in ("last_used_at", "updated_at", "created_at") if c in skills.columns]
    return top_per_key(skills.filter("status = 'approved'"), ["project_id"], [F.coalesce(*used).desc(), F.col("slug").asc()], limit).select("project_id", "slug", "rank")
