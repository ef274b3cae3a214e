"""Skills, profiles, due jobs, audit, timeline, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelore.catalog.base import Tables, query
from tracelore.catalog.events import micros, sql_trunc
from tracelore.catalog.memory import now
from tracelore.catalog.recall import COS, FLOOR, LIVE, n, r6
from tracelore.operators import audit, recall, skills
from tracelore.operators.segments import top_per_key


def joined(name: str):
    return F.array_join(F.transform(name, lambda x: x.cast("string")), ",").alias(name)


ELIGIBLE_SQL = """
 pend AS (SELECT DISTINCT s.learning_id FROM version_source s JOIN skill_version v USING (version_id) WHERE v.outcome = 'pending'),
 elig AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY confidence DESC, updated_at DESC, id) AS rank FROM learning l
   WHERE scope = 'project' AND status = 'approved' AND id NOT IN (SELECT learning_id FROM derived_from JOIN skill USING (skill_id) WHERE skill.status IN ('candidate', 'approved'))
   AND id NOT IN (SELECT learning_id FROM pend) QUALIFY rank <= 200)
"""
EL_USES = "learning skill skill_version derived_from version_source"


def _pending_sources(t: Tables):
    return t.version_source.join(t.skill_version.filter("outcome = 'pending'").select("version_id"), "version_id", "left_semi").select("learning_id").distinct()


def _eligible(t: Tables):
    return skills.eligible_learnings(t.learning, t.skill, t.derived_from, _pending_sources(t))


@query("eligible_learnings", rows="J12", uses=EL_USES, oracle=f"WITH {ELIGIBLE_SQL} SELECT project_id, id, rank FROM elig")
def eligible_learnings(t: Tables):
    return _eligible(t).select("project_id", "id", n("rank"))


@query("skill_anchors", rows="J13", uses="skill derived_from", oracle="""
SELECT learning_id, string_agg(DISTINCT CAST(skill_id AS VARCHAR), ',') AS skill_ids FROM derived_from JOIN skill USING (skill_id) WHERE skill.status = 'approved' GROUP BY 1""")
def skill_anchors(t: Tables):
    return skills.anchors(t.skill, t.derived_from).select("learning_id", joined("skill_ids"))


GROUPS_SQL = f"""{ELIGIBLE_SQL},
 anc AS (SELECT learning_id, skill_id FROM derived_from JOIN skill USING (skill_id) WHERE skill.status = 'approved'),
 tags AS (SELECT id AS learning_id, project_id * 1000 + label AS pattern_id FROM learning),
 own AS (SELECT e.project_id, t.pattern_id, e.id, e.confidence FROM elig e JOIN tags t ON t.learning_id = e.id WHERE e.id NOT IN (SELECT learning_id FROM anc)),
 held AS (SELECT pattern_id, count(DISTINCT skill_id) AS k, min(skill_id) AS skill_id FROM tags JOIN anc USING (learning_id) GROUP BY 1),
 grp AS (SELECT o.project_id, o.pattern_id, count(*) AS n, sum(o.confidence) AS confidence, coalesce(max(h.k), 0) AS k, max(h.skill_id) AS sk,
   substr(sha1(string_agg(CAST(o.id AS VARCHAR), chr(10) ORDER BY CAST(o.id AS VARCHAR))), 1, 16) AS fingerprint FROM own o LEFT JOIN held h USING (pattern_id) GROUP BY 1, 2),
 kinds AS (SELECT *, CASE WHEN k > 1 THEN 'several' WHEN k = 1 THEN 'patch' WHEN n >= 2 THEN 'create' END AS kind, CASE WHEN k = 1 THEN sk END AS skill_id FROM grp)
"""


def _groups(t: Tables):
    tags = t.learning.select(F.col("id").alias("learning_id"), (F.col("project_id") * 1000 + F.col("label")).alias("pattern_id"))
    return skills.pattern_groups(_eligible(t), skills.anchors(t.skill, t.derived_from), tags)


@query("pattern_groups", rows="A2 A4 T13", uses=EL_USES, oracle=f"""WITH {GROUPS_SQL}
SELECT project_id, pattern_id, kind, skill_id, n, fingerprint, round(confidence, 6) AS confidence FROM kinds WHERE kind IS NOT NULL""")
def pattern_groups(t: Tables):
    return _groups(t).select("project_id", "pattern_id", "kind", "skill_id", n("n"), "fingerprint", r6("confidence"))


COHESION_SQL = f"""
 members AS (SELECT skill_id AS group_id, learning_id AS member FROM derived_from),
 coh AS (SELECT a.group_id, avg({COS.format(a='x.embedding', b='y.embedding')}) AS cohesion FROM members a JOIN members b ON a.group_id = b.group_id AND a.member < b.member
   JOIN learning x ON x.id = a.member JOIN learning y ON y.id = b.member GROUP BY 1)
"""


@query("group_cohesion", rows="A3", uses="learning derived_from", oracle=f"""WITH {COHESION_SQL}
SELECT g.group_id, round(coalesce(c.cohesion, 1.0::DOUBLE), 6) AS cohesion FROM (SELECT DISTINCT group_id FROM members) g LEFT JOIN coh c USING (group_id)""")
def group_cohesion(t: Tables):
    return skills.cohesion(t.derived_from.select(F.col("skill_id").alias("group_id"), F.col("learning_id").alias("member")), t.learning).select("group_id", r6("cohesion"))


@query("ranked_groups", rows="W6", uses=EL_USES, oracle=f"""WITH {GROUPS_SQL},
 coh AS (SELECT a.pattern_id, avg({COS.format(a='x.embedding', b='y.embedding')}) AS cohesion FROM own a JOIN own b ON a.pattern_id = b.pattern_id AND a.id < b.id
   JOIN learning x ON x.id = a.id JOIN learning y ON y.id = b.id GROUP BY 1)
SELECT k.project_id, k.pattern_id, row_number() OVER (PARTITION BY k.project_id ORDER BY CASE WHEN kind <> 'patch' THEN 2 WHEN s.needs_revision THEN 0 ELSE 1 END, n DESC,
  round(coalesce(cohesion, 1.0), 6) DESC, round(k.confidence, 6) DESC, k.pattern_id) AS rank FROM kinds k LEFT JOIN coh c USING (pattern_id) LEFT JOIN skill s ON s.skill_id = k.skill_id AND s.status = 'approved' WHERE kind IN ('patch', 'create')""")
def ranked_groups(t: Tables):
    groups = _groups(t)
    co = skills.cohesion(groups.select(F.col("pattern_id").alias("group_id"), F.explode("members").alias("member")), t.learning)
    stale = t.skill.filter("needs_revision AND status = 'approved'")
    return skills.rank_groups(groups, co, stale).select("project_id", "pattern_id", n("rank"))


@query("refused_fingerprints", rows="U2", uses="skill skill_version proposal", oracle="""
SELECT project_id, fingerprint FROM skill_version WHERE outcome IN ('rejected', 'blocked') UNION SELECT project_id, fingerprint FROM proposal WHERE action = 'ignore'""")
def refused_fingerprints(t: Tables):
    return skills.refused_fingerprints(t.skill_version, t.proposal.filter("action = 'ignore'"))


@query("skill_inventory", rows="A15", uses="skill skill_version", oracle="""
SELECT skill_id, slug, status, needs_revision, EXISTS (SELECT 1 FROM skill_version v WHERE v.skill_id = s.skill_id AND outcome = 'pending') AS has_pending,
 coalesce((SELECT max(version) FROM skill_version v WHERE v.skill_id = s.skill_id AND outcome = 'accepted'), 0) AS version FROM skill s""")
def skill_inventory(t: Tables):
    return skills.inventory(t.skill, t.skill_version).select("skill_id", "slug", "status", "needs_revision", "has_pending", "version")


@query("skill_with_sources", rows="J15", uses="skill derived_from learning", oracle="""
SELECT s.skill_id, (SELECT string_agg(CAST(learning_id AS VARCHAR), ',' ORDER BY learning_id) FROM derived_from d WHERE d.skill_id = s.skill_id) AS derived_from,
 coalesce((SELECT string_agg(CAST(learning_id AS VARCHAR), ',' ORDER BY learning_id) FROM derived_from d JOIN learning l ON l.id = d.learning_id WHERE d.skill_id = s.skill_id AND l.status = 'rejected'), '') AS stale_sources,
 (SELECT string_agg(DISTINCT error_signature, ',' ORDER BY error_signature) FROM learning l WHERE l.project_id = s.project_id AND l.kind = 'error') AS informed_by,
 CASE WHEN needs_revision THEN 'sources changed; verify before use' END AS warning FROM skill s WHERE s.status = 'approved'""")
def skill_with_sources(t: Tables):
    informed = t.skill.select("skill_id", "project_id").join(t.learning.filter("kind = 'error'").select("project_id", F.col("id").alias("learning_id")), "project_id").select("skill_id", "learning_id")
    return skills.skill_with_sources(t.skill, t.derived_from, t.learning, informed).select(
        "skill_id", joined("derived_from"), joined("stale_sources"), joined("informed_by"), "warning"
    )


@query("skill_source_rows", rows="J15", uses="skill derived_from learning", oracle="""
SELECT d.skill_id, 'source' AS kind, CAST(d.learning_id AS VARCHAR) AS value, l.status FROM derived_from d JOIN learning l ON l.id = d.learning_id JOIN skill s USING (skill_id) WHERE s.status = 'approved'
UNION SELECT s.skill_id, 'informed_by', coalesce(l.error_signature, l.text), NULL FROM skill s JOIN learning l ON l.project_id = s.project_id AND l.kind = 'error' WHERE s.status = 'approved'""")
def skill_source_rows(t: Tables):
    informed = t.skill.select("skill_id", "project_id").join(t.learning.filter("kind = 'error'").select("project_id", F.col("id").alias("learning_id")), "project_id").select("skill_id", "learning_id")
    return skills.skill_source_rows(t.skill, t.derived_from, t.learning, informed)


@query("review_queue", rows="J16", uses="skill skill_version version_source learning", oracle="""
WITH q AS (SELECT v.project_id, v.version_id, v.skill_id, s.slug, v.proposal_action, coalesce(v.safety_status, 'unscreened') AS safety_status, CASE WHEN proposal_action = 'update' THEN md5(s.content) END AS current_content,
  row_number() OVER (PARTITION BY v.project_id ORDER BY v.created_at, v.version_id) AS rank FROM skill_version v JOIN skill s USING (skill_id) WHERE v.outcome = 'pending' QUALIFY rank <= 20)
SELECT q.*, (SELECT string_agg(m.learning_id || '=' || CASE WHEN l.label = 8 OR l.id IS NULL THEN 'missing' ELSE l.status END, ',' ORDER BY m.learning_id) FROM version_source m LEFT JOIN learning l ON l.id = m.learning_id WHERE m.version_id = q.version_id) AS derived_from FROM q""")
def review_queue(t: Tables):
    rows = skills.review_queue(t.skill, t.skill_version, t.version_source, t.learning.filter("label <> 8"))
    listed = F.array_join(F.transform("derived_from", lambda x: F.concat(x["learning_id"].cast("string"), F.lit("="), x["status"])), ",")
    return rows.select("project_id", "version_id", "skill_id", "slug", "proposal_action", "safety_status", F.md5("current_content").alias("current_content"), n("rank"), listed.alias("derived_from"))


CONTEXT_USES = "learning session_event skill derived_from"
RAW_FAIL = "CASE WHEN k % 6 = 0 THEN 'connection refused by host ' || k WHEN k % 6 = 1 THEN 'Request timed out' ELSE 'syntax error near token ' || k % 13 END"


@query("group_error_context", rows="J14 A6", uses=CONTEXT_USES, oracle=f"""WITH
 grp AS (SELECT DISTINCT project_id * 100 + label AS group_id, project_id, label FROM learning),
 wher AS (SELECT DISTINCT g.group_id, l.session_id FROM grp g JOIN learning l ON l.project_id = g.project_id AND l.label = g.label),
 mem AS (SELECT skill_id AS group_id, learning_id FROM derived_from),
 err AS (SELECT DISTINCT w.group_id, l.id, l.tool_key, l.error_signature, l.support_count FROM wher w JOIN learning l USING (session_id) WHERE l.kind = 'error' AND l.status = 'approved'),
 win AS (SELECT e.*, m.n FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY support_count DESC, id) AS r FROM err) e LEFT JOIN (SELECT group_id, count(*) AS n FROM mem GROUP BY 1) m USING (group_id) WHERE r <= 6 + coalesce(n, 0)),
 cur AS (SELECT group_id, 'learning' AS kind, CAST(id AS VARCHAR) AS id, tool_key, error_signature, row_number() OVER (PARTITION BY group_id ORDER BY support_count DESC, id) AS rank
   FROM win w WHERE NOT EXISTS (SELECT 1 FROM mem m WHERE m.group_id = w.group_id AND m.learning_id = w.id) QUALIFY rank <= 6),
 scan AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY ts DESC, tool_name, tool_response) AS r FROM (SELECT DISTINCT w.group_id, e.tool_name, e.tool_response, e.ts, {RAW_FAIL} AS excerpt, k FROM wher w JOIN session_event e USING (session_id) WHERE e.tool_error AND NOT e.is_interrupt) x QUALIFY r <= 40),
 free AS (SELECT * FROM scan s WHERE k % 6 > 1 AND NOT EXISTS (SELECT 1 FROM win c WHERE c.group_id = s.group_id AND c.tool_key IS NOT NULL AND contains(lower(s.tool_name), lower(c.tool_key)))),
 heads AS (SELECT group_id, tool_name AS tool_key, excerpt AS error_signature, max(ts) AS ts FROM free GROUP BY 1, 2, 3),
 raw AS (SELECT group_id, 'raw_failure' AS kind, CAST(NULL AS VARCHAR) AS id, tool_key, error_signature, row_number() OVER (PARTITION BY group_id ORDER BY ts DESC, tool_key, error_signature) AS rank FROM heads QUALIFY rank <= 4)
SELECT * FROM cur UNION ALL SELECT * FROM raw""")
def group_error_context(t: Tables):
    gid = (F.col("project_id") * 100 + F.col("label")).alias("group_id")
    groups = t.learning.select(gid, gid.alias("pattern_id")).distinct()
    links = t.learning.select(gid.alias("pattern_id"), "session_id").distinct()
    members = t.derived_from.select(F.col("skill_id").alias("group_id"), "learning_id")
    return skills.error_context(groups, members, links, t.learning, t.session_event).select("group_id", "kind", "id", "tool_key", "error_signature", n("rank"))


@query("proposal_check", rows="P17", uses="proposal skill", oracle="""
SELECT proposal_id, CASE action WHEN 'create' THEN 'fresh-' || proposal_id WHEN 'bogus' THEN slug WHEN 'ignore' THEN slug ELSE slug END AS slug,
 CASE WHEN action = 'bogus' THEN 'unknown action' WHEN action = 'ignore' THEN NULL
  WHEN label % 3 = 2 THEN 'derived_from contains unknown entries'
  WHEN label = 4 THEN 'content is missing required sections'
  WHEN action = 'update' AND label = 7 THEN 'target_skill_slug does not name the group''s skill'
  WHEN action = 'create' AND label = 6 THEN 'a new skill must fold at least two learnings' END AS reason FROM proposal""")
def proposal_check(t: Tables):
    p = t.proposal
    create = F.col("action") == "create"
    text = "## When to use\nx\n## Procedure\ny\n## Pitfalls\nz"
    rows = p.select(
        "proposal_id", F.col("proposal_id").alias("group_id"), "action", F.when(F.col("label") == 7, "elsewhere").otherwise(F.col("slug")).alias("target_slug"),
        F.concat(F.lit("Fresh "), F.col("proposal_id").cast("string")).alias("name"), F.lit("does it").alias("description"),
        F.when(F.col("label") == 4, "## Procedure only").otherwise(text).alias("content"),
        F.when(F.col("label") % 3 == 2, F.array(F.lit("a"), F.lit("zzz"))).when(F.col("label") == 6, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("derived_from"),
        F.array(F.lit("E1")).alias("informed_by"), F.array(F.lit("E1"), F.lit("E2")).alias("known_failures"),
    )
    groups = p.select(
        F.col("proposal_id").alias("group_id"), "project_id", F.when(create, "create").otherwise("patch").alias("kind"), "skill_id",
        F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("members"),
    )
    return skills.check_proposals(rows, groups, t.skill.select("skill_id", "project_id", "slug"))


@query("proposal_versions", rows="T14", uses="proposal skill_version skill", oracle="""
SELECT CASE WHEN action = 'create' THEN 'skill:' || project_id || ':' || slug ELSE CAST(skill_id AS VARCHAR) END || ':v' ||
 (1 + CASE WHEN action = 'create' THEN 0 ELSE (SELECT count(*) FROM skill_version v WHERE v.skill_id = p.skill_id) END) AS version_id, proposal_id, action AS proposal_action FROM proposal p WHERE action IN ('create', 'update')""")
def proposal_versions(t: Tables):
    out = skills.write_proposals(t.proposal.filter("action <> 'bogus'"), t.skill_version, t.skill)
    return out["versions"].select("version_id", "proposal_id", "proposal_action")


@query("proposal_audits", rows="T14", uses="proposal", oracle="SELECT 'skillaudit:' || project_id || ':' || fingerprint AS audit_id, epoch_us(at_) AS updated_at FROM (SELECT project_id, fingerprint, p.at AS at_ FROM proposal p WHERE action = 'ignore') x")
def proposal_audits(t: Tables):
    return skills.write_proposals(t.proposal.filter("action <> 'bogus'"), t.skill_version, t.skill)["audits"].select("audit_id", micros("updated_at"))


ROUTES_SQL = """
 routes AS (SELECT v.version_id, v.skill_id, v.version, v.created_at, s.status AS skill_status, CASE WHEN v.safety_status = 'passed' THEN 'activate' WHEN v.version_id % 4 = 0 THEN 'block' WHEN v.version_id % 4 < 3 THEN 'activate' ELSE 'defer' END AS route
   FROM skill_version v JOIN skill s USING (skill_id) WHERE v.outcome = 'pending')
"""


def _verdicts(t: Tables):
    x = F.col("version_id") % 4
    return t.skill_version.filter(x < 3).select("version_id", F.when(x == 0, "block").otherwise("pass").alias("verdict"), F.lit("privilege").alias("category"), F.lit("").alias("reason"))


def _routes(t: Tables, mode: str = "auto"):
    return skills.route_proposals(t.skill_version, t.skill, _verdicts(t), mode)


@query("proposal_routes", rows="T15", uses="skill skill_version", oracle=f"""WITH {ROUTES_SQL}
SELECT version_id, route, CASE WHEN route = 'block' THEN 'privilege' END AS reason FROM routes""")
def proposal_routes(t: Tables):
    return _routes(t).select("version_id", "route", "reason")


@query("proposal_routes_human", rows="T15", uses="skill skill_version", oracle=f"""WITH {ROUTES_SQL}
SELECT version_id, CASE WHEN route = 'activate' THEN 'queue' ELSE route END AS route FROM routes""")
def proposal_routes_human(t: Tables):
    return _routes(t, "human").select("version_id", "route")


def _activated(t: Tables):
    return skills.apply_routes(_routes(t), t.skill_version, t.skill, t.version_source, t.learning, now())


@query("activated_skills", rows="T16", uses="skill skill_version", oracle=f"""WITH {ROUTES_SQL},
 f AS (SELECT skill_id, max_by(version, (created_at, version_id)) FILTER (WHERE route = 'activate') AS live, bool_or(route = 'block') AS blocked FROM routes GROUP BY 1)
SELECT s.skill_id, CASE WHEN f.live IS NOT NULL THEN 'approved' WHEN f.blocked AND s.status = 'candidate' THEN 'blocked' ELSE s.status END AS status, f.live AS version,
 CASE WHEN f.live IS NOT NULL THEN false ELSE s.needs_revision END AS needs_revision FROM skill s LEFT JOIN f USING (skill_id)""")
def activated_skills(t: Tables):
    return _activated(t)["skills"].select("skill_id", "status", "version", "needs_revision")


@query("activated_versions", rows="T16", uses="skill skill_version", oracle=f"""WITH {ROUTES_SQL}
SELECT v.version_id, CASE r.route WHEN 'activate' THEN 'accepted' WHEN 'block' THEN 'blocked' ELSE v.outcome END AS outcome,
 CASE r.route WHEN 'activate' THEN 'passed' WHEN 'block' THEN 'blocked' ELSE v.safety_status END AS safety_status FROM skill_version v LEFT JOIN routes r USING (version_id)""")
def activated_versions(t: Tables):
    return _activated(t)["versions"].select("version_id", "outcome", "safety_status")


@query("compiled_learnings", rows="T16", uses="skill skill_version version_source learning", oracle=f"""WITH {ROUTES_SQL},
 u AS (SELECT s.learning_id AS id, max(r.skill_id) AS sk FROM version_source s JOIN routes r USING (version_id) WHERE route = 'activate' GROUP BY 1)
SELECT l.id, l.consolidated OR u.id IS NOT NULL AS consolidated, u.sk AS compiled_skill_id FROM learning l LEFT JOIN u USING (id)""")
def compiled_learnings(t: Tables):
    return _activated(t)["learning"].select("id", "consolidated", "compiled_skill_id")


HUMAN_SQL = """
 act AS (SELECT skill_id, status, CASE label % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'retire' WHEN 2 THEN 'reject' ELSE 'edit_approve' END AS action FROM skill),
 newest AS (SELECT skill_id, max(version) AS v FROM skill_version WHERE outcome = 'pending' GROUP BY 1),
 ok AS (SELECT a.*, n.v FROM act a LEFT JOIN newest n USING (skill_id) WHERE CASE WHEN action = 'retire' THEN status = 'approved' ELSE n.v IS NOT NULL END),
 after_ AS (SELECT s.skill_id, CASE WHEN o.action IN ('approve', 'edit_approve') THEN 'approved' WHEN o.action = 'retire' THEN 'retired' WHEN o.action = 'reject' AND s.status = 'candidate' THEN 'rejected' ELSE s.status END AS status FROM skill s LEFT JOIN ok o USING (skill_id))
"""


def _human(t: Tables):
    x = F.col("label") % 4
    acts = t.skill.select("skill_id", F.when(x == 0, "approve").when(x == 1, "retire").when(x == 2, "reject").otherwise("edit_approve").alias("action"))
    return skills.human_skill_decisions(acts, t.skill, t.skill_version, t.derived_from)


@query("human_skill_states", rows="T17", uses="skill skill_version", oracle=f"WITH {HUMAN_SQL} SELECT skill_id, status FROM after_")
def human_skill_states(t: Tables):
    return _human(t)["skills"].select("skill_id", "status")


@query("human_skill_versions", rows="T17", uses="skill skill_version", oracle=f"""WITH {HUMAN_SQL}
SELECT v.version_id, CASE WHEN o.skill_id IS NULL THEN v.outcome WHEN o.action = 'reject' THEN 'rejected' ELSE 'accepted' END AS outcome
FROM skill_version v LEFT JOIN ok o ON o.skill_id = v.skill_id AND o.v = v.version AND o.action <> 'retire'""")
def human_skill_versions(t: Tables):
    return _human(t)["versions"].select("version_id", "outcome")


@query("recalled_after_retire", rows="T17", uses="skill skill_version derived_from", oracle=f"""WITH {HUMAN_SQL}
SELECT DISTINCT learning_id FROM derived_from JOIN ok USING (skill_id) WHERE action = 'retire' AND learning_id NOT IN (SELECT learning_id FROM derived_from JOIN after_ USING (skill_id) WHERE after_.status = 'approved')""")
def recalled_after_retire(t: Tables):
    return _human(t)["recalled"].select("learning_id")


@query("live_skill_catalogue", rows="W13", uses="skill", oracle="""
SELECT project_id, slug, row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, slug) AS rank FROM skill WHERE status = 'approved' QUALIFY rank <= 20""")
def live_skill_catalogue(t: Tables):
    return skills.live_catalogue(t.skill).select("project_id", "slug", n("rank"))


# --- counts, profiles, due jobs --------------------------------------------------

PENDING = "scope = 'user' AND status = 'approved' AND (consolidated_at IS NULL OR updated_at > consolidated_at)"
STALE = "scope = 'user' AND status = 'rejected' AND consolidated_at IS NOT NULL AND unfolded_at IS NULL"


@query("profile_backlog", rows="A5", uses="learning", oracle=f"""
SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, updated_at DESC, id) AS rank, count(*) OVER (PARTITION BY user_id) AS pending FROM learning WHERE {PENDING} QUALIFY rank <= 40""")
def profile_backlog(t: Tables):
    return audit.profile_backlog(t.learning).select("user_id", "id", n("rank"), "pending")


@query("stale_profile_facts", rows="A7", uses="learning", oracle=f"""
SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id) AS rank FROM learning WHERE {STALE} QUALIFY rank <= 20""")
def stale_profile_facts(t: Tables):
    return audit.stale_profile_facts(t.learning).select("user_id", "id", n("rank"))


@query("blocked_counts", rows="A8", uses="gated skill_version learning", oracle="""
WITH s AS (SELECT DISTINCT project_id, user_id FROM learning), b AS (SELECT * FROM gated WHERE status = 'blocked' AND blocked_at >= TIMESTAMP '2024-01-13 00:00:00')
SELECT project_id, user_id, (SELECT count(*) FROM b WHERE b.scope = 'user' AND b.user_id = s.user_id) + (SELECT count(*) FROM b WHERE b.scope = 'project' AND b.project_id = s.project_id)
 + (SELECT count(*) FROM skill_version v WHERE v.outcome = 'blocked' AND v.project_id = s.project_id AND v.decided_at >= TIMESTAMP '2024-01-13 00:00:00') AS blocked FROM s""")
def blocked_counts(t: Tables):
    return audit.blocked_counts(t.gated, t.skill_version, t.learning.select("project_id", "user_id").distinct(), F.lit("2024-01-20").cast("timestamp"))


@query("pending_proposals", rows="A9", uses="skill_version skill", oracle="SELECT project_id, count(*) AS pending FROM skill_version WHERE outcome = 'pending' GROUP BY 1")
def pending_proposals(t: Tables):
    return audit.pending_proposals(t.skill_version, t.skill)


@query("project_timeline_size", rows="A10", uses="observation", oracle="SELECT project_id, count(*) AS total FROM observation GROUP BY 1")
def project_timeline_size(t: Tables):
    return t.observation.groupBy("project_id").agg(F.count("*").alias("total"))


@query("due_jobs", rows="T10", uses=EL_USES + " profile session", oracle=f"""WITH {ELIGIBLE_SQL},
 c AS (SELECT 'profile' AS job, CAST(u.user_id AS VARCHAR) AS key, (SELECT count(*) FROM learning l WHERE l.user_id = u.user_id AND {PENDING}) AS pending, (SELECT count(*) FROM learning l WHERE l.user_id = u.user_id AND {STALE}) AS stale, p.last_run FROM (SELECT DISTINCT user_id FROM learning) u LEFT JOIN profile p USING (user_id)
  UNION ALL SELECT j.job, CAST(x.project_id AS VARCHAR), CASE WHEN j.job = 'skills' THEN (SELECT count(*) FROM elig e WHERE e.project_id = x.project_id) ELSE 0 END, 0, x.last_run FROM (SELECT project_id, max(created_at) AS last_run FROM session GROUP BY 1) x, (VALUES ('skills'), ('pattern_merge'), ('salience')) j(job)),
 d AS (SELECT *, CASE job WHEN 'profile' THEN 24 WHEN 'skills' THEN 24 WHEN 'pattern_merge' THEN 8 ELSE 4 END AS every, epoch(TIMESTAMP '2024-01-05 03:00:00' - last_run) / 3600 AS h FROM c)
SELECT job, key, (job = 'profile' AND stale > 0) OR (NOT coalesce((job = 'profile' AND pending <= 5) OR (job = 'skills' AND pending < 4), false) AND NOT coalesce(h < every, false)) AS due FROM d""")
def due_jobs(t: Tables):
    people = t.learning.select("user_id").distinct()
    pend = audit.pending_profile_facts(t.learning).groupBy("user_id").agg(F.count("*").alias("pending"))
    stale = audit.stale_profile_facts(t.learning).groupBy("user_id").agg(F.count("*").alias("stale"))
    zero = F.lit(0).cast("long")
    prof = people.join(pend, "user_id", "left").join(stale, "user_id", "left").join(t.profile.select("user_id", "last_run"), "user_id", "left").select(
        F.lit("profile").alias("job"), F.col("user_id").cast("string").alias("key"), F.coalesce("pending", zero).alias("pending"), F.coalesce("stale", zero).alias("stale"), "last_run"
    )
    runs = t.session.groupBy("project_id").agg(F.max("created_at").alias("last_run"))
    elig = _eligible(t).groupBy("project_id").agg(F.count("*").alias("pending"))
    per = runs.join(elig, "project_id", "left").withColumn("job", F.explode(F.array(F.lit("skills"), F.lit("pattern_merge"), F.lit("salience")))).select(
        "job", F.col("project_id").cast("string").alias("key"), F.when(F.col("job") == "skills", F.coalesce("pending", zero)).otherwise(zero).alias("pending"), zero.alias("stale"), "last_run"
    )
    return audit.due_jobs(prof.unionByName(per), F.lit("2024-01-05 03:00:00").cast("timestamp")).select("job", "key", "due")


def _folded(t: Tables):
    section = F.when(F.col("user_id") % 4 == 3, "too short").otherwise(F.concat(F.lit("new section for user number "), F.col("user_id").cast("string")))
    sections = t.learning.select("user_id").distinct().withColumn("content", section)
    versions = t.profile.select(
        F.concat(F.col("user_id").cast("string"), F.lit(":v"), F.col("version").cast("string")).alias("id"), "user_id", "version", "content", F.lit(True).alias("is_current")
    )
    folds = audit.profile_backlog(t.learning).select("user_id", "id")
    unfolds = audit.stale_profile_facts(t.learning).select("user_id", "id")
    return audit.fold_profiles(t.profile, versions, sections, folds, unfolds, now())


@query("profile_versions", rows="T11", uses="learning profile", oracle="""
WITH s AS (SELECT DISTINCT user_id FROM learning WHERE user_id % 4 <> 3)
SELECT user_id || ':v' || (coalesce(version, 0) + 1) AS id, true AS is_current FROM s LEFT JOIN profile USING (user_id)
UNION ALL SELECT user_id || ':v' || version, user_id % 4 = 3 FROM profile""")
def profile_versions(t: Tables):
    return _folded(t)["versions"].select("id", "is_current")


@query("profile_folds", rows="T11 A5 A7", uses="learning", oracle=f"""
SELECT id, 'fold' AS what FROM (SELECT * FROM learning WHERE {PENDING} AND user_id % 4 <> 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, updated_at DESC, id) <= 40) x
UNION ALL SELECT id, 'unfold' FROM (SELECT * FROM learning WHERE {STALE} AND user_id % 4 <> 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id) <= 20) y""")
def profile_folds(t: Tables):
    out = _folded(t)
    return out["folded"].select("id", F.lit("fold").alias("what")).unionByName(out["unfolded"].select("id", F.lit("unfold").alias("what")))


@query("prompt_versions", rows="T12", uses="session_event", oracle="""
WITH w AS (SELECT event_id, session_id, ts, k % 3 AS c, lag(k % 3) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS p FROM session_event)
SELECT event_id, CASE WHEN p IS NULL THEN 'created' WHEN p = c THEN 'unchanged' ELSE 'updated' END AS action,
 sum(CASE WHEN p IS NULL OR p <> c THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, event_id)::BIGINT AS version FROM w""")
def prompt_versions(t: Tables):
    writes = t.session_event.select(
        F.col("session_id").cast("string").alias("name"), "ts", F.col("event_id").alias("write_id"), F.concat(F.lit("text "), (F.col("k") % 3).cast("string")).alias("content")
    )
    return audit.prompt_versions(writes).select(F.col("write_id").alias("event_id"), "action", n("version"))


PROMPT_SQL = """
 p AS (SELECT 'prompt ' || project_id AS name, project_id, min(text) AS content, CAST(1 + project_id % 3 AS BIGINT) AS version, min(created_at) AS made FROM learning GROUP BY project_id),
 u AS (SELECT name, 'refined ' || project_id AS content, version FROM p WHERE project_id % 2 = 0 UNION ALL SELECT 'new prompt', 'first text', NULL),
 fold AS (SELECT 'prompt ' || project_id AS name, id AS learning_id FROM learning WHERE scope = 'project' AND status = 'approved' AND id % 3 = 0),
 listed AS (SELECT name, count(*) AS n FROM fold GROUP BY name)
"""


def _prompts(t: Tables):
    name = F.concat(F.lit("prompt "), F.col("project_id").cast("string"))
    prompts = t.learning.groupBy("project_id").agg(F.min("text").alias("content"), F.min("created_at").alias("created_at")).select(
        name.alias("name"), "content", (1 + F.col("project_id") % 3).cast("long").alias("version"), F.lit(None).cast("string").alias("last_source"), "created_at", F.lit(None).cast("timestamp").alias("updated_at"), "project_id")
    history = prompts.filter("project_id % 3 = 1").select(
        F.concat("name", F.lit(":v"), F.col("version").cast("string")).alias("id"), "name", "version", "content", F.lit("human").alias("source"), "created_at", F.lit(True).alias("is_current"),
        F.lit(None).cast("timestamp").alias("archived_at"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("session_id"), F.lit(0).cast("long").alias("folded_count"), F.lit(None).cast("long").alias("supersedes"))
    updates = prompts.filter("project_id % 2 = 0").select("name", F.concat(F.lit("refined "), F.col("project_id").cast("string")).alias("content")).unionByName(
        t.spark.createDataFrame([("new prompt", "first text")], "name string, content string")).select("*", F.lit("m").alias("model"), F.lit("s").alias("session_id"))
    folds = t.learning.filter("scope = 'project' AND status = 'approved' AND id % 3 = 0").select(name.alias("name"), F.col("id").alias("learning_id"))
    return audit.snapshot_prompts(prompts.drop("project_id"), history, updates, folds, t.learning.select("id", "status", "consolidated", "consolidated_at"), now())


@query("prompt_snapshots", rows="T12", uses="learning", oracle=f"""WITH {PROMPT_SQL}
SELECT u.name || ':v' || (coalesce(u.version, 0) + 1) AS id, u.name, coalesce(u.version, 0) + 1 AS version, md5(u.content) AS content, 'consolidation' AS source, true AS is_current, false AS archived,
  CAST(coalesce(l.n, 0) AS BIGINT) AS folded_count, coalesce(u.version, 0) AS supersedes FROM u LEFT JOIN listed l ON l.name = u.name
UNION ALL SELECT p.name || ':v' || p.version, p.name, p.version, md5(p.content), CASE WHEN project_id % 3 = 1 THEN 'human' ELSE 'seed' END, project_id % 2 <> 0, project_id % 2 = 0,
  CASE WHEN project_id % 3 = 1 THEN 0 END, NULL FROM p WHERE project_id % 3 = 1 OR project_id % 2 = 0""")
def prompt_snapshots(t: Tables):
    return _prompts(t)["versions"].select(
        "id", "name", "version", F.md5("content").alias("content"), "source", "is_current", F.col("archived_at").isNotNull().alias("archived"), n("folded_count"), "supersedes")


@query("prompt_state", rows="T12", uses="learning", oracle=f"""WITH {PROMPT_SQL}
SELECT coalesce(p.name, u.name) AS name, md5(coalesce(u.content, p.content)) AS content, CASE WHEN u.name IS NOT NULL THEN coalesce(p.version, 0) + 1 ELSE p.version END AS version,
  CASE WHEN u.name IS NOT NULL THEN 'consolidation' END AS last_source FROM p FULL OUTER JOIN u ON u.name = p.name""")
def prompt_state(t: Tables):
    return _prompts(t)["prompts"].select("name", F.md5("content").alias("content"), "version", "last_source")


@query("prompt_folds", rows="T12", uses="learning", oracle=f"""WITH {PROMPT_SQL}, hit AS (SELECT f.learning_id AS id, u.version + 1 AS version FROM fold f JOIN u ON u.name = f.name)
SELECT l.id, l.status, CASE WHEN h.id IS NOT NULL THEN true ELSE l.consolidated END AS consolidated, h.version AS consolidated_prompt_version, CASE WHEN h.id IS NOT NULL THEN 'm' END AS last_consolidated_model,
  h.id IS NULL AND l.consolidated_at IS NOT NULL AS kept_time FROM learning l LEFT JOIN hit h ON h.id = l.id""")
def prompt_folds(t: Tables):
    facts = _prompts(t)["learnings"]
    return facts.select("id", "status", "consolidated", n("consolidated_prompt_version"), "last_consolidated_model",
                        (F.col("consolidated_prompt_version").isNull() & F.col("consolidated_at").isNotNull()).alias("kept_time"))


@query("gate_audit", rows="A16", uses="gated conflict skill skill_version derived_from learning", oracle="""
WITH x AS (SELECT project_id, 'blocked_learnings' AS section, CAST(id AS VARCHAR) AS key, blocked_reason AS detail, blocked_at AS w FROM gated WHERE status = 'blocked'
 UNION ALL SELECT project_id, 'blocked_skills', CAST(version_id AS VARCHAR), (SELECT slug FROM skill s WHERE s.skill_id = v.skill_id), decided_at FROM skill_version v WHERE outcome = 'blocked'
 UNION ALL SELECT project_id, 'kept_conflicts', CAST(id AS VARCHAR), coalesce((SELECT string_agg(CAST(to_id AS VARCHAR), ',' ORDER BY to_id) FROM conflict c WHERE c.from_id = g.id), ''), coalesce(consistency_checked_at, updated_at) FROM gated g WHERE status = 'approved' AND consistency_status = 'ambiguous_kept_both'
 UNION ALL SELECT project_id, 'stale_skills', CAST(skill_id AS VARCHAR), CAST((SELECT count(*) FROM derived_from d JOIN gated l ON l.id = d.learning_id WHERE d.skill_id = s.skill_id AND l.status = 'rejected') AS VARCHAR), updated_at FROM skill s WHERE status = 'approved' AND needs_revision AND skill_id NOT IN (SELECT skill_id FROM skill_version WHERE outcome = 'pending'))
SELECT project_id, section, row_number() OVER (PARTITION BY project_id, section ORDER BY CASE WHEN section = 'stale_skills' THEN epoch_us(w) ELSE -epoch_us(w) END, key) AS rank, key, detail FROM x QUALIFY rank <= 20
UNION ALL SELECT project_id, 'pending_skills', 1, '', CAST(count(*) AS VARCHAR) FROM skill_version WHERE outcome = 'pending' GROUP BY 1""")
def gate_audit(t: Tables):
    return audit.gate_audit(t.gated, t.conflict, t.skill, t.skill_version, t.derived_from).select("project_id", "section", n("rank"), "key", "detail")


@query("observation_chain", rows="W2", uses="observation", oracle="""
SELECT id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id, lead(id) OVER w IS NULL AS is_latest FROM observation WINDOW w AS (PARTITION BY project_id ORDER BY ended_at, id)""")
def observation_chain(t: Tables):
    return audit.observation_chain(t.observation).select("id", "prev_id", "next_id", "is_latest")


@query("episode_detail", rows="J17", uses="observation produced learning", oracle="""
WITH o AS (SELECT id, session_id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM observation WINDOW w AS (PARTITION BY project_id ORDER BY ended_at, id)),
 f AS (SELECT DISTINCT p.session_id, l.id AS learning_id, md5(substr(l.text, 1, 200)) AS text, l.status, l.scope FROM produced p JOIN learning l ON l.id = p.learning_id)
SELECT o.id, prev_id, next_id, f.learning_id, f.text, f.status, f.scope FROM o LEFT JOIN f USING (session_id)""")
def episode_detail(t: Tables):
    # One processing run per session here.
    runs = t.observation.select(F.col("session_id").alias("processing_id"), F.col("id").alias("observation_id"))
    facts = audit.episode_facts(runs, t.produced.withColumnRenamed("session_id", "processing_id"), t.learning)
    return audit.episode_detail(audit.observation_chain(t.observation), facts).select(
        "id", "prev_id", "next_id", "learning_id", F.md5("text").alias("text"), "status", "scope"
    )


@query("timeline_page", rows="W11 J17", uses="observation", oracle="""
SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY ended_at DESC, id DESC) AS rank FROM observation
WHERE ended_at < TIMESTAMP '2024-01-03 00:30:00' OR (ended_at = TIMESTAMP '2024-01-03 00:30:00' AND id < 48) QUALIFY rank <= 3""")
def timeline_page(t: Tables):
    c = F.lit("2024-01-03 00:30:00").cast("timestamp")
    older = t.observation.filter((F.col("ended_at") < c) | ((F.col("ended_at") == c) & (F.col("id") < 48)))
    return top_per_key(older, ["project_id"], [F.col("ended_at").desc(), F.col("id").desc()], 3).select("project_id", "id", n("rank"))


def _fact_sql(alias: str) -> str:
    return f"""'- [' || {alias}.status || ', confidence ' || printf('%.2f', {alias}.confidence) || CASE WHEN {alias}.kind <> 'error' THEN '' WHEN {alias}.resolved THEN ', error fix' ELSE ', known failure, no fix' END || '] ' || {sql_trunc(alias + '.text', 240)}"""


AGE_SQL = "CASE WHEN s < 3600 THEN CAST(greatest(1, floor(s / 60)) AS BIGINT) || 'm ago' WHEN s < 172800 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ago' ELSE CAST(floor(s / 86400) AS BIGINT) || 'd ago' END"
CTX_SQL = f"""
 fb AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY CASE WHEN status = 'approved' THEN 0 ELSE 1 END, updated_at DESC, id) AS rank FROM learning WHERE {LIVE} AND NOT consolidated AND scope = 'project' QUALIFY rank <= 5),
 ub AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN status = 'approved' THEN 0 ELSE 1 END, updated_at DESC, id) AS rank FROM learning WHERE {LIVE} AND NOT consolidated AND scope = 'user' QUALIFY rank <= 5),
 ob AS (SELECT *, greatest(epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(ended_at), 0) AS s, row_number() OVER (PARTITION BY project_id ORDER BY ended_at DESC, id DESC) AS rank FROM observation QUALIFY rank <= 3),
 ct AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, slug) AS rank FROM skill WHERE status = 'approved' QUALIFY rank <= 20),
 uu AS (SELECT user_id, string_agg({_fact_sql('ub')}, chr(10) ORDER BY rank) AS x FROM ub GROUP BY 1),
 ff AS (SELECT project_id, string_agg({_fact_sql('fb')}, chr(10) ORDER BY rank) AS x FROM fb GROUP BY 1),
 oo AS (SELECT project_id, count(*) AS shown, string_agg('- [' || type || ', ' || {AGE_SQL} || '] ' || {sql_trunc('title', 160)}, chr(10) ORDER BY rank) AS x FROM ob GROUP BY 1),
 cc AS (SELECT project_id, string_agg(slug, ', ' ORDER BY rank) AS x FROM ct GROUP BY 1),
 nn AS (SELECT project_id, count(*) AS total FROM observation GROUP BY 1), pp AS (SELECT project_id, count(*) AS pending FROM skill_version WHERE outcome = 'pending' GROUP BY 1)
"""


@query("context_packs", rows="T20 W10 W12 W13", uses="session learning observation skill skill_version", oracle=f"""WITH {CTX_SQL}
SELECT s.session_id AS request_id, CASE WHEN uu.x IS NULL AND oo.x IS NULL AND ff.x IS NULL AND cc.x IS NULL AND pp.pending IS NULL THEN '' ELSE
 'Project context for P' || s.project_id || ' (' || s.project_id || '):'
 || coalesce(chr(10) || chr(10) || 'What we know about the user (' || s.user_id || '):' || chr(10) || uu.x, '')
 || coalesce(chr(10) || chr(10) || '{audit.HEAD_ACTIVITY}' || chr(10) || oo.x || chr(10) || CASE WHEN nn.total > oo.shown THEN (nn.total - oo.shown) || ' earlier episodes are on record. ' ELSE '' END || '{audit.POINTER}', '')
 || coalesce(chr(10) || chr(10) || '{audit.HEAD_LEARNINGS}' || chr(10) || ff.x, '')
 || coalesce(chr(10) || chr(10) || '{audit.HEAD_SKILLS}' || cc.x, '')
 || coalesce(chr(10) || chr(10) || pp.pending || ' distilled skill ' || CASE WHEN pp.pending = 1 THEN 'proposal is' ELSE 'proposals are' END || ' waiting for a human to publish: nothing goes live in skill_search until a person approves it. List them with skill_review_queue.', '')
 || chr(10) || chr(10) || '{audit.CLOSING}' END AS context
FROM session s LEFT JOIN uu ON uu.user_id = s.user_id LEFT JOIN ff ON ff.project_id = s.project_id LEFT JOIN oo ON oo.project_id = s.project_id LEFT JOIN cc ON cc.project_id = s.project_id
LEFT JOIN nn ON nn.project_id = s.project_id LEFT JOIN pp ON pp.project_id = s.project_id""")
def context_packs(t: Tables):
    req = t.session.select(F.col("session_id").alias("request_id"), "project_id", "user_id", F.concat(F.lit("P"), F.col("project_id").cast("string")).alias("project_name"))

    facts = recall.recency_fallback(t.learning.filter("scope = 'project'"), ["project_id"], 5)
    people = recall.recency_fallback(t.learning.filter("scope = 'user'"), ["user_id"], 5)
    activity = top_per_key(t.observation, ["project_id"], [F.col("ended_at").desc(), F.col("id").desc()], 3)
    catalogue = skills.live_catalogue(t.skill)
    totals = t.observation.groupBy("project_id").agg(F.count("*").alias("episodes"))
    notes = req.select("request_id", "project_id").join(totals, "project_id", "left").join(
        audit.pending_proposals(t.skill_version, t.skill).withColumnRenamed("pending", "pending_skills"), "project_id", "left"
    ).select("request_id", F.lit(0).alias("blocked"), "pending_skills", "episodes")
    return audit.context_packs(req, people, activity, facts, catalogue, None, notes, F.lit("2024-02-01").cast("timestamp"), by={"u": "user_id", "a": "project_id", "f": "project_id", "c": "project_id"})


@query("prompt_packs", rows="T20 V8 A8 W12", uses="request learning observation skill skill_version gated", oracle=f"""WITH {CTX_SQL},
 near AS (SELECT r.request_id, s.slug, s.salience, {COS.format(a='r.vector', b='s.embedding')} AS cos FROM request r JOIN skill s ON s.project_id = r.project_id WHERE s.status = 'approved'),
 mt AS (SELECT request_id, slug, row_number() OVER (PARTITION BY request_id ORDER BY round(cos * (1 + 0.1::DOUBLE * salience), 6) DESC, slug) AS rank FROM near WHERE round((1 + cos) / 2, 7) >= (1 + {FLOOR}) / 2 QUALIFY rank <= 5),
 mm AS (SELECT request_id, string_agg(slug, ', ' ORDER BY rank) AS x FROM mt GROUP BY 1),
 gone AS (SELECT * FROM gated WHERE status = 'blocked' AND blocked_at >= TIMESTAMP '2024-01-13 00:00:00'),
 gu AS (SELECT user_id, count(*) AS n FROM gone WHERE scope = 'user' GROUP BY 1), gp AS (SELECT project_id, count(*) AS n FROM gone WHERE scope = 'project' GROUP BY 1),
 gv AS (SELECT project_id, count(*) AS n FROM skill_version WHERE outcome = 'blocked' AND decided_at >= TIMESTAMP '2024-01-13 00:00:00' GROUP BY 1),
 r AS (SELECT r.request_id, r.project_id, r.user_id, coalesce(gu.n, 0) + coalesce(gp.n, 0) + coalesce(gv.n, 0) AS blocked FROM request r LEFT JOIN gu ON gu.user_id = r.user_id LEFT JOIN gp ON gp.project_id = r.project_id LEFT JOIN gv ON gv.project_id = r.project_id)
SELECT r.request_id, CASE WHEN uu.x IS NULL AND ff.x IS NULL AND mm.x IS NULL AND pp.pending IS NULL AND r.blocked = 0 THEN '' ELSE
 'Project context for P' || r.project_id || ' (' || r.project_id || '):'
 || coalesce(chr(10) || chr(10) || 'What we know about the user (' || r.user_id || '):' || chr(10) || uu.x, '')
 || coalesce(chr(10) || chr(10) || '{audit.HEAD_LEARNINGS}' || chr(10) || ff.x, '')
 || coalesce(chr(10) || chr(10) || '{audit.HEAD_MATCHING}' || mm.x, '')
 || CASE WHEN r.blocked > 0 THEN chr(10) || chr(10) || 'The autonomous memory gate blocked ' || r.blocked || CASE WHEN r.blocked = 1 THEN ' unsafe item' ELSE ' unsafe items' END
   || ' in the last 7 days (suspected injected instructions, privilege grabs, or secrets) — recorded, not learned. Inspect the record with project_gate_audit; a wrongly blocked fact can be reinstated with project_resolve_learning.' ELSE '' END
 || coalesce(chr(10) || chr(10) || pp.pending || ' distilled skill ' || CASE WHEN pp.pending = 1 THEN 'proposal is' ELSE 'proposals are' END || ' waiting for a human to publish: nothing goes live in skill_search until a person approves it. List them with skill_review_queue.', '')
 || chr(10) || chr(10) || '{audit.CLOSING}' END AS context
FROM r LEFT JOIN uu ON uu.user_id = r.user_id LEFT JOIN ff ON ff.project_id = r.project_id LEFT JOIN mm ON mm.request_id = r.request_id LEFT JOIN pp ON pp.project_id = r.project_id""")
def prompt_packs(t: Tables):
    """What a prompt gets: the skills that match it instead of the catalogue, and what the gate has blocked lately."""
    req = t.request.select("request_id", "project_id", "user_id", F.concat(F.lit("P"), F.col("project_id").cast("string")).alias("project_name"))

    facts = recall.recency_fallback(t.learning.filter("scope = 'project'"), ["project_id"], 5)
    people = recall.recency_fallback(t.learning.filter("scope = 'user'"), ["user_id"], 5)
    matching = recall.suggest_skills(t.request, t.skill, 5, FLOOR, 0.1).select(F.col("q_id").alias("request_id"), "slug", "rank")
    blocked = audit.blocked_counts(t.gated, t.skill_version, req.select("project_id", "user_id").distinct(), F.lit("2024-01-20").cast("timestamp"))
    notes = req.select("request_id", "project_id", "user_id").join(blocked, ["project_id", "user_id"], "left").join(
        audit.pending_proposals(t.skill_version, t.skill).withColumnRenamed("pending", "pending_skills"), "project_id", "left"
    ).select("request_id", "blocked", "pending_skills", F.lit(0).alias("episodes"))
    return audit.context_packs(req, people, None, facts, None, matching, notes, F.lit("2024-02-01").cast("timestamp"), by={"u": "user_id", "f": "project_id"})


