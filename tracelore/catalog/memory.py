"""Replies to rows, the gate, memory writes and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelore.catalog.base import Tables, query
from tracelore.catalog.events import TREE_SQL, _tree, micros, sql_trunc
from tracelore.catalog.recall import n
from tracelore.functions import embedding as emb
from tracelore.operators import transitions as tr
from tracelore.operators import windows
from tracelore.session import stored

def now():
    return F.lit("2024-03-01").cast("timestamp")


def _replies(t: Tables, items, field: str):
    """One reply text per conversation: fenced when the id is odd, unusable for every tenth."""
    rows = t.conversations.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", items.alias("i")))), lambda x: x["i"]).alias("items")
    )
    body = F.to_json(F.struct(F.col("items").alias(field)))
    reply = F.when(F.col("conv_id") % 10 == 9, "sorry, nothing { to say").when(
        F.col("conv_id") % 2 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    ).otherwise(F.concat(F.lit("Here you go: "), body, F.lit(" done")))
    return rows.select("conv_id", reply.alias("reply"))


@query("extraction_rows", rows="P12 P19", oracle=f"""
WITH i AS (SELECT *, CASE turn % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'update' WHEN 2 THEN 'create' ELSE 'ignore' END AS action,
   CASE WHEN turn % 4 = 1 THEN 'learning:user:' || turn END AS existing, {sql_trunc('text', 500)} AS short FROM conversations WHERE conv_id % 10 <> 9),
 ok AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM i WHERE action = 'update' OR (action = 'create' AND short <> '') QUALIFY rank <= 3)
SELECT conv_id AS window_id, action, nullif(short, '') AS text,
 CASE WHEN action = 'update' THEN existing WHEN turn = 2 THEN 'learning:user:' || conv_id % 7 || ':' || substr(sha1('user:' || conv_id % 7 || chr(10) || short), 1, 16)
   ELSE 'learning:' || conv_id % 5 || ':' || substr(sha1(conv_id % 5 || chr(10) || short), 1, 16) END AS id,
 CASE WHEN action = 'update' OR turn = 2 THEN 'user' ELSE 'project' END AS scope,
 CASE WHEN role = 'assistant' THEN 'error' WHEN action = 'create' THEN 'fact' END AS kind,
 CASE WHEN turn < 2 THEN 'hook pipeline' END AS task_pattern,
 CASE WHEN role = 'user' THEN 0.6::DOUBLE ELSE least(1.0::DOUBLE, turn * 0.4::DOUBLE) END AS confidence,
 CASE WHEN role = 'assistant' THEN 'run_query' END AS tool_key, CASE WHEN role = 'assistant' THEN turn = 1 END AS resolved, rank FROM ok""")
def extraction_rows(t: Tables):
    turn = F.col("turn")
    item = F.struct(
        F.when(turn % 4 == 0, "create").when(turn % 4 == 1, "update").when(turn % 4 == 2, "CREATE").otherwise("ignore").alias("action"),
        F.when(turn % 4 == 1, F.concat(F.lit(" learning:user:"), turn.cast("string"))).alias("existing_id"), F.col("text"),
        F.when(turn == 2, "User").alias("scope"), F.when(F.col("role") == "assistant", "Error").otherwise("other").alias("kind"),
        F.when(F.col("role") == "user", "unsure").otherwise((turn * 0.4).cast("string")).alias("confidence"),
        F.when(turn < 2, "hook  pipeline").otherwise("one two three four five six seven").alias("task_pattern"),
        F.lit("mcp__srv__run_query").alias("tool_key"), F.lit("bad  input").alias("error_signature"),
        F.when(turn == 1, "yes").otherwise("no").alias("resolved"),
    )
    replies = _replies(t, item, "learnings").select(
        F.col("conv_id").alias("window_id"), (F.col("conv_id") % 5).alias("project_id"), (F.col("conv_id") % 7).alias("user_id"), "reply"
    )
    return tr.extraction_rows(replies).select(
        "window_id", "action", "text", "id", "scope", "kind", "task_pattern", "confidence", "tool_key", "resolved", n("rank")
    )


@query("observation_rows", rows="P13 P19", oracle=f"""
WITH i AS (SELECT *, {sql_trunc('text', 200)} AS title FROM conversations WHERE conv_id % 10 <> 9),
 ok AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM i WHERE title <> '' QUALIFY rank <= 3)
SELECT conv_id AS window_id, 'observation:1:' || conv_id || ':d:' || (rank - 1) AS id, title, CASE WHEN role = 'user' THEN 'bugfix' ELSE 'change' END AS type,
 'f' || turn || ',g' AS facts, {sql_trunc('text', 1000)} AS narrative FROM ok""")
def observation_rows(t: Tables):
    item = F.struct(
        F.when(F.col("role") == "user", "BugFix").otherwise("made up").alias("type"), F.col("text").alias("title"),
        F.array(F.concat(F.lit(" f"), F.col("turn").cast("string")), F.lit("  "), F.lit("g")).alias("facts"), F.col("text").alias("narrative"),
    )
    replies = _replies(t, item, "observations").select(
        F.col("conv_id").alias("window_id"), F.lit(1).alias("project_id"), F.col("conv_id").alias("session_id"), F.lit("d").alias("digest"), "reply"
    )
    return tr.observation_rows(replies).select("window_id", "id", "title", "type", F.array_join("facts", ",").alias("facts"), "narrative")


def _safety_replies(t: Tables):
    verdict = F.when(F.col("id") % 9 == 0, "maybe").when(F.col("label") == 3, "BLOCK").otherwise("pass")
    body = F.to_json(F.struct(verdict.alias("verdict"), F.when(F.col("id") % 2 == 0, "Secret").otherwise("odd").alias("category"), F.col("text").alias("reason")))
    reply = F.when(F.col("id") % 4 == 0, F.concat(F.lit("```\n"), body, F.lit("```"))).when(F.col("id") % 13 == 1, "none").otherwise(body)
    return t.learning.select(F.col("id").alias("candidate_id"), reply.alias("reply"))


@query("safety_rows", rows="P15", uses="learning", oracle="""
WITH v AS (SELECT id, text, CASE WHEN id % 9 = 0 OR (id % 13 = 1 AND id % 4 <> 0) THEN NULL WHEN label = 3 THEN 'block' ELSE 'pass' END AS verdict FROM learning)
SELECT id AS candidate_id, verdict, CASE WHEN verdict IS NOT NULL THEN CASE WHEN id % 2 = 0 THEN 'secret' ELSE 'other' END END AS category,
 CASE WHEN verdict IS NOT NULL THEN substr(text, 1, 280) END AS reason FROM v""")
def safety_rows(t: Tables):
    return tr.safety_rows(_safety_replies(t))


@query("judge_rows", rows="P14", uses="learning neighbour", oracle="""
SELECT candidate_id, CAST(existing_id AS VARCHAR) AS existing_id, CASE w WHEN 0 THEN 'new' WHEN 1 THEN 'existing' ELSE 'unclear' END AS winner, 'r' || w AS reason FROM neighbour WHERE w < 3""")
def judge_rows(t: Tables):
    item = F.struct(
        F.when(F.col("w") < 3, F.col("existing_id").cast("string")).otherwise("  ").alias("existing_id"),
        F.when(F.col("w") == 0, F.lit(None)).when(F.col("w") == 1, "Existing").otherwise("both").alias("winner"),
        F.concat(F.lit("r"), F.col("w").cast("string")).alias("reason"),
    )
    body = t.neighbour.groupBy("candidate_id").agg(F.collect_list(item).alias("contradictions"))
    replies = body.select("candidate_id", F.concat(F.lit("```json"), F.to_json(F.struct("contradictions")), F.lit("```")).alias("reply"))
    return tr.judge_rows(replies)[0].select("candidate_id", "existing_id", "winner", "reason")


def _resolved(t: Tables):
    near = t.neighbour
    contra = near.filter("w < 3 AND (candidate_id + existing_id) % 12 < 7").select(
        "candidate_id", "existing_id", F.when(F.col("w") == 0, "new").when(F.col("w") == 1, "existing").otherwise("unclear").alias("winner")
    )
    same = near.filter("w = 3 AND candidate_id % 2 = 0").select("candidate_id", "existing_id")
    return tr.resolve(t.learning.filter("status = 'candidate'"), near, contra, same)


RESOLVED_SQL = """
 cand AS (SELECT * FROM learning WHERE status = 'candidate'),
 lists AS (SELECT c.id AS candidate_id,
   list_sort(coalesce(list(existing_id) FILTER (WHERE w = 1 AND (candidate_id + existing_id) % 12 < 7), [])) AS vetoed,
   list_sort(coalesce(list(existing_id) FILTER (WHERE w = 0 AND (candidate_id + existing_id) % 12 < 7), [])) AS won,
   list_sort(coalesce(list(existing_id) FILTER (WHERE w = 2 AND (candidate_id + existing_id) % 12 < 7), [])) AS open_,
   min(existing_id) FILTER (WHERE w = 3 AND candidate_id % 2 = 0) AS again
   FROM cand c LEFT JOIN neighbour x ON x.candidate_id = c.id GROUP BY c.id),
 res AS (SELECT candidate_id, CASE WHEN len(vetoed) > 0 THEN 'rejected' WHEN again IS NOT NULL THEN 'already_learned' ELSE 'approved' END AS outcome,
   CASE WHEN len(vetoed) > 0 THEN 'vetoed' WHEN again IS NOT NULL THEN 'already_learned' WHEN len(won) > 0 THEN 'superseded_conflicts' WHEN len(open_) > 0 THEN 'ambiguous_kept_both' ELSE 'clean' END AS consistency,
   CASE WHEN len(vetoed) = 0 AND again IS NULL THEN won ELSE [] END AS superseded, vetoed AS vetoed_by,
   CASE WHEN len(vetoed) = 0 AND again IS NULL THEN open_ ELSE [] END AS unclear, CASE WHEN len(vetoed) = 0 THEN again END AS restates FROM lists)
"""


def text_list(name: str):
    return F.array_join(F.transform(name, lambda x: x.cast("string")), ",").alias(name)


@query("gate_resolutions", rows="T1", uses="learning neighbour", oracle=f"""WITH {RESOLVED_SQL}
SELECT candidate_id, outcome, consistency, array_to_string(superseded, ',') AS superseded, array_to_string(vetoed_by, ',') AS vetoed_by, array_to_string(unclear, ',') AS unclear, restates FROM res""")
def gate_resolutions(t: Tables):
    return _resolved(t).select("candidate_id", "outcome", "consistency", text_list("superseded"), text_list("vetoed_by"), text_list("unclear"), "restates")


SCREENED_SQL = f"""{RESOLVED_SQL},
 scr AS (SELECT r.candidate_id, CASE WHEN verdict = 'block' THEN 'blocked' ELSE outcome END AS outcome, CASE WHEN verdict = 'pass' THEN consistency END AS consistency,
   CASE WHEN verdict = 'block' THEN [] ELSE superseded END AS superseded, CASE WHEN verdict = 'block' THEN [] ELSE vetoed_by END AS vetoed_by,
   CASE WHEN verdict = 'block' THEN [] ELSE unclear END AS unclear, CASE WHEN verdict = 'pass' THEN restates END AS restates,
   CASE WHEN verdict = 'block' THEN 'blocked' ELSE 'passed' END AS safety_status, CASE WHEN verdict = 'block' THEN category || ': ' || reason END AS safety_reason
   FROM res r JOIN safety_verdict v USING (candidate_id))
"""


@query("safety_screen", rows="T4", uses="learning neighbour safety_verdict", oracle=f"""WITH {SCREENED_SQL}
SELECT candidate_id, outcome, consistency, safety_status, safety_reason, array_to_string(superseded, ',') AS superseded FROM scr""")
def safety_screen(t: Tables):
    return tr.block(_resolved(t), t.safety_verdict).select("candidate_id", "outcome", "consistency", "safety_status", "safety_reason", text_list("superseded"))


# Candidate ids 7, 14, ... : a chain of supersessions runs along the order.
APPLIED_SQL = f"""{SCREENED_SQL},
 ord AS (SELECT candidate_id, row_number() OVER (ORDER BY candidate_id) AS pos, superseded FROM scr),
 walk AS (SELECT CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS dead
   UNION ALL SELECT o.pos, CASE WHEN list_contains(w.dead, o.candidate_id) THEN w.dead ELSE list_concat(w.dead, o.superseded) END FROM walk w JOIN ord o ON o.pos = w.pos + 1),
 app AS (SELECT s.* FROM scr s JOIN ord o USING (candidate_id) JOIN walk w ON w.pos = o.pos - 1 WHERE NOT list_contains(w.dead, s.candidate_id))
"""
ECHO_SQL = """
 fold AS (SELECT a.candidate_id, a.restates, EXISTS (SELECT 1 FROM learning c JOIN tree t ON t.ancestor = c.session_id JOIN injected_in i ON i.session_id = t.node
   WHERE c.id = a.candidate_id AND i.learning_id = a.restates AND i.first_injected_at <= c.created_at) AS echo FROM app a WHERE a.restates IS NOT NULL)
"""


def _applied(t: Tables):
    applied = tr.applied_in_order(tr.block(_resolved(t), t.safety_verdict), F.col("candidate_id"))
    folds = applied.filter("restates IS NOT NULL").select("candidate_id", F.col("restates").alias("learning_id")).join(
        t.learning.select(F.col("id").alias("candidate_id"), "session_id", F.col("created_at").alias("at")), "candidate_id"
    )
    hit = windows.echo_pairs(folds, _tree(t), t.injected_in)
    echoes = folds.join(hit, ["learning_id", "session_id", "at"], "left_semi").select("candidate_id", F.col("learning_id").alias("existing_id"))
    return tr.apply_resolutions(t.learning, applied, echoes, now())


GATE_USES = "learning neighbour safety_verdict session injected_in"


@query("gate_state", rows="T2 T3 T4", uses=GATE_USES, recursive=True, oracle=f"""WITH {TREE_SQL}, {APPLIED_SQL}, {ECHO_SQL},
 lost AS (SELECT unnest(superseded) AS id, candidate_id AS by_ FROM app), lo AS (SELECT id, max(by_) AS by_ FROM lost GROUP BY id),
 gain AS (SELECT f.restates AS id, count(*) FILTER (WHERE NOT f.echo) AS s, count(*) FILTER (WHERE f.echo) AS e, max(c.confidence) FILTER (WHERE NOT f.echo) AS conf FROM fold f JOIN learning c ON c.id = f.candidate_id GROUP BY 1)
SELECT l.id, CASE WHEN lo.id IS NOT NULL THEN 'rejected' ELSE coalesce(a.outcome, l.status) END AS status, a.consistency AS consistency_status,
 CASE WHEN lo.id IS NOT NULL OR a.outcome IN ('rejected', 'already_learned', 'blocked') THEN true ELSE false END AS dropped,
 l.support_count + coalesce(g.s, 0) AS support_count, coalesce(g.e, 0) AS echo_gain, greatest(l.confidence, coalesce(g.conf, l.confidence)) AS confidence,
 CASE WHEN a.outcome = 'blocked' THEN a.safety_reason END AS blocked_reason, 'superseded_by:' || lo.by_ AS rejected_reason
FROM learning l LEFT JOIN app a ON a.candidate_id = l.id LEFT JOIN lo ON lo.id = l.id LEFT JOIN gain g ON g.id = l.id""")
def gate_state(t: Tables):
    return _applied(t)["learning"].select(
        "id", "status", "consistency_status", F.col("embedding").isNull().alias("dropped"), "support_count", "echo_gain", "confidence", "blocked_reason", "rejected_reason"
    )


@query("gate_edges", rows="T2", uses=GATE_USES, recursive=True, oracle=f"""WITH {TREE_SQL}, {APPLIED_SQL}, {ECHO_SQL}
SELECT 'SUPERSEDES' AS kind, candidate_id AS from_id, unnest(superseded) AS to_id, false AS echo FROM app
UNION ALL SELECT 'CONTRADICTED_BY', candidate_id, unnest(vetoed_by), false FROM app
UNION ALL SELECT 'CONTRADICTS', candidate_id, unnest(unclear), false FROM app
UNION ALL SELECT 'ALREADY_LEARNED_FROM', candidate_id, restates, echo FROM fold""")
def gate_edges(t: Tables):
    return _applied(t)["edges"]


@query("gate_sweep", rows="W14", uses="learning produced", oracle="""
SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY updated_at, id) AS rank FROM learning
WHERE status = 'candidate' AND id NOT IN (SELECT learning_id FROM produced WHERE echo) QUALIFY rank <= 8""")
def gate_sweep(t: Tables):
    return tr.sweep(t.learning, t.produced.filter("echo").select(F.col("learning_id").alias("id"))).select("project_id", "id", n("rank"))


def _state(t: Tables):
    return t.learning.select(
        "id", "created_at", "updated_at", "text", "task_pattern", "kind", "tool_key", "error_signature", "resolved", "project_id", "scope",
        "user_id", "status", "support_count", F.lit(0).cast("long").alias("echo_count"), "confidence", "consolidated",
        F.when(F.col("label") == 4, F.col("created_at")).alias("compiled_at"), "consolidated_at",
        F.lit("human").alias("reviewed_by"), F.lit("clean").alias("consistency_status"),
    )


@query("learning_upsert", rows="T5 X3", uses="learning produced", oracle="""
WITH creates AS (SELECT learning_id AS id, 'again ' || learning_id AS text, p.at AS wrote, echo, 0.5 AS confidence FROM produced p
   UNION ALL SELECT doc_id, 'new ' || doc_id, TIMESTAMP '2024-02-01 00:00:00', false, 0.3 FROM documents WHERE doc_id NOT IN (SELECT id FROM learning)),
 b AS (SELECT id, max_by(text, wrote) AS text, max(wrote) AS wrote, count(*) FILTER (WHERE NOT echo) AS s, count(*) FILTER (WHERE echo) AS e, max(confidence) FILTER (WHERE NOT echo) AS c FROM creates GROUP BY id)
SELECT coalesce(l.id, b.id) AS id, md5(coalesce(b.text, l.text)) AS text, coalesce(l.status, 'candidate') AS status, coalesce(l.kind, 'fact') AS kind,
 coalesce(l.support_count, 0) + coalesce(b.s, 0) AS support_count, coalesce(b.e, 0) AS echo_count, CAST(greatest(l.confidence, b.c) AS DOUBLE) AS confidence,
 CASE WHEN b.id IS NOT NULL THEN coalesce(l.label = 4, false) ELSE l.consolidated END AS consolidated, epoch_us(coalesce(b.wrote, l.updated_at)) AS updated_at
FROM learning l FULL JOIN b ON b.id = l.id""")
def learning_upsert(t: Tables):
    def shape(df, id_col, text, at, echo, conf):
        null = F.lit(None).cast("string")
        return df.select(
            F.col(id_col).alias("id"), text.alias("text"), null.alias("task_pattern"), null.alias("kind"), null.alias("tool_key"),
            null.alias("error_signature"), F.lit(None).cast("boolean").alias("resolved"), F.lit(None).cast("long").alias("project_id"),
            F.lit("project").alias("scope"), F.lit(None).cast("long").alias("user_id"), F.lit(conf).alias("confidence"), at.alias("at"), echo.alias("echo"),
        )

    again = shape(t.produced, "learning_id", F.concat(F.lit("again "), F.col("learning_id").cast("string")), F.col("at"), F.col("echo"), 0.5)
    fresh = t.documents.join(t.learning.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
    new = shape(fresh, "doc_id", F.concat(F.lit("new "), F.col("doc_id").cast("string")), F.lit("2024-02-01").cast("timestamp"), F.lit(False), 0.3)
    return tr.upsert_learnings(_state(t), again.unionByName(new)).select(
        "id", F.md5("text").alias("text"), "status", "kind", "support_count", "echo_count", "confidence", "consolidated", micros("updated_at")
    )


@query("learning_update", rows="T6 J18", uses="learning", oracle="""
WITH up AS (SELECT id, CASE WHEN id % 3 = 0 THEN text ELSE 'changed ' || id END AS text, id % 2 = 0 AS echo FROM learning WHERE scope = 'user' OR label < 6)
SELECT l.id, l.status = 'approved' AND u.id IS NOT NULL AND u.text <> l.text AS demoted,
 CASE WHEN l.status = 'approved' AND u.id IS NOT NULL AND u.text <> l.text THEN 'candidate' ELSE l.status END AS status,
 CASE WHEN l.status = 'approved' AND u.id IS NOT NULL AND u.text <> l.text THEN NULL ELSE 'human' END AS reviewed_by,
 l.support_count + CASE WHEN u.id IS NOT NULL AND NOT u.echo THEN 1 ELSE 0 END AS support_count,
 CASE WHEN u.id IS NOT NULL AND NOT u.echo AND l.confidence < 0.9 THEN 0.9::DOUBLE ELSE l.confidence END AS confidence
FROM learning l LEFT JOIN up u USING (id)""")
def learning_update(t: Tables):
    updates = t.learning.select(
        "id", "project_id", F.when(F.col("id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("changed "), F.col("id").cast("string"))).alias("text"),
        F.lit(None).cast("string").alias("task_pattern"), F.lit(None).cast("string").alias("kind"), F.lit(0.9).alias("confidence"),
        now().alias("at"), (F.col("id") % 2 == 0).alias("echo"),
    )
    owners = t.learning.filter("label < 6").select("project_id", F.col("id").alias("learning_id"))
    ok = tr.owned(updates, t.learning, owners)
    return tr.update_learnings(_state(t), ok).select("id", "demoted", "status", "reviewed_by", "support_count", "confidence")


ADD_ID = "'learning:' || ns || ':' || substr(sha1(ns || chr(10) || short), 1, 16)"


@query("direct_adds", rows="T7", uses="learning", oracle=f"""
WITH s AS (SELECT *, {sql_trunc('text', 500)} AS short, CASE WHEN scope = 'user' THEN 'user:' || user_id ELSE CAST(project_id AS VARCHAR) END AS ns FROM learning)
SELECT {ADD_ID} AS id, max(short) AS text, CASE WHEN bool_or(kind = 'error') THEN 'error' ELSE 'fact' END AS kind, 'candidate' AS status,
 max(confidence) AS confidence, count(*) AS support_count FROM s WHERE short <> '' GROUP BY 1
UNION ALL SELECT 'learning:old:' || id, text, kind, status, confidence, support_count FROM learning""")
def direct_adds(t: Tables):
    state = _state(t).withColumn("id", F.concat(F.lit("learning:old:"), F.col("id").cast("string")))
    return tr.add_learnings(state, t.learning.withColumn("at", F.col("created_at"))).select("id", "text", "kind", "status", "confidence", "support_count")


@query("seed_learnings", rows="S13", uses="learning", oracle="""
WITH s AS (SELECT project_id, task_pattern AS text, confidence FROM learning)
SELECT 'learning:' || project_id || ':' || substr(sha1(project_id || chr(10) || text), 1, 16) AS id, text, max(confidence) AS confidence FROM s GROUP BY project_id, text
UNION ALL SELECT 'learning:old:' || id, NULL, confidence FROM learning""")
def seed_learnings(t: Tables):
    state = t.learning.select(F.concat(F.lit("learning:old:"), F.col("id").cast("string")).alias("id"), "confidence")
    return tr.bootstrap_learnings(state, t.learning.select("project_id", F.col("task_pattern").alias("text"), "confidence")).select("id", "text", "confidence")


DEC_SQL = """
 touched AS (SELECT c.from_id, c.to_id, d.action FROM conflict c JOIN decision d ON d.id = c.from_id),
 loser AS (SELECT to_id AS id, max(from_id) AS by_ FROM touched WHERE action = 'keep_new' GROUP BY 1),
 after_ AS (SELECT l.*, d.action, lo.by_, CASE WHEN lo.id IS NOT NULL THEN 'rejected' WHEN d.action IN ('reject', 'keep_existing') THEN 'rejected' WHEN d.action IS NOT NULL THEN 'approved' ELSE l.status END AS new_status
   FROM learning l LEFT JOIN decision d USING (id) LEFT JOIN loser lo USING (id))
"""
DEC_USES = "learning decision conflict"


def _decided(t: Tables):
    return tr.human_decisions(t.learning, t.conflict, t.decision)


@query("human_decisions", rows="T8", uses=DEC_USES, oracle=f"""WITH {DEC_SQL}
SELECT id, new_status AS status, CASE WHEN action = 'edit_approve' THEN md5('edited ' || id) ELSE md5(text) END AS text,
 by_ IS NOT NULL OR coalesce(action IN ('reject', 'keep_existing'), false) AS dropped,
 CASE WHEN by_ IS NOT NULL THEN 'human_superseded_by:' || by_ WHEN action = 'reject' THEN 'human_review' WHEN action = 'keep_existing' THEN 'human_kept_existing' END AS rejected_reason FROM after_""")
def human_decisions(t: Tables):
    return _decided(t)["learning"].select("id", "status", F.md5("text").alias("text"), F.col("embedding").isNull().alias("dropped"), "rejected_reason")


@query("human_decision_edges", rows="T8", uses=DEC_USES, oracle=f"""WITH {DEC_SQL}
SELECT CASE WHEN action = 'keep_new' THEN 'SUPERSEDES' ELSE 'CONTRADICTED_BY' END AS kind, from_id, to_id FROM touched WHERE action IN ('keep_new', 'keep_existing')""")
def human_decision_edges(t: Tables):
    return _decided(t)["edges"]


def _stale(t: Tables):
    state = _decided(t)["learning"]
    rejected = state.filter("status = 'rejected' AND rejected_reason IS NOT NULL").select("id")
    return tr.flag_stale(rejected, state, t.skill, t.derived_from)


@query("stale_skills", rows="T9", uses=DEC_USES + " skill derived_from", oracle=f"""WITH {DEC_SQL},
 rej AS (SELECT id FROM after_ WHERE new_status = 'rejected' AND (by_ IS NOT NULL OR action IN ('reject', 'keep_existing')))
SELECT s.skill_id, 'source learning ' || max(d.learning_id) || ' was rejected or superseded' AS revision_reason,
 (SELECT count(*) FROM derived_from x JOIN after_ a ON a.id = x.learning_id WHERE x.skill_id = s.skill_id AND a.new_status = 'rejected') AS stale_source_count
FROM skill s JOIN derived_from d USING (skill_id) JOIN rej ON rej.id = d.learning_id GROUP BY s.skill_id""")
def stale_skills(t: Tables):
    return _stale(t)["skill"].select("skill_id", "revision_reason", "stale_source_count")


@query("stale_profiles", rows="T9", uses=DEC_USES, oracle=f"""WITH {DEC_SQL}
SELECT user_id, 'folded user fact ' || max(id) || ' was rejected or superseded' AS revision_reason FROM after_
WHERE new_status = 'rejected' AND (by_ IS NOT NULL OR action IN ('reject', 'keep_existing')) AND scope = 'user' AND consolidated_at IS NOT NULL AND unfolded_at IS NULL GROUP BY user_id""")
def stale_profiles(t: Tables):
    return _stale(t)["profile"]


@query("usage_counters", rows="A11", uses="session_event injection", oracle="""
SELECT learning_id AS id, count(*) FILTER (WHERE prompt IS NOT NULL) AS inject_count, count(*) FILTER (WHERE prompt IS NULL) AS retrieval_count, count(*) AS use_count, epoch_us(max(injected_at)) AS last_used_at
FROM injection GROUP BY 1""")
def usage_counters(t: Tables):
    serves = t.injection.select(F.col("learning_id").alias("id"), F.when(F.col("prompt").isNotNull(), "inject").otherwise("retrieve").alias("via"), F.col("injected_at").alias("at"))
    return tr.usage_counters(serves).select("id", "inject_count", "retrieval_count", "use_count", micros("last_used_at"))


@query("written_learning_links", rows="J10 P18", uses="session_event", oracle="""
SELECT 'learning:' || k AS learning_id, session_id, epoch_us(min(ts)) AS at FROM session_event
WHERE tool_name LIKE '%project_add_learning' AND event_name = 'PostToolUse' AND NOT tool_error GROUP BY 1, 2""")
def written_learning_links(t: Tables):
    rows = t.session_event.withColumn("tool_response", F.concat(F.lit('{"id": "learning:'), F.col("k").cast("string"), F.lit('"}')))
    facts = rows.select(F.concat(F.lit("learning:"), F.col("k").cast("string")).alias("id"), F.lit(None).cast("long").alias("user_id")).distinct()
    return tr.link_written_learnings(rows, facts)["links"].select("learning_id", "session_id", micros("at"))


@query("recall_flags", rows="S17", uses="learning skill derived_from", oracle="""
WITH l AS (SELECT *, CASE WHEN label % 2 = 0 THEN consolidated END AS flag FROM learning),
 c AS (SELECT d.learning_id AS id, min(d.skill_id) AS sk, min(d.created_at) AS since FROM derived_from d JOIN skill s USING (skill_id) WHERE s.status = 'approved' GROUP BY 1)
SELECT l.id, CASE WHEN flag IS NULL THEN c.id IS NOT NULL OR coalesce(consolidated_at IS NOT NULL AND updated_at <= consolidated_at, false) ELSE flag END AS consolidated,
 CASE WHEN flag IS NULL THEN c.sk END AS compiled_skill_id, CASE WHEN flag IS NULL THEN epoch_us(c.since) END AS compiled_at FROM l LEFT JOIN c USING (id)""")
def recall_flags(t: Tables):
    rows = t.learning.withColumn("consolidated", F.when(F.col("label") % 2 == 0, F.col("consolidated"))).withColumns(
        {"compiled_at": F.lit(None).cast("timestamp"), "compiled_skill_id": F.lit(None).cast("long")}
    )
    return tr.recall_flags(rows, t.skill, t.derived_from, now()).select("id", "consolidated", "compiled_skill_id", micros("compiled_at"))


@query("key_violations", rows="S16", oracle="""
SELECT 'conversation' AS "table", CAST(conv_id AS VARCHAR) AS key, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1
UNION ALL SELECT 'event', CAST(event_id AS VARCHAR), count(*) FROM events GROUP BY event_id HAVING count(*) > 1
UNION ALL SELECT 'text', md5(text), count(*) FROM documents GROUP BY text HAVING count(*) > 1""")
def key_violations(t: Tables):
    return tr.key_violations({
        "conversation": (t.conversations, "conv_id"), "event": (t.events, "event_id"),
        "text": (t.documents.select(F.md5("text").alias("text")), "text"),
    })


#: Model keys and the columns that hold them here.
KEY_COLUMNS = {
    "Session.session_id": ("session", "session_id"), "SessionEvent.event_id": ("session_event", "event_id"), "Learning.id": ("learning", "id"),
    "SystemPromptInjection.injection_id": ("injection", "injection_id"), "Observation.id": ("observation", "id"), "UserProfile.user_id": ("profile", "user_id"),
    "Skill.id": ("skill", "skill_id"), "SkillVersion.id": ("skill_version", "version_id"), "TaskPattern.id": ("pattern", "id"),
    "SkillProposalAudit.id": ("proposal", "proposal_id"), "Account.id": ("account", "account_id"), "Account.slug": ("account", "domain"),
    "Product.sku": ("product", "sku"), "Contact.contact_id": ("contact", "contact_id"),
    # Rows that repeat a key by design, as their tables would before a merge.
    "Project.id": ("session", "project_id"), "User.id": ("session", "user_id"), "CSM.name": ("account", "owner"), "Skill.slug": ("skill", "slug"),
}
_STACK = " UNION ALL ".join(f"SELECT '{name}' AS constraint_, CAST({column} AS VARCHAR) AS key FROM {view}" for name, (view, column) in KEY_COLUMNS.items())


@query("constraint_report", rows="S16", uses=" ".join(dict.fromkeys(view for view, _ in KEY_COLUMNS.values())), oracle=f"""
WITH stack AS ({_STACK}), planted AS (SELECT * FROM stack UNION ALL SELECT constraint_, key FROM (SELECT DISTINCT * FROM stack) WHERE right(key, 2) = '41'),
 bad AS (SELECT constraint_, key, count(*) AS n FROM planted GROUP BY 1, 2 HAVING count(*) > 1 OR key IS NULL)
SELECT constraint_ AS "constraint", count(key) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(max(n) FILTER (WHERE key IS NULL), 0) AS BIGINT) AS missing, min(key) AS first_key FROM bad GROUP BY 1""")
def constraint_report(t: Tables):
    """Every key that ends in 41 is planted once more."""
    keys = {}
    for name, (view, column) in KEY_COLUMNS.items():
        key = getattr(t, view).select(F.col(column).cast("string").alias("key"))
        keys[name] = key.unionByName(key.distinct().filter(F.substring("key", -2, 2) == "41"))
    return tr.constraint_report(keys)


def _toy_vectors(texts):
    """A stand-in for a provider: lengths and digit counts; no vector for very long texts."""
    return [None if len(x) > 4000 else [float(len(x)), float(sum(c.isdigit() for c in x)), 1.0] for x in texts]


@query("embedding_backfill", rows="S14 D1", uses="learning", oracle="""
SELECT id, CAST(length(trim(text)) AS DOUBLE) AS v0, CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS DOUBLE) AS v1 FROM learning
WHERE status IN ('approved', 'candidate') AND label < 5 AND length(trim(text)) <= 4000""")
def embedding_backfill(t: Tables):
    rows = t.learning.withColumn("embedding", F.when(F.col("label") >= 5, F.col("embedding")))
    out = emb.backfill(rows, _toy_vectors)
    return out.select("id", F.element_at("embedding", 1).cast("double").alias("v0"), F.element_at("embedding", 2).cast("double").alias("v1"))


@query("embedding_attach", rows="S15 D1", uses="learning", oracle="""
SELECT id, CASE WHEN status IN ('approved', 'candidate') AND length(trim(text)) <= 4000 THEN 3 ELSE len(embedding) END AS width FROM learning""")
def embedding_attach(t: Tables):
    fresh = emb.backfill(t.learning, _toy_vectors, only_missing=False)
    return emb.attach(t.learning, fresh).select("id", F.size("embedding").cast("long").alias("width"))


_INPUT = {
    "learning": ("learning", "id", ["text"]), "observation": ("observation", "id", ["title", "narrative"]), "pattern": ("pattern", "id", ["text"]),
    "skill": ("skill", "skill_id", ["name", "description", "content"]),
}
MEMORY_SQL = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, CAST({key} AS VARCHAR) AS id, concat_ws(chr(10), {', '.join(f"nullif(trim({c}), '')" for c in parts)}) AS text FROM {view}" for kind, (view, key, parts) in _INPUT.items())


def _vectors_by_content(t: Tables):
    """A first run embeds the facts, a second one what is new among all four kinds. The texts are gathered and written once: both runs and a later look-up read them."""
    t.keep("learning")  # skills are made from facts
    texts = stored(emb.memory_texts(t.learning, t.observation, t.pattern, t.skill), "memory-texts")
    first = stored(emb.fill_store(None, texts.filter("kind = 'learning'"), _toy_vectors), "vectors")
    return texts, stored(emb.fill_store(first, texts, _toy_vectors), "vectors")


@query("memory_vectors", rows="S15 S14 D1", uses="learning observation pattern skill", oracle=f"""WITH m AS ({MEMORY_SQL})
SELECT kind, id, CASE WHEN length(text) <= 4000 AND trim(text) <> '' THEN CAST(length(text) AS DOUBLE) END AS v0,
  CASE WHEN length(text) <= 4000 AND trim(text) <> '' THEN CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS DOUBLE) END AS v1 FROM m""")
def memory_vectors(t: Tables):
    out = emb.look_up(*_vectors_by_content(t))
    return out.select("kind", "id", F.try_element_at("embedding", F.lit(1)).cast("double").alias("v0"), F.try_element_at("embedding", F.lit(2)).cast("double").alias("v1"))


@query("vector_store", rows="S15 S14", uses="learning observation pattern skill", oracle=f"""WITH m AS ({MEMORY_SQL})
SELECT DISTINCT sha256(text) AS text_key, CAST(length(text) AS DOUBLE) AS v0 FROM m WHERE length(text) <= 4000 AND trim(text) <> ''""")
def vector_store(t: Tables):
    return _vectors_by_content(t)[1].select("text_key", F.element_at("embedding", 1).cast("double").alias("v0"))


@query("pending_embeddings", rows="S14", uses="learning", oracle="SELECT count(*) AS pending FROM learning WHERE status IN ('approved', 'candidate') AND label < 5")
def pending_embeddings(t: Tables):
    rows = t.learning.withColumn("embedding", F.when(F.col("label") >= 5, F.col("embedding")))
    return rows.filter("status IN ('approved', 'candidate') AND text IS NOT NULL AND embedding IS NULL").agg(F.count("*").alias("pending"))


