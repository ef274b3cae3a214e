"""Recall, search and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelore.catalog.base import Tables, query
from tracelore.functions import vectors
from tracelore.operators import recall
from tracelore.operators.segments import top_per_key
from tracelore.session import shuffled

FLOOR = 0.20  # the test vectors are nearly orthogonal; a job's floor is a parameter


def n(name: str):
    return F.col(name).cast("long").alias(name)


def r6(name: str):
    return F.round(name, 6).alias(name)


def learning_words(t: Tables):
    """The text index over facts, built once and read by every search."""
    return t.shared("learning-words", lambda: recall.learning_index(t.learning))


COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
SEEN_SQL = """
 seen AS (SELECT r.request_id AS q_id, i.learning_id AS r_id FROM request r JOIN injected_in i ON i.session_id = r.session_id
   UNION SELECT r.request_id, l.id FROM request r JOIN learning l ON l.session_id = r.session_id)
"""
# Sources of a project search: ranked by cosine before status and session filters.
PV_SQL = f"""
 pairs AS (SELECT r.request_id AS q_id, l.id AS r_id, {COS.format(a='r.vector', b='l.embedding')} AS cos, l.status
   FROM request r JOIN learning l ON l.project_id = r.project_id WHERE l.scope = 'project' AND NOT l.consolidated AND l.id <> r.request_id),
 raw AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(cos, 6) DESC, r_id) AS rk FROM pairs)
"""
UV_SQL = f"""
 upairs AS (SELECT r.request_id AS q_id, l.id AS r_id, {COS.format(a='r.vector', b='l.embedding')} AS cos, l.status, l.user_id = r.user_id AS mine
   FROM request r CROSS JOIN learning l WHERE l.scope = 'user' AND NOT l.consolidated AND l.id <> r.request_id),
 uraw AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(cos, 6) DESC, r_id) AS rk FROM upairs)
"""
LIVE = "status IN ('approved', 'candidate')"


def bm25(source: str, id_col: str, text: str, extra: str) -> str:
    """CTEs toks .. wgt: the weight of every term of every row of ``source``."""
    return f"""
 toks AS (SELECT {id_col} AS r_id, {extra}, regexp_extract_all(lower({text}), '[a-z0-9]{{3,}}') AS ws FROM {source}),
 stats AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM toks),
 tf AS (SELECT r_id, {extra}, dl, term, count(*) AS tf FROM (SELECT r_id, {extra}, len(ws) AS dl, unnest(ws) AS term FROM toks) x GROUP BY ALL),
 dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 wgt AS (SELECT t.r_id, {', '.join('t.' + e.strip() for e in extra.split(','))}, t.term, ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * t.tf / (t.tf + 1.2 * (1 - 0.75 + 0.75 * t.dl / s.avgdl)) AS w
   FROM tf t JOIN dfs d USING (term) CROSS JOIN stats s)"""


QTERMS_SQL = """
 qtok AS (SELECT q_id, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM (SELECT request_id AS q_id, regexp_extract_all(lower(query), '[a-z0-9]{3,}') AS l FROM request) x),
 qfirst AS (SELECT q_id, term, min(pos) AS pos FROM qtok GROUP BY 1, 2),
 qterm AS (SELECT q.q_id, q.term, r.project_id, r.user_id FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY pos) AS rn FROM qfirst) q JOIN request r ON r.request_id = q.q_id WHERE q.rn <= 16)
"""
L25 = bm25("learning", "id", "text || ' ' || task_pattern", "project_id, scope, user_id, status, consolidated")


def kw_sql(name: str, match: str, keep: str, limit: int, barred: bool = True, pool: str = "wgt") -> str:
    anti = "AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.q_id = q.q_id AND s.r_id = w.r_id)" if barred else ""
    return f"""
 {name} AS (SELECT * FROM (SELECT q_id, r_id, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 6) DESC, r_id) AS rank FROM (
   SELECT q.q_id, w.r_id, sum(w.w) AS score FROM qterm q JOIN {pool} w ON w.term = q.term AND {match} WHERE {keep} AND w.r_id <> q.q_id {anti} GROUP BY 1, 2) y) z WHERE rank <= {limit})"""


def fuse_sql(name: str, parts: list[tuple[str, str]]) -> str:
    union = " UNION ALL ".join(f"SELECT q_id, r_id, rank, '{src}' AS source FROM {cte}" for cte, src in parts)
    return f" {name} AS (SELECT q_id, r_id, sum(1.0::DOUBLE / (60 + rank)) AS score, string_agg(source, '+' ORDER BY source) AS sources FROM ({union}) u GROUP BY 1, 2)"


RANKED = "row_number() OVER (PARTITION BY f.q_id ORDER BY CASE WHEN l.status = 'approved' THEN 0 ELSE 1 END, round(f.score, 9) DESC, l.confidence DESC, f.r_id)"


def out(df):
    return df.select("q_id", "r_id", r6("score"), "sources", n("rank"))


@query("cosine_to_label_centre", rows="V1", oracle=f"""
WITH c AS (SELECT label, min_by(embedding, vec_id) AS centre FROM embeddings GROUP BY label)
SELECT vec_id, round({COS.format(a='e.embedding', b='c.centre')}, 6) AS cos FROM embeddings e JOIN c USING (label)""")
def cosine_to_label_centre(t: Tables):
    centre = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("centre"))
    return t.embeddings.join(centre, "label").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("centre")), 6).alias("cos"))


@query("live_memory", rows="P1", uses="learning", oracle=f"SELECT id, project_id, scope FROM learning WHERE {LIVE} AND NOT consolidated")
def live_memory(t: Tables):
    return t.learning.filter(recall.live()).select("id", "project_id", "scope")


@query("served_in_session", rows="P2", uses="request injected_in learning", oracle="""
SELECT session_id, learning_id AS r_id FROM injected_in UNION SELECT session_id, id FROM learning""")
def served_in_session(t: Tables):
    return recall.served_in_session(t.learning, t.injected_in)


@query("vector_top_k", rows="V2", uses="request learning", oracle=f"""WITH {PV_SQL}
SELECT q_id, r_id, round(cos, 6) AS cos, row_number() OVER (PARTITION BY q_id ORDER BY round(cos, 6) DESC, r_id) AS rank FROM raw WHERE rk <= 15 AND {LIVE} AND cos >= {FLOOR}""")
def vector_top_k(t: Tables):
    rows = t.learning.filter("scope = 'project' AND NOT consolidated")
    hits = recall.vector_branch(t.request, rows, ["project_id"], 15, keep=F.col("status").isin("approved", "candidate"), floor=FLOOR)
    return hits.select("q_id", "r_id", r6("cos"), n("rank"))


@query("recall_project", rows="V5 V4 P1 P2", uses="request learning injected_in salience_state", oracle=f"""WITH {SEEN_SQL}, {PV_SQL},
 hit AS (SELECT q_id, r_id, row_number() OVER (PARTITION BY q_id ORDER BY round(cos, 6) DESC, r_id) AS rank FROM raw p WHERE rk <= 15 AND {LIVE} AND cos >= {FLOOR}
   AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.q_id = p.q_id AND s.r_id = p.r_id)),
 f AS (SELECT h.q_id, h.r_id, (1.0::DOUBLE / (60 + rank)) * (1 + 0.1::DOUBLE * a.salience) AS score, 'vector' AS sources FROM hit h JOIN salience_state a ON a.id = h.r_id)
SELECT f.q_id, f.r_id, round(f.score, 6) AS score, f.sources, {RANKED} AS rank FROM f JOIN learning l ON l.id = f.r_id QUALIFY rank <= 5""")
def recall_project(t: Tables):
    barred = recall.served_in_session(t.learning, t.injected_in)
    return out(recall.recall_project(t.request, t.learning, 5, FLOOR, barred, t.salience_state, 0.1))


@query("recall_user", rows="V6", uses="request learning injected_in", oracle=f"""WITH {SEEN_SQL}, {UV_SQL},
 hit AS (SELECT q_id, r_id, row_number() OVER (PARTITION BY q_id ORDER BY round(cos, 6) DESC, r_id) AS rank FROM uraw p WHERE rk <= 5 AND {LIVE} AND mine AND cos >= {FLOOR}
   AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.q_id = p.q_id AND s.r_id = p.r_id)),
 f AS (SELECT q_id, r_id, 1.0::DOUBLE / (60 + rank) AS score, 'vector' AS sources FROM hit)
SELECT f.q_id, f.r_id, round(f.score, 6) AS score, f.sources, {RANKED} AS rank FROM f JOIN learning l ON l.id = f.r_id QUALIFY rank <= 5""")
def recall_user(t: Tables):
    barred = recall.served_in_session(t.learning, t.injected_in)
    return out(recall.recall_user(t.request, t.learning, 5, FLOOR, barred))


@query("keyword_top_k", rows="V3 X2", uses="request learning injected_in", oracle=f"""WITH {SEEN_SQL}, {QTERMS_SQL}, {L25},
 {kw_sql('kw', 'w.project_id = q.project_id', f"w.scope = 'project' AND NOT w.consolidated AND w.{LIVE}", 5)}
SELECT q_id, r_id, rank FROM kw""")
def keyword_top_k(t: Tables):
    barred = recall.served_in_session(t.learning, t.injected_in)
    terms = recall.query_terms(t.request.withColumn("scope", F.lit("project")).withColumn("owner", F.col("project_id").cast("string")), "request_id", "query", ["scope", "owner"])
    allow = lambda pairs: recall.drop_served(pairs, t.request, barred, "doc_id")
    keep = F.col("status").isin("approved", "candidate") & ~F.col("consolidated")
    return learning_words(t).top(terms, 5, keep, allow, True).select("q_id", "r_id", n("rank"))


HYBRID_P = f"""{SEEN_SQL}, {PV_SQL}, {QTERMS_SQL}, {L25},
 vec AS (SELECT q_id, r_id, row_number() OVER (PARTITION BY q_id ORDER BY round(cos, 6) DESC, r_id) AS rank FROM raw p WHERE rk <= 5 AND {LIVE}
   AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.q_id = p.q_id AND s.r_id = p.r_id)),
 {kw_sql('kw', 'w.project_id = q.project_id', f"w.scope = 'project' AND NOT w.consolidated AND w.{LIVE}", 5)},
 {fuse_sql('f', [('vec', 'vector'), ('kw', 'keyword')])}"""
HYBRID_U = f"""{UV_SQL},
 uvec AS (SELECT q_id, r_id, row_number() OVER (PARTITION BY q_id ORDER BY round(cos, 6) DESC, r_id) AS rank FROM uraw p WHERE rk <= 5 AND {LIVE} AND mine
   AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.q_id = p.q_id AND s.r_id = p.r_id)),
 {kw_sql('ukw', 'w.user_id = q.user_id', f"w.scope = 'user' AND NOT w.consolidated AND w.{LIVE}", 5)},
 {fuse_sql('uf', [('uvec', 'vector'), ('ukw', 'keyword')])}"""


@query("hybrid_project", rows="V4 U1", uses="request learning injected_in", oracle=f"""WITH {HYBRID_P}
SELECT f.q_id, f.r_id, round(f.score, 6) AS score, f.sources, {RANKED} AS rank FROM f JOIN learning l ON l.id = f.r_id QUALIFY rank <= 5""")
def hybrid_project(t: Tables):
    barred = recall.served_in_session(t.learning, t.injected_in)
    return out(recall.hybrid(t.request, t.learning, ["project_id"], 5, barred=barred, index=learning_words(t)))


@query("hybrid_keyword_only", rows="V4", uses="request learning injected_in", oracle=f"""WITH {SEEN_SQL}, {QTERMS_SQL}, {L25},
 {kw_sql('kw', 'w.project_id = q.project_id', f"w.scope = 'project' AND NOT w.consolidated AND w.{LIVE}", 5)},
 {fuse_sql('f', [('kw', 'keyword')])}
SELECT f.q_id, f.r_id, round(f.score, 6) AS score, f.sources, {RANKED} AS rank FROM f JOIN learning l ON l.id = f.r_id QUALIFY rank <= 5""")
def hybrid_keyword_only(t: Tables):
    barred = recall.served_in_session(t.learning, t.injected_in)
    return out(recall.hybrid(t.request, t.learning, ["project_id"], 5, barred=barred, branches=["keyword"], index=learning_words(t)))


FALLBACK = f"""row_number() OVER (PARTITION BY {{key}} ORDER BY CASE WHEN status = 'approved' THEN 0 ELSE 1 END, updated_at DESC, id) AS rank"""


@query("recency_fallback", rows="W12", uses="learning", oracle=f"""
SELECT project_id, id, {FALLBACK.format(key='project_id')} FROM learning WHERE {LIVE} AND NOT consolidated AND scope = 'project' QUALIFY rank <= 5""")
def recency_fallback(t: Tables):
    return recall.recency_fallback(t.learning.filter("scope = 'project'"), ["project_id"], 5).select("project_id", "id", n("rank"))


@query("context_on_demand", rows="V7 W12", uses="request learning injected_in", oracle=f"""WITH {HYBRID_P}, {HYBRID_U},
 phit AS (SELECT f.q_id AS request_id, f.r_id AS id, {RANKED} AS rank FROM f JOIN learning l ON l.id = f.r_id QUALIFY rank <= 5),
 uhit AS (SELECT f.q_id AS request_id, f.r_id AS id, {RANKED} AS rank FROM uf f JOIN learning l ON l.id = f.r_id QUALIFY rank <= 5),
 pback AS (SELECT project_id, id, {FALLBACK.format(key='project_id')} FROM learning WHERE {LIVE} AND NOT consolidated AND scope = 'project' QUALIFY rank <= 5),
 uback AS (SELECT user_id, id, {FALLBACK.format(key='user_id')} FROM learning WHERE {LIVE} AND NOT consolidated AND scope = 'user' QUALIFY rank <= 5)
SELECT 'project' AS part, request_id, id, rank, 'search' AS via FROM phit
UNION ALL SELECT 'project', r.request_id, b.id, b.rank, 'recency' FROM request r JOIN pback b USING (project_id) WHERE r.request_id NOT IN (SELECT request_id FROM phit)
UNION ALL SELECT 'user', request_id, id, rank, 'search' FROM uhit
UNION ALL SELECT 'user', r.request_id, b.id, b.rank, 'recency' FROM request r JOIN uback b USING (user_id) WHERE r.request_id NOT IN (SELECT request_id FROM uhit)""")
def context_on_demand(t: Tables):
    return _on_demand(t)


def _on_demand(t: Tables):
    barred = recall.served_in_session(t.learning, t.injected_in)
    parts = []
    for part, scope, key in (("project", "project", "project_id"), ("user", "user", "user_id")):
        hits = recall.hybrid(t.request, t.learning, [key], 5, scope=scope, barred=barred, index=learning_words(t))
        back = recall.recency_fallback(t.learning.filter(F.col("scope") == scope), [key], 5)
        parts.append(recall.context_hits(t.request, hits, back, key).withColumn("part", F.lit(part)))
    return parts[0].unionByName(parts[1]).select("part", "request_id", "id", n("rank"), "via")


MARK_AT = "2024-06-01 00:00:00"


@query("context_usage_marks", rows="V7 A11", uses="request learning injected_in", oracle=f"""WITH {HYBRID_P}, {HYBRID_U},
 phit AS (SELECT f.q_id AS request_id, f.r_id AS id, {RANKED} AS rank FROM f JOIN learning l ON l.id = f.r_id QUALIFY rank <= 5),
 uhit AS (SELECT f.q_id AS request_id, f.r_id AS id, {RANKED} AS rank FROM uf f JOIN learning l ON l.id = f.r_id QUALIFY rank <= 5),
 pback AS (SELECT project_id, id, {FALLBACK.format(key='project_id')} FROM learning WHERE {LIVE} AND NOT consolidated AND scope = 'project' QUALIFY rank <= 5),
 uback AS (SELECT user_id, id, {FALLBACK.format(key='user_id')} FROM learning WHERE {LIVE} AND NOT consolidated AND scope = 'user' QUALIFY rank <= 5),
 given AS (SELECT request_id, id FROM phit UNION SELECT r.request_id, b.id FROM request r JOIN pback b USING (project_id) WHERE r.request_id NOT IN (SELECT request_id FROM phit)
   UNION SELECT request_id, id FROM uhit UNION SELECT r.request_id, b.id FROM request r JOIN uback b USING (user_id) WHERE r.request_id NOT IN (SELECT request_id FROM uhit)),
 n AS (SELECT id, count(*) AS n FROM given GROUP BY id)
SELECT l.id, l.support_count + coalesce(n.n, 0) AS use_count, coalesce(n.n, 0) AS retrieval_count,
  CASE WHEN n.n IS NOT NULL THEN epoch_us(TIMESTAMP '{MARK_AT}') END AS last_retrieved_at, CASE WHEN n.n IS NOT NULL THEN epoch_us(TIMESTAMP '{MARK_AT}') END AS last_used_at
FROM learning l LEFT JOIN n USING (id)""")
def context_usage_marks(t: Tables):
    """What the on-demand pull leaves on the facts: each fact given to a request counts once for it."""
    rows = t.learning.withColumn("use_count", F.col("support_count")).withColumn("last_used_at", F.lit(None).cast("timestamp"))
    marked = recall.mark_retrieved(rows, _on_demand(t), F.lit(MARK_AT).cast("timestamp"))
    micros = lambda c: F.unix_micros(c).alias(c)
    return marked.select("id", n("use_count"), n("retrieval_count"), micros("last_retrieved_at"), micros("last_used_at"))


@query("suggest_skills", rows="V8", uses="request skill", oracle=f"""
WITH c AS (SELECT r.request_id AS q_id, s.slug, s.salience, {COS.format(a='r.vector', b='s.embedding')} AS cos FROM request r JOIN skill s ON s.project_id = r.project_id WHERE s.status = 'approved')
SELECT q_id, slug, row_number() OVER (PARTITION BY q_id ORDER BY round(cos * (1 + 0.1::DOUBLE * salience), 6) DESC, slug) AS rank FROM c
WHERE round((1 + cos) / 2, 7) >= (1 + {FLOOR}) / 2 QUALIFY rank <= 5""")
def suggest_skills(t: Tables):
    return recall.suggest_skills(t.request, t.skill, 5, FLOOR, 0.1).select("q_id", "slug", n("rank"))


@query("skill_search", rows="V9", uses="request skill", oracle=f"""WITH
 sv AS (SELECT r.request_id AS q_id, s.skill_id AS r_id, s.status, {COS.format(a='r.vector', b='s.embedding')} AS cos FROM request r JOIN skill s ON s.project_id = r.project_id),
 vec AS (SELECT q_id, r_id, row_number() OVER (PARTITION BY q_id ORDER BY round(cos, 6) DESC, r_id) AS rank FROM (
   SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(cos, 6) DESC, r_id) AS rk FROM sv) x WHERE rk <= 15 AND status = 'approved'),
 {QTERMS_SQL}, {bm25('skill', 'skill_id', "name || ' ' || description || ' ' || content", 'project_id, status')},
 kw AS (SELECT * FROM (SELECT q_id, r_id, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 6) DESC, r_id) AS rank FROM (
   SELECT q.q_id, w.r_id, sum(w.w) AS score FROM qterm q JOIN wgt w ON w.term = q.term AND w.project_id = q.project_id WHERE w.status = 'approved' GROUP BY 1, 2) y) z WHERE rank <= 15),
 {fuse_sql('f', [('vec', 'vector'), ('kw', 'keyword')])}
SELECT f.q_id, f.r_id, round(f.score * (1 + 0.1::DOUBLE * s.salience), 6) AS score, f.sources,
 row_number() OVER (PARTITION BY f.q_id ORDER BY round(f.score * (1 + 0.1::DOUBLE * s.salience), 9) DESC, f.r_id) AS rank FROM f JOIN skill s ON s.skill_id = f.r_id QUALIFY rank <= 5""")
def skill_search(t: Tables):
    text = F.concat_ws(" ", "name", "description", "content")
    words = t.shared("skill-words", lambda: recall.text_index(t.skill, "skill_id", text, ["project_id"], ["status"]))
    return out(recall.search(
        t.request, t.skill, "skill_id", text, ["project_id"], 5, keep=F.col("status") == "approved", salience=True, weight=0.1, index=words
    ))


@query("episode_search", rows="V10", uses="request observation", oracle=f"""WITH {QTERMS_SQL}, {bm25('observation', 'id', "coalesce(title || ' ', '') || coalesce(narrative, '')", 'project_id')},
 vec AS (SELECT q_id, r_id, row_number() OVER (PARTITION BY q_id ORDER BY round(cos, 6) DESC, r_id) AS rank FROM (
   SELECT r.request_id AS q_id, o.id AS r_id, {COS.format(a='r.vector', b='o.embedding')} AS cos FROM request r JOIN observation o ON o.project_id = r.project_id WHERE o.embedding IS NOT NULL) x QUALIFY rank <= 5),
 kw AS (SELECT q_id, r_id, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 6) DESC, r_id) AS rank FROM (
   SELECT q.q_id, w.r_id, sum(w.w) AS score FROM qterm q JOIN wgt w ON w.term = q.term AND w.project_id = q.project_id GROUP BY 1, 2) y QUALIFY rank <= 5),
 {fuse_sql('f', [('vec', 'vector'), ('kw', 'keyword')])}
SELECT f.q_id, f.r_id, round(f.score, 6) AS score, f.sources, row_number() OVER (PARTITION BY f.q_id ORDER BY round(f.score, 9) DESC, f.r_id) AS rank, substr(coalesce(o.narrative, ''), 1, 160) AS snippet
FROM f JOIN observation o ON o.id = f.r_id QUALIFY rank <= 5""")
def episode_search(t: Tables):
    text = F.concat_ws(" ", "title", "narrative")
    words = t.shared("episode-words", lambda: recall.text_index(t.observation, "id", text, ["project_id"]))
    hits = recall.search(t.request, t.observation, "id", text, ["project_id"], 5, index=words)
    return out(hits).join(
        t.observation.select(F.col("id").alias("r_id"), F.substring(F.coalesce("narrative", F.lit("")), 1, 160).alias("snippet")), "r_id"
    )


@query("hybrid_outcomes", rows="V4 V7", uses="request learning injected_in", oracle=f"""WITH {SEEN_SQL}, asked AS (
   SELECT *, CASE WHEN request_id % 4 <> 0 THEN vector END AS v, CASE WHEN request_id % 6 <> 0 THEN query END AS words FROM request),
 apairs AS (SELECT r.request_id AS q_id, l.id AS r_id, l.status, {COS.format(a='r.v', b='l.embedding')} AS cos
   FROM asked r JOIN learning l ON l.project_id = r.project_id WHERE r.v IS NOT NULL AND l.scope = 'project' AND NOT l.consolidated AND l.id <> r.request_id),
 araw AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(cos, 6) DESC, r_id) AS rk FROM apairs),
 {QTERMS_SQL.strip().replace('FROM request)', 'FROM (SELECT request_id, words AS query FROM asked) asked_)')}, {L25},
 vec AS (SELECT q_id, r_id, row_number() OVER (PARTITION BY q_id ORDER BY round(cos, 6) DESC, r_id) AS rank FROM araw p WHERE rk <= 5 AND {LIVE}
   AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.q_id = p.q_id AND s.r_id = p.r_id)),
 {kw_sql('kw', 'w.project_id = q.project_id', f"w.scope = 'project' AND NOT w.consolidated AND w.{LIVE}", 5)},
 {fuse_sql('f', [('vec', 'vector'), ('kw', 'keyword')])},
 best AS (SELECT f.q_id, f.r_id, {RANKED} AS rank FROM f JOIN learning l ON l.id = f.r_id QUALIFY rank <= 5),
 hits AS (SELECT q_id, count(*) AS n FROM best GROUP BY q_id)
SELECT a.request_id AS q_id, CASE WHEN a.v IS NOT NULL OR len(regexp_extract_all(lower(coalesce(a.words, '')), '[a-z0-9]{{3,}}')) > 0 THEN coalesce(h.n, 0) END AS n_hits
FROM asked a LEFT JOIN hits h ON h.q_id = a.request_id""")
def hybrid_outcomes(t: Tables):
    """Hits per request, null where nothing could be searched: some requests have no vector, some no words, some neither."""
    asked = t.request.withColumn("vector", F.when(F.col("request_id") % 4 != 0, F.col("vector"))).withColumn("query", F.when(F.col("request_id") % 6 != 0, F.col("query")))
    barred = recall.served_in_session(t.learning, t.injected_in)
    hits = recall.hybrid(asked, t.learning, ["project_id"], 5, barred=barred, index=learning_words(t)).groupBy("q_id").agg(F.count("*").alias("n"))
    return recall.searched(asked).join(shuffled(hits), "q_id", "left").select("q_id", F.when(F.col("searched"), F.coalesce("n", F.lit(0))).alias("n_hits"))


@query("gate_neighbours", rows="V11", uses="request learning", oracle=f"""WITH {QTERMS_SQL}, {L25},
 cand AS (SELECT * FROM learning WHERE status = 'candidate'),
 cp AS (SELECT c.id AS q_id, l.id AS r_id, l.status, l.scope = 'project' OR l.user_id = c.user_id AS mine, {COS.format(a='c.embedding', b='l.embedding')} AS cos
   FROM cand c JOIN learning l ON l.project_id = c.project_id AND l.scope = c.scope),
 vec AS (SELECT q_id, r_id, row_number() OVER (PARTITION BY q_id ORDER BY round(cos, 6) DESC, r_id) AS rank FROM (
   SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(cos, 6) DESC, r_id) AS rk FROM cp) x WHERE rk <= 16 AND q_id <> r_id AND {LIVE} AND mine),
 kw AS (SELECT * FROM (SELECT q_id, r_id, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 6) DESC, r_id) AS rank FROM (
   SELECT q.q_id, w.r_id, sum(w.w) AS score FROM qterm q JOIN cand c ON c.id = q.q_id JOIN wgt w ON w.term = q.term AND w.project_id = c.project_id AND w.scope = c.scope
   AND (c.scope = 'project' OR w.user_id = c.user_id) WHERE w.{LIVE} AND w.r_id <> q.q_id GROUP BY 1, 2) y) z WHERE rank <= 15),
 {fuse_sql('f', [('vec', 'vector'), ('kw', 'keyword')])}
SELECT q_id, r_id, round(score, 6) AS score, sources, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, r_id) AS rank FROM f QUALIFY rank <= 15""")
def gate_neighbours(t: Tables):
    return out(recall.gate_neighbours(t.learning.filter("status = 'candidate'"), t.learning, index=learning_words(t)))


@query("similar_learnings", rows="V12", uses="learning", oracle=f"""
WITH a AS (SELECT * FROM learning WHERE status = 'approved' AND scope = 'project'),
 p AS (SELECT a.project_id, a.id AS source, b.id AS target, {COS.format(a='a.embedding', b='b.embedding')} AS cos FROM a JOIN a b ON a.project_id = b.project_id AND a.id <> b.id)
SELECT project_id, source, target, round(cos, 6) AS similarity FROM p WHERE cos >= {FLOOR} QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(cos, 6) DESC, target) <= 5""")
def similar_learnings(t: Tables):
    return recall.similar_pairs(t.learning, 5, FLOOR).select("project_id", "source", "target", r6("similarity"))


EDGES_SQL = f"""
 act AS (SELECT * FROM pattern WHERE status = 'active'),
 edge AS (SELECT a.project_id, a.id AS source, b.id AS target, {COS.format(a='a.embedding', b='b.embedding')} AS similarity
   FROM act a JOIN act b ON a.project_id = b.project_id AND a.id < b.id WHERE round((1 + {COS.format(a='a.embedding', b='b.embedding')}) / 2, 7) >= (1 + {FLOOR}) / 2)
"""


@query("pattern_edges", rows="V13", uses="pattern", oracle=f"WITH {EDGES_SQL} SELECT project_id, source, target, round(similarity, 6) AS similarity FROM edge")
def pattern_edges(t: Tables):
    return recall.pattern_edges(t.pattern, FLOOR).select("project_id", "source", "target", r6("similarity"))


@query("recent_observations", rows="W10 A10", uses="observation", oracle="""
SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY ended_at DESC, id DESC) AS rank, count(*) OVER (PARTITION BY project_id) AS total FROM observation QUALIFY rank <= 3""")
def recent_observations(t: Tables):
    top = top_per_key(t.observation, ["project_id"], [F.col("ended_at").desc(), F.col("id").desc()], 3)
    totals = t.observation.groupBy("project_id").agg(F.count("*").alias("total"))
    return top.join(totals, "project_id").select("project_id", "id", n("rank"), "total")


def _silent(t: Tables):
    """Every other request asks nothing."""
    return t.request.withColumn("query", F.when(F.col("request_id") % 2 == 1, F.col("query")))


def _listing_sql(rows: str, row_id: str, key: str, latest: str, k: int) -> str:
    return f"""WITH top AS (SELECT {key}, {row_id} AS r_id, row_number() OVER (PARTITION BY {key} ORDER BY {latest} DESC, {row_id}) AS rank FROM {rows} QUALIFY rank <= {k})
SELECT r.request_id AS q_id, t.r_id, t.rank FROM request r JOIN top t USING ({key}) WHERE r.request_id % 2 = 0"""


@query("user_listing", rows="V6", uses="request learning", oracle=_listing_sql(
    f"(SELECT * FROM learning WHERE scope = 'user' AND NOT consolidated AND {LIVE})", "id", "user_id", "updated_at", 5))
def user_listing(t: Tables):
    rows = t.learning.filter(f"scope = 'user' AND NOT consolidated AND {LIVE}")
    return recall.recent_listing(_silent(t), rows, "id", "user_id", F.col("updated_at"), 5).select("q_id", "r_id", n("rank"))


@query("skill_listing", rows="V9", uses="request skill", oracle=_listing_sql("(SELECT * FROM skill WHERE status = 'approved')", "skill_id", "project_id", "updated_at", 5))
def skill_listing(t: Tables):
    return recall.recent_listing(_silent(t), t.skill.filter("status = 'approved'"), "skill_id", "project_id", F.col("updated_at"), 5).select("q_id", "r_id", n("rank"))


@query("episode_listing", rows="V10 V7", uses="request observation", oracle=_listing_sql("observation", "id", "project_id", "ended_at", 5))
def episode_listing(t: Tables):
    return recall.recent_listing(_silent(t), t.observation, "id", "project_id", F.col("ended_at"), 5).select("q_id", "r_id", n("rank"))
