"""Salience graph, communities, task labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelore import params
from tracelore.catalog.base import Tables, query
from tracelore.catalog.events import TREE_SQL
from tracelore.catalog.recall import COS, EDGES_SQL, FLOOR, n, r6
from tracelore.operators import graph, patterns, recall, windows
from tracelore.plans.patterns import review_pass
from tracelore.plans.salience import related_facts, salience_pass

FACTS_SQL = " facts AS (SELECT * FROM learning WHERE status = 'approved' AND scope = 'project')"
SEEDS_SQL = """
 starts AS (SELECT project_id, created_at FROM session WHERE parent_session_id IS NULL),
 edits AS (SELECT p.learning_id AS id, p.at, CASE WHEN kind = 'PRODUCED_LEARNING' THEN 2.0 ELSE 1.0 END AS w, kind FROM produced p WHERE NOT echo),
 touch AS (SELECT f.project_id, f.id, e.at, e.w FROM edits e JOIN facts f USING (id)
   UNION ALL SELECT f.project_id, f.id, f.created_at + INTERVAL 2 DAY, 1.0 FROM facts f JOIN labels b ON b.doc_id = f.id WHERE quality = 1 AND toxic = 0
   UNION ALL SELECT project_id, id, created_at, 2.0 FROM facts WHERE id NOT IN (SELECT id FROM edits WHERE kind = 'PRODUCED_LEARNING')),
 seed AS (SELECT project_id, id, sum(w * pow(0.9, (SELECT count(*) FROM starts s WHERE s.project_id = t.project_id AND s.created_at > t.at))) AS bias FROM touch t GROUP BY 1, 2)
"""
GRAPH_SQL = f"""
 origin AS (SELECT f.id, max_by(t.ancestor, t.depth) AS root FROM facts f JOIN tree t ON t.node = f.session_id GROUP BY f.id),
 members AS (SELECT s.project_id, s.skill_id, d.learning_id AS id FROM skill s JOIN derived_from d USING (skill_id) JOIN facts f ON f.id = d.learning_id WHERE s.status = 'approved'),
 grp AS (SELECT f.project_id, 'r' || o.root AS g, f.id FROM facts f JOIN origin o USING (id)
   UNION ALL SELECT f.project_id, 's' || m.skill_id, f.id FROM members m JOIN facts f ON f.id = m.id
   UNION ALL SELECT project_id, 'e' || error_signature, id FROM facts WHERE kind = 'error' AND error_signature IS NOT NULL),
 sized AS (SELECT *, count(*) OVER (PARTITION BY project_id, g) AS n FROM grp),
 ge AS (SELECT a.project_id, a.id AS a, b.id AS b, 1.0::DOUBLE / (a.n - 1) AS w FROM sized a JOIN sized b ON a.project_id = b.project_id AND a.g = b.g AND a.id < b.id WHERE a.n BETWEEN 2 AND 50),
 knn AS (SELECT project_id, source, target FROM (SELECT a.project_id, a.id AS source, b.id AS target, {COS.format(a='a.embedding', b='b.embedding')} AS cos FROM facts a JOIN facts b ON a.project_id = b.project_id AND a.id <> b.id) p
   WHERE cos >= {FLOOR} QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(cos, 6) DESC, target) <= 5),
 se AS (SELECT DISTINCT project_id, least(source, target) AS a, greatest(source, target) AS b, 0.5::DOUBLE AS w FROM knn),
 gedge AS (SELECT project_id, a, b, sum(w) AS w FROM (SELECT * FROM ge UNION ALL SELECT * FROM se) x GROUP BY 1, 2, 3)
"""
ROUNDS, SETTLED = params.MAX_ITERATIONS, params.TOLERANCE
PPR_SQL = f"""
 restart AS (SELECT f.project_id, f.id AS node, coalesce(s.bias / sum(s.bias) OVER (PARTITION BY f.project_id), 0) AS r FROM facts f LEFT JOIN seed s ON s.id = f.id),
 dir AS (SELECT project_id, a, b, w FROM gedge UNION ALL SELECT project_id, b, a, w FROM gedge),
 step AS (SELECT d.project_id, d.a, d.b, d.w / sum(d.w) OVER (PARTITION BY d.project_id, d.a) AS p FROM dir d),
 ppr AS (SELECT node, 0 AS it, r AS score FROM restart
   UNION ALL SELECT node, max(it) + 1, sum(add) FROM (
     SELECT r.node, p.it, 0.5::DOUBLE * r.r AS add FROM restart r JOIN ppr p ON p.node = r.node
     UNION ALL SELECT s.b, p.it, 0.5::DOUBLE * p.score * s.p FROM ppr p JOIN step s ON s.a = p.node) u WHERE it < {ROUNDS} GROUP BY node),
 moved AS (SELECT f.project_id, p.it, sum(abs(p.score - q.score)) AS d FROM ppr p JOIN ppr q ON q.node = p.node AND q.it = p.it - 1 JOIN facts f ON f.id = p.node GROUP BY 1, 2),
 ends AS (SELECT project_id, coalesce(min(it) FILTER (WHERE d < {SETTLED}), {ROUNDS}) AS it FROM moved GROUP BY 1),
 rank AS (SELECT f.project_id, p.node, p.score FROM ppr p JOIN facts f ON f.id = p.node JOIN ends e ON e.project_id = f.project_id AND e.it = p.it),
 sal AS (SELECT project_id, node, round(score / max(score) OVER (PARTITION BY project_id), 6) AS salience FROM rank)
"""
USES = "session learning produced skill derived_from"
ALL_SQL = f"{TREE_SQL}, {FACTS_SQL}, {SEEDS_SQL}, {GRAPH_SQL}"


def _restated(t: Tables):
    """Labelled facts of good quality were said again two days on; the toxic ones as an echo."""
    return t.labels.filter("quality = 1").join(t.learning.select(F.col("id").alias("doc_id"), "created_at"), "doc_id").select(
        F.col("doc_id").alias("learning_id"), (F.col("created_at") + F.expr("INTERVAL 2 DAYS")).alias("at"), (F.col("toxic") == 1).alias("echo")
    )


def _pass(t: Tables):
    return salience_pass(t.learning, t.session, t.produced, _restated(t), t.skill, t.derived_from, floor=FLOOR)


@query("seed_weights", rows="A1", uses=USES, oracle=f"WITH {FACTS_SQL}, {SEEDS_SQL} SELECT project_id, id, round(bias, 6) AS bias FROM seed")
def seed_weights(t: Tables):
    facts = t.learning.filter("status = 'approved' AND scope = 'project'")
    starts = t.session.filter("parent_session_id IS NULL").select("project_id", "created_at")
    return graph.seed_weights(facts, t.produced, _restated(t), starts).select("project_id", "id", r6("bias"))


# The graph itself has the edges of groups of every size; the salience passes leave out those beyond 50.
WHOLE_SQL = ALL_SQL.replace("a.n BETWEEN 2 AND 50", "a.n >= 2")


@query("relatedness_graph", rows="G1 G2 G3 U3", uses=USES, recursive=True, oracle=f"WITH {WHOLE_SQL} SELECT project_id, a, b, round(w, 6) AS w FROM gedge")
def relatedness_graph(t: Tables):
    return related_facts(t.learning, t.session, t.skill, t.derived_from, FLOOR, None)[0].select("project_id", "a", "b", r6("w"))


@query("learning_salience", rows="G4 G5 G8", uses=USES, recursive=True, oracle=f"WITH {ALL_SQL}, {PPR_SQL} SELECT project_id, node, salience FROM sal")
def learning_salience(t: Tables):
    return _pass(t)["learning"].select("project_id", "node", "salience")


@query("skill_salience", rows="A13 G8", uses=USES, recursive=True, oracle=f"""WITH {ALL_SQL}, {PPR_SQL},
 tot AS (SELECT m.project_id, m.skill_id, sum(s.salience) AS score FROM members m JOIN sal s ON s.node = m.id GROUP BY 1, 2)
SELECT project_id, skill_id, round(CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 0 END, 6) AS salience FROM tot WINDOW w AS (PARTITION BY project_id)""")
def skill_salience(t: Tables):
    return _pass(t)["skill"].select("project_id", "skill_id", "salience")


PRUNED_SQL = f"""{EDGES_SQL},
 ends AS (SELECT *, source AS e FROM edge UNION ALL SELECT *, target FROM edge),
 pruned AS (SELECT DISTINCT project_id, source, target, similarity FROM (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY project_id, e ORDER BY round(similarity, 6) DESC, source, target) <= {{k}}) x)
"""
COMP_SQL = """
 both_ways AS (SELECT source AS u, target AS v FROM pruned UNION SELECT target, source FROM pruned),
 reach AS (SELECT u, u AS v FROM both_ways UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON b.u = r.v),
 comp AS (SELECT u AS node, min(v) AS root FROM reach GROUP BY u)
"""


@query("pruned_edges", rows="W4", uses="pattern", oracle=f"WITH {PRUNED_SQL.format(k=2)} SELECT project_id, source, target FROM pruned")
def pruned_edges(t: Tables):
    return graph.prune_edges(recall.pattern_edges(t.pattern, FLOOR, per_end=2), 2).select("project_id", "source", "target")


@query("pattern_components", rows="G6 G7", uses="pattern", recursive=True, oracle=f"""WITH {PRUNED_SQL.format(k=1)}, {COMP_SQL}
SELECT p.project_id, c.node, c.root, dense_rank() OVER (PARTITION BY p.project_id ORDER BY c.root) - 1 AS community FROM comp c JOIN pattern p ON p.id = c.node""")
def pattern_components(t: Tables):
    edges = graph.prune_edges(recall.pattern_edges(t.pattern, FLOOR, per_end=1), 1)
    return graph.component_index(graph.connected_components(edges)).select("project_id", "node", "root", n("community"))


VOTES_SQL = "".join(
    f""",
 v{i} AS (SELECT node, min_by(label, (-w, label)) AS label FROM (SELECT e.u AS node, l.label, round(sum(e.similarity), 6) AS w FROM sym e JOIN v{i - 1} l ON l.node = e.v GROUP BY 1, 2) x GROUP BY node)"""
    for i in range(1, 4)
)


@query("pattern_communities_by_vote", rows="G7", uses="pattern", oracle=f"""WITH {EDGES_SQL},
 sym AS (SELECT source AS u, target AS v, similarity FROM edge UNION ALL SELECT target, source, similarity FROM edge),
 v0 AS (SELECT DISTINCT u AS node, u AS label FROM sym){VOTES_SQL}
SELECT node, label FROM v3""")
def pattern_communities_by_vote(t: Tables):
    return graph.vote_by_products(t.pattern.filter("status = 'active'"), FLOOR, 3).select("node", "label")


BATCH_SQL = f"""{PRUNED_SQL.format(k=10)}, {COMP_SQL},
 mem AS (SELECT p.project_id, c.node, c.root, p.reviewed, p.learning_count FROM comp c JOIN pattern p ON p.id = c.node),
 deg AS (SELECT node, sum(similarity) AS degree FROM (SELECT source AS node, similarity FROM pruned UNION ALL SELECT target, similarity FROM pruned) d GROUP BY 1),
 ok AS (SELECT root FROM mem GROUP BY root HAVING count(*) >= 2 AND bool_or(NOT reviewed)),
 shown AS (SELECT m.*, row_number() OVER (PARTITION BY project_id, root ORDER BY reviewed, round(coalesce(degree, 0), 6) DESC, m.node) AS position FROM mem m JOIN ok USING (root) LEFT JOIN deg USING (node) QUALIFY position <= 20),
 comm AS (SELECT project_id, root, count(*) FILTER (WHERE NOT reviewed) AS un, sum(learning_count) AS ln, min(node) AS mn FROM shown GROUP BY 1, 2),
 chosen AS (SELECT project_id, root, row_number() OVER (PARTITION BY project_id ORDER BY un DESC, ln DESC, mn) AS batch FROM comm QUALIFY batch <= 10)
"""


@query("review_batches", rows="W5 G9", uses="pattern", recursive=True, oracle=f"""WITH {BATCH_SQL}
SELECT s.project_id, c.batch, s.position, s.node FROM shown s JOIN chosen c USING (project_id, root)""")
def review_batches(t: Tables):
    return review_pass(t.pattern.filter("status = 'active'"), FLOOR)["batches"].select("project_id", n("batch"), n("position"), "node")


@query("reviewed_after_pass", rows="G9", uses="pattern", recursive=True, oracle=f"""WITH {BATCH_SQL}
SELECT s.node AS id FROM shown s JOIN chosen c USING (project_id, root)
UNION SELECT id FROM pattern WHERE status = 'active' AND NOT reviewed AND id NOT IN (SELECT node FROM comp)""")
def reviewed_after_pass(t: Tables):
    return review_pass(t.pattern.filter("status = 'active'"), FLOOR)["marked"].select("id")


LOOKUP_SQL = """
 chain AS (SELECT id, merged_into AS at, 1 AS d FROM pattern WHERE status = 'merged'
   UNION ALL SELECT c.id, p.merged_into, c.d + 1 FROM chain c JOIN pattern p ON p.id = c.at WHERE p.status = 'merged' AND c.d < 200),
 lab AS (SELECT project_id, normalized AS label, 0 AS tier, id AS who, id AS pattern_id FROM pattern WHERE status = 'active'
   UNION ALL SELECT project_id, label, 0, id, id FROM pattern_alias
   UNION ALL SELECT m.project_id, m.normalized, 1, m.id, p.id FROM chain c JOIN pattern m ON m.id = c.id JOIN pattern p ON p.id = c.at AND p.status = 'active'),
 lookup AS (SELECT project_id, label, min_by(pattern_id, (tier, who)) AS pattern_id FROM lab GROUP BY 1, 2)
"""


@query("label_lookup", rows="J11", uses="pattern pattern_alias", recursive=True, oracle=f"WITH {LOOKUP_SQL} SELECT project_id, label, pattern_id FROM lookup")
def label_lookup(t: Tables):
    return patterns.label_lookup(t.pattern, t.pattern_alias).select("project_id", "label", "pattern_id")


TAG_SQL = """
 todo AS (SELECT id, project_id, session_id, task_pattern AS raw, trim(regexp_replace(lower(task_pattern), '[^a-z0-9]+', ' ', 'g')) AS label FROM learning WHERE id NOT IN (SELECT learning_id FROM tagged)),
 look AS (SELECT project_id, 'task ' || label AS label, min(id) AS pattern_id FROM pattern WHERE status = 'active' AND label % 2 = 1 GROUP BY ALL),
 put AS (SELECT t.*, coalesce(CAST(l.pattern_id AS VARCHAR), 'taskpattern:' || t.project_id || ':' || substr(sha1(t.project_id || chr(10) || t.label), 1, 16)) AS pattern_id FROM todo t LEFT JOIN look l ON l.project_id = t.project_id AND l.label = t.label)
"""


def _tagging(t: Tables):
    look = t.pattern.filter("status = 'active' AND label % 2 = 1").groupBy(
        "project_id", F.concat(F.lit("task "), F.col("label").cast("string")).alias("label")
    ).agg(F.min("id").alias("pattern_id"))
    return patterns.tag(t.learning, t.tagged, look)


@query("tag_learnings", rows="G11", uses="learning pattern tagged", oracle=f"WITH {TAG_SQL} SELECT id AS learning_id, pattern_id FROM put")
def tag_learnings(t: Tables):
    return _tagging(t)["tags"]


@query("pattern_sessions", rows="G11", uses="learning pattern tagged", oracle=f"""WITH {TAG_SQL}
SELECT DISTINCT pattern_id, session_id FROM (SELECT pattern_id, session_id FROM put UNION ALL SELECT CAST(pattern_id AS VARCHAR), session_id FROM tagged) x""")
def pattern_sessions(t: Tables):
    return _tagging(t)["links"]


PROFILE_SQL = """
 feeds AS (SELECT DISTINCT t.pattern_id, s.slug FROM tagged t JOIN derived_from d USING (learning_id) JOIN skill s ON s.skill_id = d.skill_id WHERE s.status = 'approved')
"""


@query("pattern_profiles", rows="A12", uses="pattern tagged skill derived_from", oracle=f"""WITH {PROFILE_SQL},
 top AS (SELECT pattern_id, learning_id, row_number() OVER (PARTITION BY pattern_id ORDER BY confidence DESC, learning_id) AS r FROM tagged)
SELECT p.id, (SELECT count(*) FROM tagged t WHERE t.pattern_id = p.id) AS learning_count,
 (SELECT string_agg(CAST(learning_id AS VARCHAR), ',' ORDER BY r) FROM top WHERE top.pattern_id = p.id AND r <= 2) AS samples,
 (SELECT string_agg(slug, ',' ORDER BY slug) FROM feeds f WHERE f.pattern_id = p.id) AS skill_slugs FROM pattern p WHERE p.status = 'active'""")
def pattern_profiles(t: Tables):
    rows = patterns.pattern_profiles(t.pattern.drop("learning_count"), t.tagged, t.skill, t.derived_from)
    return rows.select("id", "learning_count", F.array_join("samples", ",").alias("samples"), F.array_join("skill_slugs", ",").alias("skill_slugs"))


@query("merge_reply_check", rows="P16", uses="pattern merge_member merge_decision", oracle="""
WITH bad AS (SELECT reply_id, merge, 1 AS rule FROM merge_member WHERE label = 'X'
 UNION ALL SELECT reply_id, merge, 2 FROM merge_member GROUP BY 1, 2 HAVING count(DISTINCT label) < 2
 UNION ALL SELECT a.reply_id, a.merge, 3 FROM merge_member a JOIN merge_member b ON a.reply_id = b.reply_id AND a.label = b.label AND b.merge < a.merge
 UNION ALL SELECT d.reply_id, d.merge, 4 FROM merge_decision d WHERE NOT EXISTS (SELECT 1 FROM merge_member m WHERE m.reply_id = d.reply_id AND m.merge = d.merge AND m.label = d.canonical)),
 w AS (SELECT reply_id, min_by(rule, (merge, rule)) AS rule FROM bad GROUP BY 1)
SELECT d.reply_id, CASE w.rule WHEN 1 THEN 'unknown label' WHEN 2 THEN 'a merge needs at least two distinct members' WHEN 3 THEN 'label appears in more than one merge'
 WHEN 4 THEN 'canonical is not one of its members' END AS reason FROM (SELECT DISTINCT reply_id FROM merge_decision) d LEFT JOIN w USING (reply_id)""")
def merge_reply_check(t: Tables):
    labels = t.pattern.select(F.floor(F.col("id") / 12).cast("long").alias("reply_id"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("label"))
    return patterns.check_merges(t.merge_member.select("reply_id", "merge", "label"), t.merge_decision, labels)


@query("merge_skill_guard", rows="J19", uses="pattern accepted_merge tagged skill derived_from", oracle=f"""WITH {PROFILE_SQL},
 mm AS (SELECT target AS merge_id, source AS pattern_id FROM accepted_merge UNION SELECT target, target FROM accepted_merge)
SELECT merge_id, count(DISTINCT slug) AS skills, count(DISTINCT slug) > 1 AS refused FROM mm LEFT JOIN feeds USING (pattern_id) GROUP BY 1""")
def merge_skill_guard(t: Tables):
    feeds = t.tagged.join(t.derived_from, "learning_id").join(t.skill.filter("status = 'approved'"), "skill_id").select("pattern_id", "slug").distinct()
    merged = t.accepted_merge
    members = merged.select(F.col("target").alias("merge_id"), F.col("source").alias("pattern_id")).unionByName(
        merged.select(F.col("target").alias("merge_id"), F.col("target").alias("pattern_id"))
    ).distinct()
    return patterns.guard_skills(members, feeds)


def _applied(t: Tables):
    tags = t.tagged.select("learning_id", "pattern_id")
    links = t.tagged.select("pattern_id", "session_id").distinct()
    aliases = t.pattern_alias.select("id", "label")
    return patterns.apply_merges(t.accepted_merge, t.pattern, tags, links, aliases, F.lit("2024-03-01").cast("timestamp"), t.learning)


@query("merged_labels", rows="G10", uses="learning pattern accepted_merge tagged", oracle="""
WITH moved AS (SELECT t.learning_id, min_by(p.text, m.target) AS label FROM tagged t JOIN accepted_merge m ON m.source = t.pattern_id JOIN pattern p ON p.id = m.target GROUP BY 1)
SELECT l.id, coalesce(m.label, l.task_pattern) AS task_pattern FROM learning l LEFT JOIN moved m ON m.learning_id = l.id""")
def merged_labels(t: Tables):
    return _applied(t)["learning"].select("id", "task_pattern")


@query("merged_tags", rows="G10", uses="accepted_merge tagged", oracle="""
SELECT DISTINCT t.learning_id, coalesce(m.target, t.pattern_id) AS pattern_id FROM tagged t LEFT JOIN accepted_merge m ON m.source = t.pattern_id""")
def merged_tags(t: Tables):
    return _applied(t)["tags"]


@query("merged_patterns", rows="G10", uses="pattern accepted_merge", oracle="""
SELECT p.id, CASE WHEN m.target IS NOT NULL THEN 'merged' WHEN p.id IN (SELECT target FROM accepted_merge) THEN 'active' ELSE p.status END AS status,
 coalesce(m.target, p.merged_into) AS merged_into FROM pattern p LEFT JOIN accepted_merge m ON m.source = p.id""")
def merged_patterns(t: Tables):
    return _applied(t)["patterns"].select("id", "status", "merged_into")


@query("merged_aliases", rows="U4", uses="pattern accepted_merge pattern_alias", oracle="""
WITH every AS (SELECT a.id, 0 AS src, 0 AS part, a.label FROM pattern_alias a WHERE a.id IN (SELECT target FROM accepted_merge)
 UNION ALL SELECT m.target, m.pos, 1, p.normalized FROM accepted_merge m JOIN pattern p ON p.id = m.source
 UNION ALL SELECT m.target, m.pos, 2, a.label FROM accepted_merge m JOIN pattern_alias a ON a.id = m.source),
 firsts AS (SELECT e.id, e.label, min((src, part)) AS at FROM every e JOIN pattern p ON p.id = e.id WHERE e.label <> p.normalized GROUP BY 1, 2)
SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY f.at, label) AS position FROM firsts f""")
def merged_aliases(t: Tables):
    return _applied(t)["aliases"].select("id", "label", n("position"))
