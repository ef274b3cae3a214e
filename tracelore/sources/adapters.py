"""Views that give the warehouse tables the shapes of the memory model.

The text below is plain SQL that Spark and any ANSI engine read alike, so the
same definition feeds a job and its check. ``<name>`` marks a base table or
another view. Every view covers its whole tables. About a third of the sessions,
and with them a third of the learnings, fall into project 0: skew is part of the
test data, not an afterthought.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from tracelore.sources.tables import TABLES, read_table

_TREE = "CAST(floor({x} / {n}) AS BIGINT)"


def _project(expr: str, per_tree: int) -> str:
    tree = _TREE.format(x=expr, n=per_tree)
    return f"CASE WHEN {tree} % 3 = 0 THEN 0 ELSE 1 + CAST(floor({tree} / 4) AS BIGINT) END"


_EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"
_HOUR = "INTERVAL '1' HOUR"
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"


def _json(*pairs: tuple[str, str]) -> str:
    """A JSON object literal as SQL: keys in the given order, values are SQL text
    already rendered as JSON."""
    body = " || ', ' || ".join(f"'\"{k}\": ' || {v}" for k, v in pairs)
    return f"(chr(123) || {body} || chr(125))"


def _quoted(expr: str) -> str:
    return f"('\"' || {expr} || '\"')"


VIEWS: dict[str, str] = {
    # --- sessions and events -------------------------------------------------
    "session": f"""
        SELECT conv_id AS session_id,
               CASE WHEN conv_id % 3 > 0 THEN conv_id - 1 END AS parent_session_id,
               {_project('conv_id', 3)} AS project_id,
               conv_id % 10 AS user_id,
               {_EPOCH} + conv_id * {_HOUR} AS created_at
        FROM (SELECT DISTINCT conv_id FROM <conversations>) c""",
    "session_event": f"""
        SELECT event_id,
               user_id AS session_id,
               {_project('user_id', 3)} AS project_id,
               user_id % 10 AS user_id,
               ts,
               CASE event_type WHEN 'view' THEN 'PreToolUse' WHEN 'click' THEN 'PostToolUse'
                    WHEN 'error' THEN 'PostToolUse' WHEN 'purchase' THEN 'Stop'
                    ELSE 'UserPromptSubmit' END AS event_name,
               CASE WHEN event_type IN ('view', 'click', 'error') THEN
                    CASE k % 5 WHEN 0 THEN 'Bash' WHEN 1 THEN 'Edit'
                         WHEN 2 THEN 'mcp__memory__project_get_context'
                         WHEN 3 THEN 'mcp__memory__project_add_learning' ELSE 'Write' END
               END AS tool_name,
               CASE WHEN event_type IN ('view', 'click', 'error') THEN
                    CASE WHEN k % 5 = 0 THEN
                        {_json(('command', _quoted("'cat src/part' || CAST(k % 10 AS STRING) || '.py --verbose notes.md'")))}
                    WHEN k % 5 = 2 THEN
                        {_json(('query', _quoted("'match items of kind ' || CAST(k % 10 AS STRING)")))}
                    ELSE
                        {_json(('path', _quoted("'src/part' || CAST(k % 10 AS STRING) || '.py'")), ('url', _quoted("'http://h/' || CAST(k % 10 AS STRING)")))}
                    END
               END AS tool_input,
               CAST(NULL AS STRING) AS tool_use_id,
               CASE WHEN k % 2 = 0 THEN 't' || CAST(CAST(floor(event_id / 500) AS BIGINT) AS STRING) END AS turn_id,
               CASE WHEN event_type = 'signup' THEN
                    CASE k % 7 WHEN 0 THEN '<task-notification> job ' || CAST(k AS STRING) || ' ended'
                         WHEN 1 THEN '  <agent-message from="x"> report ' || CAST(k AS STRING)
                         WHEN 2 THEN '<unknown-tag> look at ' || CAST(k AS STRING)
                         ELSE 'please fix part ' || CAST(k AS STRING) END
               END AS prompt,
               CASE WHEN event_type = 'purchase' THEN 'done with step ' || CAST(k AS STRING) END AS last_assistant_message,
               CASE WHEN event_type = 'click' THEN
                    CASE WHEN k % 3 = 0 THEN 'Process exited with code 0'
                         ELSE {_json(('content', "('[' || " + _json(('type', _quoted("'text'")), ('text', _quoted("'ok ' || CAST(k AS STRING)"))) + " || ']')"), ('isError', "'false'"))} END
                    WHEN event_type = 'error' THEN
                    {_json(('content', "('[' || " + _json(('type', _quoted("'text'")), ('text', _quoted("CASE WHEN k % 6 = 0 THEN 'connection refused by host ' || CAST(k AS STRING) WHEN k % 6 = 1 THEN 'Request timed out' ELSE 'syntax error near token ' || CAST(k % 13 AS STRING) END"))) + " || ']')"), ('isError', "'true'"))}
               END AS tool_response,
               event_type = 'error' AS tool_error,
               (event_type = 'error' AND k % 17 = 0) AS is_interrupt,
               k
        FROM (SELECT event_id, ts, user_id, event_type, value, {_K} AS k FROM <events>) x""",
    "raw_payload": f"""
        SELECT event_id,
               {_json(
                   ('session_id', _quoted("'s' || CAST(session_id AS STRING)")),
                   ('hook_event_name', _quoted("CASE WHEN tool_error THEN 'PostToolUseFailure' ELSE event_name END")),
                   ('tool_name', "CASE WHEN tool_name IS NULL THEN 'null' ELSE '\"' || tool_name || '\"' END"),
                   ('tool_input', "CASE WHEN tool_input IS NULL THEN 'null' ELSE tool_input END"),
                   ('prompt', "CASE WHEN prompt IS NULL THEN 'null' ELSE '\"' || replace(prompt, '\"', '') || '\"' END"),
                   ('last_assistant_message', "CASE WHEN last_assistant_message IS NULL THEN 'null' ELSE '\"' || last_assistant_message || '\"' END"),
                   ('error', "CASE WHEN tool_error THEN '\"failure ' || CAST(k AS STRING) || '\"' ELSE 'null' END"),
                   ('is_interrupt', "CASE WHEN is_interrupt THEN 'true' ELSE 'false' END"),
                   ('agent_id', "CASE WHEN k % 9 = 0 THEN '\"sub' || CAST(k AS STRING) || '\"' ELSE 'null' END"),
                   ('turn', "CAST(k AS STRING)"),
               )} AS payload,
               ts AS received_at, session_id, event_name, tool_error, is_interrupt, k, tool_name, tool_input,
               replace(prompt, '"', '') AS prompt, last_assistant_message
        FROM <session_event>""",
    "injection": """
        SELECT e.event_id AS injection_id, e.session_id, e.event_id * 7 % 400 AS learning_id,
               e.ts + (e.k - 20) * INTERVAL '1' SECOND AS injected_at,
               'UserPromptSubmit' AS hook_event,
               CASE WHEN e.k % 2 = 0 THEN e.prompt END AS prompt
        FROM <session_event> e WHERE e.event_name = 'UserPromptSubmit'""",
    # --- memory --------------------------------------------------------------
    "learning": f"""
        SELECT d.doc_id AS id,
               {_project('d.doc_id', 24)} AS project_id,
               CASE WHEN d.doc_id % 5 = 0 THEN 'user' ELSE 'project' END AS scope,
               CAST(floor(d.doc_id / 8) AS BIGINT) % 10 AS user_id,
               CAST(floor(d.doc_id / 8) AS BIGINT) AS session_id,
               CASE d.doc_id % 7 WHEN 0 THEN 'candidate' WHEN 1 THEN 'rejected' ELSE 'approved' END AS status,
               d.doc_id % 11 = 0 AS consolidated,
               CAST(d.doc_id % 100 AS DOUBLE) / 100 AS confidence,
               CASE WHEN e.label < 2 THEN 'error' ELSE 'fact' END AS kind,
               CASE WHEN e.label = 0 THEN 'Bash' WHEN e.label = 1 THEN 'Edit' END AS tool_key,
               CASE WHEN e.label < 2 THEN 'E' || CAST(e.label AS STRING) || '-' || d.lang END AS error_signature,
               CASE WHEN e.label < 2 THEN d.doc_id % 2 = 0 END AS resolved,
               'Task ' || CAST(e.label AS STRING) AS task_pattern,
               e.label AS label, d.lang AS lang,
               d.doc_id % 6 AS support_count,
               {_EPOCH} + d.doc_id * {_HOUR} AS created_at,
               {_EPOCH} + (d.doc_id + d.doc_id % 50) * {_HOUR} AS updated_at,
               CASE WHEN d.doc_id % 4 = 3 THEN {_EPOCH} + (d.doc_id + 20) * {_HOUR} END AS consolidated_at,
               CASE WHEN d.doc_id % 24 = 3 THEN {_EPOCH} + (d.doc_id + 60) * {_HOUR} END AS unfolded_at,
               d.text AS text, e.embedding AS embedding
        FROM <embeddings> e JOIN <documents> d ON d.doc_id = e.vec_id""",
    "request": """
        SELECT id AS request_id, project_id, user_id, session_id, text AS query, embedding AS vector
        FROM <learning>""",
    "injected_in": f"""
        SELECT l.id AS learning_id, s.session_id,
               s.created_at + {_HOUR} AS first_injected_at
        FROM (SELECT id, session_id + 1 AS sid FROM <learning>
              UNION ALL SELECT id, session_id - 2 AS sid FROM <learning>) l
        JOIN <session> s ON s.session_id = l.sid""",
    "salience_state": """
        SELECT id, CAST(id % 17 AS DOUBLE) / 17 AS salience FROM <learning>""",
    "derived_from": """
        SELECT project_id * 100 + label AS skill_id, id AS learning_id, created_at
        FROM <learning> WHERE scope = 'project' AND status <> 'candidate' AND lang IN ('en', 'fr')""",
    "skill": """
        SELECT project_id * 100 + label AS skill_id,
               'skill-' || CAST(project_id AS STRING) || '-' || CAST(label AS STRING) AS slug,
               project_id,
               'Skill ' || CAST(label AS STRING) AS name,
               'how to do task ' || CAST(label AS STRING) AS description,
               CASE WHEN label % 3 > 0 THEN 'approved' ELSE 'candidate' END AS status,
               label % 5 = 1 AS needs_revision,
               CAST(label % 7 AS DOUBLE) / 7 AS salience,
               min_by(text, id) AS content,
               min_by(embedding, id) AS embedding,
               min(created_at) AS created_at, max(updated_at) AS updated_at, label
        FROM <learning> WHERE scope = 'project' AND status <> 'candidate' AND lang IN ('en', 'fr')
        GROUP BY project_id, label""",
    "skill_version": """
        SELECT skill_id * 10 + 1 AS version_id, skill_id, project_id, 1 AS version,
               CASE WHEN status = 'candidate' THEN 'create' ELSE 'update' END AS proposal_action,
               CASE label % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'accepted' WHEN 2 THEN 'rejected' ELSE 'blocked' END AS outcome,
               CASE WHEN label % 8 = 0 THEN 'passed' END AS safety_status,
               'fp' || CAST(skill_id AS STRING) AS fingerprint, updated_at AS decided_at, created_at, label
        FROM <skill>
        UNION ALL
        SELECT skill_id * 10 + 2 AS version_id, skill_id, project_id, 2 AS version, 'update' AS proposal_action,
               CASE label % 2 WHEN 0 THEN 'pending' ELSE 'rejected' END AS outcome,
               CAST(NULL AS STRING) AS safety_status,
               'fp' || CAST(skill_id % 7 AS STRING) AS fingerprint, updated_at AS decided_at, updated_at AS created_at, label
        FROM <skill> WHERE status = 'approved'""",
    "version_source": """
        SELECT v.version_id, l.id AS learning_id
        FROM <skill_version> v JOIN <learning> l
          ON l.project_id = v.project_id AND l.label = v.label AND l.lang = 'de' AND l.scope = 'project'""",
    "observation": f"""
        SELECT s.session_id AS id, s.project_id, s.session_id, s.user_id,
               CASE s.session_id % 4 WHEN 0 THEN 'bugfix' WHEN 1 THEN 'feature' ELSE 'change' END AS type,
               min_by(c.text, c.turn) FILTER (WHERE c.role = 'user') AS title,
               max_by(c.text, c.turn) FILTER (WHERE c.role = 'assistant') AS narrative,
               min(s.created_at) AS started_at, min(s.created_at) + INTERVAL '30' MINUTE AS ended_at,
               CASE WHEN s.session_id % 5 <> 4 THEN min_by(e.embedding, e.vec_id) END AS embedding
        FROM <session> s JOIN <conversations> c ON c.conv_id = s.session_id LEFT JOIN <embeddings> e ON e.vec_id = s.session_id
        GROUP BY s.session_id, s.project_id, s.user_id""",
    "pattern": f"""
        SELECT vec_id AS id, {_project('vec_id', 24)} AS project_id,
               'pattern ' || CAST(vec_id % 300 AS STRING) AS text,
               'pattern ' || CAST(vec_id % 300 AS STRING) AS normalized,
               CASE WHEN vec_id % 10 = 3 THEN 'merged' ELSE 'active' END AS status,
               CASE WHEN vec_id % 10 = 3 THEN vec_id - CASE WHEN vec_id % 3 = 0 THEN 10 ELSE 1 END END AS merged_into,
               vec_id % 4 = 1 AS reviewed,
               vec_id % 7 AS learning_count,
               embedding, label
        FROM <embeddings>""",
    "pattern_alias": """
        SELECT id, project_id, 'alias ' || CAST(id % 200 AS STRING) AS label FROM <pattern> WHERE status = 'active' AND id % 3 = 0""",
    "merge_member": """
        SELECT CAST(floor(id / 12) AS BIGINT) AS reply_id, CAST(floor(id / 3) AS BIGINT) % 4 AS merge,
               CASE WHEN id % 29 = 0 THEN 'X' ELSE 'P' || CAST(id AS STRING) END AS label, id
        FROM <pattern>
        UNION ALL
        SELECT CAST(floor(id / 12) AS BIGINT) AS reply_id, 3 AS merge, 'P' || CAST(id AS STRING) AS label, id
        FROM <pattern> WHERE label = 7""",
    "merge_decision": """
        SELECT reply_id, merge, CASE WHEN max(id) % 11 = 0 THEN 'Z' ELSE 'P' || CAST(min(id) AS STRING) END AS canonical
        FROM <merge_member> GROUP BY reply_id, merge""",
    "accepted_merge": """
        SELECT m.target, p.id AS source, p.id - m.target AS pos
        FROM (SELECT CAST(floor(id / 3) AS BIGINT) AS g, min(id) AS target FROM <pattern> WHERE label < 5 GROUP BY CAST(floor(id / 3) AS BIGINT)) m
        JOIN <pattern> p ON CAST(floor(p.id / 3) AS BIGINT) = m.g AND p.id <> m.target AND p.label < 5""",
    "tagged": """
        SELECT id AS learning_id, id - id % 4 AS pattern_id, confidence, session_id FROM <learning> WHERE label <> 3""",
    "neighbour": """
        SELECT c.id AS candidate_id, l.id AS existing_id, (c.id + l.id) % 4 AS w
        FROM <learning> c JOIN <learning> l
          ON l.project_id = c.project_id AND l.scope = c.scope AND CAST(floor(l.id / 12) AS BIGINT) = CAST(floor(c.id / 12) AS BIGINT)
        WHERE c.status = 'candidate' AND l.status IN ('approved', 'candidate') AND l.id <> c.id""",
    "decision": """
        SELECT l.id, CASE l.id % 6 WHEN 0 THEN 'approve' WHEN 1 THEN 'keep_both' WHEN 2 THEN 'edit_approve' WHEN 3 THEN 'reject'
               WHEN 4 THEN 'keep_new' ELSE 'keep_existing' END AS action,
               'edited ' || CAST(l.id AS STRING) AS edited_text, CAST(NULL AS BIGINT) AS conflict_id
        FROM <learning> l JOIN <labels> b ON b.doc_id = l.id WHERE b.quality = 1""",
    "conflict": """
        SELECT a.id AS from_id, b.id AS to_id
        FROM <learning> a JOIN <learning> b ON CAST(floor(b.id / 3) AS BIGINT) = CAST(floor(a.id / 3) AS BIGINT) AND b.id > a.id
        WHERE a.status <> 'rejected'""",
    "gated": """
        SELECT l.id, l.project_id, l.scope, l.user_id, l.created_at, l.updated_at,
               CASE WHEN v.verdict = 'block' THEN 'blocked' ELSE l.status END AS status,
               CASE WHEN v.verdict = 'block' THEN l.updated_at END AS blocked_at,
               CASE WHEN v.verdict = 'block' THEN v.category || ': ' || v.reason END AS blocked_reason,
               CASE WHEN l.label = 6 THEN 'ambiguous_kept_both' ELSE 'clean' END AS consistency_status,
               CASE WHEN l.id % 2 = 0 THEN l.created_at END AS consistency_checked_at
        FROM <learning> l LEFT JOIN <safety_verdict> v ON v.candidate_id = l.id""",
    "profile": """
        SELECT user_id, count(*) AS version, 'profile of user ' || CAST(user_id AS STRING) || ' with facts' AS content,
               false AS needs_revision, max(created_at) AS last_run
        FROM <learning> WHERE scope = 'user' AND consolidated_at IS NOT NULL GROUP BY user_id""",
    "proposal": """
        SELECT skill_id AS proposal_id, skill_id, project_id, label, slug, status,
               CASE label % 10 WHEN 0 THEN 'ignore' WHEN 1 THEN 'bogus' ELSE CASE WHEN status = 'approved' THEN 'update' ELSE 'create' END END AS action,
               'fp' || CAST(skill_id AS STRING) AS fingerprint, created_at AS at
        FROM <skill>""",
    "ledger": """
        SELECT project_id, 'turn' AS mode, event_id
        FROM <session_event> WHERE ts < TIMESTAMP '2024-01-10 00:00:00'""",
    "produced": """
        SELECT id AS learning_id, session_id, 'PRODUCED_LEARNING' AS kind, created_at AS at, id % 9 = 4 AS echo
        FROM <learning> WHERE label <> 9
        UNION ALL
        SELECT id AS learning_id, session_id + 1 AS session_id, 'UPDATED_LEARNING' AS kind, updated_at AS at, id % 4 = 0 AS echo
        FROM <learning>""",
    "safety_verdict": """
        SELECT l.id AS candidate_id, CASE WHEN b.toxic = 1 THEN 'block' ELSE 'pass' END AS verdict,
               CASE WHEN b.quality = 1 THEN 'injection' ELSE 'secret' END AS category,
               'doc ' || CAST(l.id AS STRING) AS reason
        FROM <learning> l JOIN <labels> b ON b.doc_id = l.id""",
    # --- account star --------------------------------------------------------
    "account": """
        SELECT c.c_custkey AS account_id, c.c_name AS name,
               lower(replace(c.c_name, '#', '-')) || '.com' AS domain,
               n.n_name AS owner, r.r_name AS region,
               CASE c.c_custkey % 4 WHEN 0 THEN 'expanding' WHEN 1 THEN 'steady' WHEN 2 THEN 'new' ELSE 'at_risk' END AS trajectory,
               c.c_mktsegment AS industry,
               CASE WHEN c.c_acctbal > 5000 THEN 'strategic' WHEN c.c_acctbal > 0 THEN 'mid' ELSE 'smb' END AS size_class,
               30 + c.c_custkey * 7 % 70 AS health_score,
               c.c_custkey % 11 - 5 AS health_jitter,
               DATE '2001-08-01' + CAST(c.c_custkey % 365 AS INT) AS renewal_date
        FROM <customer> c JOIN <nation> n ON n.n_nationkey = c.c_nationkey
        JOIN <region> r ON r.r_regionkey = n.n_regionkey""",
    "product": """
        SELECT p_brand AS sku, min(p_type) AS category, min(p_retailprice) AS list_price,
               CASE WHEN count(*) % 2 = 0 THEN 'low' ELSE 'high' END AS tier
        FROM <part> GROUP BY p_brand""",
    "usage": """
        SELECT o.o_custkey AS account_id, p.p_brand AS sku,
               CAST(date_trunc('month', o.o_orderdate) AS DATE) AS month,
               sum(l.l_quantity) AS mau,
               round(sum(l.l_extendedprice * (1 - l.l_discount)), 4) AS monthly_revenue,
               CAST(10 + o.o_custkey % 40 AS DOUBLE) AS contracted_seats
        FROM <orders> o JOIN <lineitem> l ON l.l_orderkey = o.o_orderkey
        JOIN <part> p ON p.p_partkey = l.l_partkey
        GROUP BY o.o_custkey, p.p_brand, CAST(date_trunc('month', o.o_orderdate) AS DATE)""",
    "contact": """
        SELECT account_id * 10 + 1 AS contact_id, account_id, 'champion' AS role, 'c1@' || domain AS email FROM <account>
        UNION ALL
        SELECT account_id * 10 + 2 AS contact_id, account_id, 'economic_buyer' AS role, 'c2@' || domain AS email FROM <account>""",
    "renewal": """
        SELECT a.account_id, a.renewal_date, 12 * (1 + a.account_id % 3) AS term_months,
               a.account_id % 2 = 0 AS auto_renew
        FROM <account> a""",
    "attach_rule": """
        SELECT a.sku AS has_sku, min(b.sku) AS lacks_sku
        FROM <product> a JOIN <product> b ON b.category = a.category AND b.sku > a.sku GROUP BY a.sku""",
    "entity": """
        SELECT domain, CASE WHEN account_id % 5 = 0 THEN 'OTHER' ELSE industry END AS industry, region
        FROM <account> WHERE trajectory <> 'new'
        UNION ALL
        SELECT lower(replace(s_name, '#', '-')) || '.org' AS domain, 'SUPPLY' AS industry, CAST(NULL AS STRING) AS region FROM <supplier>""",
}

_REF = re.compile(r"<([a-z_]+)>")


def dependencies(name: str) -> list[str]:
    """Views ``name`` is built from, in definition order, ``name`` last."""
    order: list[str] = []

    def visit(view: str) -> None:
        if view in TABLES or view in order:
            return
        for ref in _REF.findall(VIEWS[view]):
            visit(ref)
        order.append(view)

    visit(name)
    return order


@lru_cache(maxsize=None)
def with_clause(names: tuple[str, ...]) -> str:
    """The CTE chain that defines ``names`` for a single-string SQL engine."""
    order: list[str] = []
    for name in names:
        for view in dependencies(name):
            if view not in order:
                order.append(view)
    return ",\n".join(f"{v} AS ({_REF.sub(lambda m: m.group(1), VIEWS[v])})" for v in order)


def stream_view(spark: SparkSession, source: DataFrame, base: str, name: str) -> DataFrame:
    """``name`` over a streaming ``source`` that stands for the base table ``base``."""
    if name == base:
        return source
    text = VIEWS[name]
    frames = {ref: stream_view(spark, source, base, ref) for ref in dict.fromkeys(_REF.findall(text))}
    return spark.sql(_REF.sub(lambda m: "{" + m.group(1) + "}", text), **frames)


def view(spark: SparkSession, folder: str, name: str, seen: dict[str, DataFrame] | None = None) -> DataFrame:
    """The view (or base table) ``name`` over the parquet tables in ``folder``. ``seen`` keeps
    what was already built, so a table's files are listed once."""
    seen = {} if seen is None else seen
    if name not in seen:
        if name in TABLES:
            seen[name] = read_table(spark, folder, name)
        else:
            text = VIEWS[name]
            frames = {ref: view(spark, folder, ref, seen) for ref in dict.fromkeys(_REF.findall(text))}
            seen[name] = spark.sql(_REF.sub(lambda m: "{" + m.group(1) + "}", text), **frames)
    return seen[name]
