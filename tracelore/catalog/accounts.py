"""Account star and loads."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelore.catalog.base import Tables, query
from tracelore.catalog.memory import now
from tracelore.catalog.recall import n, r6
from tracelore.operators import accounts as ac
from tracelore.session import work_dir
from tracelore.sources.tables import publish_snapshot, read_snapshot, refresh_partition, replace_table

LATEST_SQL = """
 latest AS (SELECT *, CASE WHEN contracted_seats <> 0 THEN round(mau / contracted_seats, 3) END AS utilization FROM usage u
   QUALIFY month = max(month) OVER (PARTITION BY account_id, sku))
"""
FINAL_SQL = f"""{LATEST_SQL},
 line AS (SELECT account_id, sum(monthly_revenue) AS mrr, sum(contracted_seats) AS seats, sum(round(utilization * 1000)) / count(utilization) / 1000 AS util FROM latest GROUP BY 1),
 final AS (SELECT a.account_id, a.owner, a.trajectory, round(coalesce(mrr, 0) * 12, 2) AS arr, coalesce(seats, 0) AS seats_total, round(coalesce(util, 0), 3) AS avg_utilization,
   CAST(floor(greatest(5.0, least(99.0, CASE trajectory WHEN 'expanding' THEN 84 WHEN 'steady' THEN 73 WHEN 'new' THEN 64 ELSE 38 END + (coalesce(util, 0) - 0.8) * 15 + health_jitter))) AS BIGINT) AS health_score
   FROM account a LEFT JOIN line USING (account_id))
"""


def as_of():
    return F.lit("2001-08-01").cast("date")


@query("latest_usage", rows="W9 Q10", uses="usage", oracle=f"WITH {LATEST_SQL} SELECT account_id, sku, month, mau, utilization, monthly_revenue FROM latest")
def latest_usage(t: Tables):
    return ac.usage_edges(t.usage).select("account_id", "sku", "month", "mau", "utilization", "monthly_revenue")


@query("finalized_accounts", rows="A17", uses="account usage", oracle=f"""WITH {FINAL_SQL}
SELECT account_id, round(arr, 1) AS arr, CASE WHEN arr < 100000 THEN '<100k' WHEN arr < 500000 THEN '100k-500k' WHEN arr < 1000000 THEN '500k-1m' WHEN arr < 5000000 THEN '1m-5m' ELSE '5m+' END AS arr_band,
 seats_total, avg_utilization, health_score FROM final""")
def finalized_accounts(t: Tables):
    return ac.finalize_accounts(t.account, t.usage).select("account_id", F.round("arr", 1).alias("arr"), "arr_band", "seats_total", "avg_utilization", "health_score")


@query("expansion", rows="Q1", uses="account usage", oracle=f"WITH {LATEST_SQL} SELECT l.account_id, l.sku, l.utilization, a.owner FROM latest l JOIN account a USING (account_id) WHERE utilization >= 1.0")
def expansion(t: Tables):
    return ac.expansion(t.usage, t.account).select("account_id", "sku", "utilization", "owner")


@query("renewal_risk", rows="Q2", uses="account usage", oracle=f"""WITH {LATEST_SQL},
 m AS (SELECT account_id, month, sum(mau) AS mau FROM usage GROUP BY 1, 2), s AS (SELECT account_id, regr_slope(mau, year(month) * 12 + month(month)) AS slope FROM m GROUP BY 1)
SELECT a.account_id, concat_ws('+', CASE WHEN trajectory = 'at_risk' THEN 'at_risk' END, CASE WHEN health_score < 50 THEN 'health' END, CASE WHEN slope < 0 THEN 'falling' END) AS reasons
FROM account a LEFT JOIN s USING (account_id) WHERE renewal_date - DATE '2001-08-01' BETWEEN 0 AND 90 AND (trajectory = 'at_risk' OR health_score < 50 OR slope < 0)""")
def renewal_risk(t: Tables):
    return ac.renewal_risk(t.account, t.usage, as_of()).select("account_id", "reasons")


@query("whitespace", rows="Q3", uses="account product usage", oracle="""
SELECT a.account_id, p.sku FROM account a CROSS JOIN product p WHERE NOT EXISTS (SELECT 1 FROM usage u WHERE u.account_id = a.account_id AND u.sku = p.sku)""")
def whitespace(t: Tables):
    return ac.whitespace(t.account, t.product, t.usage)


@query("attach_plays", rows="Q4", uses="usage attach_rule", oracle="""
WITH o AS (SELECT DISTINCT account_id, sku FROM usage) SELECT o.account_id, r.has_sku, r.lacks_sku FROM o JOIN attach_rule r ON r.has_sku = o.sku WHERE NOT EXISTS (SELECT 1 FROM o x WHERE x.account_id = o.account_id AND x.sku = r.lacks_sku)""")
def attach_plays(t: Tables):
    return ac.attach(t.usage, t.attach_rule).select("account_id", "has_sku", "lacks_sku")


@query("upgrade_plays", rows="Q4", uses="usage account product", oracle="""
SELECT DISTINCT u.account_id, u.sku FROM usage u JOIN account a USING (account_id) JOIN product p USING (sku) WHERE a.size_class = 'strategic' AND p.tier = 'low'""")
def upgrade_plays(t: Tables):
    return ac.upgrades(t.usage, t.account, t.product)


@query("book_of_business", rows="Q5", uses="account usage", oracle=f"""WITH {FINAL_SQL}
SELECT owner, count(*) AS accounts, round(sum(arr), 0) AS arr, round(avg(health_score), 6) AS health, count(*) FILTER (WHERE trajectory = 'at_risk') AS at_risk FROM final GROUP BY owner""")
def book_of_business(t: Tables):
    return ac.book_of_business(ac.finalize_accounts(t.account, t.usage)).select("owner", "accounts", F.round("arr", 0).alias("arr"), r6("health"), "at_risk")


@query("usage_trend", rows="Q6", uses="usage", oracle="SELECT account_id, sku, month, mau, mau - lag(mau) OVER (PARTITION BY account_id, sku ORDER BY month) AS change FROM usage")
def usage_trend(t: Tables):
    return ac.usage_trend(t.usage).select("account_id", "sku", "month", "mau", "change")


@query("renewals_due", rows="Q7", uses="renewal", oracle="SELECT account_id, renewal_date, term_months, auto_renew FROM renewal WHERE renewal_date - DATE '2001-08-01' BETWEEN 0 AND 60")
def renewals_due(t: Tables):
    return ac.renewals_due(t.renewal, as_of(), 60).select("account_id", "renewal_date", "term_months", "auto_renew")


@query("account_brief", rows="Q8", uses="account usage contact renewal", oracle=f"""WITH {LATEST_SQL},
 f AS (SELECT account_id, count(*) AS lines, sum(mau) AS mau, string_agg(sku, ',' ORDER BY sku) AS skus FROM latest GROUP BY 1),
 c AS (SELECT account_id, string_agg(role || ':' || email, ',' ORDER BY role) AS contacts FROM contact GROUP BY 1)
SELECT a.account_id, a.owner, a.health_score, r.term_months, f.mau, coalesce(f.skus, '') AS skus, c.contacts FROM account a LEFT JOIN f USING (account_id) LEFT JOIN c USING (account_id) LEFT JOIN renewal r USING (account_id)""")
def account_brief(t: Tables):
    rows = ac.account_brief(t.account, t.usage, t.contact, t.renewal)
    return rows.select(
        "account_id", "owner", "health_score", "term_months", "mau",
        F.coalesce(F.array_join(F.transform("footprint", lambda x: x["sku"]), ","), F.lit("")).alias("skus"),
        F.array_join(F.transform("contacts", lambda x: F.concat(x["role"], F.lit(":"), x["email"])), ",").alias("contacts"),
    )


@query("reconcile", rows="Q9", uses="account entity", oracle="""
WITH j AS (SELECT coalesce(a.domain, e.domain) AS domain, a.domain IS NOT NULL AS ka, e.domain IS NOT NULL AS ke, a.industry AS ai, e.industry AS ei, a.region AS ar, e.region AS er FROM account a FULL JOIN entity e USING (domain))
SELECT domain, 'industry' AS field, ai AS ours, ei AS theirs FROM j WHERE ka AND ke AND ai IS DISTINCT FROM ei
UNION ALL SELECT domain, 'region', ar, er FROM j WHERE ka AND ke AND ar IS DISTINCT FROM er
UNION ALL SELECT domain, 'missing', CASE WHEN ka THEN 'yes' ELSE 'no' END, CASE WHEN ke THEN 'yes' ELSE 'no' END FROM j WHERE NOT (ka AND ke)""")
def reconcile(t: Tables):
    return ac.reconcile(t.account, t.entity, ["industry", "region"])


@query("schema_profile", rows="Q11", uses="session learning", oracle="""
SELECT 'session' AS "table", p AS property, ty AS type, (SELECT count(*) FROM session) AS rows,
 CASE WHEN p = 'parent_session_id' THEN (SELECT round(count(*) FILTER (WHERE parent_session_id IS NULL) / count(*), 6) FROM session) ELSE 0 END AS null_share
FROM (VALUES ('session_id', 'bigint'), ('parent_session_id', 'bigint'), ('project_id', 'bigint'), ('user_id', 'bigint'), ('created_at', 'timestamp')) v(p, ty)
UNION ALL SELECT 'learning', p, ty, (SELECT count(*) FROM learning), CASE WHEN p = 'tool_key' THEN (SELECT round(count(*) FILTER (WHERE tool_key IS NULL) / count(*), 6) FROM learning) ELSE 0 END
FROM (VALUES ('id', 'bigint'), ('status', 'string'), ('tool_key', 'string'), ('confidence', 'double'), ('embedding', 'array<float>')) v(p, ty)""")
def schema_profile(t: Tables):
    return ac.schema_profile({"session": t.session, "learning": t.learning.select("id", "status", "tool_key", "confidence", "embedding")})


@query("edge_triples", rows="Q11", uses="injected_in derived_from usage", oracle="""
SELECT 'Learning' AS from_label, 'INJECTED_IN' AS edge, 'Session' AS to_label, count(*) AS n FROM injected_in
UNION ALL SELECT 'Skill', 'DERIVED_FROM', 'Learning', count(*) FROM derived_from UNION ALL SELECT 'Account', 'USES_PRODUCT', 'Product', count(*) FROM (SELECT DISTINCT account_id, sku FROM usage) x""")
def edge_triples(t: Tables):
    return ac.edge_triples({
        ("Learning", "INJECTED_IN", "Session"): t.injected_in, ("Skill", "DERIVED_FROM", "Learning"): t.derived_from,
        ("Account", "USES_PRODUCT", "Product"): t.usage.select("account_id", "sku").distinct(),
    })


#: Every node table of the model, and every edge table with its ends.
NODE_TABLES = (
    "session", "session_event", "learning", "injection", "observation", "pattern", "skill", "skill_version", "proposal", "profile", "ledger", "account", "product", "contact", "usage", "renewal",
)
EDGE_TABLES = {
    ("Learning", "INJECTED_IN", "Session"): ("injected_in", "learning_id, session_id"), ("Skill", "DERIVED_FROM", "Learning"): ("derived_from", "skill_id, learning_id"),
    ("SkillVersion", "DERIVED_FROM", "Learning"): ("version_source", "version_id, learning_id"), ("Session", "PRODUCED_LEARNING", "Learning"): ("produced", "session_id, learning_id"),
    ("Learning", "CONTRADICTS", "Learning"): ("conflict", "from_id, to_id"), ("TaskPattern", "HAS_ALIAS", "Label"): ("pattern_alias", "id, label"),
    ("Project", "HAS_SESSION", "Session"): ("session", "project_id, session_id"), ("User", "HAS_SESSION", "Session"): ("session", "user_id, session_id"),
    ("Session", "HAS_EVENT", "SessionEvent"): ("session_event", "session_id, event_id"), ("Project", "HAS_LEARNING", "Learning"): ("learning", "project_id, id"),
    ("Project", "HAS_OBSERVATION", "Observation"): ("observation", "project_id, id"), ("Project", "HAS_SKILL", "Skill"): ("skill", "project_id, skill_id"),
    ("Account", "USES_PRODUCT", "Product"): ("usage", "account_id, sku"), ("Account", "HAS_CONTACT", "Contact"): ("contact", "account_id, contact_id"),
    ("Account", "RENEWS", "Renewal"): ("renewal", "account_id, renewal_date"),
}


#: Columns whose values no node table looks into: they are passed on, picked by another column's order, or summed.
PASSED_ON = {"documents": ("text",), "conversations": ("text",), "embeddings": ("embedding",), "lineitem": ("l_quantity", "l_extendedprice", "l_discount")}


@query("model_profile", rows="Q11", uses=" ".join(NODE_TABLES), oracle=" UNION ALL ".join(f"""
SELECT '{name}' AS "table", property, count(*) AS rows, round((count(*) - count(v)) / count(*), 6) AS null_share
FROM (FROM (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM {name}) UNPIVOT INCLUDE NULLS (v FOR property IN (COLUMNS(*)))) GROUP BY property""" for name in NODE_TABLES))
def model_profile(t: Tables):
    """A share of nulls asks of these columns only where they are null, so marks travel through the joins and sums of the views instead of texts, vectors and amounts."""
    marked = Tables(t.spark, t.folder)
    for name, columns in PASSED_ON.items():
        marked.put(name, ac.null_marks(getattr(t, name), columns))
    return ac.schema_profile({name: getattr(marked, name) for name in NODE_TABLES}).drop("type")


@query("model_edges", rows="Q11", uses=" ".join(dict.fromkeys(view for view, _ in EDGE_TABLES.values())), oracle=" UNION ALL ".join(f"""
SELECT '{a}' AS from_label, '{kind}' AS edge, '{b}' AS to_label, count(*) AS n FROM (SELECT DISTINCT {ends} FROM {view}) x""" for (a, kind, b), (view, ends) in EDGE_TABLES.items()))
def model_edges(t: Tables):
    return ac.edge_triples({triple: getattr(t, view).select(*ends.split(", ")).distinct() for triple, (view, ends) in EDGE_TABLES.items()})


AD_HOC = "SELECT l.project_id, s.status, count(*) AS n FROM {learning} l JOIN {derived_from} d ON d.learning_id = l.id JOIN {skill} s ON s.skill_id = d.skill_id GROUP BY l.project_id, s.status"


@query("ad_hoc_question", rows="Q12", uses="learning derived_from skill", oracle=AD_HOC.replace("{", "").replace("}", ""))
def ad_hoc_question(t: Tables):
    return ac.ad_hoc({"learning": t.learning, "derived_from": t.derived_from, "skill": t.skill}, AD_HOC)


# --- loads -----------------------------------------------------------------------

USAGE_SCHEMA = T.StructType([
    T.StructField("account_id", T.LongType()), T.StructField("sku", T.StringType()), T.StructField("month", T.DateType()),
    T.StructField("mau", T.LongType()), T.StructField("monthly_revenue", T.DecimalType(38, 9)),
])


@query("table_replace", rows="S10", uses="usage", oracle="SELECT account_id, count(*) AS lines, sum(CAST(mau AS BIGINT))::BIGINT AS mau FROM usage GROUP BY 1")
def table_replace(t: Tables):
    path = work_dir(t.spark, "account_product_usage")
    for _ in range(2):  # a rerun truncates, it does not add
        loaded = replace_table(t.usage, path, USAGE_SCHEMA)
    return loaded.groupBy("account_id").agg(F.count("*").alias("lines"), F.sum("mau").alias("mau"))


@query("account_upsert", rows="S11", uses="account", oracle="""
SELECT account_id, CASE WHEN trajectory = 'new' THEN owner ELSE 'moved ' || owner END AS owner, trajectory = 'steady' AS inserted, trajectory <> 'new' AS touched FROM account""")
def account_upsert(t: Tables):
    old = F.lit("2023-01-01").cast("timestamp")
    state = t.account.filter("trajectory <> 'steady'").select("account_id", "owner", old.alias("created_at"), old.alias("updated_at"))
    rows = t.account.filter("trajectory <> 'new'").select("account_id", F.concat(F.lit("moved "), F.col("owner")).alias("owner"))
    root = work_dir(t.spark, "accounts")
    publish_snapshot(state, root, "000")
    publish_snapshot(ac.upsert_nodes(read_snapshot(t.spark, root), rows, "account_id", now()), root, "001")
    out = read_snapshot(t.spark, root)
    return out.select("account_id", "owner", (F.col("created_at") == now()).alias("inserted"), (F.col("updated_at") == now()).alias("touched"))


@query("edge_refresh", rows="S12", uses="account contact", oracle="""
SELECT account_id, contact_id, 'seed' AS source FROM contact UNION ALL SELECT account_id, account_id * 10 + 9, 'crm' FROM account""")
def edge_refresh(t: Tables):
    path = work_dir(t.spark, "has_contact")
    crm = t.account.select("account_id", (F.col("account_id") * 10 + 9).alias("contact_id"), F.lit("crm").alias("source"))
    stale = t.contact.select("account_id", (F.col("contact_id") + 5).alias("contact_id"), F.lit("seed").alias("source"))
    refresh_partition(crm.unionByName(stale), path, "source")
    fresh = ac.refresh_edges(crm.unionByName(stale), t.contact.unionByName(t.contact).select("account_id", "contact_id"), ["account_id", "contact_id"])
    refresh_partition(fresh, path, "source")
    return t.spark.read.parquet(path).select("account_id", "contact_id", "source")


@query("largest_lines", rows="W9", uses="usage", oracle=f"""WITH {LATEST_SQL}
SELECT account_id, sku, row_number() OVER (PARTITION BY account_id ORDER BY monthly_revenue DESC, sku) AS rank FROM latest QUALIFY rank <= 3""")
def largest_lines(t: Tables):
    return ac.largest_lines(t.usage).select("account_id", "sku", n("rank"))
