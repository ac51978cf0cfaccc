"""Registered queries: index upkeep, filters, orders, and detail rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import closure, dashboard, index, search
from loomspark.plans import lens
from loomspark.plans.analytics import INSIDE, Model
from loomspark.plans.lens import BASE, CLOSURE_SQL, FACTS_SQL, FROM, TO, with_sql
from loomspark.plans.lookup import TALKS, talks

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str, *parts: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = with_sql(*parts) + sql
        return function

    return add


HASH = "sha256(concat_ws(chr(31), title, coalesce(time_updated::VARCHAR, chr(0)), message_count::VARCHAR))"
FACTS = ("title", "time_updated", "message_count")
#: Documents of the search index: some missing, some pending, some of an old version, hash or count.
DOCUMENTS = f"docs AS (SELECT ref, CASE WHEN ordinal % 8 = 1 THEN 'x' ELSE {HASH} END AS hash, (SELECT count(*) FROM facts f WHERE f.ref = s.ref) + CASE WHEN ordinal % 6 = 1 THEN 1 ELSE 0 END AS messages, CASE WHEN ordinal % 9 = 0 THEN 1 ELSE 2 END AS version, ordinal % 13 = 2 AS pending FROM sessions s WHERE ordinal % 5 <> 0)"


def _documents(m: Model):
    n = m.facts.groupBy("ref").agg(F.count("*").alias("n"))
    rows = m.sessions.where("ordinal % 5 <> 0").join(n, "ref", "left")
    hashed = F.when(F.expr("ordinal % 8 = 1"), "x").otherwise(index.content_hash(*FACTS))
    return rows.select("ref", hashed.alias("hash"), F.expr("coalesce(n, 0) + if(ordinal % 6 = 1, 1, 0) AS messages"), F.expr("if(ordinal % 9 = 0, 1, 2) AS version"), F.expr("ordinal % 13 = 2 AS pending"))


@query(f"SELECT ref, {HASH} AS hash FROM sessions", *BASE)
def content_hashes(spark, sf_dir):
    return lens.sessions(spark, sf_dir).select("ref", index.content_hash(*FACTS).alias("hash"))


@query(f"""SELECT r.ref, CASE WHEN s.ref IS NULL THEN 'absent' WHEN d.ref IS NULL THEN 'unindexed' WHEN pending THEN 'pending' WHEN version <> 2 THEN 'old' WHEN d.hash <> s.hash THEN 'changed'
  WHEN d.messages <> (SELECT count(*) FROM facts f WHERE f.ref = r.ref) THEN 'partial' ELSE 'fresh' END AS state
  FROM (SELECT CASE WHEN ordinal % 11 = 0 THEN 'gone/' || session_id ELSE ref END AS ref FROM sessions) r LEFT JOIN docs d ON d.ref = r.ref LEFT JOIN (SELECT ref, {HASH} AS hash FROM sessions) s ON s.ref = r.ref""", *BASE, FACTS_SQL, DOCUMENTS)
def index_freshness(spark, sf_dir):
    m = Model(spark, sf_dir)
    wanted = m.sessions.select(F.expr("if(ordinal % 11 = 0, concat('gone/', session_id), ref) AS ref"))
    return index.freshness(wanted, _documents(m), m.sessions.select("ref", index.content_hash(*FACTS).alias("hash")), m.facts, 2)


@query("SELECT d.ref, s.activity FROM docs d JOIN sessions s ON s.ref = d.ref WHERE pending", *BASE, FACTS_SQL, DOCUMENTS)
def pending_reindex(spark, sf_dir):
    m = Model(spark, sf_dir)
    return index.to_reindex(_documents(m), m.heads)


@query(f"""SELECT coalesce(a.ref, b.ref) AS ref, coalesce(b.hash, a.hash) AS hash, coalesce(b.messages, a.messages) AS messages, coalesce(b.version, a.version) AS version,
  CASE WHEN b.ref IS NULL OR (a.hash = b.hash AND a.messages = b.messages AND a.version = b.version) THEN 'kept' WHEN a.ref IS NULL THEN 'new' ELSE 'updated' END AS op
  FROM docs a FULL JOIN (SELECT ref, {HASH} AS hash, (SELECT count(*) FROM facts f WHERE f.ref = s.ref) AS messages, 2 AS version FROM sessions s WHERE ordinal % 3 <> 0) b ON a.ref = b.ref""", *BASE, FACTS_SQL, DOCUMENTS)
def document_upsert(spark, sf_dir):
    m = Model(spark, sf_dir)
    n = m.facts.groupBy("ref").agg(F.count("*").alias("n"))
    incoming = m.sessions.where("ordinal % 3 <> 0").join(n, "ref", "left").select("ref", index.content_hash(*FACTS).alias("hash"), F.coalesce("n", F.lit(0)).alias("messages"), F.lit(2).alias("version"))
    return index.upsert_documents(_documents(m), incoming)


@query("""SELECT ref, message_index, tool FROM (SELECT ref, message_index, CASE WHEN order_key % 4 = 1 AND message_index % 2 = 0 THEN 'new' ELSE tool END AS tool, order_key FROM facts)
  WHERE NOT (order_key % 4 = 1 AND message_index >= 3)""", *BASE, FACTS_SQL)
def message_replacement(spark, sf_dir):
    rows = Model(spark, sf_dir).facts
    incoming = rows.where("order_key % 4 = 1 and message_index % 2 = 0").select("ref", "message_index", F.lit("new").alias("tool"))
    counts = rows.where("order_key % 4 = 1").select("ref", F.lit(3).alias("n")).distinct()
    return index.replace_messages(rows.select("ref", "message_index", "tool"), incoming, counts)


@query("SELECT ref FROM sessions WHERE ordinal % 4 = 0 OR ordinal % 6 = 1 OR ordinal % 10 = 3", *BASE)
def stale_tags(spark, sf_dir):
    heads = lens.heads(spark, sf_dir)
    known = heads.where("ordinal % 4 <> 0").select("ref", F.expr("activity - if(ordinal % 6 = 1, 1, 0) AS source_time"), F.expr("if(ordinal % 10 = 3, 1, 2) AS revision"))
    return index.stale_tags(heads, known, 2)


@query("SELECT ref, CASE WHEN ordinal % 3 = 0 THEN 'own' WHEN ordinal % 2 = 0 THEN 'known' ELSE '' END AS tags FROM sessions", *BASE)
def tag_inheritance(spark, sf_dir):
    heads = lens.heads(spark, sf_dir).withColumn("tags", F.when(F.expr("ordinal % 3 = 0"), F.array(F.lit("own"))))
    known = heads.where("ordinal % 2 = 0").select("agent_name", "session_id", F.array(F.lit("known")).alias("tags"))
    return index.inherited_tags(heads, known).select("ref", F.array_join("tags", ",").alias("tags"))


@query("SELECT ref, activity, shard FROM (SELECT ref, activity // 1000000000 AS activity, 0 AS shard FROM sessions WHERE ordinal % 3 = 0 UNION ALL SELECT ref, activity // 1000000000, 1 FROM sessions WHERE ordinal % 3 = 1) ORDER BY activity DESC, shard, ref LIMIT 200", *BASE)
def shard_merge(spark, sf_dir):
    heads = lens.heads(spark, sf_dir).select("ordinal", "ref", F.expr("activity div 1000000000 AS activity"))
    shards = [heads.where(F.col("ordinal") % 3 == i).select("ref", "activity") for i in (0, 1)]
    return index.merged_shards(shards, F.desc("activity")).orderBy(F.desc("activity"), "shard", "ref").limit(200)


@query("SELECT project_kind, project_key, latest FROM (SELECT project_kind, project_key, max(CASE WHEN ordinal % 2 = 0 AND project_key < '/work/nation_2' THEN NULL ELSE activity END) AS latest FROM sessions WHERE ordinal % 50 <> 8 GROUP BY ALL) ORDER BY project_kind = 'loose', latest DESC NULLS LAST, project_kind, project_key LIMIT 30", *BASE)
def project_order(spark, sf_dir):
    heads = lens.heads(spark, sf_dir).where("ordinal % 50 <> 8")
    latest = F.max(F.expr("if(ordinal % 2 = 0 and project_key < '/work/nation_2', null, activity)"))
    return index.project_order(heads.groupBy("project_kind", "project_key").agg(latest.alias("latest"))).limit(30)


@query("SELECT user_id::VARCHAR AS ref, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY 1", *BASE)
def first_wins(spark, sf_dir):
    rows = lens.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("ref"), "event_type", "event_id")
    return index.first_of(rows, "ref", "event_id")


@query("""walk AS (SELECT t.ref, t.entry, s.activity, [s.activity::VARCHAR || ':' || s.ref] AS path FROM tree t JOIN sessions s USING (ref) WHERE t.depth = 0
  UNION ALL SELECT c.ref, w.entry, c.activity, list_append(w.path, c.activity::VARCHAR || ':' || c.ref) FROM walk w JOIN sessions c ON c.parent_ref = w.ref)
SELECT ref, entry, array_to_string(path, '>') AS path FROM walk UNION ALL SELECT ref, ref, activity::VARCHAR || ':' || ref FROM sessions WHERE ref NOT IN (SELECT ref FROM tree)""".replace("walk AS", ", walk AS", 1), *BASE, CLOSURE_SQL)
def depth_first_order(spark, sf_dir):
    m = Model(spark, sf_dir)
    rows = index.depth_first(m.heads, m.closure)
    return rows.select("ref", "entry", F.array_join(F.transform("path", lambda p: F.concat_ws(":", p["activity"], p["ref"])), ">").alias("path"))


@query("SELECT mount, count(*) AS entries, sum(subs)::BIGINT AS subs, sum(tokens)::BIGINT AS tokens FROM (SELECT e.ref, e.mount, i.descendants AS subs, i.tokens FROM entries e JOIN incl i ON i.entry = e.ref) GROUP BY 1", *BASE, CLOSURE_SQL)
def timeline_totals(spark, sf_dir):
    m = Model(spark, sf_dir)
    return index.timeline_totals(m.entries, m.closure, m.sessions)


@query("SELECT max(activity) AS latest, count(*) AS sessions FROM sessions", *BASE)
def cache_info(spark, sf_dir):
    return index.cache_info(lens.heads(spark, sf_dir))


@query("SELECT ref, sum(messages)::BIGINT AS messages, sum(tokens)::BIGINT AS tokens, round(sum(cost), 2) AS cost FROM (SELECT ref, message_count AS messages, coalesce(total_tokens, input_tokens + output_tokens) AS tokens, total_cost AS cost FROM sessions UNION ALL SELECT parent_ref, message_count, coalesce(total_tokens, input_tokens + output_tokens), total_cost FROM sessions WHERE parent_ref IN (SELECT ref FROM sessions)) GROUP BY 1", *BASE)
def detail_with_children(spark, sf_dir):
    return index.with_children(lens.sessions(spark, sf_dir)).withColumn("cost", F.round("cost", 2))


OCCURRENCES = "occ AS (SELECT ref, CASE tool WHEN 'read' THEN 'read' WHEN 'edit' THEN 'edit' ELSE 'write' END AS kind, path, coalesce(at_ms // 10000000000, 0) AS moment, message_index FROM facts)"


@query("SELECT ref, kind, path, n, moment AS \"at\", message_index AS last_index FROM (SELECT *, count(*) OVER (PARTITION BY ref, kind, path) AS n, row_number() OVER (PARTITION BY ref, kind, path ORDER BY moment DESC, message_index DESC) AS rn FROM occ) WHERE rn = 1", *BASE, FACTS_SQL, OCCURRENCES)
def file_change_summary(spark, sf_dir):
    kind = F.expr("CASE tool WHEN 'read' THEN 'read' WHEN 'edit' THEN 'edit' ELSE 'write' END AS kind")
    return index.file_changes(Model(spark, sf_dir).facts.select("ref", kind, "path", F.expr("at_ms div 10000000000 AS at"), "message_index"))


CALLS = "calls AS (SELECT ref, message_index, [upper(tool), ' ' || tool, model] AS calls FROM facts)"


def _calls(spark, sf_dir):
    return Model(spark, sf_dir).facts.select("ref", "message_index", F.array(F.upper("tool"), F.concat(F.lit(" "), "tool"), "model").alias("calls"))


@query("SELECT ref, message_index, tool || ',' || lower(model) AS tools FROM facts", *BASE, FACTS_SQL)
def message_tool_names(spark, sf_dir):
    return index.tool_names(_calls(spark, sf_dir)).select("ref", "message_index", F.array_join("tools", ",").alias("tools"))


@query("SELECT ref, message_index, unnest(range(0, 3))::INT AS tool_index, unnest(calls) AS tool FROM calls", *BASE, FACTS_SQL, CALLS)
def tool_occurrences(spark, sf_dir):
    return index.tool_occurrences(_calls(spark, sf_dir))


@query("""SELECT c.ref, c.call_id, c.tool, CASE WHEN r.output IS NULL THEN 'running' WHEN r.error THEN 'error' ELSE 'completed' END AS status, r.output
  FROM (SELECT ref, message_index AS call_id, tool FROM facts WHERE message_index % 2 = 0) c LEFT JOIN (SELECT ref, (message_index - 1) // 4 * 4 AS call_id, arg_max(path, message_index) AS output, arg_max(message_index % 5 = 3, message_index) AS error FROM facts WHERE message_index % 2 = 1 GROUP BY 1, 2) r ON r.ref = c.ref AND r.call_id = c.call_id""", *BASE, FACTS_SQL)
def tool_results(spark, sf_dir):
    rows = Model(spark, sf_dir).facts
    calls = rows.where("message_index % 2 = 0").select("ref", F.col("message_index").cast("long").alias("call_id"), "tool")
    results = rows.where("message_index % 2 = 1").select("ref", F.expr("cast((message_index - 1) div 4 * 4 AS long) AS call_id"), "message_index", F.expr("message_index % 5 = 3 AS error"), F.col("path").alias("output"))
    return index.tool_results(calls, results)


@query("SELECT t.ref, concat_ws(chr(10), t.title, (SELECT string_agg(text, chr(10) ORDER BY message_index) FROM m WHERE m.ref = t.ref AND trim(text) <> '')) AS content FROM t", TALKS)
def session_content(spark, sf_dir):
    messages, titles = talks(spark, sf_dir)
    return index.session_content(titles, messages)


@query("""SELECT f.ref, count(*) AS messages, coalesce(any_value(b.input), sum(f.input))::BIGINT AS input, sum(f.output)::BIGINT AS output, round(sum(f.cost), 2) AS cost
  FROM facts f LEFT JOIN (SELECT ref, input_tokens AS input FROM sessions WHERE ordinal % 3 = 0) b ON b.ref = f.ref GROUP BY 1""", *BASE, FACTS_SQL)
def finished_stats(spark, sf_dir):
    m = Model(spark, sf_dir)
    base = m.sessions.where("ordinal % 3 = 0").select("ref", F.col("input_tokens").alias("input"), F.lit(None).cast("long").alias("output"), F.lit(None).cast("double").alias("cost"))
    return index.finished_stats(base, index.derived_stats(m.facts)).withColumn("cost", F.round("cost", 2))


@query("SELECT ref, CASE WHEN bool_or(coalesce(cost_source = 'estimated', false)) THEN 'estimated' WHEN count(cost_source) > 0 THEN 'recorded' END AS cost_source FROM facts GROUP BY 1", *BASE, FACTS_SQL)
def derived_source(spark, sf_dir):
    return index.derived_stats(Model(spark, sf_dir).facts).select("ref", "cost_source")


@query("SELECT agent_name, count(*) AS sessions, round(sum(total_cost) / 1000, 2) AS cost FROM sessions GROUP BY 1", *BASE)
def agent_order(spark, sf_dir):
    return index.ranked_agents(lens.sessions(spark, sf_dir)).withColumn("cost", F.round(F.col("cost") / 1000, 2))


TAGGED = "tagged AS (SELECT *, CASE WHEN ordinal % 3 = 0 THEN ['docs', 'bugfix'] WHEN ordinal % 3 = 1 THEN ['docs'] ELSE [] END AS tags FROM sessions)"


def _tagged(spark, sf_dir):
    none = F.array().cast("array<string>")
    tags = F.when(F.expr("ordinal % 3 = 0"), F.array(F.lit("docs"), F.lit("bugfix"))).when(F.expr("ordinal % 3 = 1"), F.array(F.lit("docs"))).otherwise(none)
    return lens.sessions(spark, sf_dir).withColumn("tags", tags)


@query("SELECT ref FROM tagged WHERE agent_name = '1-urgent' AND (contains(lower(project_key), 'nation_1') OR contains(lower(project_name), 'nation_1') OR contains(lower(directory), 'nation_1')) AND list_contains(tags, 'docs') AND list_contains(tags, 'bugfix')", *BASE, TAGGED)
def search_agent_tag_filter(spark, sf_dir):
    parsed = search.parse_query("agent:1-URGENT project:Nation_1 tag:docs signal:bugfix")
    return search.filtered(_tagged(spark, sf_dir), parsed).select("ref")


@query("SELECT ref FROM tagged WHERE agent_name = '2-high' AND project_kind = 'path' AND project_key = '/work/nation_4' AND list_contains(tags, 'docs')", *BASE, TAGGED)
def search_explicit_options(spark, sf_dir):
    parsed = search.with_options(search.parse_query("agent:1-urgent projectkind:path tag:docs"), agent="2-high", project_key="/work/nation_4")
    return search.filtered(_tagged(spark, sf_dir), parsed).select("ref")


@query("SELECT ref, round(cost, 2) AS cost FROM (SELECT entry AS ref, cost FROM incl) WHERE cost >= 200000 AND cost < 500000", *BASE, CLOSURE_SQL)
def search_cost_combined(spark, sf_dir):
    m = Model(spark, sf_dir)
    bounds = search.parse_query("cost:>1 cost:<500000 cost:>=200000").filters["cost"]
    rows = closure.inclusive_stats(m.sessions, m.closure).select(F.col("entry").alias("ref"), "cost")
    return search.within_cost(rows, bounds, "cost").withColumn("cost", F.round("cost", 2))


@query("SELECT DISTINCT a.ref FROM facts a WHERE a.tool = 'edit' AND a.ref IN (SELECT ref FROM facts WHERE contains(path, 'ring'))", *BASE, FACTS_SQL)
def text_and_file_hits(spark, sf_dir):
    rows = Model(spark, sf_dir).facts
    return search.file_hits_with_text(rows.where("tool = 'edit'").select("ref").distinct(), rows.where(F.col("path").contains("ring")))


@query(f"SELECT e.ref FROM entries e JOIN tagged t ON t.ref = e.ref WHERE e.activity BETWEEN {FROM} AND {TO} AND list_contains(t.tags, 'bugfix')", *BASE, CLOSURE_SQL, TAGGED)
def list_tags_after_window(spark, sf_dir):
    m, tagged = Model(spark, sf_dir), _tagged(spark, sf_dir)
    shown = dashboard.in_window(m.entries, FROM, TO).select("ref")
    return tagged.join(shown, "ref", "left_semi").where(F.array_contains("tags", "bugfix")).select("ref")


FILTERED = CLOSURE_SQL.replace("FROM sessions", "FROM some_heads").replace("JOIN sessions", "JOIN some_heads")


@query("SELECT ref, entry, depth, mount FROM closure", *BASE, "some_heads AS (SELECT * FROM sessions WHERE agent_name IN ('1-urgent', '2-high'))", FILTERED)
def list_filter_before_tree(spark, sf_dir):
    """Children of a parent that the filter takes away become orphans."""
    return closure.mount(lens.heads(spark, sf_dir).where("agent_name in ('1-urgent', '2-high')")).select("ref", "entry", "depth", "mount")


@query("SELECT b.ref, marked, coalesce(s.activity, marked) AS shown FROM (SELECT CASE WHEN ordinal % 5 = 0 THEN 'gone/' || session_id ELSE ref END AS ref, time_created + 5 AS marked FROM sessions WHERE ordinal % 11 = 0) b LEFT JOIN sessions s USING (ref) ORDER BY shown DESC, marked DESC, b.ref LIMIT 60", *BASE)
def bookmark_order(spark, sf_dir):
    heads = lens.heads(spark, sf_dir)
    marks = heads.where("ordinal % 11 = 0").select(F.expr("if(ordinal % 5 = 0, concat('gone/', session_id), ref) AS ref"), (F.col("time_created") + 5).alias("marked"))
    rows = marks.join(heads.select("ref", "activity"), "ref", "left").select("ref", "marked", F.coalesce("activity", "marked").alias("shown"))
    return rows.orderBy(F.desc("shown"), F.desc("marked"), "ref").limit(60)
