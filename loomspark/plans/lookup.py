"""Registered queries: search, filters, bookmarks and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import bookmarks, closure, dashboard, facts, search
from loomspark.plans import lens
from loomspark.plans.analytics import FILES, INSIDE, Model
from loomspark.plans.lens import BASE, CLOSURE_SQL, FACTS_SQL, FROM, TO, with_sql

QUERIES: dict = {}
ORACLES: dict = {}
#: Search words of the registered queries.
TERMS = ["the", "with"]


def query(sql: str, *parts: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = (with_sql(*parts) if parts else "") + sql
        return function

    return add


def docs(spark, sf_dir):
    return lens.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.substring("text", 1, 100).alias("title"), "text")


def index_of(spark, sf_dir):
    """The postings, each file sorted by token so that a query reads few pages of it, and the sizes; written once."""
    both = search.postings(lens.kept(spark, sf_dir, "tokens", lambda: search.tokenised(docs(spark, sf_dir))))
    index = lens.kept(spark, sf_dir, "postings", lambda: both[0].sortWithinPartitions("token"))
    return index, lens.kept(spark, sf_dir, "sizes", lambda: both[1])


TOKENS = r"""tok AS (SELECT doc_id AS doc, regexp_extract_all(strip_accents(lower(substr(text, 1, 100))), '[\p{L}\p{N}]+') AS a, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS b FROM documents)"""


def bm25_sql(tests: list[str], join: str) -> str:
    """tests: the hits of each phrase in a token list {0}, as SQL."""
    cols = ", ".join(f"8.0 * ({t.format('a')}) + ({t.format('b')}) AS h{i}" for i, t in enumerate(tests))
    idf = ", ".join(f"greatest(1e-6, ln((count(*) - count(*) FILTER (WHERE h{i} > 0) + 0.5) / (count(*) FILTER (WHERE h{i} > 0) + 0.5))) AS i{i}" for i in range(len(tests)))
    score = " + ".join(f"i{i} * (h{i} * 2.2) / (h{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in range(len(tests)))
    match = join.join(f"h{i} > 0" for i in range(len(tests)))
    return f"WITH {TOKENS}, hits AS (SELECT doc, len(a) + len(b) AS size, {cols} FROM tok), st AS (SELECT avg(size) AS mean, {idf} FROM hits) SELECT doc, round(-({score}), 6) AS score FROM hits, st WHERE {match}"


@query(bm25_sql(["len(list_filter({0}, lambda t: t = 'the'))", "len(list_filter({0}, lambda t: t = 'with'))"], " AND ") + " ORDER BY score, doc LIMIT 50")
def search_bm25(spark, sf_dir):
    rows = search.bm25(*index_of(spark, sf_dir), [TERMS]).withColumn("score", F.round("score", 6))
    return rows.orderBy("score", "doc").limit(50)


@query(bm25_sql(["len(list_filter(range(1, len({0})), lambda i: {0}[i] = 'of' AND {0}[i + 1] = 'the'))", "len(list_filter({0}, lambda t: t = 'pour'))"], " OR "))
def search_phrase_or(spark, sf_dir):
    parsed = search.parse_query('"of the" OR pour')
    return search.bm25(*index_of(spark, sf_dir), parsed.groups).withColumn("score", F.round("score", 6))


@query(bm25_sql(["len(list_filter({0}, lambda t: t = 'the'))", "len(list_filter({0}, lambda t: t = 'de'))", "len(list_filter({0}, lambda t: t = 'pour'))"], "#").replace("h0 > 0#h1 > 0#h2 > 0", "h0 > 0 OR (h1 > 0 AND h2 > 0)"))
def search_mixed_or(spark, sf_dir):
    """the, or both of the other two: AND binds tighter than OR."""
    return search.bm25(*index_of(spark, sf_dir), search.parse_query("the or de pour").groups).withColumn("score", F.round("score", 6))


def talks(spark, sf_dir):
    rows = lens.table(spark, sf_dir, "conversations")
    messages = rows.select(F.col("conv_id").cast("string").alias("ref"), F.col("turn").cast("long").alias("message_index"), F.when(F.col("role").isin("assistant", "tool"), F.col("role")).otherwise("user").alias("role"), "text")
    titles = messages.where("role = 'user'").groupBy("ref").agg(F.substring(F.regexp_replace(F.min_by("text", "message_index"), r"\s+", " "), 1, 60).alias("title"))
    return messages, titles


TALKS = r"""m AS (SELECT conv_id::VARCHAR AS ref, turn::BIGINT AS message_index, CASE WHEN role IN ('assistant', 'tool') THEN role ELSE 'user' END AS role, text FROM conversations),
t AS (SELECT ref, substr(regexp_replace(arg_min(text, message_index), '\s+', ' ', 'g'), 1, 60) AS title FROM m WHERE role = 'user' GROUP BY 1)"""
HOLDS = "contains(lower({0}), 'the') AND contains(lower({0}), 'with')"


@query(f"""SELECT t.ref, CASE WHEN {HOLDS.format('title')} THEN 'title' WHEN f.role = 'user' THEN 'user_message' WHEN f.role = 'tool' THEN 'tool_output' ELSE 'assistant_reply' END AS match_type
  FROM t LEFT JOIN (SELECT ref, arg_min(role, message_index) AS role FROM m WHERE {HOLDS.format('text')} GROUP BY 1) f USING (ref)""", TALKS)
def search_match_type(spark, sf_dir):
    messages, titles = talks(spark, sf_dir)
    return search.match_types(titles, messages, TERMS).select("ref", "match_type")


@query(r"""SELECT ref, message_index, CASE WHEN s > 0 THEN '… ' ELSE '' END || substr(text, s + 1, e - s) || CASE WHEN e < length(text) THEN ' …' ELSE '' END AS snippet
  FROM (SELECT *, greatest(pos - 80, 0) AS s, least(length(text), pos + length(term) + 80) AS e FROM (SELECT *, instr(lower(text), term) - 1 AS pos
  FROM (SELECT *, CASE WHEN contains(lower(text), 'with') THEN 'with' WHEN contains(lower(text), 'pour') THEN 'pour' ELSE 'with' END AS term FROM m)))""", TALKS)
def search_snippet(spark, sf_dir):
    messages, _ = talks(spark, sf_dir)
    return messages.select("ref", "message_index", T.snippet(F.col("text"), ["with", "pour"]).alias("snippet"))


def search_highlights(spark, sf_dir):
    messages, _ = talks(spark, sf_dir)
    found = T.highlights(F.col("text"), ["the", "there", "with"])
    return messages.select("ref", "message_index", F.array_join(F.transform(found, lambda r: F.concat_ws("-", r["start"], r["stop"])), ",").alias("ranges"))


QUERIES["search_highlights"] = search_highlights


@query("SELECT s.ref, s.activity FROM sessions s WHERE s.ref IN (SELECT ref FROM facts WHERE tool = 'edit') AND s.ref IN (SELECT ref FROM facts WHERE tool = 'read') AND s.ref IN (SELECT ref FROM files WHERE contains(lower(path), 'ring') AND kind = 'edit')", *BASE, FACTS_SQL, FILES)
def search_tag_tool_file_filter(spark, sf_dir):
    m = Model(spark, sf_dir)
    parsed = search.parse_query("tool:edit tool:read file:ring kind:edit")
    return search.tools_and_files(m.sessions, m.facts.select("ref", "tool"), facts.file_activity(m.facts), parsed).select("ref", "activity")


@query("SELECT ref, round(cost, 2) AS cost FROM (SELECT entry AS ref, cost FROM incl) WHERE cost > 100000 AND cost <= 900000", *BASE, CLOSURE_SQL)
def search_cost_filter(spark, sf_dir):
    m = Model(spark, sf_dir)
    bounds = search.parse_query("cost:5..900000 cost:>100000").filters["cost"]
    rows = closure.inclusive_stats(m.sessions, m.closure).select(F.col("entry").alias("ref"), "cost")
    return search.within_cost(rows, bounds, "cost").withColumn("cost", F.round("cost", 2))


@query("SELECT ref FROM sessions WHERE lower(directory) = '/work/nation_3' OR starts_with(lower(directory), '/work/nation_3/') OR starts_with('/work/nation_3', lower(directory) || '/') OR (project_kind = 'path' AND project_key = '/work/nation_7')", *BASE)
def project_scope(spark, sf_dir):
    return search.in_project(lens.heads(spark, sf_dir), "path", "/work/nation_7", "/Work/NATION_3").select("ref")


@query(f"SELECT s.ref, p.title AS parent_title FROM (SELECT * FROM sessions WHERE {INSIDE}) s LEFT JOIN sessions p ON s.parent_ref = p.ref", *BASE)
def parent_titles(spark, sf_dir):
    heads = lens.heads(spark, sf_dir)
    return search.with_parent_titles(dashboard.in_window(heads, FROM, TO).select("ref"), heads)


MERGE = """a AS (SELECT ref, row_number() OVER (ORDER BY latest DESC, ref) AS place FROM (SELECT ref, max(latest) AS latest FROM files WHERE kind = 'edit' GROUP BY 1) ORDER BY 2 LIMIT 50),
b AS (SELECT ref, row_number() OVER (ORDER BY activity DESC, ref) AS place FROM sessions ORDER BY 2 LIMIT 60)"""


def _ranked(rows, *order):
    """The place within a bounded result: a global order over a limited table."""
    from pyspark.sql import Window as W

    return rows.select("ref", F.row_number().over(W.orderBy(*order)).cast("long").alias("place"))


@query("SELECT ref, source::INT AS source, place FROM (SELECT ref, source, place, row_number() OVER (PARTITION BY ref ORDER BY source, place) AS rn FROM (SELECT ref, 0 AS source, place FROM a UNION ALL SELECT ref, 1, place FROM b)) WHERE rn = 1 ORDER BY source, place, ref LIMIT 50", *BASE, FACTS_SQL, FILES, MERGE)
def search_merge(spark, sf_dir):
    m = Model(spark, sf_dir)
    edited = facts.file_activity(m.facts).where("kind = 'edit'").groupBy("ref").agg(F.max("latest").alias("latest")).orderBy(F.desc("latest"), "ref").limit(50)
    recent = m.heads.select("ref", "activity").orderBy(F.desc("activity"), "ref").limit(60)
    return search.merge_sources([_ranked(edited, F.desc("latest"), "ref"), _ranked(recent, F.desc("activity"), "ref")], 50)


@query("""SELECT ref, source::INT AS source, place FROM (SELECT ref, 0 AS source, place FROM a WHERE place <= 5 UNION ALL SELECT ref, 1, place FROM b WHERE ref NOT IN (SELECT ref FROM a WHERE place <= 5)) ORDER BY source, place, ref LIMIT 20""", *BASE, "a AS (SELECT ref, row_number() OVER (ORDER BY activity DESC, ref) AS place FROM sessions WHERE ordinal % 20 = 3 ORDER BY 2 LIMIT 40), b AS (SELECT ref, row_number() OVER (ORDER BY activity DESC, ref) AS place FROM sessions ORDER BY 2 LIMIT 40)")
def alias_quota_merge(spark, sf_dir):
    heads = lens.heads(spark, sf_dir).select("ref", "ordinal", "activity")
    named = heads.where("ordinal % 20 = 3").orderBy(F.desc("activity"), "ref").limit(40)
    found = heads.orderBy(F.desc("activity"), "ref").limit(40)
    return search.alias_quota(_ranked(found, F.desc("activity"), "ref"), _ranked(named, F.desc("activity"), "ref"), 20)


@query("""SELECT b.ref, marked, coalesce(l.title, s.title) AS title, coalesce(l.activity, s.activity, marked) AS activity, CASE WHEN l.ref IS NOT NULL THEN 'live' WHEN s.ref IS NOT NULL THEN 'stored' ELSE 'missing' END AS availability
  FROM (SELECT CASE WHEN ordinal % 5 = 0 THEN 'gone/' || session_id ELSE ref END AS ref, time_created + 5 AS marked FROM sessions WHERE ordinal % 11 = 0) b LEFT JOIN (SELECT * FROM sessions WHERE ordinal % 2 = 0) l ON l.ref = b.ref LEFT JOIN sessions s ON s.ref = b.ref""", *BASE)
def bookmark_views(spark, sf_dir):
    heads = lens.heads(spark, sf_dir)
    marks = heads.where("ordinal % 11 = 0").select(F.when(F.col("ordinal") % 5 == 0, F.concat(F.lit("gone/"), F.col("session_id"))).otherwise(F.col("ref")).alias("ref"), (F.col("time_created") + 5).alias("marked"))
    return bookmarks.bookmark_views(marks, heads.where("ordinal % 2 = 0"), heads)


@query("SELECT ref, coalesce(CASE WHEN ordinal % 13 = 0 THEN 'Alias ' || session_id END, title) AS display_title FROM sessions WHERE contains(lower(coalesce(CASE WHEN ordinal % 13 = 0 THEN 'Alias ' || session_id END, title)), 'alias 1')", *BASE)
def alias_search(spark, sf_dir):
    heads = lens.heads(spark, sf_dir)
    aliases = heads.where("ordinal % 13 = 0").select("ref", F.concat(F.lit(" Alias "), F.col("session_id"), F.lit(" ")).alias("alias"))
    return bookmarks.display_titles(heads, aliases).where(F.lower("display_title").contains("alias 1")).select("ref", "display_title")


@query("SELECT ref, activity FROM sessions ORDER BY activity DESC, ref LIMIT 40 OFFSET 80", *BASE)
def snapshot_page(spark, sf_dir):
    return dashboard.page(lens.heads(spark, sf_dir).select("ref", "activity"), [F.desc("activity"), F.col("ref")], 80, 40)


@query("SELECT ref, agent_name, ((row_number() OVER (PARTITION BY agent_name ORDER BY activity DESC, ref) - 1) // 40)::INT AS page FROM sessions", *BASE)
def timeline_pages(spark, sf_dir):
    rows = lens.heads(spark, sf_dir).select("ref", "agent_name", "activity")
    return dashboard.aligned_pages(rows, "agent_name", [F.desc("activity"), F.col("ref")]).drop("activity")


@query("SELECT project, n FROM (SELECT project_kind || ':' || project_key AS project, count(*) AS n FROM sessions GROUP BY 1 ORDER BY n DESC, project LIMIT 8) UNION ALL SELECT 'path:/nowhere', 0", *BASE)
def project_facets(spark, sf_dir):
    return bookmarks.facets(lens.heads(spark, sf_dir), "path:/nowhere")


@query("SELECT ref, min(marked) AS marked FROM (SELECT ref, time_created AS marked FROM sessions WHERE ordinal % 11 = 0 UNION ALL SELECT ref, time_created - 50 + ordinal % 100 FROM sessions WHERE ordinal % 4 = 0) GROUP BY 1", *BASE)
def bookmark_upsert(spark, sf_dir):
    heads = lens.heads(spark, sf_dir)
    incoming = heads.where("ordinal % 4 = 0").select("ref", (F.col("time_created") - 50 + F.col("ordinal") % 100).alias("marked"))
    return bookmarks.mark(heads.where("ordinal % 11 = 0").select("ref", F.col("time_created").alias("marked")), incoming)


@query("SELECT ref, 'new ' || session_id AS alias FROM sessions WHERE ordinal % 6 = 0 AND ordinal % 4 <> 0 UNION ALL SELECT ref, 'old' FROM sessions WHERE ordinal % 3 = 0 AND ordinal % 6 <> 0", *BASE)
def alias_upsert(spark, sf_dir):
    heads = lens.heads(spark, sf_dir)
    existing = heads.where("ordinal % 3 = 0").select("ref", F.lit("old").alias("alias"))
    incoming = heads.where("ordinal % 6 = 0").select("ref", F.when(F.col("ordinal") % 4 == 0, " ").otherwise(F.concat(F.lit(" new "), "session_id")).alias("alias"))
    return bookmarks.rename(existing, incoming)


@query("SELECT ref FROM closure WHERE entry IN (SELECT entry FROM closure JOIN sessions USING (ref) WHERE ordinal % 40 = 3)", *BASE, CLOSURE_SQL)
def tree_context(spark, sf_dir):
    m = Model(spark, sf_dir)
    return closure.context(m.closure, m.heads.where("ordinal % 40 = 3"))


@query(f"SELECT count(*) FILTER (WHERE a.ref IS NULL) AS added, count(*) FILTER (WHERE b.ref IS NULL) AS removed FROM (SELECT ref FROM sessions WHERE {INSIDE} AND ordinal % 5 <> 0) a FULL JOIN (SELECT ref FROM sessions WHERE {INSIDE} AND ordinal % 7 <> 0) b ON a.ref = b.ref", *BASE)
def window_change(spark, sf_dir):
    inside = dashboard.in_window(lens.heads(spark, sf_dir), FROM, TO)
    return closure.visible_change(inside.where("ordinal % 5 <> 0"), inside.where("ordinal % 7 <> 0"))
