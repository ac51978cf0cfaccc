"""Registered queries: rollups, hierarchy, attribution, dashboard and projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import attribution, closure, dashboard, facts
from loomspark.plans import lens
from loomspark.plans.lens import BASE, CLOSURE_SQL, DAY, FACTS_SQL, FROM, SPAN, TO, with_sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str, *parts: str):
    """Register a function as a query with its oracle, whose tables are the given WITH parts."""

    def add(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = with_sql(*(parts or BASE)) + sql
        return function

    return add


class Model:
    """The lens and what hangs on it, each written once for an application."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _kept(self, name: str, build) -> DataFrame:
        return lens.kept(self.spark, self.sf_dir, name, build)

    @property
    def heads(self) -> DataFrame:
        return lens.heads(self.spark, self.sf_dir)

    @property
    def sessions(self) -> DataFrame:
        return lens.sessions(self.spark, self.sf_dir)

    @property
    def closure(self) -> DataFrame:
        return self._kept("closure", lambda: closure.mount(self.heads))

    @property
    def entries(self) -> DataFrame:
        return self.heads.join(self.closure.where("ref = entry").select("ref", "mount"), "ref")

    @property
    def facts(self) -> DataFrame:
        return lens.facts(self.spark, self.sf_dir)

    @property
    def summary(self) -> DataFrame:
        return self._kept("summary", lambda: facts.session_summary(self.facts))

    @property
    def models(self) -> DataFrame:
        return self._kept("models", lambda: facts.model_costs(self.facts))

    def costs(self, start: int = FROM, end: int = TO) -> DataFrame:
        return self._kept(f"costs-{start}-{end}", lambda: attribution.attributed_costs(self.sessions, self.closure, self.facts, self.summary, None, start, end))

    def usage(self, start: int = FROM, end: int = TO) -> DataFrame:
        return self._kept(f"usage-{start}-{end}", lambda: attribution.attributed_usage(self.sessions, self.closure, self.facts, self.summary, start, end))


def money(column: str, places: int = 2):
    return F.round(column, places).alias(column)


FULL = (*BASE, CLOSURE_SQL, FACTS_SQL)


def attributed_sql(start: int = FROM, end: int = TO, tag: str = "") -> str:
    near = lambda a, b: f"abs({a} - {b}) <= greatest(1e-8, 1e-6 * greatest(abs({a}), abs({b})))"
    return f"""
nodes{tag} AS (SELECT s.*, c.entry, e.agent_name AS agent, e.project_kind || ':' || e.project_key AS project, e.activity AS entry_activity, coalesce(s.total_tokens, s.input_tokens + s.output_tokens) AS tokens,
  m.n AS m_n, m.input AS m_input, m.output AS m_output, m.reasoning AS m_reasoning, m.cache_read AS m_read, m.cache_create AS m_create, m.untimed_n, m.untimed_tokens, m.untimed_cost, m.cost AS m_cost,
  (SELECT sum(cost) FROM model_facts f WHERE f.ref = s.ref) AS known
  FROM closure c JOIN sessions e ON e.ref = c.entry JOIN sessions s ON s.ref = c.ref LEFT JOIN summary m ON m.ref = s.ref),
paid{tag} AS (SELECT *, coalesce(untimed_cost <= 1e-8 AND {near('m_cost', 'total_cost')}, false) AS detailed, coalesce(known > 0 AND (known <= total_cost OR {near('known', 'total_cost')}), false) AS split FROM nodes{tag} WHERE total_cost > 0),
costs{tag} AS (
  SELECT entry, p.ref, agent, project, f.at_ms, f.model, f.cost, coalesce(f.cost_source, p.cost_source, 'recorded') AS source FROM paid{tag} p JOIN facts f ON f.ref = p.ref WHERE detailed AND f.cost > 0 AND f.at_ms BETWEEN {start} AND {end}
  UNION ALL SELECT entry, p.ref, agent, project, entry_activity, f.model, f.cost, coalesce(p.cost_source, 'recorded') FROM paid{tag} p JOIN model_facts f ON f.ref = p.ref WHERE NOT detailed AND split AND entry_activity BETWEEN {start} AND {end}
  UNION ALL SELECT entry, ref, agent, project, entry_activity, NULL, CASE WHEN split THEN greatest(total_cost - known, 0) ELSE total_cost END, coalesce(cost_source, 'recorded') FROM paid{tag}
    WHERE NOT detailed AND entry_activity BETWEEN {start} AND {end} AND CASE WHEN split THEN greatest(total_cost - known, 0) ELSE total_cost END > 1e-6),
used{tag} AS (SELECT *, coalesce(untimed_n = 0 AND m_n = message_count, false) AS by_message,
  coalesce(untimed_tokens = 0 AND m_input = input_tokens AND m_read = cache_read AND m_create = cache_create AND (m_output = output_tokens OR m_output + m_reasoning = output_tokens) AND input_tokens + output_tokens = tokens, false) AS by_token,
  NOT coalesce(m_output = output_tokens, false) AS reasoned FROM nodes{tag}),
usage{tag} AS (SELECT * FROM (
  SELECT entry, u.ref, agent, project, f.at_ms, by_message::INT::BIGINT AS messages, CASE WHEN by_token THEN f.input + f.output + CASE WHEN reasoned THEN f.reasoning ELSE 0 END ELSE 0 END AS tokens, CASE WHEN by_token THEN f.input ELSE 0 END AS input,
    CASE WHEN by_token THEN f.output + CASE WHEN reasoned THEN f.reasoning ELSE 0 END ELSE 0 END AS output, CASE WHEN by_token THEN f.cache_read ELSE 0 END AS cache_read, CASE WHEN by_token THEN f.cache_create ELSE 0 END AS cache_create
    FROM used{tag} u JOIN facts f ON f.ref = u.ref WHERE (by_message OR by_token) AND f.at_ms BETWEEN {start} AND {end}
  UNION ALL SELECT entry, ref, agent, project, entry_activity, CASE WHEN by_message THEN 0 ELSE message_count END, CASE WHEN by_token THEN 0 ELSE tokens END, CASE WHEN by_token THEN 0 ELSE input_tokens END, CASE WHEN by_token THEN 0 ELSE output_tokens END,
    CASE WHEN by_token THEN 0 ELSE cache_read END, CASE WHEN by_token THEN 0 ELSE cache_create END FROM used{tag} WHERE NOT (by_message AND by_token) AND entry_activity BETWEEN {start} AND {end})
  WHERE messages > 0 OR tokens > 0 OR input > 0 OR output > 0 OR cache_read > 0 OR cache_create > 0)"""


ATTRIBUTED = (*FULL, attributed_sql())
INSIDE = f"activity BETWEEN {FROM} AND {TO}"
DAY_SQL = "strftime(make_timestamp({} * 1000), '%Y-%m-%d')"


@query("SELECT project_kind, project_key, min(project_name) AS name, string_agg(DISTINCT agent_name, ',' ORDER BY agent_name) AS agents, count(*) AS sessions, max(activity) AS latest FROM sessions WHERE parent_ref IS NULL GROUP BY 1, 2")
def project_groups_view(spark, sf_dir):
    roots = lens.heads(spark, sf_dir).where("parent_ref is null")
    return dashboard.project_groups(roots, F.min("project_name"))


@query("SELECT project_kind, project_key, arg_min(project_name, ordinal) AS name, string_agg(DISTINCT agent_name, ',' ORDER BY agent_name) AS agents, count(*) AS sessions, max(activity) AS latest FROM entries GROUP BY 1, 2", *BASE, CLOSURE_SQL)
def project_groups_tree(spark, sf_dir):
    return dashboard.project_groups(Model(spark, sf_dir).entries, F.min_by("project_name", "ordinal"))


@query("SELECT ref, model, round(cost, 2) AS cost, round(recorded, 2) AS recorded FROM model_facts", *BASE, FACTS_SQL)
def model_cost_rollup(spark, sf_dir):
    return Model(spark, sf_dir).models.select("ref", "model", money("cost"), money("recorded"))


@query("SELECT ref, n, input, output, reasoning, cache_read, cache_create, untimed_n, untimed_tokens, round(cost, 2) AS cost, round(untimed_cost, 2) AS untimed_cost, round(recorded_cost, 2) AS recorded_cost FROM summary", *BASE, FACTS_SQL)
def session_cost_summary(spark, sf_dir):
    rows = Model(spark, sf_dir).summary
    return rows.select("ref", "n", "input", "output", "reasoning", "cache_read", "cache_create", "untimed_n", "untimed_tokens", money("cost"), money("untimed_cost"), money("recorded_cost"))


@query(f"SELECT model, round(sum(f.cost), 2) AS cost, round(sum(recorded), 2) AS recorded, round(sum(f.cost - recorded), 2) AS estimated FROM model_facts f JOIN sessions s USING (ref) WHERE {INSIDE} GROUP BY model", *BASE, FACTS_SQL)
def model_cost_distribution(spark, sf_dir):
    m = Model(spark, sf_dir)
    return facts.model_distribution(m.models, m.heads, FROM, TO).select("model", money("cost"), money("recorded"), money("estimated"))


FILES = "files AS (SELECT ref, path, CASE tool WHEN 'read' THEN 'read' WHEN 'edit' THEN 'edit' ELSE 'write' END AS kind, count(*) AS count, max(coalesce(at_ms, 0)) AS latest FROM facts GROUP BY ALL)"


@query("SELECT ref, path, kind, count, latest FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY latest DESC, count DESC, path, kind) AS rn FROM files) WHERE rn = 1", *BASE, FACTS_SQL, FILES)
def file_activity_latest_per_session(spark, sf_dir):
    return facts.latest_file_per_session(facts.file_activity(Model(spark, sf_dir).facts))


@query("SELECT kind, path, sum(count)::BIGINT AS count, max(latest) AS latest FROM files GROUP BY 1, 2", *BASE, FACTS_SQL, FILES)
def file_activity_summary(spark, sf_dir):
    return facts.file_activity(Model(spark, sf_dir).facts).groupBy("kind", "path").agg(F.sum("count").alias("count"), F.max("latest").alias("latest"))


@query("SELECT ref, entry, depth, mount FROM closure", *BASE, CLOSURE_SQL)
def mount_state(spark, sf_dir):
    return Model(spark, sf_dir).closure


@query("SELECT entry, descendants, messages, tokens, input, output, cache_read, cache_create, round(cost, 2) AS cost, CASE WHEN estimated THEN 'estimated' WHEN sourced THEN 'recorded' END AS cost_source FROM incl", *BASE, CLOSURE_SQL)
def inclusive_stats(spark, sf_dir):
    m = Model(spark, sf_dir)
    return closure.inclusive_stats(m.sessions, m.closure).withColumn("cost", F.round("cost", 2))


@query("SELECT ref, round(sum(total_cost), 2) AS subtree_cost FROM reach JOIN (SELECT ref AS r, total_cost FROM sessions) ON node = r GROUP BY ref HAVING sum(total_cost) > 500000", *BASE, "reach AS (SELECT ref, ref AS node FROM sessions UNION SELECT reach.ref, c.ref FROM reach JOIN sessions c ON c.parent_ref = reach.node)")
def subtree_cost_filter(spark, sf_dir):
    return closure.subtree_costs(lens.sessions(spark, sf_dir)).where("subtree_cost > 500000").select("ref", money("subtree_cost", 2))


@query(f"SELECT s.ref, c.entry, c.depth, c.mount, s.activity FROM sessions s JOIN closure c USING (ref) JOIN sessions e ON e.ref = c.entry WHERE e.{INSIDE}", *BASE, CLOSURE_SQL)
def tree_window_filter(spark, sf_dir):
    m = Model(spark, sf_dir)
    return closure.window_filter(m.heads, m.closure, FROM, TO).select("ref", "entry", "depth", "mount", "activity")


@query(f"SELECT {DAY_SQL.format('activity')} AS day, count(*) AS mains, sum(descendants)::BIGINT AS subs FROM entries e JOIN incl i ON i.entry = e.ref GROUP BY 1", *BASE, CLOSURE_SQL)
def day_groups(spark, sf_dir):
    m = Model(spark, sf_dir)
    return closure.day_groups(m.entries, m.closure)


@query(f"SELECT agent_name AS agent, count(*) AS sessions FROM entries WHERE {INSIDE} GROUP BY 1", *BASE, CLOSURE_SQL)
def agent_counts(spark, sf_dir):
    return dashboard.in_window(Model(spark, sf_dir).entries, FROM, TO).groupBy(F.col("agent_name").alias("agent")).agg(F.count("*").alias("sessions"))


@query("SELECT entry, ref, agent, project, at_ms, model, source, round(sum(cost), 2) AS cost FROM costs GROUP BY ALL", *ATTRIBUTED)
def attributed_cost(spark, sf_dir):
    return Model(spark, sf_dir).costs().groupBy("entry", "ref", "agent", "project", "at_ms", "model", "source").agg(F.round(F.sum("cost"), 2).alias("cost"))


@query("SELECT entry, ref, agent, project, at_ms, sum(messages)::BIGINT AS messages, sum(tokens)::BIGINT AS tokens, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(cache_create)::BIGINT AS cache_create FROM usage GROUP BY ALL", *ATTRIBUTED)
def attributed_usage(spark, sf_dir):
    sums = [F.sum(c).alias(c) for c in ("messages", "tokens", "input", "output", "cache_read", "cache_create")]
    return Model(spark, sf_dir).usage().groupBy("entry", "ref", "agent", "project", "at_ms").agg(*sums)


def totals_sql(start: int, end: int, tag: str = "") -> str:
    return f"""SELECT count(*) AS sessions, count(DISTINCT (project_key, project_kind)) AS projects, count(DISTINCT agent_name) AS agents,
  (SELECT coalesce(sum(messages), 0)::BIGINT FROM usage{tag}) AS messages, (SELECT coalesce(sum(tokens), 0)::BIGINT FROM usage{tag}) AS tokens, (SELECT coalesce(sum(cache_read), 0)::BIGINT FROM usage{tag}) AS cache_read,
  (SELECT round(sum(cost), 2) FROM costs{tag}) AS cost, (SELECT round(coalesce(sum(cost) FILTER (WHERE source = 'recorded'), 0), 2) FROM costs{tag}) AS recorded_cost, (SELECT round(coalesce(sum(cost) FILTER (WHERE source <> 'recorded'), 0), 2) FROM costs{tag}) AS estimated_cost,
  (SELECT CASE WHEN bool_or(source = 'estimated') THEN 'estimated' WHEN count(*) > 0 THEN 'recorded' END FROM costs{tag}) AS cost_source FROM entries WHERE activity BETWEEN {start} AND {end}"""


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.round(c, 2) for c in ("cost", "recorded_cost", "estimated_cost")})


@query(totals_sql(FROM, TO), *ATTRIBUTED)
def dashboard_totals(spark, sf_dir):
    m = Model(spark, sf_dir)
    return _rounded(dashboard.totals(m.entries, m.costs(), m.usage(), FROM, TO))


@query(totals_sql(FROM - SPAN, FROM - 1), *FULL, attributed_sql(FROM - SPAN, FROM - 1))
def compare_window(spark, sf_dir):
    start, end = dashboard.previous_window(FROM, TO)
    m = Model(spark, sf_dir)
    return _rounded(dashboard.totals(m.entries, m.costs(start, end), m.usage(start, end), start, end))


@query(f"""SELECT day, coalesce(sessions, 0) AS sessions, coalesce(messages, 0)::BIGINT AS messages, coalesce(tokens, 0)::BIGINT AS tokens, greatest(coalesce(input, 0) - coalesce(cache_read, 0) - coalesce(cache_create, 0), 0)::BIGINT AS input,
  coalesce(output, 0)::BIGINT AS output, coalesce(cache_read, 0)::BIGINT AS cache_read, coalesce(cache_create, 0)::BIGINT AS cache_create, round(coalesce(cost, 0), 2) AS cost
  FROM (SELECT {DAY_SQL.format('t')} AS day FROM range({FROM}, {TO}, {DAY}) r(t)) LEFT JOIN (SELECT {DAY_SQL.format('activity')} AS day, count(*) AS sessions FROM entries WHERE {INSIDE} GROUP BY 1) USING (day)
  LEFT JOIN (SELECT {DAY_SQL.format('at_ms')} AS day, sum(messages) AS messages, sum(tokens) AS tokens, sum(input) AS input, sum(output) AS output, sum(cache_read) AS cache_read, sum(cache_create) AS cache_create FROM usage GROUP BY 1) USING (day)
  LEFT JOIN (SELECT {DAY_SQL.format('at_ms')} AS day, sum(cost) AS cost FROM costs GROUP BY 1) USING (day)""", *ATTRIBUTED)
def dashboard_daily(spark, sf_dir):
    m = Model(spark, sf_dir)
    return dashboard.daily(m.entries, m.costs(), m.usage(), FROM, TO).withColumn("cost", F.round("cost", 2))


@query(f"""SELECT agent, coalesce(sessions, 0) AS sessions, coalesce(messages, 0)::BIGINT AS messages, coalesce(tokens, 0)::BIGINT AS tokens, round(coalesce(cost, 0), 2) AS cost
  FROM (SELECT agent_name AS agent, count(*) AS sessions FROM entries WHERE {INSIDE} GROUP BY 1) FULL JOIN (SELECT agent, sum(messages) AS messages, sum(tokens) AS tokens FROM usage GROUP BY 1) USING (agent) FULL JOIN (SELECT agent, sum(cost) AS cost FROM costs GROUP BY 1) USING (agent)""", *ATTRIBUTED)
def dashboard_per_agent(spark, sf_dir):
    m = Model(spark, sf_dir)
    return dashboard.per_agent(m.entries, m.costs(), m.usage(), FROM, TO).withColumn("cost", F.round("cost", 2))


@query("SELECT model, round(cost, 2) AS cost, round(least(recorded, cost), 2) AS recorded FROM (SELECT model, sum(cost) AS cost, coalesce(sum(cost) FILTER (WHERE source = 'recorded'), 0) AS recorded FROM costs WHERE model IS NOT NULL GROUP BY 1) ORDER BY cost DESC, model LIMIT 20", *ATTRIBUTED)
def dashboard_model_costs(spark, sf_dir):
    return dashboard.model_costs(Model(spark, sf_dir).costs()).select("model", money("cost", 2), money("recorded", 2))


@query(f"SELECT model, sum(tokens)::BIGINT AS tokens, count(*) AS sessions FROM (SELECT c.entry, f.model, sum(f.input + f.output) AS tokens FROM closure c JOIN sessions e ON e.ref = c.entry JOIN facts f ON f.ref = c.ref WHERE e.{INSIDE} GROUP BY ALL) GROUP BY 1", *FULL)
def dashboard_model_distribution(spark, sf_dir):
    m = Model(spark, sf_dir)
    return dashboard.model_sessions(m.entries, m.closure, m.facts, FROM, TO)


PROJECTS = f"""by_project AS (SELECT project, coalesce(sessions, 0)::BIGINT AS sessions, coalesce(agents, '') AS agents, coalesce(messages, 0)::BIGINT AS messages, coalesce(tokens, 0)::BIGINT AS tokens, coalesce(cost, 0) AS cost
  FROM (SELECT project, sum(n) AS sessions, string_agg(agent_name, ',' ORDER BY n DESC, agent_name) AS agents FROM (SELECT project_kind || ':' || project_key AS project, agent_name, count(*) AS n FROM entries WHERE {INSIDE} GROUP BY 1, 2) GROUP BY 1)
  FULL JOIN (SELECT project, sum(messages) AS messages, sum(tokens) AS tokens FROM usage GROUP BY 1) USING (project) FULL JOIN (SELECT project, sum(cost) AS cost FROM costs GROUP BY 1) USING (project))"""


@query("SELECT project, sessions, agents, messages, tokens, round(cost, 2) AS cost FROM by_project", *ATTRIBUTED, PROJECTS)
def dashboard_projects(spark, sf_dir):
    m = Model(spark, sf_dir)
    return dashboard.projects(m.entries, m.costs(), m.usage(), FROM, TO).withColumn("cost", F.round("cost", 2))


@query("SELECT CASE WHEN rn <= 12 THEN project ELSE '(other)' END AS project, sum(sessions)::BIGINT AS sessions, sum(messages)::BIGINT AS messages, sum(tokens)::BIGINT AS tokens, round(sum(cost), 2) AS cost FROM (SELECT *, row_number() OVER (ORDER BY cost DESC, project) AS rn FROM by_project) GROUP BY 1", *ATTRIBUTED, PROJECTS)
def dashboard_projects_top12(spark, sf_dir):
    m = Model(spark, sf_dir)
    return dashboard.top_with_rest(closure.checkpointed(dashboard.projects(m.entries, m.costs(), m.usage(), FROM, TO))).withColumn("cost", F.round("cost", 2))


@query(f"SELECT project, slot, round(sum(cost), 2) AS cost FROM (SELECT project, cost, (13 - ({TO} // {DAY} - at_ms // {DAY}))::INT AS slot FROM costs) WHERE slot BETWEEN 0 AND 13 GROUP BY 1, 2", *ATTRIBUTED)
def project_sparkline(spark, sf_dir):
    return dashboard.sparkline(Model(spark, sf_dir).costs(), TO).withColumn("cost", F.round("cost", 2))


@query(f"SELECT ref, title, activity FROM entries WHERE {INSIDE} ORDER BY activity DESC, agent_name, session_id LIMIT 10", *BASE, CLOSURE_SQL)
def recent_sessions(spark, sf_dir):
    return dashboard.recent(Model(spark, sf_dir).entries, FROM, TO).select("ref", "title", "activity")


@query(f"""SELECT a.sessions, a.cost, a.tokens, round((a.sessions - b.sessions) * 100.0 / nullif(b.sessions, 0), 3) AS sessions_change, round((a.cost - b.cost) / nullif(b.cost, 0) * 100, 3) AS cost_change, round((a.tokens - b.tokens) * 100.0 / nullif(b.tokens, 0), 3) AS tokens_change,
  round(a.sessions / {SPAN // DAY}.0, 3) AS sessions_per_day, round(a.messages / a.sessions::DOUBLE, 3) AS messages_per_session, round(a.cache_read / a.tokens::DOUBLE, 3) AS cache_hit FROM ({totals_sql(FROM, TO)}) a, ({totals_sql(FROM - SPAN, FROM - 1, '0')}) b""", *ATTRIBUTED, attributed_sql(FROM - SPAN, FROM - 1, "0"))
def dashboard_ratios(spark, sf_dir):
    start, end = dashboard.previous_window(FROM, TO)
    m = Model(spark, sf_dir)
    now = _rounded(dashboard.totals(m.entries, m.costs(), m.usage(), FROM, TO))
    before = _rounded(dashboard.totals(m.entries, m.costs(start, end), m.usage(start, end), start, end))
    rows = dashboard.ratios(now, before, SPAN // DAY)
    return rows.select("sessions", "cost", "tokens", *[money(c, 3) for c in ("sessions_change", "cost_change", "tokens_change", "sessions_per_day", "messages_per_session", "cache_hit")])


MODEL_COSTS = "by_model AS (SELECT model, sum(cost) AS cost, row_number() OVER (ORDER BY sum(cost) DESC, model) AS rn FROM costs WHERE model IS NOT NULL GROUP BY 1)"


@query("SELECT model, round(cost, 2) AS cost FROM by_model WHERE rn <= 5 UNION ALL SELECT 'Other', round(sum(cost), 2) FROM by_model WHERE rn > 5 HAVING sum(cost) > 0.01 * (SELECT sum(cost) FROM by_model)", *ATTRIBUTED, MODEL_COSTS)
def model_composition(spark, sf_dir):
    costs = Model(spark, sf_dir).costs().where("model is not null").groupBy("model").agg(F.sum("cost").alias("cost"))
    return dashboard.composition(closure.checkpointed(costs)).withColumn("cost", F.round("cost", 2))


@query(f"SELECT round(max(c), 2) AS peak, round(avg(c), 2) AS average, round(sum(c), 2) AS total FROM (SELECT coalesce(sum(cost), 0) AS c FROM range({FROM}, {TO}, {DAY}) r(t) LEFT JOIN costs ON at_ms // {DAY} = t // {DAY} GROUP BY t)", *ATTRIBUTED)
def cost_curve(spark, sf_dir):
    rows = dashboard.curve(dashboard.daily_costs(Model(spark, sf_dir).costs(), FROM, TO))
    return rows.select(money("peak", 2), money("average", 2), money("total", 2))


@query("SELECT g.*, m.messages, m.tokens, m.cost FROM (SELECT project_kind, project_key, arg_min(project_name, ordinal) AS name, string_agg(DISTINCT agent_name, ',' ORDER BY agent_name) AS agents, count(*) AS sessions, max(activity) AS latest FROM entries GROUP BY 1, 2) g JOIN (SELECT project_kind, project_key, sum(messages)::BIGINT AS messages, sum(tokens)::BIGINT AS tokens, round(sum(cost), 2) AS cost FROM entries e JOIN incl i ON i.entry = e.ref GROUP BY 1, 2) m USING (project_kind, project_key)", *BASE, CLOSURE_SQL)
def project_metrics(spark, sf_dir):
    m = Model(spark, sf_dir)
    rows = dashboard.project_metrics(m.sessions, m.closure)
    return rows.withColumn("cost", F.round("cost", 2))


@query("SELECT count(DISTINCT (project_kind, project_key)) AS projects, count(*) AS sessions, max(activity) AS latest, count(*) FILTER (WHERE mount = 'orphan') AS orphans FROM entries", *BASE, CLOSURE_SQL)
def projects_summary(spark, sf_dir):
    return Model(spark, sf_dir).entries.agg(F.count_distinct("project_kind", "project_key").alias("projects"), F.count("*").alias("sessions"), F.max("activity").alias("latest"), F.count_if(F.col("mount") == "orphan").alias("orphans"))
