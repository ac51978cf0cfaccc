"""Registered queries: the adapters' transcripts and heads over records made from the lens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.parts import with_part
from loomspark.plans.analytics import Model
from loomspark.plans.lens import BASE, CLOSURE_SQL, FACTS_SQL, with_sql
from loomspark.sources import opencode, pi

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str, *parts: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = with_sql(*parts) + sql
        return function

    return add


def _json(**fields: str) -> F.Column:
    """A JSON object of SQL expressions; null fields are left out."""
    return F.to_json(F.struct(*[F.expr(v).alias(k) for k, v in fields.items()]))


def _opencode(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = Model(spark, sf_dir)
    sessions = m.heads.select(F.col("ref").alias("id"), F.col("parent_ref").alias("parent_id"), F.expr("if(ordinal % 3 = 0, ' ', title) AS title"), "directory", "time_created", "time_updated")
    data = _json(type="if(message_index % 5 = 4, 'queue-operation', null)", role="role", modelID="model", cost="if(message_index % 3 = 0, 0, cost)", tokens="named_struct('input', input, 'output', output)")
    rows = m.facts.withColumn("id", F.concat_ws("/", "ref", "message_index"))
    messages = rows.select("id", F.col("ref").alias("session_id"), F.col("message_index").cast("long").alias("time_created"), data.alias("data"))
    text = _json(type="if(message_index % 4 = 3, 'progress', 'text')", text="concat('<system-reminder>x</system-reminder>', path)")
    tool = _json(type="'tool'", title="concat('Tool: ', tool)", state="named_struct('status', if(message_index % 2 = 0, 'success', null), 'result', if(message_index % 3 = 2, path, null))")
    both = F.array(F.struct(F.lit("1").alias("id"), text.alias("data")), F.struct(F.lit("2").alias("id"), F.when(F.col("role") == "tool", tool).alias("data")))
    parts = rows.select(F.col("id").alias("message_id"), F.lit(1).cast("long").alias("time_created"), F.inline(both)).where("data is not null")
    return sessions, messages, parts


SEEN = "seen AS (SELECT * FROM facts WHERE message_index % 5 <> 4 AND (message_index % 4 <> 3 OR role = 'tool'))"


@query("""SELECT s.ref AS session_id, s.parent_ref AS parent_id, CASE WHEN ordinal % 3 <> 0 THEN title ELSE coalesce(x.said, 'Untitled Session') END AS title, x.n AS message_count, x.input AS input_tokens, x.output AS output_tokens, round(x.cost, 2) AS total_cost,
  CASE WHEN x.cost > 0 THEN 'recorded' END AS cost_source
  FROM sessions s JOIN (SELECT ref, count(*) AS n, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, coalesce(sum(cost) FILTER (WHERE message_index % 3 <> 0), 0) AS cost, arg_min(path, message_index) FILTER (WHERE role = 'user' AND message_index % 4 <> 3) AS said FROM seen GROUP BY 1) x USING (ref)
  WHERE ref IN (SELECT c.ref FROM closure c JOIN closure e ON e.ref = c.entry WHERE e.mount = 'root')""", *BASE, CLOSURE_SQL, FACTS_SQL, SEEN)
def opencode_heads(spark, sf_dir):
    sessions, messages, parts = _opencode(spark, sf_dir)
    rows = opencode.heads(sessions, opencode.transcripts(messages, parts))
    return rows.select("session_id", "parent_id", "title", "message_count", "input_tokens", "output_tokens", F.round("total_cost", 2).alias("total_cost"), "cost_source")


@query("""SELECT ref || '/' || message_index AS message_id, 'text' AS type, path AS text, NULL AS tool, NULL AS status, NULL AS output FROM facts WHERE message_index % 4 <> 3
  UNION ALL SELECT ref || '/' || message_index, 'tool', NULL, tool, CASE WHEN message_index % 2 = 0 OR message_index % 3 = 2 THEN 'completed' ELSE 'running' END, CASE WHEN message_index % 3 = 2 THEN path END FROM facts WHERE role = 'tool'""", *BASE, FACTS_SQL)
def message_parts(spark, sf_dir):
    parts = with_part(_opencode(spark, sf_dir)[2].select("message_id", "data"), "p")
    return parts.select("message_id", "p.type", "p.text", "p.tool", "p.status", "p.output")


def _pi(spark, sf_dir) -> DataFrame:
    """Each session's messages as a chain of entries, but that entry 2 follows entry 0, behind a header."""
    m = Model(spark, sf_dir)
    said = _json(
        role="if(role = 'tool', 'toolResult', role)", toolCallId="if(role = 'tool', concat('c', message_index - 1), null)", isError="message_index % 2 = 1", model="model",
        content="if(role = 'assistant', to_json(array(named_struct('type', 'text', 'text', path, 'id', null, 'name', null), named_struct('type', 'toolCall', 'text', null, 'id', concat('c', message_index), 'name', tool))), path)",
        usage="if(role = 'assistant', named_struct('input', input, 'output', output, 'cacheRead', cache_read, 'cacheWrite', cache_create, 'cost', named_struct('total', cost)), null)",
    )
    empty = [F.lit(None).cast("string").alias(c) for c in ("name", "summary", "content")]
    after = F.expr("cast(if(message_index = 2, 0, if(message_index = 0, null, message_index - 1)) AS string)")
    facts = m.facts.repartition("ref")  # before JSON is made of them
    entries = facts.select("ref", F.col("message_index").cast("long").alias("line"), F.lit("message").alias("type"), F.col("message_index").cast("string").alias("id"), after.alias("parentId"), F.col("time_created").cast("string").alias("timestamp"), F.lit(None).cast("string").alias("cwd"), *empty, F.lit(None).cast("boolean").alias("display"), F.from_json(said, pi.MESSAGE).alias("message"))
    top = m.heads.select("ref", F.lit(-1).cast("long").alias("line"), F.lit("session").alias("type"), F.col("time_created").cast("string").alias("timestamp"), F.col("directory").alias("cwd"))
    both = entries.unionByName(top, allowMissingColumns=True)
    return both.withColumns({"stem": F.col("ref"), "changed": F.lit(None).cast("timestamp")})


BRANCH = "branch AS (SELECT f.*, count(*) OVER (PARTITION BY ref) AS n FROM facts f QUALIFY NOT (message_index = 1 AND n >= 3))"


@query("""SELECT ref AS session_id, any_value(path) FILTER (WHERE message_index = 0) AS title, any_value(s.directory) AS directory, any_value(s.time_created) AS time_created, greatest(max(b.time_created), any_value(s.time_created)) AS time_updated,
  count(*) FILTER (WHERE role <> 'tool') AS message_count, coalesce(sum(b.input + b.cache_read + b.cache_create) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS input, coalesce(sum(b.output) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS output,
  round(coalesce(sum(b.cost) FILTER (WHERE role = 'assistant'), 0), 2) AS total_cost FROM branch b JOIN sessions s USING (ref) GROUP BY 1""", *BASE, FACTS_SQL, BRANCH)
def pi_heads(spark, sf_dir):
    entries = _pi(spark, sf_dir)
    branch = pi.branches(entries)
    rows = pi.heads(entries, branch, pi.transcripts(branch))
    return rows.select("session_id", "title", "directory", "time_created", "time_updated", "message_count", "input", "output", F.round("total_cost", 2).alias("total_cost"))


@query("""SELECT c.ref, 'c' || c.message_index AS call_id, c.tool, CASE WHEN r.ref IS NULL THEN 'running' WHEN r.message_index % 2 = 1 THEN 'error' ELSE 'completed' END AS status, r.path AS output
  FROM branch c LEFT JOIN branch r ON r.ref = c.ref AND r.message_index = c.message_index + 1 AND r.role = 'tool' WHERE c.role = 'assistant'""", *BASE, FACTS_SQL, BRANCH)
def pi_tool_calls(spark, sf_dir):
    branch = pi.branches(_pi(spark, sf_dir))
    return pi.tool_calls(branch, pi.transcripts(branch)).select("ref", "call_id", "tool", "status", "output")
