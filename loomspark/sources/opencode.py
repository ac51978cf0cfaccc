"""Sessions of the OpenCode family from their SQLite tables session, message and part.

A root is a session without a parent; the roots and all below them are shown, and so is every session where the
table has no parents, but for those marked as children of a task. Messages of internal kinds and messages
without a visible part are left out, and sessions that keep none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.parts import with_part
from loomspark.functions.text import first_line_title
from loomspark.operators.closure import mount
from loomspark.operators.transcript import is_internal_event
from loomspark.sources.sqlite import SqliteSource, column_names

MESSAGE = "type STRING, role STRING, agent STRING, mode STRING, modelID STRING, providerID STRING, cost DOUBLE, tokens STRUCT<input: LONG, output: LONG>"
TABLES = {
    "session": "id string, parent_id string, task_type string, title string, directory string, time_created long, time_updated long",
    "message": "id string, session_id string, time_created long, data string",
    "part": "id string, message_id string, time_created long, data string",
}


def read_table(spark: SparkSession, path: str, table: str, ranges: int = 8) -> DataFrame:
    """The columns of TABLES that the database has."""
    spark.dataSource.register(SqliteSource)
    has = column_names(path, table)
    schema = ", ".join(c for c in TABLES[table].split(", ") if c.split()[0] in has)
    return spark.read.format("sqlite").schema(schema).option("path", path).option("table", table).option("ranges", str(ranges)).load()


def shown_sessions(sessions: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """Roots active between since and until (milliseconds, inclusive), and all below them whatever their activity."""
    active = F.coalesce("time_updated", "time_created")
    inside = F.lit(True) if since is None else active >= since
    inside = inside if until is None else inside & (active <= until)
    if "parent_id" not in sessions.columns:
        own = sessions.where("coalesce(task_type, '') <> 'subagent_child'") if "task_type" in sessions.columns else sessions
        return own.where(inside)
    tree = mount(sessions.select(F.col("id").alias("ref"), F.col("parent_id").alias("parent_ref")))
    roots = tree.where("mount = 'root'").select(F.col("ref").alias("entry"))
    roots = roots.join(sessions.where(inside).select(F.col("id").alias("entry")), "entry", "left_semi")
    return sessions.join(tree.join(roots, "entry", "left_semi").select(F.col("ref").alias("id")), "id", "left_semi")


def transcripts(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """(session_id, id, time_created, role, model, input, output, cost, cost_source, parts), parts in order of time and id.

    cost is the recorded one; without one it is null, for the price table to fill.
    """
    shown = with_part(parts.where("coalesce(message_id, '') <> ''").select("message_id", "time_created", "id", "data"), "part")
    order = F.array_sort(F.collect_list(F.struct("time_created", "id", "part")))
    held = shown.groupBy(F.col("message_id").alias("id")).agg(F.transform(order, lambda x: x["part"]).alias("parts"))
    rows = messages.select("session_id", "id", "time_created", F.explode_outer(F.array(F.from_json("data", MESSAGE))).alias("m"))  # generated, so read once
    rows = rows.where(~is_internal_event(F.coalesce("m.type", F.lit(""))))
    role = F.when(F.col("m.role").isin("user", "assistant", "tool"), F.col("m.role")).otherwise("assistant")
    cost = F.when(F.col("m.cost") > 0, F.col("m.cost"))
    count = lambda c: F.coalesce(f"m.tokens.{c}", F.lit(0).cast("long")).alias(c)
    return rows.join(held, "id").select("session_id", "id", "time_created", role.alias("role"), F.col("m.modelID").alias("model"), count("input"), count("output"), cost.alias("cost"), F.when(cost > 0, "recorded").alias("cost_source"), "parts")


def heads(sessions: DataFrame, shown: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """Heads of the sessions of shown_sessions() with the transcripts() shown."""
    texts = F.transform(F.filter("parts", lambda p: p["type"] == "text"), lambda p: first_line_title(p["text"]))
    said = F.when(F.col("role") == "user", F.get(F.filter(texts, lambda t: t.isNotNull()), F.lit(0)))
    rows = shown.withColumn("said", said)
    at = F.when(F.col("said").isNotNull(), F.struct("time_created", "id"))
    estimated = F.bool_or(F.coalesce(F.col("cost_source") == "estimated", F.lit(False)))
    stats = rows.groupBy(F.col("session_id").alias("id")).agg(
        F.count("*").alias("message_count"), F.sum("input").alias("input_tokens"), F.sum("output").alias("output_tokens"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
        estimated.alias("estimated"), F.min_by("said", at).alias("said"),
    )
    source = F.when(F.col("estimated"), "estimated").when(F.col("total_cost") > 0, "recorded")
    parent = F.when(F.col("parent_id") != "", F.col("parent_id")) if "parent_id" in sessions.columns else F.lit(None).cast("string")
    title = F.coalesce(first_line_title(F.col("title")), "said", F.lit("Untitled Session"))
    return shown_sessions(sessions, since, until).where("id <> ''").join(stats, "id").select(
        F.col("id").alias("session_id"), parent.alias("parent_id"), title.alias("title"), "directory", "time_created", F.coalesce("time_updated", "time_created").alias("time_updated"),
        "message_count", "input_tokens", "output_tokens", "total_cost", source.alias("cost_source"),
    )
