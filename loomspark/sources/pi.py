"""Sessions of Pi logs: a tree of entries in each JSON-lines file, of which the branch to the last entry is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions.parts import part
from loomspark.functions.text import first_line_title, parsed_millis, title_of
from loomspark.operators.transcript import branch_depths, cleaned
from loomspark.sources.jsonl import read_lines

USAGE = "STRUCT<input: LONG, output: LONG, cacheRead: LONG, cacheWrite: LONG, totalTokens: LONG, cost: STRUCT<total: DOUBLE>>"
MESSAGE = f"STRUCT<role: STRING, content: STRING, model: STRING, usage: {USAGE}, toolCallId: STRING, isError: BOOLEAN, display: BOOLEAN, summary: STRING, command: STRING, output: STRING, exitCode: LONG, cancelled: BOOLEAN>"
ENTRY = f"type STRING, id STRING, parentId STRING, timestamp STRING, cwd STRING, name STRING, summary STRING, content STRING, display BOOLEAN, message {MESSAGE}"
ITEMS = "ARRAY<STRUCT<type: STRING, text: STRING, thinking: STRING, id: STRING, name: STRING, arguments: STRING>>"


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Whole records with ref, the file name behind its first underscore."""
    stem = F.regexp_extract("file", r"([^/]+)\.jsonl$", 1)
    return read_lines(spark, path, ENTRY).where("not bad").select(F.regexp_replace(stem, "^[^_]*_(?=.)", "").alias("ref"), stem.alias("stem"), "changed", "line", "r.*")


def branches(entries: DataFrame) -> DataFrame:
    """Entries on the branch to each file's last one, with their depth; of repeated ids the last counts.

    Entries are shuffled by file, once: a file's depths are found from its ids alone and come as an array by the entries'
    places. All that follows is worked out file by file and needs no shuffle.
    """
    rows = entries.where("coalesce(type, '') <> 'session' and id <> ''")
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("ref").orderBy("line", "id", "parentId")) - 1)
    of_file = branch_depths(rows.select("ref", "place", "id", F.col("parentId").alias("parent_id")), "place")
    met = rows.join(of_file, "ref").withColumn("depth", F.get("depths", F.col("place")))
    return met.where("depth is not null").select("ref", "id", "depth", "type", "parentId", "timestamp", "name", "summary", "content", "display", "message")


def content_text(content: Column) -> Column:
    """A text, or the texts of its items with images named, a line each."""
    kept = F.filter(F.from_json(content, ITEMS), lambda i: (i["type"] == "image") | ((i["type"] == "text") & (i["text"] != "")))
    return F.coalesce(F.array_join(F.transform(kept, lambda i: F.when(i["type"] == "image", "[image]").otherwise(i["text"])), "\n"), content)


def _assistant_parts(content: Column) -> Column:
    items = F.coalesce(F.from_json(content, ITEMS), F.array().cast(ITEMS))
    name = lambda i: F.coalesce(F.when(F.trim(i["name"]) != "", F.trim(i["name"])), F.lit("tool"))
    made = F.transform(items, lambda i: F.when(i["type"] == "text", part(type=F.lit("text"), text=cleaned(i["text"])))
        .when(i["type"] == "thinking", part(type=F.lit("reasoning"), text=cleaned(i["thinking"])))
        .when(i["type"] == "toolCall", part(type=F.lit("tool"), tool=name(i), title=F.concat(F.lit("Tool: "), name(i)), call_id=F.trim(i["id"]), status=F.lit("running"), input=F.coalesce(i["arguments"], F.lit("{}")))))
    return F.filter(made, lambda p: (p["type"] == "tool") | p["text"].isNotNull())


def _read(branch: DataFrame) -> DataFrame:
    """branch with what transcripts() shows of each entry, shown, and message_index, which counts those that are shown."""
    m, kind = F.col("message"), F.when(F.col("type") == "message", F.col("message.role")).otherwise(F.concat(F.lit("entry "), "type"))
    entry_text = cleaned(F.when(F.col("type") == "custom_message", content_text(F.col("content"))).otherwise(F.col("summary")))
    role = (
        F.when((kind == "user") | (kind == "custom") & m["display"] | (kind == "entry custom_message") & F.col("display"), "user")
        .when(kind.isin("assistant", "branchSummary", "compactionSummary", "entry compaction", "entry branch_summary"), "assistant")
        .when(kind == "bashExecution", "tool")
    )
    failed = F.coalesce(m["exitCode"] != 0, F.lit(False)) | F.coalesce(m["cancelled"], F.lit(False))
    bash = part(type=F.lit("tool"), tool=F.lit("bash"), title=F.lit("Tool: bash"), status=F.when(failed, "error").otherwise("completed"), input=F.to_json(F.struct(F.coalesce(m["command"], F.lit("")).alias("command"))), output=m["output"])
    text = F.when(kind.startswith("entry "), entry_text).when(kind.endswith("Summary"), F.when(F.trim(m["summary"]) != "", F.trim(m["summary"]))).otherwise(cleaned(content_text(m["content"])))
    parts = F.when(kind == "assistant", _assistant_parts(m["content"])).when(kind == "bashExecution", F.array(bash)).when(text.isNotNull(), F.array(part(type=F.lit("text"), text=text)))
    own = kind == "assistant"
    read = dict(role=role, model=F.when(own, F.trim(m["model"])), time_created=parsed_millis(F.col("timestamp")), parts=parts, u=F.when(own, m["usage"]))
    rows = branch.select("*", *[c.alias(name) for name, c in read.items()])
    rows = rows.withColumn("shown", F.col("role").isNotNull() & F.coalesce(F.size("parts") > 0, F.lit(False)))
    rows = rows.withColumn("message_index", F.count_if("shown").over(W.partitionBy("ref").orderBy("depth")).cast("int") - 1)
    count = lambda c: F.coalesce(F.col(f"u.{c}"), F.lit(0).cast("long"))
    cached, create = count("cacheRead"), count("cacheWrite")
    whole = count("input") + cached + create
    cost = F.when(~F.isnan("u.cost.total") & (F.col("u.cost.total") != 0), F.col("u.cost.total"))
    return rows.withColumns({
        "input": whole, "output": count("output"), "cache_read": cached, "cache_create": create, "total": F.coalesce("u.totalTokens", whole + count("output")), "cost": cost, "cost_source": F.when(cost > 0, "recorded"),
    })


def transcripts(branch: DataFrame) -> DataFrame:
    """(ref, message_index, depth, id, role, model, time_created, parts, input, output, cache_read, cache_create, total, cost, cost_source)."""
    return _read(branch).where("shown").select("ref", "message_index", "depth", "id", "role", "model", "time_created", "parts", "input", "output", "cache_read", "cache_create", "total", "cost", "cost_source")


def tool_calls(branch: DataFrame, _shown: DataFrame | None = None) -> DataFrame:
    """(ref, message_index, call_id, tool, input, status, output): calls with the first result that follows; without one they are running.

    The branch's transcript is made along, so that its entries are read and shuffled once.
    """
    status = F.when(F.col("message.isError"), "error").otherwise("completed")
    is_result = (F.col("type") == "message") & (F.col("message.role") == "toolResult") & (F.trim("message.toolCallId") != "")
    result = F.when(is_result, F.struct(status.alias("status"), cleaned(content_text(F.col("message.content"))).alias("output")))
    calls = F.when(F.col("shown"), F.filter("parts", lambda p: p["type"] == "tool"))
    rows = _read(branch).select("ref", "message_index", "depth", F.when(is_result, F.trim("message.toolCallId")).alias("of"), result.alias("r"), calls.alias("calls"))
    rows = rows.select("ref", "message_index", "depth", "of", "r", F.explode_outer("calls").alias("p")).where("r is not null or p is not null")
    rows = rows.withColumn("call_id", F.coalesce("of", "p.call_id"))
    first = F.last("r", True).over(W.partitionBy("ref", "call_id").orderBy(F.desc("depth")))  # an entry is a result or has calls
    rows = rows.withColumn("first", first).where("p is not null")
    return rows.select("ref", "message_index", "call_id", "p.tool", "p.input", F.coalesce("first.status", "p.status").alias("status"), F.coalesce("first.output", "p.output").alias("output"))


def heads(entries: DataFrame, branch: DataFrame, _shown: DataFrame | None = None) -> DataFrame:
    """Heads of the sessions with a header and a visible message; the branch's transcript is made along, as for tool_calls()."""
    top = entries.where("type = 'session'").groupBy("ref").agg(F.min_by(F.struct("cwd", "timestamp", "stem", "changed"), "line").alias("h"))
    name = F.when(F.col("type") == "session_info", first_line_title(F.col("name")))
    said = F.when((F.col("type") == "message") & (F.col("message.role") == "user"), first_line_title(content_text(F.col("message.content"))))
    counts = ("input", "output", "cache_read", "cache_create")
    rows = _read(branch).select("ref", "depth", name.alias("name"), said.alias("said"), F.col("time_created").alias("at"), "shown", *[F.when(F.col("shown"), F.col(c)).alias(c) for c in (*counts, "cost", "cost_source")])
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("depth"))
    stats = rows.groupBy("ref").agg(
        F.max_by("name", at("name")).alias("name"), F.min_by("said", at("said")).alias("said"), F.max("at").alias("latest"),
        F.count_if("shown").alias("message_count"), *[F.sum(c).alias(c) for c in counts], F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"), F.max("cost_source").alias("cost_source"),
    ).where("message_count > 0")
    created = F.coalesce(parsed_millis(F.col("h.timestamp")), F.unix_millis("h.changed"))
    directory = F.coalesce(F.when(F.trim("h.cwd") != "", F.trim("h.cwd")), F.col("h.stem"))
    return top.join(stats, "ref").select(F.col("ref").alias("session_id"), title_of(F.col("name"), F.col("said"), directory).alias("title"), directory.alias("directory"), created.alias("time_created"), F.greatest("latest", created).alias("time_updated"), "message_count", *counts, "total_cost", "cost_source")


def model_usage(shown: DataFrame) -> DataFrame:
    """(ref, model, tokens) of messages with a model and tokens."""
    return shown.where("model <> '' and total > 0").groupBy("ref", "model").agg(F.sum("total").alias("tokens"))
