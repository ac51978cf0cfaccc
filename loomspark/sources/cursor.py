"""Sessions of Cursor's key-value table: composers under composerData:<id>, their messages under bubbleId:<composer>:<id>.

Messages stand in order of insertion. Those of subagents, kept under bubble:<id>, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions.parts import part
from loomspark.functions.text import first_line_title
from loomspark.operators.transcript import cleaned, is_internal_event
from loomspark.sources.sqlite import SqliteSource

COMPOSER = "id STRING, composerId STRING, text STRING, name STRING, title STRING, createdAt LONG, updatedAt LONG, lastSendTime LONG, lastUpdatedAt LONG, model STRING, modelConfig STRUCT<modelName: STRING>, inputTokenCount LONG, outputTokenCount LONG, subagentInfos ARRAY<STRUCT<id: STRING>>"
TOOL = "STRUCT<name: STRING, toolCallId: STRING, status: STRING, params: STRING, result: STRING>"
BUBBLE = f"type LONG, text STRING, requestId STRING, createdAt LONG, timestamp LONG, timingInfo STRUCT<clientRpcSendTime: DOUBLE>, tokenCount STRUCT<inputTokens: LONG, outputTokens: LONG>, modelInfo STRUCT<modelName: STRING>, eventType STRING, kind STRING, subtype STRING, name STRING, toolFormerData {TOOL}"
#: Names of tools and what they are shown as.
TOOLS = {"read_file_v2": "read", "edit_file_v2": "edit", "run_terminal_command_v2": "bash", "ripgrep_raw_search": "grep", "glob_file_search": "glob"}


COMPOSERS, BUBBLES = "composerData:", "bubbleId:"


def read_pairs(spark: SparkSession, path: str, ranges: int = 8, beginning: str = "", push: bool = False) -> DataFrame:
    """(rowid, key, value) of the keys that begin so, which SQLite reads as a range of keys; push lets filters reach SQLite, too."""
    spark.dataSource.register(SqliteSource)
    return spark.read.option("push", str(push)).option("column", "key").option("beginning", beginning).format("sqlite").schema("rowid long, key string, value string").option("path", path).option("table", "cursorDiskKV").option("ranges", str(ranges)).load()


def composers(pairs: DataFrame) -> DataFrame:
    """Parsed composers with an id; malformed values are left out."""
    rows = pairs.where(F.col("key").startswith(COMPOSERS)).select("rowid", F.from_json("value", COMPOSER).alias("c")).select("rowid", "c.*")
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    return rows.select("rowid", F.coalesce(text("id"), text("composerId")).alias("session_id"), F.coalesce("modelConfig.modelName", "model").alias("model"), F.coalesce(text("name"), text("title")).alias("title"), "text", F.coalesce("createdAt", F.lit(0)).alias("time_created"),
        F.coalesce("updatedAt", "lastUpdatedAt", "lastSendTime", "createdAt").alias("time_updated"), F.coalesce("inputTokenCount", F.lit(0)).alias("input"), F.coalesce("outputTokenCount", F.lit(0)).alias("output"), (F.coalesce(F.size("subagentInfos"), F.lit(0)) > 0).alias("has_subagents")).where("session_id is not null")


def transcripts(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """(session_id, rowid, id, role, model, time_created, parts, input, output, request_id) of the composers in heads.

    A message without a model takes that of the last one before it that names one, at first its composer's.
    """
    rows = pairs.where(F.col("key").startswith(BUBBLES)).select("rowid", F.split("key", ":").alias("k"), "value").select("rowid", F.get("k", F.lit(1)).alias("session_id"), F.element_at("k", -1).alias("bubble"), F.from_json("value", BUBBLE).alias("b"))
    internal = [F.coalesce(is_internal_event(F.col(f"b.{c}")), F.lit(False)) for c in ("eventType", "kind", "subtype", "name")]
    rows = rows.where(~(internal[0] | internal[1] | internal[2] | internal[3])).join(heads.select("session_id", F.col("model").alias("first_model")), "session_id")
    before = W.partitionBy("session_id").orderBy("rowid").rowsBetween(W.unboundedPreceding, 0)
    named = F.last(F.when(F.col("b.modelInfo.modelName") != "", F.col("b.modelInfo.modelName")), ignorenulls=True).over(before)
    tool, status = F.col("b.toolFormerData"), F.expr("CASE b.toolFormerData.status WHEN 'completed' THEN 'completed' WHEN 'error' THEN 'error' WHEN 'failed' THEN 'error' ELSE 'running' END")
    shown_as = tool["name"]
    for name, label in TOOLS.items():
        shown_as = F.when(tool["name"] == name, label).otherwise(shown_as)
    shown_as = F.when(tool["name"] == "create_plan", "plan").otherwise(shown_as)
    failure = F.coalesce(*[F.get_json_object(tool["result"], f"$.{k}") for k in ("error", "message", "stderr")], tool["result"])
    plan = F.when(tool["name"] == "create_plan", F.trim(F.get_json_object(tool["params"], "$.plan")))
    call = part(type=F.lit("tool"), tool=shown_as, title=F.concat(F.lit("Tool: "), shown_as), call_id=F.coalesce(tool["toolCallId"], F.lit("")), status=status, input=tool["params"], output=tool["result"], error=F.when(status == "error", failure))
    second = F.when(plan != "", part(type=F.lit("plan"), text=plan, status=F.when(status == "completed", "success").otherwise("fail"))).when(tool["name"] != "", call)
    text = cleaned(F.col("b.text"))
    parts = F.filter(F.array(F.when(text.isNotNull(), part(type=F.lit("text"), text=text)), second), lambda p: p.isNotNull())
    sent = lambda c: F.when(F.col(c) != 0, F.floor(c).cast("long"))
    rows = rows.select(
        "session_id", "rowid", F.concat_ws("-", F.lit("cursor"), "session_id", "bubble").alias("id"), F.when(F.col("b.type") == 2, "assistant").otherwise("user").alias("role"), F.coalesce(named, "first_model").alias("model"),
        F.coalesce(sent("b.timingInfo.clientRpcSendTime"), sent("b.createdAt"), sent("b.timestamp"), F.lit(0)).alias("time_created"), parts.alias("parts"),
        F.coalesce("b.tokenCount.inputTokens", F.lit(0)).alias("input"), F.coalesce("b.tokenCount.outputTokens", F.lit(0)).alias("output"), F.trim("b.requestId").alias("request_id"),
    )
    return rows.where("size(parts) > 0")


def heads(found: DataFrame, shown: DataFrame) -> DataFrame:
    """Heads of composers() with a visible message or subagents; tokens are the composer's own counts."""
    titles = F.transform(F.filter("parts", lambda p: p["type"] == "text"), lambda p: first_line_title(p["text"]))
    said = shown.withColumn("said", F.when(F.col("role") == "user", F.get(F.filter(titles, lambda t: t.isNotNull()), F.lit(0))))
    stats = said.groupBy("session_id").agg(F.count("*").alias("message_count"), F.min_by("said", F.when(F.col("said").isNotNull(), F.col("rowid"))).alias("said"))
    title = F.coalesce(first_line_title(F.col("title")), "said", first_line_title(F.col("text")), F.lit("Untitled Session"))
    rows = found.join(stats, "session_id", "left").where("message_count > 0 or has_subagents")
    return rows.select("session_id", title.alias("title"), "time_created", F.when(F.col("time_updated") != 0, F.col("time_updated")).alias("time_updated"), F.coalesce("message_count", F.lit(0)).alias("message_count"), "input", "output")
