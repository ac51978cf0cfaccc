"""JSON-lines logs: readers and two adapters that normalise records to sessions and messages.

Lines are read as text and parsed with explicit schemas; malformed lines are counted, not fatal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.functions.text import first_line_title, parsed_millis

USAGE = "input_tokens LONG, output_tokens LONG, cache_read_input_tokens LONG, cache_creation_input_tokens LONG"
CLAUDE = f"type STRING, uuid STRING, requestId STRING, timestamp STRING, cwd STRING, message STRUCT<role STRING, model STRING, content STRING, usage STRUCT<{USAGE.replace(' LONG', ': LONG')}>>"
COUNTS = "STRUCT<input_tokens: LONG, output_tokens: LONG, reasoning_output_tokens: LONG, cached_input_tokens: LONG, total_tokens: LONG>"
CODEX = f"timestamp STRING, type STRING, payload STRUCT<type STRING, role STRING, id STRING, cwd STRING, model STRING, content STRING, name STRING, arguments STRING, info STRUCT<last_token_usage: {COUNTS}, total_token_usage: {COUNTS}>>"


def read_lines(spark: SparkSession, path: str, schema: str, glob: str = "*.jsonl", after: str | None = None, raw: bool = False) -> DataFrame:
    """(file, changed, line, r, bad): parsed records of all files below path in file order; bad marks lines that don't parse.

    after prunes files by modification time; raw gives each record as VARIANT in a column raw, in place of r.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if after:
        reader = reader.option("modifiedAfter", after)
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("line"), F.trim("value").alias("value"))
    rows = rows.where("value <> ''")
    if raw:
        return rows.withColumn("raw", F.try_parse_json("value")).select("file", "changed", "line", "raw", F.col("raw").isNull().alias("bad"))
    rows = rows.withColumn("bad", F.try_parse_json("value").isNull())
    return rows.select("file", "changed", "line", F.from_json("value", schema).alias("r"), "bad")


def skipped(lines: DataFrame) -> DataFrame:
    """(file, lines, skipped) per file."""
    return lines.groupBy("file").agg(F.count("*").alias("lines"), F.count_if("bad").alias("skipped"))


def _visible_text(content: Column) -> Column:
    """A content that is a text, or the text parts of an array."""
    parts = F.from_json(content, "ARRAY<STRUCT<type STRING, text STRING>>")
    texts = F.array_join(F.transform(F.filter(parts, lambda p: p["type"].isin("text", "input_text", "output_text")), lambda p: p["text"]), "\n")
    return F.coalesce(F.when(content.startswith("["), texts), content)


def claude_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of Claude-style logs. Assistant usage counts once for each request; input includes cache tokens."""
    rows = read_lines(spark, path, CLAUDE).where("not bad and r.message.role in ('user', 'assistant')")
    rows = rows.select(
        F.regexp_extract("file", r"([^/]+)\.jsonl$", 1).alias("session_id"), "line", F.col("r.message.role").alias("role"), F.col("r.message.model").alias("model"), F.col("r.cwd").alias("directory"),
        parsed_millis(F.col("r.timestamp")).alias("time_created"), _visible_text(F.col("r.message.content")).alias("text"), F.col("r.message.usage").alias("u"), F.coalesce("r.requestId", "r.uuid").alias("request"),
    ).where("role = 'assistant' or coalesce(text, '') <> ''")
    first = rows.where("u is not null").groupBy("session_id", "request").agg(F.min("line").alias("line")).withColumn("first", F.lit(True))
    rows = rows.join(first, ["session_id", "request", "line"], "left")
    count = lambda c: F.when(F.col("first"), F.coalesce(f"u.{c}", F.lit(0))).otherwise(0).cast("long")
    read, create = count("cache_read_input_tokens"), count("cache_creation_input_tokens")
    return rows.select("session_id", "line", "role", "model", "directory", "time_created", "text", (count("input_tokens") + read + create).alias("input"), count("output_tokens").alias("output"), read.alias("cache_read"), create.alias("cache_create"))


def codex_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of Codex-style rollout logs; token rows stay for usage.token_deltas()."""
    rows = read_lines(spark, path, CODEX, "rollout-*.jsonl").where("not bad")
    rows = rows.withColumn("session_id", F.regexp_extract("file", r"rollout-[0-9T-]{19}-(.+)\.jsonl$", 1))
    shown = rows.where("r.type = 'response_item' and r.payload.type in ('message', 'function_call', 'function_call_output')")
    role = F.when(F.col("r.payload.type") == "message", F.col("r.payload.role")).otherwise("tool")
    return shown.select("session_id", "line", role.alias("role"), F.col("r.payload.model").alias("model"), parsed_millis(F.col("r.timestamp")).alias("time_created"), _visible_text(F.col("r.payload.content")).alias("text"), F.col("r.payload.name").alias("tool"))


def codex_usage(spark: SparkSession, path: str) -> DataFrame:
    """Records for usage.token_deltas()."""
    rows = read_lines(spark, path, CODEX, "rollout-*.jsonl").where("not bad and r.payload.type = 'token_count'")
    last, total = "r.payload.info.last_token_usage.", "r.payload.info.total_token_usage."
    fields = {"input": "input_tokens", "output": "output_tokens", "reasoning": "reasoning_output_tokens", "cached": "cached_input_tokens"}
    number = F.row_number().over(W.partitionBy("file").orderBy("line")).cast("long")
    return rows.select(F.regexp_extract("file", r"rollout-[0-9T-]{19}-(.+)\.jsonl$", 1).alias("ref"), number.alias("line"), F.col(total + "total_tokens").alias("total"), *[F.col(p + f).alias(f"{n}_{k}") for n, p in (("total", total), ("last", last)) for k, f in fields.items()])


def session_heads(messages: DataFrame, agent: str) -> DataFrame:
    """Heads from normalised messages: counts, sums, times and the first user text as title; sessions without messages have none."""
    sums = [F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_create") if c in messages.columns]
    title = first_line_title(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("line"))))
    return messages.groupBy("session_id").agg(F.lit(agent).alias("agent_name"), F.coalesce(title, F.lit("Untitled Session")).alias("title"), F.count("*").alias("message_count"), F.min("time_created").alias("time_created"), F.max("time_created").alias("time_updated"), *sums)
