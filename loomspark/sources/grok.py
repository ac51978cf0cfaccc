"""Sessions of Grok logs: a folder with summary.json and updates.jsonl, whose rewind markers take back earlier records.

Which records survive is three running values in one window each. The level of a record is the number of prompts begun
before it that no marker had taken back by then: a marker with target t lets at most t of them stand, so the level is
the running count of prompts plus the least, so far, of zero and of each marker's target less its own running count. A
record survives if no later marker's target is below its level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.functions.parts import filled, given, is_object, member, part, shown, text_in
from loomspark.functions.text import first_line_title, once, parsed_millis, title_of
from loomspark.operators import builder
from loomspark.operators.transcript import cleaned
from loomspark.sources.jsonl import read_lines

#: The two methods of updates, names of tools with a title of their own, states of tools, and ticks of a dollar.
PLAIN_METHOD, OWN_METHOD = "session/update", "_x.ai/session/update"
TITLES = {"get_command_or_subagent_output": "task", "grep": "grep", "list_dir": "list", "read_file": "read", "run_terminal_command": "bash", "search_replace": "edit", "todo_write": "todo", "web_fetch": "web fetch"}
STATUS = {"completed": "completed", "failed": "error", "in_progress": "running", "pending": "running"}
TICKS = 10_000_000_000
#: The largest whole number that the logs' writer keeps exact.
EXACT = (1 << 53) - 1

SUMMARY = "info STRUCT<id STRING, cwd STRING>, generated_title STRING, session_summary STRING, created_at STRING, updated_at STRING, last_active_at STRING, current_model_id STRING, parent_session_id STRING"


def whole(value: Column) -> Column:
    """A JSON number that is whole, exact and not negative."""
    n = F.when(F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), value.try_cast("double"))
    return F.when((n >= 0) & (n <= EXACT) & (n == F.floor(n)), n.cast("long"))


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(folder, ref, cwd, title, created, updated, model, parent) of the summaries with an id and a folder."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "summary.json").load(path)
    rows = files.select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder"), F.unix_millis("_metadata.file_modification_time").alias("changed"), F.from_json("value", SUMMARY).alias("s"))
    ref, cwd = filled(F.trim("s.info.id")), filled(F.trim("s.info.cwd"))
    created = F.coalesce(parsed_millis(F.col("s.created_at")), "changed")
    updated = F.coalesce(parsed_millis(F.col("s.last_active_at")), parsed_millis(F.col("s.updated_at")), created)
    title = F.coalesce(filled(F.trim("s.generated_title")), filled(F.trim("s.session_summary")))
    parent = F.when(F.trim("s.parent_session_id") != ref, filled(F.trim("s.parent_session_id")))
    out = rows.select("folder", ref.alias("ref"), cwd.alias("cwd"), title.alias("title"), created.alias("created"), updated.alias("updated"), filled(F.trim("s.current_model_id")).alias("model"), parent.alias("parent"))
    return out.where("ref is not null and cwd is not null")


def read_updates(spark: SparkSession, path: str, summaries: DataFrame) -> DataFrame:
    """(ref, line, raw, created, model) of the lines of updates.jsonl that parse, raw as VARIANT."""
    lines = read_lines(spark, path, "x STRING", "updates.jsonl", raw=True).where("not bad")
    rows = lines.select(F.regexp_replace("file", "/[^/]*$", "").alias("folder"), "line", "raw").join(summaries.select("folder", "ref", "created", "model"), "folder")
    return rows.withColumn("line", F.row_number().over(W.partitionBy("ref").orderBy("line")).cast("long")).drop("folder")


def records(updates: DataFrame) -> DataFrame:
    """updates with the fields of their records: method, type, at, prompt, own, host, update and others; type is null without an update."""
    params = once(F.col("raw"), lambda r: F.when(is_object(member(r, "params")), member(r, "params")).otherwise(r))
    rows = updates.withColumn("params", params).withColumns({"update": F.when(is_object(member(F.col("params"), "update")), member(F.col("params"), "update")), "method": F.coalesce(text_in(member(F.col("raw"), "method")), F.lit(PLAIN_METHOD))})
    u, meta = F.col("update"), F.col("meta")
    seconds = whole(member(F.col("raw"), "timestamp"))
    rows = rows.withColumn("meta", F.when(is_object(member(F.col("params"), "_meta")), member(F.col("params"), "_meta")))
    return rows.select(
        "ref", "line", "created", "model", "method", "update", F.when(u.isNotNull(), F.coalesce(text_in(member(u, "sessionUpdate")), F.lit(""))).alias("type"),
        F.coalesce(whole(member(meta, "agentTimestampMs")), F.when(seconds <= EXACT // 1000, seconds * 1000), "created").alias("at"),
        filled(F.trim(text_in(member(meta, "promptId")))).alias("prompt"), filled(text_in(member(meta, "eventId"))).alias("event"),
        whole(F.try_variant_get(u, "$._meta.promptIndex", "variant")).alias("prompt_index"), F.coalesce(F.try_variant_get(u, "$._meta.hostTurn", "boolean"), F.lit(False)).alias("host"),
        whole(member(u, "target_prompt_index")).alias("target"),
    )


def surviving(rows: DataFrame) -> DataFrame:
    """The rows(ref, line, method, type, prompt_index, host, target) that no rewind marker takes back, without the markers.

    A run of a user's chunks with one prompt index begins a prompt; once a session has shown an index, those without
    one don't count.
    """
    order = W.partitionBy("ref").orderBy("line")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    own = F.coalesce(F.col("method") == OWN_METHOD, F.lit(False))
    marker = own & F.coalesce(F.col("type") == "rewind_marker", F.lit(False)) & F.col("target").isNotNull()
    said = ~own & F.coalesce(F.col("type") == "user_message_chunk", F.lit(False)) & ~F.col("host")
    rows = rows.withColumns({"_marker": marker, "_said": said, "_index": F.when(said, F.col("prompt_index"))})
    seen = F.max(F.col("_index").isNotNull()).over(so_far)
    new = F.col("_said") & (~F.coalesce(F.lag("_said").over(order), F.lit(False)) | ~F.lag("_index").over(order).eqNullSafe(F.col("_index")))
    rows = rows.withColumn("_starts", new & (F.col("_index").isNotNull() | ~seen))
    rows = rows.withColumn("_count", F.sum(F.col("_starts").cast("long")).over(so_far))
    limit = F.least(F.lit(0), F.coalesce(F.min(F.when(F.col("_marker"), F.col("target") - F.col("_count"))).over(so_far), F.lit(0)))
    back = W.partitionBy("ref").orderBy(F.desc("line")).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_level", F.col("_count") + limit).withColumn("_least", F.min(F.when(F.col("_marker"), F.col("target"))).over(back))
    kept = ~F.col("_marker") & (F.col("_least").isNull() | (F.col("_level") <= F.col("_least")))
    return rows.where(kept).drop("_marker", "_said", "_index", "_starts", "_count", "_level", "_least")


def block_text(content: Column) -> Column:
    """The text of a content block, or of its resource."""
    own = once(content, lambda c: F.when(text_in(member(c, "type")) == "text", text_in(member(c, "text"))).otherwise(text_in(F.try_variant_get(c, "$.resource.text", "variant"))))
    return filled(own)


def block_part(content: Column) -> Column:
    """A user's part: an image with data or an address, else a text; null if it is neither."""

    def made(c: Column) -> Column:
        url = F.coalesce(text_in(member(c, "uri")), text_in(member(c, "url")))
        drawn = filled(text_in(member(c, "data"))).isNotNull() & filled(F.coalesce(text_in(member(c, "mimeType")), text_in(member(c, "mime_type")))).isNotNull()
        image = F.when((text_in(member(c, "type")) == "image") & (drawn | filled(url).isNotNull()), part(type=F.lit("image"), text=url))
        return F.coalesce(image, once(block_text(c), lambda t: F.when(t.isNotNull(), part(type=F.lit("text"), text=t))))

    return once(content, made)


def plan_part(entries: Column) -> Column:
    """A plan's entries as a list with marks; it succeeds when all are completed."""
    items = F.transform(entries.try_cast("array<variant>"), lambda e: F.struct(cleaned(text_in(member(e, "content"))).alias("text"), F.coalesce(text_in(member(e, "status")), F.lit("pending")).alias("status")))

    def made(kept: Column) -> Column:
        lines = F.transform(kept, lambda e: F.concat(F.when(e["status"] == "completed", "- [x] ").otherwise("- [ ] "), e["text"]))
        status = F.when(F.forall(kept, lambda e: e["status"] == "completed"), "success").otherwise("fail")
        return F.when(F.size(kept) > 0, part(type=F.lit("plan"), text=F.array_join(lines, "\n"), status=status))

    return once(F.filter(items, lambda e: e["text"].isNotNull()), made)


def tool_output(update: Column) -> Column:
    """The raw output, else the texts of the content, else the content."""

    def of_content(content: Column) -> Column:
        blocks = F.transform(content.try_cast("array<variant>"), lambda i: F.when(text_in(member(i, "type")) == "content", member(i, "content")).otherwise(i))
        texts = F.filter(F.transform(blocks, block_text), lambda t: t.isNotNull())
        return once(texts, lambda t: F.when(F.size(t) > 0, F.array_join(t, "\n")).otherwise(shown(content)))

    return F.coalesce(shown(member(update, "rawOutput")), once(member(update, "content"), lambda c: F.when(F.schema_of_variant(c).startswith("ARRAY"), of_content(c))))


def usage_of(update: Column) -> Column:
    """(tokens, total, cost, known, models) of a completed turn; a cost is known unless it is zero or in part."""

    def made(u: Column) -> Column:
        count = lambda name: F.coalesce(whole(member(u, name)), F.lit(0).cast("long"))
        some = lambda name: F.when(count(name) > 0, count(name))
        tokens = F.struct(count("inputTokens").alias("input"), count("outputTokens").alias("output"), some("reasoningTokens").alias("reasoning"), some("cachedReadTokens").alias("cache_read"), some("cacheCreationTokens").alias("cache_create"))
        total = F.coalesce(some("totalTokens"), count("inputTokens") + count("outputTokens"))
        part_only = F.coalesce(F.try_variant_get(u, "$.usageIsIncomplete", "boolean"), F.lit(False)) | F.coalesce(F.try_variant_get(u, "$.costIsPartial", "boolean"), F.lit(False))
        each = lambda v, name: F.coalesce(whole(member(v, name)), F.lit(0).cast("long"))
        models = F.transform_values(member(u, "modelUsage").try_cast("map<string,variant>"), lambda _, v: F.when(each(v, "totalTokens") > 0, each(v, "totalTokens")).otherwise(each(v, "inputTokens") + each(v, "outputTokens")))
        return F.struct(tokens.alias("tokens"), total.alias("total"), F.when(~part_only, some("costUsdTicks") / TICKS).alias("cost"), F.map_filter(models, lambda _, n: n > 0).alias("models"))

    return once(member(update, "usage"), lambda u: F.when(is_object(u), once(u, made)))


def events(rows: DataFrame) -> DataFrame:
    """Events for the transcript builder from the surviving records()."""
    order = W.partitionBy("ref").orderBy("line")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    own = F.col("method") == OWN_METHOD
    u, content = F.col("update"), member(F.col("update"), "content")
    kind = F.when(~own, F.col("type"))
    model = F.when(own & F.col("type").isin("model_changed", "model_auto_switched"), filled(F.trim(text_in(F.when(F.col("type") == "model_changed", member(u, "model_id")).otherwise(member(u, "new_model_id"))))))
    rows = rows.where("type is not null").withColumns({
        "user": F.when((kind == "user_message_chunk") & ~F.col("host"), block_part(content)), "said": F.when(kind.isin("agent_thought_chunk", "agent_message_chunk"), block_text(content)),
        "call": F.when(kind.isin("tool_call", "tool_call_update"), filled(F.trim(text_in(member(u, "toolCallId"))))), "plan": F.when(kind == "plan", plan_part(member(u, "entries"))), "mode_set": F.when(kind == "current_mode_update", F.struct(filled(F.trim(text_in(member(u, "currentModeId")))).alias("mode"))),
        "model": F.coalesce(F.last(model, True).over(so_far), "model"),
    }).withColumn("mode", F.last("mode_set", True).over(so_far)["mode"])
    acts = F.col("said").isNotNull() | F.col("plan").isNotNull() | ((F.col("type") == "tool_call") & ~own & F.col("call").isNotNull())
    rows = rows.withColumn("acts", acts).withColumn("shows", F.when(F.col("user").isNotNull(), "user").when(F.col("acts"), "assistant"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("shows").isNotNull(), F.struct("shows", "prompt_index")), True).over(before)
    rows = rows.withColumn("last", last)
    again = (F.col("last.shows") == "user") & (F.col("prompt_index").isNull() | F.col("last.prompt_index").isNull() | (F.col("prompt_index") == F.col("last.prompt_index")))
    rows = rows.withColumn("begins", F.col("user").isNotNull() & ~F.coalesce(again, F.lit(False))).withColumn("said_by", F.sum(F.col("begins").cast("long")).over(so_far))
    known = F.last(F.when(F.col("acts"), F.col("prompt")), True).over(W.partitionBy("ref", "said_by").orderBy("line").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("turn", F.col("acts") & F.coalesce(F.col("prompt") != known, F.lit(False)))
    rows = rows.withColumn("turns", F.sum((F.col("turn") | F.col("begins")).cast("long")).over(so_far))
    made = lambda who: F.coalesce("event", F.concat_ws("-", "ref", F.lit(who), "at"))
    user = rows.where("user is not null").groupBy("ref", "said_by").agg(F.min("line").alias("line"), F.min_by(made("user"), "line").alias("id"), F.min_by("at", "line").alias("time_created"), F.transform(F.array_sort(F.collect_list(F.struct("line", F.col("user").alias("p")))), lambda x: x["p"]).alias("chunks"))
    user = user.select("ref", "line", F.lit("message").alias("kind"), F.lit("user").alias("role"), "id", "time_created", _joined(F.col("chunks")).alias("parts"))
    common = ["ref", "line", "turn", F.coalesce("prompt", made("assistant")).alias("id"), F.col("at").alias("time_created"), F.lit("grok").alias("agent"), "mode", "model", F.lit("xai").alias("provider")]
    spoken = rows.where("said is not null").select(*common, F.lit("part").alias("kind"), F.lit("current").alias("grouping"), F.lit(True).alias("joined"), F.array(part(type=F.when(F.col("type") == "agent_thought_chunk", "reasoning").otherwise("text"), text=F.col("said"))).alias("parts"))
    native = lambda c: text_in(F.try_variant_get(u, f"$._meta['x.ai/tool'].{c}", "variant"))
    status = lambda: F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])[F.lower(text_in(member(u, "status")))]
    name = F.coalesce(filled(F.trim(native("name"))), filled(F.trim(text_in(member(u, "title")))), F.lit("tool"))
    about = F.to_json(F.struct(F.coalesce(native("kind"), text_in(member(u, "kind"))).alias("kind"), member(u, "locations").alias("locations")))
    title = F.coalesce(F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])[name], name)
    tool = once(F.struct(name.alias("name"), title.alias("title")), lambda x: part(type=F.lit("tool"), tool=x["name"], title=x["title"], call_id=F.col("call"), status=F.coalesce(status(), F.lit("running")), input=shown(member(u, "rawInput")), metadata=about))
    calls = rows.where("call is not null and type = 'tool_call'").select(*common, F.lit("call").alias("kind"), F.lit("current").alias("target"), F.lit(True).alias("mark"), F.array(tool).alias("parts"))
    out, state = tool_output(u), status()
    results = rows.where("call is not null and type = 'tool_call_update'").select("ref", "line", F.lit("result").alias("kind"), F.col("call").alias("call_id"), state.alias("status"), shown(member(u, "rawInput")).alias("input"), F.when(~state.eqNullSafe(F.lit("error")), out).alias("output"), F.when(state == "error", out).alias("error"), F.lit(True).alias("silent"))
    first = W.partitionBy("ref", "turns").orderBy("line")
    plans = rows.where("plan is not null").withColumns({"nth": F.row_number().over(first), "newest": F.last("plan").over(first.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    plans = plans.where("nth = 1").select(*common, F.lit("part").alias("kind"), F.lit("current").alias("grouping"), F.array("newest").alias("parts"))
    used = rows.where((F.col("method") == OWN_METHOD) & (F.col("type") == "turn_completed")).withColumn("x", usage_of(u)).where("x is not null")
    primary = F.when(F.size("x.models") == 1, F.map_keys("x.models")[0])
    usage = used.select("ref", "line", F.lit("usage").alias("kind"), "x.tokens", F.coalesce(primary, "model").alias("model"), "x.cost", F.when(F.col("x.cost").isNotNull(), "recorded").alias("cost_source"))
    child = rows.where((F.col("method") == OWN_METHOD) & (F.col("type") == "subagent_spawned")).select("ref", "line", F.lit("child").alias("kind"), filled(F.trim(text_in(member(u, "child_session_id")))).alias("subagent_id")).where("subagent_id is not null")
    return builder.events_of(user, spoken, calls, results, plans, usage, child)


def _joined(chunks: Column) -> Column:
    """Parts with adjacent texts as one."""

    def add(out: Column, p: Column) -> Column:
        last = F.element_at(out, -1)
        merged = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(last.withField("text", F.concat(last["text"], p["text"]))))
        return F.when((F.size(out) > 0) & (F.get(out, F.size(out) - 1)["type"] == "text") & (p["type"] == "text"), merged).otherwise(F.concat(out, F.array(p)))

    return F.aggregate(chunks, F.slice(chunks, 1, 0), add)


def transcripts(rows: DataFrame) -> DataFrame:
    """Messages of records(), rewound ones left out; see builder.transcripts()."""
    return builder.transcripts(events(surviving(rows)))


def heads(summaries: DataFrame, rows: DataFrame, shown_messages: DataFrame) -> DataFrame:
    """Heads of the sessions with a visible message. Usage counts rewound turns too, and costs only if each turn's is known."""
    turns = rows.where((F.col("method") == OWN_METHOD) & (F.col("type") == "turn_completed")).withColumn("x", usage_of(F.col("update"))).where("x is not null")
    sums = turns.groupBy("ref").agg(*[F.sum(f"x.tokens.{c}").alias(c) for c in ("input", "output", "cache_read", "cache_create")], F.sum("x.total").alias("total"), F.coalesce(F.sum("x.cost"), F.lit(0.0)).alias("cost"), F.bool_or(F.col("x.cost").isNull() & (F.col("x.total") > 0)).alias("unknown"))
    said = first_line_title(F.get(F.filter("parts", lambda p: p["type"] == "text"), F.lit(0))["text"])
    seen = shown_messages.groupBy("ref").agg(F.count("*").alias("message_count"), F.min_by(said, F.when((F.col("role") == "user") & said.isNotNull(), F.col("message_index"))).alias("said"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    out = summaries.join(seen, "ref").join(sums, "ref", "left")
    return out.select(F.col("ref").alias("session_id"), F.col("parent").alias("parent_id"), title_of(F.col("title"), F.col("said"), F.col("cwd")).alias("title"), F.col("cwd").alias("directory"), F.col("created").alias("time_created"), F.col("updated").alias("time_updated"), "message_count", *[zero(c) for c in ("input", "output", "cache_read", "cache_create", "total")], F.coalesce("cost", F.lit(0.0)).alias("total_cost"), F.when((F.col("cost") > 0) & ~F.col("unknown"), "recorded").alias("cost_source"))


def model_usage(rows: DataFrame) -> DataFrame:
    """(ref, model, tokens) of all completed turns of records()."""
    turns = rows.where((F.col("method") == OWN_METHOD) & (F.col("type") == "turn_completed")).select("ref", usage_of(F.col("update")).alias("x"))
    return turns.select("ref", F.explode("x.models").alias("model", "n")).groupBy("ref", "model").agg(F.sum("n").alias("tokens"))
