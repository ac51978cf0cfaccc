"""Sessions of DSH logs: one log of events a session, plain or in Zstandard frames, each frame an appended batch of whole lines.

A log is read frame by frame; a frame or line cut short at the end is left out, anything else that is broken makes the log
a problem, which is reported and not shown. Packed rows of streamed deltas are spread into their events; events are then
numbered from zero without a gap. Deltas of a step are put together by (turn, step) and count only where no message
settled the step before the log went on to another one. Of a step's blocks the deltas behind the last restart are
joined in order; a block's end holds the block as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.functions.parts import filled, is_object, member, part, shown, text_in
from loomspark.functions.text import once
from loomspark.operators import builder
from loomspark.operators.closure import written
from loomspark.operators.transcript import cleaned
from loomspark.sources.framed import frames

#: The format's version, its packed rows with the deltas they hold, and the events of that version.
FORMAT = 0
PACKED = {"text-chunks": "text-delta", "reasoning-chunks": "reasoning-delta", "tool-call-chunks": "tool-call-delta"}
KNOWN = (
    "agent-preset/selected", "agent/inbox/spliced", "approval/asked", "approval/decided", "approval/policy", "assistant/chunk", "assistant/message", "command/done", "command/run", "compaction/end", "compaction/prune", "compaction/start", "compaction/summary",
    "feedback/record", "goal/change", "hook/invoked", "hook/result", "llm/retry", "llm/retry-started", "permission/preset", "plan/mode", "request/context", "request/header", "sandbox/mode", "schedule/change", "session/end-seed", "session/title",
    "session/title-llm-request", "step/end", "step/start", "subagent/descriptor", "todo/write", "tool-workflow/agent-end", "tool-workflow/agent-start", "tool-workflow/run-end", "tool-workflow/run-start", "tool/call", "tool/code-dispatch",
    "tool/code-dispatch-start", "tool/result", "turn/end", "turn/start", "user/message", "web/deepseek-search-llm-request",
)
SURFACE = ("user/message", "assistant/message", "tool/result")


def log_lines(data: bytes, compressed: bool) -> tuple[list[str], str | None]:
    """Whole lines of a log, the header first, and what is wrong with it, if anything is."""
    if not compressed:
        whole, _, _ = data.rpartition(b"\n")
        return (whole.decode("utf-8", "replace").split("\n"), None) if b"\n" in data else ([], "no complete header")
    lines: list[str] = []
    try:
        for n, frame in enumerate(frames(data)):
            if not frame.endswith(b"\n"):
                return lines, "a frame ends within a record"
            batch = frame[:-1].decode("utf-8", "replace").split("\n")
            if n == 0 and len(batch) != 1:
                return lines, "the header's frame doesn't hold one record"
            lines += batch
    except ValueError as error:
        return lines, str(error)
    return lines, None if lines else "no complete header"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw, broken): lines of all logs below path as VARIANT; broken says what is wrong with a file, in a row without line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                lines, broken = log_lines(bytes(data), name.endswith(".zstd"))
                rows = [(name, i, x, None) for i, x in enumerate(lines)] + ([(name, None, None, broken)] if broken else [])
                yield pd.DataFrame(rows, columns=["file", "line", "value", "broken"]).astype({"line": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "session.jsonl{,.zstd}").load(path)
    return files.select("path", "content").mapInPandas(run, "file string, line long, value string, broken string").select("file", "line", F.try_parse_json("value").alias("raw"), "broken")


def _number(value: Column) -> Column:
    return F.when(F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), value.try_cast("double"))


def _long(value: Column) -> Column:
    return F.when(F.schema_of_variant(value).rlike("^BIGINT"), value.try_cast("long"))


def headers(lines: DataFrame) -> DataFrame:
    """(file, ref, cwd, parent, seed, created, problem) of the first line of each log."""
    h = lambda c: member(F.col("raw"), c)
    wrong = (
        F.when(~is_object(F.col("raw")), "the header is no object").when(~_long(h("version")).eqNullSafe(F.lit(FORMAT)), "another version of the format").when(~text_in(h("type")).eqNullSafe(F.lit("session")), "the first record is no header")
        .when(filled(text_in(h("id"))).isNull() | ~F.coalesce(_long(h("createdAt")) >= 0, F.lit(False)) | ~F.coalesce(_long(h("delegationDepth")) >= 0, F.lit(False)), "a field of the header is missing")
        .when(h("seedLength").isNotNull() & ~F.coalesce(_long(h("seedLength")) >= 0, F.lit(False)), "the seed's length is wrong").when(h("origin").isNotNull() & ~text_in(h("origin")).eqNullSafe(F.lit("subagent")), "an unknown origin")
    )
    rows = lines.where("line = 0")
    return rows.select("file", text_in(h("id")).alias("ref"), text_in(h("cwd")).alias("cwd"), text_in(h("parentSession")).alias("parent"), F.coalesce(_long(h("seedLength")), F.lit(0).cast("long")).alias("seed"), _long(h("createdAt")).alias("created"), wrong.alias("problem"))


def events(lines: DataFrame) -> DataFrame:
    """(file, seq, place, type, time, data, op, problem) with packed rows spread; place counts the events of a log; settled."""
    r = lambda c: member(F.col("raw"), c)
    rows = lines.where("line > 0").withColumns({"type": text_in(r("type")), "data": r("data")})
    kept = rows.where(~F.coalesce(F.col("type").isin(*PACKED), F.lit(False)))
    wrong = F.when(filled(F.col("type")).isNull(), "a record has no type").when(~F.col("type").isin(*KNOWN) & ~F.coalesce(F.try_variant_get("raw", "$.ignorable", "boolean"), F.lit(False)), "an unknown event").when(~F.coalesce(_long(r("seq")) >= 0, F.lit(False)) | _long(r("time")).isNull(), "an event's number or time is wrong")
    single = kept.select("file", "line", F.lit(0).alias("nth"), "type", _long(r("seq")).alias("seq"), _long(r("time")).alias("time"), "data", r("surfaceOp").alias("op"), wrong.alias("problem"))
    d = lambda c: member(F.col("data"), c)
    texts = F.when(F.col("type") == "tool-call-chunks", d("args")).otherwise(d("texts"))
    members, gaps = texts.try_cast("array<variant>"), d("dt").try_cast("array<variant>")
    packed = rows.where(F.col("type").isin(*PACKED)).select("file", "line", "type", "data", _long(r("seq0")).alias("seq0"), _long(r("time0")).alias("time0"), F.transform(members, text_in).alias("members"), F.transform(gaps, _long).alias("dt"))
    ids = F.coalesce(F.col("type") != "tool-call-chunks", F.lit(True)) | text_in(d("id")).isNotNull()
    fine = (F.col("seq0") >= 0) & F.col("time0").isNotNull() & (F.size("members") > 0) & ~F.exists("members", lambda x: x.isNull()) & (F.size("dt") == F.size("members") - 1) & ~F.exists("dt", lambda x: x.isNull()) & ids
    fine = fine & _number(d("turn")).isNotNull() & _number(d("step")).isNotNull() & _number(d("index")).isNotNull()
    packed = packed.withColumn("fine", F.coalesce(fine, F.lit(False)))
    delta = F.create_map(*[F.lit(x) for pair in PACKED.items() for x in pair])[F.col("type")]
    spread = packed.where("fine").select("*", F.posexplode("members").alias("nth", "text"))
    chunk = F.struct(delta.alias("type"), _number(d("index")).alias("index"), F.when(F.col("type") != "tool-call-chunks", F.col("text")).alias("text"), text_in(d("id")).alias("id"), text_in(d("name")).alias("name"), F.when(F.col("type") == "tool-call-chunks", F.col("text")).alias("argumentsDelta"))
    made = F.try_parse_json(F.to_json(F.struct(_number(d("turn")).alias("turn"), _number(d("step")).alias("step"), chunk.alias("chunk"))))
    at = F.col("time0") + F.aggregate(F.slice("dt", F.lit(1), F.col("nth")), F.lit(0).cast("long"), lambda s, x: s + x)
    spread = spread.select("file", "line", "nth", F.lit("assistant/chunk").alias("type"), (F.col("seq0") + F.col("nth")).alias("seq"), at.alias("time"), made.alias("data"), F.lit(None).cast("variant").alias("op"), F.lit(None).cast("string").alias("problem"))
    bad = packed.where("not fine").select("file", "line", F.lit(0).alias("nth"), "type", F.col("seq0").alias("seq"), F.col("time0").alias("time"), "data", F.lit(None).cast("variant").alias("op"), F.lit("a packed row is malformed").alias("problem"))
    whole = single.unionByName(spread).unionByName(bad).withColumn("place", F.row_number().over(W.partitionBy("file").orderBy("line", "nth")) - 1)
    surface = F.col("type").isin(*SURFACE)
    append = text_in(F.col("op")).eqNullSafe(F.lit("append"))
    replace = F.coalesce((text_in(member(F.col("op"), "op")) == "replace") & _long(member(F.col("op"), "start")).isNotNull() & _long(member(F.col("op"), "end")).isNotNull(), F.lit(False))
    problem = F.coalesce("problem", F.when(F.col("seq") != F.col("place"), "the events' numbers have a gap"), F.when(surface & ~append & ~replace, "an event's place on the surface is unknown"))
    return written(whole.select("file", "seq", "place", "type", "time", "data", (surface & append).alias("appended"), problem.alias("problem")), "events")


def problems(lines: DataFrame, heads: DataFrame, rows: DataFrame) -> DataFrame:
    """(file, problem) of the logs that can't be shown, with the first thing that is wrong."""
    counts = rows.groupBy("file").agg(F.count("*").alias("n"))
    calls = rows.where("type = 'tool/call'").select("file", F.coalesce(text_in(member(F.col("data"), "callId")), F.lit("")).alias("id")).groupBy("file", "id").agg(F.count("*").alias("n"))
    found = [
        lines.where("broken is not null").select("file", F.lit(0).alias("rank"), F.col("broken").alias("problem")), heads.where("problem is not null").select("file", F.lit(1).alias("rank"), "problem"),
        rows.where("problem is not null").select("file", (F.col("place") + 2).alias("rank"), "problem"), calls.where("id = '' or n > 1").select("file", F.lit(1 << 40).alias("rank"), F.lit("a tool call's id is missing or not its own").alias("problem")),
        heads.join(counts, "file", "left").where("seed > coalesce(n, 0)").select("file", F.lit(1 << 41).alias("rank"), F.lit("the seed is longer than the log").alias("problem")),
    ]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("file").agg(F.min_by("problem", "rank").alias("problem"))


def _count(value: Column) -> Column:
    return F.coalesce(F.when(_number(value) > 0, _number(value).cast("long")), F.lit(0).cast("long"))


def tokens_of(usage: Column) -> Column:
    """Tokens of a usage: the input with both kinds of cache, the output without the reasoning that it includes."""

    def made(u: Column) -> Column:
        n = lambda c: _count(member(u, c))
        some = lambda v: F.when(v > 0, v)
        reasoning = F.least(n("reasoningTokens"), n("outputTokens"))
        return F.struct((n("inputTokens") + n("cacheReadTokens") + n("cacheWriteTokens")).alias("input"), (n("outputTokens") - reasoning).alias("output"), some(reasoning).alias("reasoning"), some(n("cacheReadTokens")).alias("cache_read"), some(n("cacheWriteTokens")).alias("cache_create"))

    return F.when(is_object(usage), made(usage))


def tool_part(call_id: Column, name: Column, arguments: Column) -> Column:
    """A running call; arguments are a JSON text, kept as it is."""
    tool = F.coalesce(filled(F.trim(name)), F.lit("tool"))
    return part(type=F.lit("tool"), tool=tool, title=F.lower(tool), call_id=filled(call_id), status=F.lit("running"), input=arguments)


def content_parts(content: Column, canonical: Column) -> Column:
    """Parts of content blocks; a tool call that has an event of its own is left out, images stand as a note."""

    def made(b: Column) -> Column:
        kind = text_in(member(b, "type"))
        call = text_in(member(b, "id"))
        tool = F.when(~F.array_contains(canonical, F.coalesce(call, F.lit(""))), tool_part(call, text_in(member(b, "name")), shown(member(b, "arguments"))))
        text = once(cleaned(text_in(member(b, "text"))), lambda t: F.when(t.isNotNull(), part(type=kind, text=t)))
        return F.when(kind.isin("text", "reasoning"), text).when(kind == "tool-call", tool)

    blocks = content.try_cast("array<variant>")
    drawn = F.exists(blocks, lambda b: text_in(member(b, "type")) == "image")
    note = F.array(part(type=F.lit("text"), text=F.lit("[image unavailable]")))
    return once(F.filter(F.transform(blocks, made), lambda p: p.isNotNull()), lambda p: F.when((F.size(p) == 0) & drawn, note).otherwise(p))


def step_blocks(chunks: DataFrame, key: list[str]) -> DataFrame:
    """(key.., index, kind, id, name, text): blocks of chunks(key.., seq, chunk) put together from their deltas."""
    c = F.col("chunk")
    kind = text_in(member(c, "type"))
    block = member(c, "block")
    ended = (kind == "block-end") & text_in(member(block, "type")).isin("text", "reasoning", "tool-call")
    deltas = chunks.where(_number(member(c, "index")).isNotNull() & (kind.isin(*PACKED.values()) | ended))
    of = lambda d, b: F.when(kind == "block-end", text_in(member(block, b))).otherwise(text_in(member(c, d)))
    told = F.when(kind == "block-end", text_in(member(block, "type"))).otherwise(F.regexp_replace(kind, "-delta$", ""))
    piece = F.when(told == "tool-call", of("argumentsDelta", "arguments")).otherwise(of("text", "text"))
    rows = deltas.select(*key, "seq", _number(member(c, "index")).alias("index"), told.alias("kind"), of("id", "id").alias("id"), of("name", "name").alias("name"), F.coalesce(piece, F.lit("")).alias("piece"), (kind == "block-end").alias("whole"))
    order = W.partitionBy(*key, "index").orderBy("seq")
    rows = rows.withColumn("starts", F.col("whole") | ~F.lag("kind").over(order).eqNullSafe(F.col("kind"))).withColumn("part_of", F.sum(F.col("starts").cast("int")).over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "")
    runs = rows.groupBy(*key, "index", "part_of").agg(F.first("kind").alias("kind"), F.max_by("id", "seq").alias("id"), F.max_by("name", F.when(F.col("name") != "", F.col("seq"))).alias("name"), text.alias("text"))
    return runs.groupBy(*key, "index").agg(F.max_by(F.struct("kind", "id", "name", "text"), "part_of").alias("b")).select(*key, "index", "b.*")


def transcript_events(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Events for the transcript builder from events() of the logs in heads; the seed, which belongs to the parent, only settles steps and names models."""
    calls = rows.where("type = 'tool/call'").groupBy("file").agg(F.collect_set(text_in(member(F.col("data"), "callId"))).alias("canonical"))
    rows = rows.join(heads.select("file", "ref", "seed"), "file").join(calls, "file", "left").withColumns({"own": F.col("seq") >= F.col("seed"), "canonical": F.coalesce("canonical", F.array().cast("array<string>")), "line": F.col("seq") * 2})
    d = lambda *path: F.try_variant_get("data", "$" + "".join(f".{p}" for p in path), "variant")
    text = lambda *path: filled(text_in(d(*path)))
    order = W.partitionBy("file").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    answered = (F.col("type") == "assistant/message") & F.col("appended") & F.col("own")
    says = lambda c: F.when(F.col("type") == "request/context", text(c)).when(answered, text("message", "source", c))
    rows = rows.withColumns({"provider": F.last(says("provider"), True).over(order), "model": F.last(says("model"), True).over(order)})
    shown_rows = rows.where("own and appended")
    user = shown_rows.where(F.col("type") == "user/message").where(text("source", "kind") == "user").select("ref", "line", F.lit("message").alias("kind"), F.lit("user").alias("role"), F.coalesce(text("id"), F.concat(F.lit("dsh-user-"), "seq")).alias("id"), F.col("time").alias("time_created"), content_parts(d("content"), F.col("canonical")).alias("parts"))
    answers = shown_rows.where(F.col("type") == "assistant/message").select("ref", "line", F.lit("message").alias("kind"), F.lit("assistant").alias("role"), F.coalesce(text("message", "id"), F.concat(F.lit("dsh-assistant-"), "seq")).alias("id"), F.col("time").alias("time_created"), F.lit("dsh").alias("agent"), text("message", "source", "provider").alias("provider"), text("message", "source", "model").alias("model"), content_parts(d("message", "content"), F.col("canonical")).alias("parts"), tokens_of(d("usage")).alias("tokens"))
    tools = rows.where("own").where(F.col("type") == "tool/call").select("ref", "line", F.lit("call").alias("kind"), F.lit("current").alias("target"), text("callId").alias("id"), F.col("time").alias("time_created"), F.lit("dsh").alias("agent"), F.array(tool_part(text("callId"), text("name"), shown(d("arguments")))).alias("parts"))
    block = F.try_variant_get("data", "$.message.content[0]", "variant")
    failed = F.coalesce(F.try_variant_get(block, "$.isError", "boolean"), F.lit(False)) | is_object(d("error"))
    output = F.array_join(F.transform(content_parts(member(block, "content"), F.col("canonical")), lambda p: F.coalesce(p["text"], p["tool"])), "\n")
    results = shown_rows.where(F.col("type") == "tool/result").select("ref", "line", F.lit("result").alias("kind"), text("message", "source", "callId").alias("call_id"), output.alias("output"), F.when(failed, "error").otherwise("completed").alias("status"), shown(d("meta")).alias("metadata"), F.lit(True).alias("consume"))
    # steps that no message settled
    step = rows.withColumns({"turn_no": _number(d("turn")), "step_no": _number(d("step"))}).where("turn_no is not null and step_no is not null")
    settled = step.where(F.col("type") == "assistant/message").groupBy("file", "turn_no", "step_no").agg(F.min("seq").alias("settled"))
    chunks = step.where("own").where(F.col("type") == "assistant/chunk").join(settled, ["file", "turn_no", "step_no"], "left").where("settled is null or settled > seq").withColumn("chunk", d("chunk"))
    along = W.partitionBy("file").orderBy("seq")
    stays = lambda c: F.lag(c).over(along).eqNullSafe(F.col(c))
    chunks = chunks.withColumn("moved", ~(stays("turn_no") & stays("step_no"))).withColumn("run", F.sum(F.col("moved").cast("int")).over(along))
    used = F.max_by(tokens_of(member(F.col("chunk"), "usage")), F.when((text_in(member(F.col("chunk"), "type")) == "usage") & member(F.col("chunk"), "index").isNull(), F.col("seq")))
    runs = chunks.groupBy("file", "run").agg(F.min("seq").alias("first"), F.min_by("time", "seq").alias("time_created"), F.first("ref").alias("ref"), F.first("turn_no").alias("turn_no"), F.first("step_no").alias("step_no"), F.first("settled").alias("settled"), F.first("canonical").alias("canonical"), used.alias("tokens"))
    ends = rows.groupBy("file").agg((F.max("seq") + 1).alias("end"))
    flushed = F.coalesce(F.lead("first").over(W.partitionBy("file").orderBy("run")), "end")
    runs = runs.join(ends, "file").withColumn("flushed", flushed).where("settled is null or settled > flushed")
    named = rows.select("file", (F.col("seq") + 1).alias("flushed"), "provider", "model")  # as known before the log went on
    blocks = step_blocks(chunks, ["file", "run"])
    text_part = once(cleaned(F.col("text")), lambda t: F.when(t.isNotNull(), part(type=F.col("kind"), text=t)))
    made = F.when(F.col("kind") == "tool-call", F.when(~F.array_contains("canonical", F.coalesce("id", F.lit(""))), tool_part(F.col("id"), F.col("name"), F.col("text")))).otherwise(text_part)
    pieces = blocks.join(runs.select("file", "run", "canonical"), ["file", "run"]).select("file", "run", "index", made.alias("p")).where("p is not null").groupBy("file", "run").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "p"))), lambda x: x["p"]).alias("parts"))
    number = lambda c: F.col(c).cast("long").cast("string")
    torn = runs.join(pieces, ["file", "run"]).join(named, ["file", "flushed"], "left").select("ref", (F.col("flushed") * 2 - 1).alias("line"), F.lit("message").alias("kind"), F.lit("assistant").alias("role"), F.concat_ws("-", F.lit("dsh-step"), number("turn_no"), number("step_no")).alias("id"), "time_created", F.lit("dsh").alias("agent"), "provider", "model", "parts", "tokens")
    return builder.events_of(user.where("size(parts) > 0"), answers.where("size(parts) > 0"), tools, results, torn)


def heads_of(heads: DataFrame, rows: DataFrame, shown_messages: DataFrame) -> DataFrame:
    """Heads of the logs: the own title, else the subagent's label, the first text of a user, the inherited title."""
    mine = rows.join(heads.select("file", "ref", "seed"), "file").withColumn("own", F.col("seq") >= F.col("seed"))
    title = filled(F.trim(F.regexp_replace(text_in(member(F.col("data"), "title")), r"\s+", " ")))
    label = filled(F.trim(F.regexp_replace(text_in(member(F.col("data"), "label")), r"\s+", " ")))
    at = lambda test: F.when(test, F.col("seq"))
    titled, labelled = (F.col("type") == "session/title") & title.isNotNull(), (F.col("type") == "subagent/descriptor") & label.isNotNull()
    sums = mine.groupBy("ref").agg(F.max_by(title, at(titled & F.col("own"))).alias("title"), F.max_by(title, at(titled & ~F.col("own"))).alias("inherited"), F.min_by(label, at(labelled & F.col("own"))).alias("label"), F.max(F.when(F.col("own"), F.col("time"))).alias("updated"))
    said = F.get(F.filter("parts", lambda p: p["type"] == "text"), F.lit(0))["text"]
    seen = shown_messages.groupBy("ref").agg(F.count("*").alias("message_count"), F.min_by(said, F.when((F.col("role") == "user") & said.isNotNull(), F.col("message_index"))).alias("said"))
    out = heads.join(sums, "ref", "left").join(seen, "ref", "left")
    return out.select(F.col("ref").alias("session_id"), F.col("parent").alias("parent_id"), F.coalesce("title", "label", "said", "inherited").alias("title"), F.col("cwd").alias("directory"), F.col("created").alias("time_created"), F.coalesce("updated", "created").alias("time_updated"), F.coalesce("message_count", F.lit(0)).alias("message_count"))
