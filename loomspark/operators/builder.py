"""Transcripts from the events of a session log: which message each event belongs to, then messages, parts and tool calls.

One pass over each session's events in order decides the message of each. It keeps a few values for each message and no
texts: rows stream through it by Arrow batches, sorted by session and line. All that follows are groupings, windows and
joins.

Events have ref, line, kind and the columns of COLUMNS that they need:

- `message` opens a message of a role with its parts; a user's message begins a turn
- `part` adds a part to the assistant's message. With grouping `current` any message of the turn takes it, else texts go
  on in a message without tools, reasoning in one without texts and tools, and all others open one. reset forgets the
  message with the latest text; dedup leaves a part out that repeats the one before; joined continues its text
- `call` adds a tool call to the turn's latest message with a text (else to the current one; with target `current`, to
  that at once), which becomes the current one; mark makes its mode `tool`, on_create names the mode of a message it opens
- `result` updates the latest call of its call_id that isn't consumed; consume ends it. Of several the last value counts. An
  output without a status completes a running call, unless silent
- `usage` gives tokens, cost and model to the latest assistant message without tokens, else adds them to the latest of
  its model, else is lost
- `child` names the subagent of the current message; `turn`, on any event, begins a turn before it
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.functions.parts import FIELDS
from loomspark.operators.closure import written
from loomspark.operators.transcript import cleaned, is_internal_event

COUNTERS = ("input", "output", "reasoning", "cache_read", "cache_create")
PART = "struct<" + ",".join(f"{c}:string" for c in FIELDS) + ">"
TOKENS = "struct<" + ",".join(f"{c}:bigint" for c in COUNTERS) + ">"
#: Columns of events, null where an event has none.
COLUMNS = {
    "ref": "string", "line": "bigint", "kind": "string", "role": "string", "parts": f"array<{PART}>", "grouping": "string", "reset": "boolean", "dedup": "boolean", "joined": "boolean", "target": "string", "mark": "boolean", "on_create": "string",
    "turn": "boolean", "call_id": "string", "status": "string", "input": "string", "output": "string", "error": "string", "metadata": "string", "consume": "boolean", "silent": "boolean", "id": "string", "time_created": "bigint", "agent": "string", "mode": "string",
    "model": "string", "provider": "string", "tokens": TOKENS, "cost": "double", "cost_source": "string", "subagent_id": "string",
}
#: Columns that assigned() adds: message, whether the event opens it and gives it tokens, and its model, cost and source after the event.
ADDED = [("message", pa.int32()), ("opened", pa.bool_()), ("counted", pa.bool_()), ("model_after", pa.string()), ("cost_after", pa.float64()), ("source_after", pa.string())]
NOTHING = (None, None, None, None, None, None)


def events_of(*rows: DataFrame) -> DataFrame:
    """The union of event tables that have some of COLUMNS each."""
    typed = [r.select(*[(F.col(c) if c in r.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()]) for r in rows]
    out = typed[0]
    for more in typed[1:]:
        out = out.unionByName(more)
    return out


class Session:
    """Where a session stands: its current assistant message, the latest with a text, and a few values of each message."""

    def __init__(self) -> None:
        self.current: int | None = None
        self.texted: int | None = None
        self.texts: list[bool] = []
        self.tools: list[bool] = []
        self.tokens: list[bool] = []
        self.models: list[str | None] = []
        self.costs: list[float] = []
        self.sources: list[str | None] = []
        self.bare: list[int] = []  # assistants without tokens, the latest last; some may have got theirs meanwhile
        self.unnamed: list[int] = []  # likewise, without a model
        self.latest: dict[str, int] = {}  # the latest assistant of a model

    def open(self, e: dict, assistant: bool) -> int:
        n = len(self.texts)
        self.texts.append("text" in e["types"])
        self.tools.append("tool" in e["types"])
        self.tokens.append(e["has_tokens"])
        self.models.append(e["model"])
        self.costs.append(e["cost"] or 0.0)
        self.sources.append(e["cost_source"])
        if assistant:
            if not e["has_tokens"]:
                self.bare.append(n)
            if e["model"] is None:
                self.unnamed.append(n)
            else:
                self.latest[e["model"]] = n
            self.current = n
            self.texted = n if self.texts[n] else self.texted
        return n

    def named(self, n: int, model: str | None) -> None:
        if self.models[n] is None and model is not None:
            self.models[n] = model
            self.latest[model] = max(n, self.latest.get(model, -1))

    def added(self, n: int, e: dict) -> bool:
        """A part joins message n, which takes from the event what it lacks; whether that includes its tokens."""
        self.texts[n] |= "text" in e["types"]
        self.tools[n] |= "tool" in e["types"]
        self.named(n, e["model"])
        counted = e["has_tokens"] and not self.tokens[n]
        self.tokens[n] |= counted
        if self.costs[n] == 0 and e["cost"] is not None:
            self.costs[n] = e["cost"]
        self.sources[n] = self.sources[n] or e["cost_source"]
        return counted

    def usage(self, e: dict) -> tuple[int | None, bool]:
        while self.bare and self.tokens[self.bare[-1]]:
            self.bare.pop()
        if self.bare:
            n = self.bare.pop()
            self.tokens[n] = True
            self.named(n, e["model"])
            self.costs[n] = self.costs[n] if e["cost"] is None else e["cost"]
            self.sources[n] = e["cost_source"] or self.sources[n]
            return n, True
        while self.unnamed and self.models[self.unnamed[-1]] is not None:
            self.unnamed.pop()
        n = self.latest.get(e["model"]) if e["model"] is not None else (self.unnamed[-1] if self.unnamed else None)
        if n is not None and e["cost"] is not None:
            self.costs[n] += e["cost"]
            self.sources[n] = self.sources[n] or e["cost_source"]
        return n, n is not None

    def put(self, e: dict) -> tuple:
        """The values of ADDED for an event."""
        kind, opened, counted = e["kind"], False, False
        if e["turn"] or (kind == "message" and e["role"] == "user"):
            self.current = self.texted = None
        if kind == "message":
            n, opened, counted = self.open(e, e["role"] == "assistant"), True, e["has_tokens"]
        elif kind == "part":
            n, first = self.current, e["types"][0]
            fits = n is not None and (e["grouping"] == "current" or (first == "text" and not self.tools[n]) or (first == "reasoning" and not self.texts[n] and not self.tools[n]))
            if fits:
                counted = self.added(n, e)
            else:
                n, opened, counted = self.open(e, True), True, e["has_tokens"]
            self.texted = n if first == "text" else None if e["reset"] else self.texted
        elif kind == "call":
            n = self.current if e["target"] == "current" or self.texted is None else self.texted
            if n is None:
                n, opened, counted = self.open(e, True), True, e["has_tokens"]
            else:
                counted = self.added(n, e)
            self.current = n
        elif kind == "usage":
            n, counted = self.usage(e)
        elif kind == "child":
            n = self.current
        else:
            return NOTHING
        return NOTHING if n is None else (n, opened, counted, self.models[n], self.costs[n], self.sources[n])


def assigned(events: DataFrame) -> DataFrame:
    """events with the columns of ADDED, settled."""
    rows = events_of(events).withColumns({"types": F.coalesce(F.transform("parts", lambda p: p["type"]), F.array().cast("array<string>")), "has_tokens": F.col("tokens").isNotNull() & (F.col("kind") != "usage")})
    control = ["ref", "kind", "role", "types", "grouping", "reset", "target", "turn", "has_tokens", "model", "cost", "cost_source"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref, session = None, Session()
        for batch in batches:
            out = []
            for values in zip(*[batch.column(c).to_pylist() for c in control]):
                e = dict(zip(control, values))
                if e["ref"] != ref:
                    ref, session = e["ref"], Session()
                out.append(session.put(e))
            added = [pa.array([row[i] for row in out], t) for i, (_, t) in enumerate(ADDED)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *[n for n, _ in ADDED]])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", message int, opened boolean, counted boolean, model_after string, cost_after double, source_after string"
    ordered = rows.where("ref is not null").repartition("ref").sortWithinPartitions("ref", "line")
    return written(ordered.mapInArrow(run, schema).drop("types", "has_tokens"), "assigned")


def _first(column: str, when: Column | None = None) -> Column:
    """The first value that isn't null, by line."""
    value = F.col(column) if when is None else F.when(when, F.col(column))
    return F.min_by(value, F.when(value.isNotNull(), F.col("line"))).alias(column)


def heads_of(rows: DataFrame) -> DataFrame:
    """(ref, message, id, role, ..) of the messages of assigned() events, without their parts."""
    own = rows.where("message is not null")
    joins = F.col("kind").isin("message", "part", "call")
    mode = F.when(F.col("opened") & (F.col("kind") == "call"), F.coalesce("on_create", "mode")).when(joins, F.col("mode"))
    own = own.withColumns({"mode": mode, "kept": joins, "marked": F.coalesce(F.col("mark") & ~(F.col("opened") & F.col("on_create").isNotNull()), F.lit(False))})
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line")))
    sums = [F.sum(F.when(F.col("counted"), F.col(f"tokens.{c}"))).alias(c) for c in COUNTERS]
    opened = lambda c: F.min_by(c, F.when(F.col("opened"), F.col("line"))).alias(c)
    named = F.coalesce(F.max_by("id", F.when(F.col("opened") & (F.col("id") != ""), F.col("line"))), F.min_by("id", F.when(F.col("kept") & (F.col("id") != ""), F.col("line"))))
    return own.groupBy("ref", "message").agg(
        named.alias("id"), F.coalesce(F.min_by("role", F.when(F.col("opened"), F.col("line"))), F.lit("assistant")).alias("role"), opened("time_created"), _first("agent", F.col("kept")),
        F.when(F.bool_or("marked"), "tool").otherwise(F.min_by("mode", F.when(F.col("mode").isNotNull(), F.col("line")))).alias("mode"), last("model_after").alias("model"), _first("provider", F.col("kept")), *sums,
        F.coalesce(F.max_by("cost_after", "line"), F.lit(0.0)).alias("cost"), last("source_after").alias("cost_source"), _first("subagent_id"),
    )


def parts_of(rows: DataFrame) -> DataFrame:
    """(ref, message, line, pos, registers, p): the parts of assigned() events, repeats left out and continued texts joined."""
    placed = rows.where("message is not null and parts is not null").select("ref", "message", "line", "dedup", "joined", (F.col("opened") | (F.col("kind") == "call")).alias("registers"), F.posexplode("parts").alias("pos", "p"))
    order = W.partitionBy("ref", "message").orderBy("line", "pos")
    same = lambda c: F.lag(f"p.{c}").over(order) == F.col(f"p.{c}")
    placed = placed.withColumns({"repeats": F.coalesce(F.col("dedup") & same("type") & same("text"), F.lit(False)), "goes_on": F.coalesce(F.col("joined") & same("type"), F.lit(False))}).where("not repeats")
    runs = placed.withColumn("run", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(order))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "pos", F.col("p.text").alias("text")))), lambda x: x["text"]), "")
    first = F.min_by(F.struct("line", "pos", "registers", "p"), F.struct("line", "pos")).alias("x")
    joined = runs.groupBy("ref", "message", "run").agg(first, F.count("*").alias("n"), texts.alias("text"))
    part = F.col("x.p").withField("text", F.when(F.col("n") > 1, F.col("text")).otherwise(F.col("x.p.text")))
    return joined.select("ref", "message", "x.line", "x.pos", "x.registers", part.alias("p"))


RESULT = ("status", "input", "output", "error", "metadata")


def with_results(parts: DataFrame, rows: DataFrame) -> DataFrame:
    """parts_of() with what the results among assigned() events say of the calls."""
    known = parts.where("registers and p.type = 'tool' and p.call_id <> ''").select("ref", F.col("p.call_id").alias("call_id"), "line", "pos", F.lit(True).alias("registers"), *[F.lit(None).cast("string").alias(c) for c in RESULT], F.lit(False).alias("consume"), F.lit(True).alias("silent"))
    results = rows.where("kind = 'result' and call_id <> ''").select("ref", "call_id", "line", F.lit(0).alias("pos"), F.lit(False).alias("registers"), *RESULT, F.coalesce("consume", F.lit(False)).alias("consume"), F.coalesce("silent", F.lit(False)).alias("silent"))
    order = W.partitionBy("ref", "call_id").orderBy("line", F.desc("registers"), "pos")
    met = known.unionByName(results).withColumn("nth", F.sum(F.col("registers").cast("int")).over(order))
    within = W.partitionBy("ref", "call_id", "nth").orderBy("line", F.desc("registers"), "pos").rowsBetween(W.unboundedPreceding, -1)
    met = met.withColumn("spent", F.coalesce(F.max("consume").over(within), F.lit(False)))
    value = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & ~F.col("registers") & ~F.col("spent"), F.col("line")))
    stated = F.max(F.when(F.col("status").isNotNull() & ~F.col("spent"), F.col("line")))
    put = F.max(F.when(F.col("output").isNotNull() & F.col("status").isNull() & ~F.col("silent") & ~F.col("spent"), F.col("line")))
    of_call = met.where("nth > 0").groupBy("ref", "call_id", "nth").agg(F.min(F.when(F.col("registers"), F.struct("line", "pos"))).alias("at"), *[value(c).alias(f"r_{c}") for c in RESULT], stated.alias("stated"), put.alias("put"))
    of_call = of_call.select("ref", F.col("at.line").alias("line"), F.col("at.pos").alias("pos"), *[f"r_{c}" for c in RESULT], "stated", "put")
    out = parts.join(of_call, ["ref", "line", "pos"], "left")
    said = F.coalesce("r_status", "p.status")
    later = F.col("put") > F.coalesce("stated", F.lit(-1).cast("long"))
    status = F.when(later & (said == "running"), "completed").otherwise(said)
    part = F.col("p").withField("status", status)
    for c in RESULT[1:]:
        part = part.withField(c, F.coalesce(f"r_{c}", f"p.{c}"))
    return out.select("ref", "message", "line", "pos", part.alias("p"))


def visible_part(p: Column) -> Column:
    """A part with internal text cleaned away; null if nothing is left."""
    text = cleaned(p["text"])
    spoken = p["type"].isin("text", "reasoning", "plan")
    kept = F.when(spoken, p.withField("text", text)).when(p["type"] == "tool", p.withField("title", cleaned(p["title"]))).otherwise(p)
    return F.when((~spoken | text.isNotNull()) & ~is_internal_event(p["type"]), kept)


def transcripts(events: DataFrame) -> DataFrame:
    """(ref, message_index, id, role, time_created, .., parts) of all sessions; messages that show nothing are left out."""
    rows = assigned(events)
    parts = with_results(parts_of(rows), rows).withColumn("p", visible_part(F.col("p"))).where("p is not null")
    whole = parts.groupBy("ref", "message").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "pos", "p"))), lambda x: x["p"]).alias("parts"))
    shown = heads_of(rows).join(whole, ["ref", "message"])
    return shown.withColumn("message_index", (F.row_number().over(W.partitionBy("ref").orderBy("message")) - 1).cast("int")).drop("message")


def stats(shown: DataFrame) -> DataFrame:
    """(ref, messages, input, output, cache_read, cache_create, cost, cost_source) of transcripts()."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input", "output", "cache_read", "cache_create")]
    source = F.when(F.sum("cost") > 0, F.when(F.bool_or(F.coalesce(F.col("cost_source") == "estimated", F.lit(False))), "estimated").otherwise("recorded"))
    return shown.groupBy("ref").agg(F.count("*").alias("messages"), *sums, F.sum("cost").alias("cost"), source.alias("cost_source"))
