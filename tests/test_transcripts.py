"""Transcripts: the builder's events, message parts, and logs with rewinds, from fixture files."""

import json

import duckdb
from pyspark.sql import functions as F

from loomspark.functions.parts import FIELDS, part_of
from loomspark.operators import builder
from loomspark.plans.transcripts import ORACLES, QUERIES
from loomspark.sources import grok


def p(kind, text=None, **fields):
    return {**dict.fromkeys(FIELDS), "type": kind, "text": text, **fields}


def built(spark, *rows):
    """Messages by session of events given as (kind, fields)."""
    events = [{"ref": "s", "line": i, "kind": kind, "id": "a", "time_created": 10, **fields} for i, (kind, fields) in enumerate(rows)]
    schema = ", ".join(f"{c} {t}" for c, t in builder.COLUMNS.items())
    table = spark.createDataFrame([{c: e.get(c) for c in builder.COLUMNS} for e in events], schema)
    shown = builder.transcripts(table)
    return [r.asDict(True) for r in shown.orderBy("message_index").collect()], shown


def texts(message):
    return [(x["type"], x["text"] or x["call_id"]) for x in message["parts"]]


CALL = p("tool", tool="read", call_id="c1", status="running")


def tokens(**counts):
    return {**dict.fromkeys(builder.COUNTERS), **counts}


def test_parts_group_until_a_tool_closes_the_text(spark):
    part = lambda kind, text, **more: ("part", {"parts": [p(kind, text)], "agent": "x", **more})
    got, _ = built(spark, part("reasoning", "think"), part("text", "answer"), ("call", {"parts": [CALL], "mark": True}), part("text", "after"))
    assert [texts(m) for m in got] == [[("reasoning", "think"), ("text", "answer"), ("tool", "c1")], [("text", "after")]]
    assert (got[0]["mode"], got[0]["agent"], got[0]["cost"], got[1]["mode"]) == ("tool", "x", 0.0, None)
    got, _ = built(spark, part("text", "same"), part("text", "same"), part("text", "same", dedup=True))
    assert texts(got[0]) == [("text", "same"), ("text", "same")]
    got, _ = built(spark, part("text", "before", grouping="current"), ("call", {"parts": [CALL], "target": "current"}), part("reasoning", "after", grouping="current"))
    assert [texts(m) for m in got] == [[("text", "before"), ("tool", "c1"), ("reasoning", "after")]]
    got, _ = built(spark, part("text", "answer"), part("reasoning", "next", reset=True), ("call", {"parts": [CALL]}))
    assert [texts(m) for m in got] == [[("text", "answer")], [("reasoning", "next"), ("tool", "c1")]]
    got, _ = built(spark, part("text", "answer"), part("reasoning", "next"), ("call", {"parts": [CALL]}), part("reasoning", "new"))
    assert [texts(m) for m in got] == [[("text", "answer"), ("tool", "c1")], [("reasoning", "next")], [("reasoning", "new")]]
    got, _ = built(spark, part("text", "one "), part("text", "two", joined=True), ("message", {"role": "user", "parts": [p("text", "u")]}), part("text", "three", joined=True))
    assert [texts(m) for m in got] == [[("text", "one two")], [("text", "u")], [("text", "three")]]


def test_results_update_the_latest_open_call(spark):
    message = ("message", {"role": "assistant", "parts": [CALL]})
    result = lambda **fields: ("result", {"call_id": "c1", **fields})
    state = lambda *rows: [(x["status"], x["output"]) for m in built(spark, *rows)[0] for x in m["parts"]]
    assert state(message, result(output="done", status="completed", consume=True), result(status="error")) == [("completed", "done")]
    assert state(message, result(output="done")) == [("completed", "done")]
    assert state(message, result(output="done", silent=True)) == [("running", "done")]
    assert state(message, result(status="error"), result(output="late")) == [("error", "late")]
    assert state(message, result(output="a"), result(status="running")) == [("running", "a")]
    assert state(result(output="early"), message, message, result(output="second")) == [("running", None), ("completed", "second")]


def test_usage_goes_backwards(spark):
    turn = ("message", {"role": "assistant", "parts": [p("text", "turn")]})
    first = ("usage", {"tokens": tokens(input=10, output=5, reasoning=2), "model": "sol", "cost": 0.1, "cost_source": "estimated"})
    more = ("usage", {"tokens": tokens(input=4, output=1, cache_read=8), "model": "sol", "cost": 0.05, "cost_source": "estimated"})
    (got,), shown = built(spark, turn, first, more)
    assert (got["model"], got["input"], got["output"], got["reasoning"], got["cache_read"], got["cache_create"]) == ("sol", 14, 6, 2, 8, None)
    assert abs(got["cost"] - 0.15) < 1e-9 and got["cost_source"] == "estimated"
    assert builder.stats(shown).select("messages", "input", "cache_read", "cost_source").first() == (1, 14, 8, "estimated")
    counted = ("message", {"role": "assistant", "parts": [p("text", "turn")], "model": "luna", "tokens": tokens(input=10), "cost": 0.1})
    (got,), _ = built(spark, counted, ("usage", {"tokens": tokens(input=4), "model": "sol", "cost": 0.05}))
    assert (got["input"], got["cost"]) == (10, 0.1)
    got, _ = built(spark, turn, turn, *[("usage", {"tokens": tokens(input=n), "model": m}) for n, m in ((1, "a"), (2, None), (4, None), (8, "a"))])
    assert [(m["model"], m["input"]) for m in got] == [(None, 6), ("a", 9)]


def test_messages_without_visible_parts_go(spark):
    got, shown = built(spark, ("message", {"role": "user", "parts": [p("text", "<command-name>clear</command-name>")]}), ("message", {"role": "assistant", "id": "b", "parts": [p("text", "seen")]}))
    assert [(m["message_index"], m["id"]) for m in got] == [(0, "b")] and builder.transcripts(shown.limit(0).select("ref")).count() == 0


def test_parts_tell_null_from_missing(spark):
    rows = {
        '{"type":"tool","tool":"t","state":{"input":null,"arguments":{"a":1}}}': ("running", None, None, None),
        '{"type":"tool","tool":"t","state":{"arguments":{"a":1},"output":null,"result":"r"}}': ("completed", '{"a":1}', None, None),
        '{"type":"tool","tool":"t","input":"old","output":"o","state":{"error":null,"a.b":[1],"meta":{"a.b":0,"k":null}}}': ("completed", "old", "o", '{"k":null,"a.b":[1]}'),
        '{"type":"tool","tool":"t","state":{"metadata":null,"meta":"m"}}': ("running", None, None, "m"),
        '{"type":"tool","title":"Tool:  t ","state":{"error":"e","x":1,"metadata":"gone"}}': ("error", None, None, '{"x":1}'),
    }
    got = {r.j: (r.p.status, r.p.input, r.p.output, r.p.metadata) for r in spark.createDataFrame([(x,) for x in rows], "j string").select("j", part_of(F.col("j")).alias("p")).collect()}
    assert got == rows
    deep = '"end"'
    for i in range(40):
        deep = f'{{"x":1,"{("text", "plan", "content")[i % 3]}":{deep}}}'
    plans = ['{"type":"plan","input":%s}' % deep, '{"type":"plan","text":"{a"}', '{"type":"plan","text":null,"approval_status":"fail","output":"no","input":"yes"}', '{"type":"plan","input":[1]}', "[]", None]
    got = [r.p and (r.p.text, r.p.status) for r in spark.createDataFrame([(x,) for x in plans], "j string").select(part_of(F.col("j")).alias("p")).collect()]
    assert got == [("end", "success"), ("{a", "success"), ("no", "fail"), None, None, None]


AT = 1_785_916_800_000  # 2026-08-05T08:00:00Z


def update(ms, prompt, kind, method="session/update", **fields):
    return {"timestamp": (AT + ms) // 1000, "method": method, "params": {"update": {"sessionUpdate": kind, **fields}, "_meta": {"agentTimestampMs": AT + ms, "eventId": f"e{ms}", "promptId": prompt}}}


def chunk(ms, prompt, kind, text, **meta):
    return update(ms, prompt, kind, content={"type": "text", "text": text}, **({"_meta": meta} if meta else {}))


def own(ms, prompt, kind, **fields):
    return update(ms, prompt, kind, "_x.ai/session/update", **fields)


def used(ms, prompt, n, ticks, **more):
    usage = {"inputTokens": n, "outputTokens": n // 5, "totalTokens": n + n // 5, "cachedReadTokens": 10, "costUsdTicks": ticks, "modelUsage": {"g-build": {"totalTokens": n + n // 5}}, **more}
    return own(ms, prompt, "turn_completed", usage=usage)


def grok_log(root, ref, updates, **summary):
    folder = root / "sessions" / ref
    folder.mkdir(parents=True)
    about = {"info": {"id": ref, "cwd": "/tmp/p"}, "created_at": "2026-08-05T08:00:00.000Z", "last_active_at": "2026-08-05T08:29:00.000Z", "current_model_id": "g", **summary}
    (folder / "summary.json").write_text(json.dumps(about, indent=1))
    (folder / "updates.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in updates))


def grok_sessions(spark, root):
    heads = grok.read_summaries(spark, str(root))
    rows = grok.records(grok.read_updates(spark, str(root), heads)).cache()
    shown = grok.transcripts(rows).cache()
    return {r.session_id: r for r in grok.heads(heads, rows, shown).collect()}, shown, rows


def test_grok_transcripts(spark, tmp_path):
    tool = {"toolCallId": "t1", "title": "Read", "rawInput": {"file": "a"}, "_meta": {"x.ai/tool": {"name": "read_file", "kind": "read"}}}
    log = [
        chunk(500, "host", "user_message_chunk", "internal", hostTurn=True), chunk(750, "host", "agent_thought_chunk", "   "),
        chunk(1000, "p0", "user_message_chunk", "Inspect ", promptIndex=0), chunk(1100, "p0", "user_message_chunk", "it", promptIndex=0),
        chunk(2000, "p0", "agent_thought_chunk", "Look"), chunk(2100, "p0", "agent_thought_chunk", "ing"), chunk(3000, "p0", "agent_message_chunk", "I will."),
        update(4000, "p0", "tool_call", status="pending", **tool), update(5000, "p0", "tool_call_update", toolCallId="t1", status="completed", rawOutput={"type": "F"}), own(5500, "p0", "subagent_spawned", child_session_id="kid"),
        update(6000, "p0", "plan", entries=[{"content": "Read", "status": "pending"}]), update(6100, "p0", "plan", entries=[{"content": "Read", "status": "completed"}]), "torn {",
        used(7000, "p0", 100, 500_000_000), chunk(8000, "p1", "user_message_chunk", "Sum", promptIndex=1), chunk(9000, "p1", "agent_message_chunk", "Valid."), used(10_000, "p1", 50, 100_000_000),
    ]
    grok_log(tmp_path, "s1", log, generated_title="Named", parent_session_id="up")
    grok_log(tmp_path, "s2", [chunk(1, "h", "user_message_chunk", "x", hostTurn=True)])
    heads, shown, rows = grok_sessions(spark, tmp_path)
    h = heads["s1"]
    assert heads.keys() == {"s1"} and (h.title, h.parent_id, h.directory, h.message_count, h.input, h.output, h.cache_read, h.total, h.cost_source) == ("Named", "up", "/tmp/p", 4, 150, 30, 20, 180, "recorded")
    assert h.time_created == AT and h.time_updated == AT + 29 * 60_000 and abs(h.total_cost - 0.06) < 1e-9
    first, second = shown.where("role = 'assistant'").orderBy("message_index").collect()
    parts = {x.type: x for x in first.parts}
    assert [x.type for x in first.parts] == ["reasoning", "text", "tool", "plan"] and parts["reasoning"].text == "Looking" and (parts["plan"].text, parts["plan"].status) == ("- [x] Read", "success")
    assert (parts["tool"].tool, parts["tool"].title, parts["tool"].status, parts["tool"].input, parts["tool"].output) == ("read_file", "read", "completed", '{"file":"a"}', '{"type":"F"}')
    assert (first.id, first.model, first.mode, first.provider, first.subagent_id, first.input, first.cost) == ("p0", "g", "tool", "xai", "kid", 100, 0.05)
    assert second.input == 50 and [x.text for x in shown.where("message_index = 0").first().parts] == ["Inspect it"]
    assert [tuple(r) for r in grok.model_usage(rows).collect()] == [("s1", "g-build", 180)]


def test_grok_rewinds(spark, tmp_path):
    ask = lambda ms, text, i: chunk(ms, f"p{ms}", "user_message_chunk", text, promptIndex=i)
    say = lambda ms, text: chunk(ms, None, "agent_message_chunk", text)
    back = lambda ms, target: own(ms, None, "rewind_marker", target_prompt_index=target)
    one = [ask(1, "keep", 0), say(2, "kept"), used(3, None, 10, 10), ask(4, "drop", 1), say(5, "dropped"), used(6, None, 20, 20, costIsPartial=True), back(7, 1), ask(8, "new", 1), say(9, "newer")]
    nested = [ask(1, "a", 0), say(2, "A"), ask(3, "b", 1), say(4, "B"), ask(5, "c", 2), back(6, 2), ask(7, "d", 2), say(8, "D"), back(9, 9), back(10, -1), back(11, 1), ask(12, "e", 1), back(13, 5), say(14, "E"), back(15, 0), back(16, 0), ask(17, "f", 0), say(18, "F"), ask(19, "g", 1), back(20, 1)]
    grok_log(tmp_path, "one", one)
    grok_log(tmp_path, "nested", nested)
    heads, shown, _ = grok_sessions(spark, tmp_path)
    text = lambda ref: ["".join(x.text for x in r.parts) for r in shown.where(F.col("ref") == ref).orderBy("message_index").collect()]
    assert text("one") == ["keep", "kept", "new", "newer"] and text("nested") == ["f", "F"]
    assert (heads["one"].title, heads["one"].input, heads["one"].cost_source) == ("keep", 30, None)


def test_numbers_that_users_share(spark, tmp_path):
    """grok_messages equals its SQL where an event's number repeats among users."""
    made = duckdb.connect()
    made.execute("CREATE TABLE events AS SELECT event_id, ts, user_id + 1500 * k AS user_id, event_type, value, props FROM '/root/testdata/sf0.001/events.parquet', range(3) r(k) WHERE k < 2 OR event_id % 4 < 2")
    made.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = sorted(made.execute(ORACLES["grok_messages"]).fetchall())
    assert sorted(map(tuple, QUERIES["grok_messages"](spark, str(tmp_path)).collect())) == want
    assert any(x[3].startswith(("ask", "say")) and len(x[3].split("ask")) > 2 for x in want)
