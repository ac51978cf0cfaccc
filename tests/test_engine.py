"""Hierarchy, attribution, search language, pricing, snapshots and sources on small fixtures."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from loomspark.functions import pricing, tags
from loomspark.functions import text as T
from loomspark.operators import attribution, closure, facts, incremental, search, transcript, usage

HEAD = "ref string, session_id string, agent_name string, parent_ref string, activity long, total_cost double, cost_source string, message_count long, input_tokens long, output_tokens long, cache_read long, cache_create long, total_tokens long, project_kind string, project_key string"


def heads(spark, rows):
    """rows: (ref, parent, activity, cost)."""
    return spark.createDataFrame([(r, r, "a", p, t, c, "recorded", 1, 10, 5, 0, 0, None, "path", "/p") for r, p, t, c in rows], HEAD)


def test_mounts_orphans_and_cycles(spark):
    rows = heads(spark, [("root", None, 1, 1.0), ("kid", "root", 2, 2.0), ("deep", "kid", 3, 4.0), ("lost", "gone", 4, 8.0), ("below", "lost", 5, 16.0), ("x", "y", 6, 32.0), ("y", "x", 7, 64.0), ("z", "x", 8, 128.0)])
    got = {r.ref: (r.entry, r.depth, r.mount) for r in closure.mount(rows).collect()}
    assert got == {
        "root": ("root", 0, "root"), "kid": ("root", 1, "mounted"), "deep": ("root", 2, "mounted"), "lost": ("lost", 0, "orphan"), "below": ("lost", 1, "mounted"),
        "x": ("x", 0, "orphan"), "y": ("y", 0, "orphan"), "z": ("z", 0, "orphan"),
    }
    costs = {r.ref: r.subtree_cost for r in closure.subtree_costs(rows).collect()}
    assert costs["root"] == 7 and costs["lost"] == 24 and costs["x"] == costs["y"] == 224 and costs["z"] == 128
    stats = {r.entry: r.cost for r in closure.inclusive_stats(rows, closure.mount(rows)).collect()}
    assert stats == {"root": 7.0, "lost": 24.0, "x": 32.0, "y": 64.0, "z": 128.0}


def test_deep_chain_mounts(spark):
    rows = heads(spark, [(str(i), str(i - 1) if i else None, i, 1.0) for i in range(150)])
    got = closure.mount(rows).agg(F.max("depth"), F.count_distinct("entry")).first()
    assert tuple(got) == (149, 1)


def test_subtree_costs_of_deep_chains_and_cycles(spark):
    import random

    rng = random.Random(8)
    chain = [(f"c{i:05}", f"c{i - 1:05}" if i else None, i, 1.0) for i in range(10_000)]
    rows = [(f"n{i:03}", f"n{rng.randrange(200):03}" if rng.random() < 0.9 else None, i, float(i)) for i in range(200)] + [("loop", "loop", 1, 5.0), ("below", "loop", 1, 6.0)]
    for size in (2, 3, 5, 8, 13):  # cycles whose members come in any order
        names = rng.sample([f"r{size}-{i}" for i in range(size)], size)
        rows += [(a, b, 1, 1.0) for a, b in zip(names, names[1:] + names[:1])]
    up, cost = {r: p for r, p, _, _ in rows}, {r: c for r, _, _, c in rows}
    want = dict.fromkeys(up, 0.0)
    for ref in up:
        at, seen = ref, set()
        while at in up and at not in seen:  # every session counts once for each session on its way up
            seen.add(at)
            want[at] += cost[ref]
            at = up[at]
    got = {r.ref: r.subtree_cost for r in closure.subtree_costs(heads(spark, rows + chain)).collect()}
    assert all(got[f"c{i:05}"] == 10_000 - i for i in range(10_000)) and {r: got[r] for r in up} == want


def test_window_keeps_descendants(spark):
    rows = heads(spark, [("in", None, 50, 1.0), ("old kid", "in", 1, 1.0), ("out", None, 1, 1.0), ("new kid", "out", 50, 1.0)])
    got = closure.window_filter(rows, closure.mount(rows), 10, 100)
    assert {r.ref for r in got.collect()} == {"in", "old kid"}


def test_cost_detail_and_fallback(spark):
    rows = heads(spark, [("exact", None, 1000, 3.0), ("off", None, 50, 9.0)])
    messages = spark.createDataFrame([("exact", "m", 20, 1.0, "recorded"), ("exact", "m", 60, 2.0, None), ("off", "m", 20, 1.0, None)], "session_id string, model string, time_created long, cost double, cost_source string")
    messages = messages.select("*", F.lit(None).cast("long").alias("time_completed"), *[F.lit(0).cast("long").alias(c) for c in ("input", "output", "reasoning", "cache_read", "cache_create")])
    f = facts.message_facts(messages, rows)
    got = attribution.attributed_costs(rows, closure.mount(rows), f, facts.session_summary(f), facts.model_costs(f), 10, 55)
    assert sorted((r.ref, r.at_ms, r.model or "", r.cost) for r in got.collect()) == [("exact", 20, "m", 1.0), ("off", 50, "", 8.0), ("off", 50, "m", 1.0)]


def test_query_language():
    q = search.parse_query('agent:Codex tool:bash tool:BASH "two words" cost:1..2 cost:>1.5 nope:x kind:oops tag:docs tag:odd project-key:"" filekind:edit cost:x')
    assert q.groups == [["two words", "nope:x", "kind:oops", "tag:odd"]]
    assert q.filters == {"agent": "codex", "tools": ["bash"], "tags": ["docs"], "file_kind": "edit", "cost": {"cost_min": 1.5, "cost_max": 2.0, "above": True, "below": False}}
    assert search.parse_query("a b or c").groups == [["a", "b"], ["c"]] and search.parse_query("OR b OR").groups == [["b"]]
    assert search.cost_bounds(">=5") == {"cost_min": 5.0, "above": False} and search.cost_bounds("..") == search.cost_bounds("a..") == {}
    assert search.with_options(q, agent="x", tags=["bugfix"]).filters["tags"] == ["bugfix", "docs"]


def test_cleaned_texts(spark):
    texts = ["a\n<system-reminder>x\ny</system-reminder>\nb  \n", "<command-args>keep</command-args>", "<command-name>x</command-name>", "a <system-reminder> open", "t </command-name>u"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(transcript.cleaned(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["a\nb", "keep", None, "a", "t u"]


def test_half_an_identity_matches_nothing(spark):
    rows = heads(spark, [("a", None, 1, 1.0)])
    assert search.in_project(rows, "path", None).count() == 0 and search.in_project(rows, "path", "/p").count() == 1


def test_bm25_folds_accents_and_needs_phrases(spark):
    docs = spark.createDataFrame([(1, "Café note", "quick brown fox"), (2, "x", "brown quick cafe"), (3, "y", "nothing")], "doc long, title string, text string")
    index, sizes = search.postings(docs)
    assert {r.doc for r in search.bm25(index, sizes, [["cafe"]]).collect()} == {1, 2}
    assert {r.doc for r in search.bm25(index, sizes, [["quick brown"]]).collect()} == {1}
    best = search.bm25(index, sizes, [["cafe"]]).orderBy("score").first()
    assert best.doc == 1


def test_highlights_merge(spark):
    row = spark.createDataFrame([("The there with", "none")], "a string, b string").select(T.highlights(F.col("a"), ["the", "there", "with"]).alias("x"), T.highlights(F.col("b"), ["the"]).alias("y")).first()
    assert [(r.start, r.stop) for r in row.x] == [(0, 3), (4, 9), (10, 14)] and row.y == []


def test_timestamps_and_titles(spark):
    rows = spark.createDataFrame([("1700000000000",), ("2024-01-02 03:04:05",), ("2024-01-02T03:04:05+01:00",), ("bad",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.parsed_millis(F.col("t"))).collect()] == [1700000000000, 1704164645000, 1704161045000, None, None]
    one = spark.createDataFrame([(None, " \n a   b\nc", "/w/dir"), (None, None, "C:\\w\\dir\\"), (None, None, None)], "e string, m string, d string")
    assert [r[0] for r in one.select(T.title_of(F.col("e"), F.col("m"), F.col("d"))).collect()] == ["a b", "dir", "Untitled Session"]


def test_prices_resolve_in_order(spark):
    prices = spark.createDataFrame([("gpt-x",), ("gpt-x-mini",), ("anthropic/cl",)], "price_key string")
    models = spark.createDataFrame([(m,) for m in ("GPT_X", "gpt-x-20240101", "gpt-x-mini-high", "p/gpt-x@v1", "cl", "nick", "unknown")], "model string")
    got = {r.model: r.price_key for r in pricing.resolve_prices(models, prices, {"nick": "gpt-x"}).collect()}
    assert got == {"GPT_X": "gpt-x", "gpt-x-20240101": "gpt-x", "gpt-x-mini-high": "gpt-x-mini", "p/gpt-x@v1": "gpt-x", "cl": "anthropic/cl", "nick": "gpt-x"}


def test_tags_and_their_order(spark):
    rows = [("s", "user", "fix修 the é", None, None, None, False), *[("s", "assistant", None, "Read", None, None, False)] * 3, ("s", "assistant", None, "plan", "git push", "a.MD", False), ("t", "user", "prefix", "edit", None, None, False)]
    df = spark.createDataFrame(rows, "ref string, role string, text string, tool_name string, payload string, edited_path string, is_plan boolean")
    assert {r.ref: r.tags for r in tags.session_tags(df).collect()} == {"s": ["bugfix", "docs", "git-ops", "exploration", "planning"], "t": []}


def test_token_deltas_skip_repeats_and_resets(spark):
    cols = "ref string, line long, total long, total_input long, total_output long, total_reasoning long, total_cached long, last_input long, last_output long, last_reasoning long, last_cached long"
    rows = [("s", 1, 15, 10, 5, 0, 0, None, None, None, None), ("s", 2, 15, 10, 5, 0, 0, 99, 99, 0, 0), ("s", 3, 30, 20, 10, 0, 4, 7, 3, 1, 2), ("s", 4, 12, 8, 12, 0, 0, None, None, None, None)]
    got = usage.token_deltas(spark.createDataFrame(rows, cols)).orderBy("line").collect()
    assert [(r.line, r.input, r.output, r.reasoning, r.cached) for r in got] == [(1, 10, 5, 0, 0), (3, 7, 3, 1, 2), (4, 0, 2, 0, 0)]


def test_branch_ends_at_cycles(spark):
    rows = spark.createDataFrame([("s", 1, "a", "c"), ("s", 2, "b", "a"), ("s", 3, "c", "b"), ("t", 1, "r", None), ("t", 2, "side", "r"), ("t", 3, "tip", "r"), ("t", 4, None, "tip")], "ref string, line long, id string, parent_id string")
    got = transcript.visible_branch(rows).orderBy("ref", "depth").collect()
    assert [r.id for r in got] == ["a", "b", "c", "r", "tip"]


def test_stream_folds_late_and_removed_rows_over_restarts(spark, tmp_path):
    from loomspark.streaming import feed

    source = tmp_path / "in"
    source.mkdir()

    def arrive(name=None, rows=()):
        """A run of the stream, which stops and starts again from its checkpoint, and all changes after it."""
        if name:
            (source / name).write_text("\n".join(json.dumps(dict(zip(("key", "op", "at", "seq", "value"), r))) for r in rows))
        feed.start(spark, str(source), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination(120)
        log = feed.read_changes(spark, str(tmp_path / "log"))
        return log, sorted((r.key, r.value) for r in feed.current(log).collect()), sorted(r.key for r in feed.settled(log).collect())

    arrive("1.json", [(1, "upsert", 10, 1, 1.0), (1, "upsert", 20, 2, 2.0), (2, "upsert", 5, 3, 3.0)])
    _, now, quiet = arrive("2.json", [(1, "upsert", 15, 4, 9.0), (2, "remove", 6, 5, None), (3, "upsert", 1, 6, 4.0), (None, "upsert", 1, 6, 4.0)])
    assert now == [(1, 2.0), (3, 4.0)] and quiet == []
    log, now, _ = arrive("3.json", [(2, "upsert", 5, 9, 7.0), (3, "upsert", 1, 6, 8.0)])  # older than the removal; a repeat
    assert now == [(1, 2.0), (3, 4.0)]
    before = log.count()
    assert arrive()[0].count() == before  # nothing new, nothing again
    log, now, quiet = arrive("4.json", [(4, "upsert", 10_000_000, 10, 1.0), (3, "upsert", 9_999_000, 11, 5.0)])
    assert now == [(1, 2.0), (3, 5.0), (4, 1.0)] and quiet == [1]
    log, _, quiet = arrive("5.json", [(5, "upsert", 20_000_000, 12, 1.0)])
    assert quiet == [1, 3, 4] and log.where("op = 'settled'").groupBy("key").count().where("key in (1, 4) and count > 1").isEmpty()


def test_jsonl_counts_usage_once(spark, tmp_path):
    from loomspark.sources import jsonl

    log = tmp_path / "projects" / "p" / "s1.jsonl"
    log.parent.mkdir(parents=True)
    usage_of = {"input_tokens": 10, "cache_read_input_tokens": 4, "cache_creation_input_tokens": 1, "output_tokens": 7}
    say = lambda role, content, **k: {"type": role, "uuid": content if isinstance(content, str) else "u", "timestamp": "2024-01-01T00:00:00Z", "cwd": "/w", "message": {"role": role, "content": content, **k}}
    records = [say("user", "Fix it\nplease"), say("assistant", [{"type": "text", "text": "ok"}], model="m", usage=usage_of) | {"requestId": "r"}, say("assistant", "more", model="m", usage=usage_of) | {"requestId": "r"}, say("user", [{"type": "tool_result"}])]
    log.write_text("\n".join(["{broken", "", *map(json.dumps, records)]))
    rows = jsonl.claude_messages(spark, str(tmp_path))
    head = jsonl.session_heads(rows, "claudecode").first()
    assert (head.session_id, head.title, head.message_count, head.input, head.output) == ("s1", "Fix it", 3, 15, 7)
    counts = jsonl.skipped(jsonl.read_lines(spark, str(tmp_path), jsonl.CLAUDE)).first()
    assert (counts.lines, counts.skipped) == (5, 1)


def test_sqlite_source(spark, tmp_path):
    from loomspark.sources.sqlite import SqliteSource

    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("CREATE TABLE m (id TEXT, n INTEGER)")
        db.executemany("INSERT INTO m VALUES (?, ?)", [(str(i), i) for i in range(100)])
    spark.dataSource.register(SqliteSource)
    rows = spark.read.format("sqlite").schema("id string, n long").option("path", str(tmp_path / "x.db")).option("table", "m").option("ranges", "7").load()
    assert rows.agg(F.count("*"), F.sum("n")).first()[:] == (100, 4950)


def test_framed_logs_tolerate_torn_tails(spark, tmp_path):
    import zstandard

    from loomspark.sources.framed import read_framed

    pack = zstandard.ZstdCompressor().compress
    (tmp_path / "a.log").write_bytes(pack(b"one\ntwo\n") + pack(b"three\n") + pack(b"x" * 5000)[:20])
    (tmp_path / "b.log").write_bytes(b"plain\ntorn")
    got = read_framed(spark, str(tmp_path), "*.log").collect()
    assert sorted(r.value for r in got) == ["one", "plain", "three", "two"]


def test_merge_and_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "ref string, signature string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "ref string, signature string")
    assert {(r.ref, r.op) for r in incremental.diff(old, new).collect()} == {("b", "updated"), ("c", "removed"), ("d", "new")}
    assert {r.op for r in incremental.diff(old, new, partial=True).collect()} == {"updated", "new"}


def test_tool_status(spark):
    rows = spark.createDataFrame([("success", False, False), (None, True, True), (None, False, True), ("odd", False, False)], "s string, e boolean, o boolean")
    assert [r[0] for r in rows.select(transcript.tool_status(F.col("s"), F.col("e"), F.col("o"))).collect()] == ["completed", "error", "completed", "running"]


def test_payloads(spark):
    from loomspark.functions import payload

    rows = spark.createDataFrame([('{"file_path": " a.py ", "n": 1, "x": [true, null, {"path": "b.md"}, "t"]}', "Edit"), ("plain", "odd"), (None, None)], "p string, t string")
    got = rows.select(payload.leaf_text("p").alias("text"), payload.path_list("p").alias("paths"), payload.tool_kind(F.col("t")).alias("kind")).collect()
    assert [r.text for r in got] == ["a.py\n1\ntrue\nb.md\nt", "plain", ""]
    assert got[0].paths == ["a.py", "b.md"] and got[1].paths == [] and [r.kind for r in got] == ["edit", None, None]
    patch = "*** Begin Patch\n*** Update File: a b.py\n+x\n*** Add File: c.md \n*** Delete File: d\n*** End Patch"
    files = spark.createDataFrame([(patch,)], "p string").select(payload.patch_files(F.col("p")).alias("f")).first().f
    assert [(f.kind, f.path) for f in files] == [("edit", "a b.py"), ("write", "c.md"), ("delete", "d")]


def test_bookmark_and_alias_writes(spark):
    from loomspark.operators import bookmarks

    marks = bookmarks.mark(spark.createDataFrame([("a", 5)], "ref string, marked long"), spark.createDataFrame([("a", 9), ("b", 1)], "ref string, marked long"))
    assert {(r.ref, r.marked) for r in marks.collect()} == {("a", 5), ("b", 1)}
    names = bookmarks.rename(spark.createDataFrame([("a", "x"), ("b", "y")], "ref string, alias string"), spark.createDataFrame([("a", " z "), ("b", " "), ("c", "w" * 161)], "ref string, alias string"))
    assert {(r.ref, r.alias) for r in names.collect()} == {("a", "z")}


def test_pi_shows_the_last_branch(spark, tmp_path):
    from loomspark.sources import pi

    entry = lambda id, parent, at, **k: {"id": id, "parentId": parent, "timestamp": at, **k}
    say = lambda id, parent, at, role, content=None, **k: entry(id, parent, at, type="message", message={"role": role, "content": content, **k})
    usage_of = {"input": 10, "output": 7, "cacheRead": 4, "cacheWrite": 1, "cost": {"total": 0.5}}
    call = {"type": "toolCall", "id": "c1", "name": "read", "arguments": {"path": "a.py"}}
    records = [
        {"type": "session", "id": "top", "timestamp": 1000, "cwd": "/w/dir"},
        say("a", None, 2000, "user", "[WIP] fix\nit"),
        say("x", "a", 9000, "user", "left branch"),
        say("b", "a", 3000, "assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "<system-reminder>z</system-reminder>"}, call], model=" m ", usage=usage_of),
        say("c", "b", 4000, "toolResult", [{"type": "text", "text": "out"}], toolCallId="c1", isError=True),
        say("c2", "c", 4500, "toolResult", "late", toolCallId="c1"),
        say("d", "c2", 5000, "bashExecution", command="ls", output="o", exitCode=0),
        entry("e", "d", 6000, type="compaction", summary=" short "),
        entry("f", "e", 7000, type="custom_message", content="hidden", display=False),
        entry("g", "f", 8000, type="session_info", name=" "),
        say("h", "g", 8500, "user", [{"type": "image"}, {"type": "text", "text": "see"}]),
    ]
    (tmp_path / "2024_s_1.jsonl").write_text("\n".join(map(json.dumps, records)))
    (tmp_path / "headless.jsonl").write_text(json.dumps(say("a", None, 1, "user", "x")))
    entries = pi.read_entries(spark, str(tmp_path))
    branch = pi.branches(entries)
    shown = pi.transcripts(branch)
    got = shown.where("ref = 's_1'").orderBy("message_index").collect()
    assert [(r.id, r.role, [(p.type, p.text or p.tool) for p in r.parts]) for r in got] == [
        ("a", "user", [("text", "[WIP] fix\nit")]), ("b", "assistant", [("reasoning", "hm"), ("tool", "read")]), ("d", "tool", [("tool", "bash")]),
        ("e", "assistant", [("text", " short")]), ("h", "user", [("text", "[image]\nsee")]),
    ]
    head = pi.heads(entries, branch, shown).collect()
    assert [(h.session_id, h.title, h.directory, h.time_created, h.time_updated, h.message_count, h.input, h.output, h.total_cost, h.cost_source) for h in head] == [("s_1", "[WIP] fix", "/w/dir", 1000, 8500, 5, 15, 7, 0.5, "recorded")]
    calls = pi.tool_calls(branch, shown).orderBy("message_index").collect()
    assert [(c.tool, c.status, c.output, json.loads(c.input)) for c in calls] == [("read", "error", "out", {"path": "a.py"}), ("bash", "completed", "o", {"command": "ls"})]
    assert [tuple(r) for r in pi.model_usage(shown).collect()] == [("s_1", "m", 22)]


def test_opencode_tables(spark, tmp_path):
    from loomspark.sources import opencode

    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE session (id TEXT, parent_id TEXT, title TEXT, directory TEXT, time_created INTEGER, time_updated INTEGER)")
        db.execute("CREATE TABLE message (id TEXT, session_id TEXT, time_created INTEGER, data TEXT)")
        db.execute("CREATE TABLE part (id TEXT, message_id TEXT, time_created INTEGER, data TEXT)")
        sessions = [("root", None, " ", "/w", 1, None), ("kid", "root", "Kid", "/w", 2, 5), ("deep", "kid", "Deep", "/w", 3, 6), ("lost", "gone", "Lost", "/w", 4, 7), ("bare", None, "Bare", "/w", 5, 8)]
        db.executemany("INSERT INTO session VALUES (?, ?, ?, ?, ?, ?)", sessions)
        said = lambda **k: json.dumps(k)
        messages = [("m1", "root", 1, said(role="user")), ("m2", "root", 2, said(role="odd", cost=0.25, modelID="m", tokens={"input": 3, "output": 4})), ("m3", "root", 3, said(type="queue-operation", role="user")), ("m4", "kid", 1, said(role="user")), ("m5", "deep", 1, "[]"), ("m6", "lost", 1, said(role="user")), ("m7", "bare", 1, said(role="user", cost=9))]
        db.executemany("INSERT INTO message VALUES (?, ?, ?, ?)", messages)
        tool = said(type="tool", title="Tool: grep", callID="c", state={"output": "o", "arguments": {"q": 1}})
        parts = [("p2", "m1", 2, said(type="text", text="second")), ("p1", "m1", 1, said(type="text", text="First line\nmore")), ("p3", "m2", 1, tool), ("p4", "m2", 1, said(type="step-start")), ("p5", "m3", 1, said(type="text", text="x")), ("p6", "m4", 1, said(type="plan", input={"plan": "do"}))]
        parts += [("p7", "m5", 1, said(type="image", url="u")), ("p8", "m6", 1, said(type="text", text="x")), ("p9", "m7", 1, said(type="text", text="<command-name>x</command-name>")), ("p10", "m7", 1, said(type="progress", text="x"))]
        db.executemany("INSERT INTO part VALUES (?, ?, ?, ?)", parts)
    sessions, messages, parts = (opencode.read_table(spark, path, t) for t in ("session", "message", "part"))
    assert "task_type" not in sessions.columns
    shown = opencode.transcripts(messages, parts)
    got = {r.id: r for r in shown.collect()}
    assert sorted(got) == ["m1", "m2", "m4", "m5", "m6"] and [p.text for p in got["m1"].parts] == ["First line\nmore", "second"]
    p = got["m2"].parts[0]
    assert (got["m2"].role, p.tool, p.status, json.loads(p.input), p.output, got["m4"].parts[0].text, got["m5"].role) == ("assistant", "grep", "completed", {"q": 1}, "o", "do", "assistant")
    heads = {r.session_id: r for r in opencode.heads(sessions, shown).collect()}
    root = heads["root"]
    assert sorted(heads) == ["deep", "kid", "root"] and heads["deep"].parent_id == "kid"
    assert (root.title, root.time_updated, root.message_count, root.input_tokens, root.output_tokens, root.total_cost, root.cost_source, root.parent_id) == ("First line", 1, 2, 3, 4, 0.25, "recorded", None)
    assert {r.session_id for r in opencode.heads(sessions, shown, since=2).collect()} == set() and opencode.heads(sessions, shown, 0, 1).count() == 3


def test_cursor_pairs(spark, tmp_path):
    from loomspark.sources import cursor

    path = str(tmp_path / "state.vscdb")
    pairs = {
        "composerData:a": {"composerId": "a", "createdAt": 5, "lastUpdatedAt": 9, "modelConfig": {"modelName": "m0"}, "inputTokenCount": 3, "outputTokenCount": 4},
        "bubbleId:a:z": {"type": 1, "text": "Fix it\nnow", "createdAt": 6},
        "bubbleId:a:y": {"type": 2, "modelInfo": {"modelName": "m1"}, "text": "", "toolFormerData": {"name": "read_file_v2", "toolCallId": "c", "status": "failed", "params": '{"path": "x"}', "result": '{"message": "no"}'}, "timingInfo": {"clientRpcSendTime": 7.9}},
        "bubbleId:a:x": {"type": 2, "text": "done", "tokenCount": {"inputTokens": 1, "outputTokens": 2}},
        "bubbleId:a:w": {"type": 2, "text": "hidden", "kind": "queue_operation"},
        "bubbleId:a:v": {"type": 2, "toolFormerData": {"name": "create_plan", "status": "completed", "params": {"plan": " steps "}}},
        "composerData:b": {"id": "b", "name": "Kept", "subagentInfos": [{"id": "s"}]},
        "composerData:c": {"id": "c", "chatMessages": []},
        "bubbleId:gone:1": {"type": 1, "text": "x"},
    }
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE cursorDiskKV (key TEXT, value TEXT)")
        db.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", [(k, json.dumps(v)) for k, v in pairs.items()] + [("composerData:d", "{broken")])
    rows = cursor.read_pairs(spark, path)
    found = cursor.composers(rows)
    shown = cursor.transcripts(rows, found)
    got = shown.orderBy("rowid").collect()
    assert [(r.id, r.role, r.model, r.time_created, [(p.type, p.text or p.tool, p.status, p.error) for p in r.parts], r.output) for r in got] == [
        ("cursor-a-z", "user", "m0", 6, [("text", "Fix it\nnow", None, None)], 0), ("cursor-a-y", "assistant", "m1", 7, [("tool", "read", "error", "no")], 0),
        ("cursor-a-x", "assistant", "m1", 0, [("text", "done", None, None)], 2), ("cursor-a-v", "assistant", "m1", 0, [("plan", "steps", "success", None)], 0),
    ]
    heads = {r.session_id: tuple(r)[1:] for r in cursor.heads(found, shown).collect()}
    assert heads == {"a": ("Fix it", 5, 9, 4, 3, 4), "b": ("Kept", 0, None, 0, 0, 0)}


def test_sources_keep_what_is_not_proved_gone(spark):
    from loomspark.operators import sync

    found = spark.createDataFrame([("same", "/same", "1"), ("new", "/new", "1"), ("moved", "/b", "1"), ("edited", "/e", "2"), ("stale", "/s", "1")], "ref string, path string, fingerprint string")
    known = spark.createDataFrame([("same", "/same", "1", 5, False), ("moved", "/a", "1", 5, False), ("edited", "/e", "1", 5, False), ("stale", "/s", "1", 5, True), ("gone", "/gone", "1", 5, None), ("hidden", "/hidden", "1", 5, None), ("lost", None, None, 5, None), ("early", "/x", "1", 1, None), ("timeless", "/y", "1", None, None)], "ref string, path string, fingerprint string, changed_at long, stale boolean")
    present = spark.createDataFrame([("/hidden",), ("/hidden",), ("/same",)], "path string")
    state = lambda *window: {r.ref: r.state for r in sync.source_changes(found, known, present, *window).collect()}
    want = {"same": "unchanged", "new": "changed", "moved": "changed", "edited": "changed", "stale": "changed", "gone": "missing", "hidden": "failed", "lost": "missing"}
    assert state(3, 9) == want | {"early": "unseen", "timeless": "unseen"} and state() == want | {"early": "missing", "timeless": "missing"}
    heads = known.selectExpr("ref", "'old' AS title")
    read = spark.createDataFrame([("new", "parsed"), ("moved", "failed"), ("edited", "parsed"), ("same", "parsed")], "ref string, status string")
    outcomes = sync.outcomes_of(sync.source_changes(found, known, present, 3, 9), read, heads)
    assert {r.ref: (r.outcome, r.known) for r in outcomes.collect()} == {"same": ("kept", True), "new": ("parsed", False), "moved": ("failed", True), "edited": ("parsed", True), "stale": ("missing", True), "gone": ("missing", True), "hidden": ("failed", True), "lost": ("missing", True), "early": ("kept", True), "timeless": ("kept", True)}
    parsed = spark.createDataFrame([("new", "new", "n"), ("edited", "edited/2", "e"), ("same", "same", "not asked for")], "source_ref string, ref string, title string")
    after = {r.ref: r.title for r in sync.synchronised(heads, parsed, outcomes).collect()}
    assert after == {"same": "old", "moved": "old", "hidden": "old", "early": "old", "timeless": "old", "new": "n", "edited/2": "e"}
    assert sync.completeness(outcomes, False).first() == ("partial", 2) and sync.completeness(outcomes.where("outcome <> 'failed'"), False).first() == ("complete", 0)
