"""Sources: filters that reach SQLite, and framed logs, from fixture files."""

import sqlite3

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringEndsWith, StringStartsWith

from loomspark.sources import cursor, sqlite


def database(path):
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE cursorDiskKV (key TEXT UNIQUE, value TEXT)")
        db.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", [(f"{kind}:{i:03}", "{}" if kind else None) for i in range(200) for kind in ("composerData", "bubbleId", "other")] + [("bubbleIe", None), ("bubbleId", None), (None, "x")])


def test_filters_become_sql():
    reader = sqlite.PushingReader(["key"], {"path": "x", "table": 'a"b'})
    filters = [StringStartsWith(("key",), "ab"), GreaterThan(("n",), 5), In(("n",), (1, 2)), EqualTo(("s", "inner"), 1), StringEndsWith(("key",), "z"), EqualTo(("n",), 1.5)]
    assert list(reader.pushFilters(filters)) == filters
    assert reader.sql('"key"') == ('SELECT "key" FROM "a""b" WHERE rowid BETWEEN ? AND ? AND ("key" >= ? AND "key" < ?) AND ("n" > ?) AND ("n" IN (?, ?))', ["ab", "ac", 5, 1, 2])


def test_beginnings_are_read_as_ranges_of_keys(spark, tmp_path):
    path = str(tmp_path / "state.db")
    database(path)
    pairs = cursor.read_pairs(spark, path, ranges=3)
    assert pairs.count() == 603 and pairs.where("key is null").count() == 1
    bubbles, composers = (cursor.read_pairs(spark, path, beginning=b) for b in (cursor.BUBBLES, cursor.COMPOSERS))
    assert bubbles.count() == composers.count() == 200 and min(r.key for r in bubbles.collect()) == "bubbleId:000"
    one, other = (F.substring(side["key"], -3, 3) for side in (bubbles, composers))
    assert bubbles.join(composers, one == other).count() == 200
    reader = sqlite.SqliteReader(["key"], {"path": path, "table": "cursorDiskKV", "ranges": "4", "column": "key", "beginning": "bubbleId:19"})
    parts = reader.partitions()
    assert sum(len(list(reader.read(p))) for p in parts) == 10 and (parts[0].first, parts[-1].last) == (572, 599)
    before = sqlite.fingerprint(path)
    (tmp_path / "state.db-wal").write_bytes(b"log")
    assert [x[0] for x in sqlite.fingerprint(path)] == ["", "-wal"] and sqlite.fingerprint(path)[:1] == before


def test_pushed_filters(spark, tmp_path):
    path = str(tmp_path / "state.db")
    database(path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        want = {r.key for r in cursor.read_pairs(spark, path).collect() if r.rowid > 590 and r.key and "bubbleId:198" <= r.key <= "composerData:198"}
        few = cursor.read_pairs(spark, path, 3, push=True).where("rowid > 590 and key >= 'bubbleId:198' and key <= 'composerData:198'")
        assert {r.key for r in few.collect()} == want and len(want) > 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def dsh_log(*events, **header):
    """A header and events, numbered and timed by their places unless they say so."""
    top = {"type": "session", "version": 0, "id": "s", "createdAt": 5, "delegationDepth": 0, "cwd": "/p", **header}
    return [top, *({"seq": i, "time": 100 + i, **e} if "seq0" not in e else e for i, e in events)]


def numbered(events):
    at = 0
    for e in events:
        yield at, e
        at += len(e["data"].get("texts", e["data"].get("args", [1])))


def write_log(path, records, *, frames=None, tail=b""):
    import json

    import zstandard

    path.parent.mkdir(parents=True)
    lines = [(json.dumps(r) + "\n").encode() for r in records]
    if frames is None:
        path.write_bytes(b"".join(lines) + tail)
        return
    pack = zstandard.ZstdCompressor(write_checksum=True).compress
    cuts = [0, 1, *frames, len(lines)]
    path.write_bytes(b"".join(pack(b"".join(lines[a:b])) for a, b in zip(cuts, cuts[1:])) + tail)


def message(text, source=None, **more):
    return {"id": more.pop("id", ""), "source": source or {}, "content": [{"type": "text", "text": text}], **more}


def dsh_events():
    chunk = lambda turn, step, **c: {"type": "assistant/chunk", "data": {"turn": turn, "step": step, "chunk": c}}
    result = lambda call, text, **more: {"type": "tool/result", "surfaceOp": "append", "data": {"message": {"source": {"kind": "tool", "callId": call}, "content": [{"type": "tool-result", "toolCallId": call, "content": [{"type": "text", "text": text}], **more}]}, "meta": {"k": 1}}}
    events = [
        {"type": "user/message", "surfaceOp": "append", "data": {**message("inherited"), "source": {"kind": "user"}}}, {"type": "session/title", "data": {"title": "Old  title"}},
        {"type": "user/message", "surfaceOp": "append", "data": {**message("Fix it"), "source": {"kind": "user"}}}, {"type": "user/message", "surfaceOp": "append", "data": {**message("context"), "source": {"kind": "hook"}}},
        {"type": "user/message", "surfaceOp": {"op": "replace", "start": 0, "end": 2}, "data": {**message("copy"), "source": {"kind": "user"}}}, {"type": "request/context", "data": {"provider": "prov", "model": "mod"}},
        {"type": "text-chunks", "seq0": 6, "time0": 200, "data": {"turn": 1, "step": 0, "index": 0, "texts": ["set", "tled"], "dt": [3]}},
        {"type": "assistant/message", "surfaceOp": "append", "data": {"turn": 1, "step": 0, "usage": {"inputTokens": 10, "cacheReadTokens": 4, "outputTokens": 8, "reasoningTokens": 3}, "message": {"id": "a1", "source": {"provider": "prov", "model": "mod2"}, "content": [{"type": "reasoning", "text": "why"}, {"type": "text", "text": "Settled."}, {"type": "tool-call", "id": "c1", "name": "Read", "arguments": "{}"}, {"type": "tool-call", "id": "c9", "name": "Odd", "arguments": "{\"x\":1}"}]}}},
        {"type": "tool/call", "data": {"callId": "c1", "name": "Read", "arguments": "{\"f\":\"a\"}"}}, result("c1", "contents"), result("c1", "again", isError=True),
        chunk(1, 0, type="text-delta", index=0, text="late"), {"type": "reasoning-chunks", "seq0": 13, "time0": 300, "data": {"turn": 1, "step": 1, "index": 1, "texts": ["th", "ink"], "dt": [1]}},
        {"type": "tool-call-chunks", "seq0": 15, "time0": 310, "data": {"turn": 1, "step": 1, "index": 2, "id": "c2", "name": "Grep", "args": ["{\"q\"", ":1}"], "dt": [1]}}, chunk(1, 1, type="text-delta", index=0, text="draft"),
        chunk(1, 1, type="block-end", index=0, block={"type": "text", "text": "Torn"}), chunk(1, 1, type="text-delta", index=0, text=" end"), chunk(1, 1, type="usage", usage={"inputTokens": 7, "outputTokens": 2}),
    ]
    return events


def test_dsh_sessions(spark, tmp_path):
    from loomspark.operators import builder
    from loomspark.sources import dsh

    records = dsh_log(*numbered(dsh_events()), seedLength=2, parentSession="up")
    write_log(tmp_path / "a" / "session.jsonl.zstd", records, frames=[3, 9], tail=b"\x28\xb5\x2f\xfd\x04")
    write_log(tmp_path / "b" / "session.jsonl", [{**records[0], "id": "plain"}, *records[1:]], tail=b'{"torn')
    lines = dsh.read_logs(spark, str(tmp_path))
    heads, rows = dsh.headers(lines), dsh.events(lines)
    assert dsh.problems(lines, heads, rows).count() == 0 and rows.count() == 2 * 21
    shown = builder.transcripts(dsh.transcript_events(rows, heads)).cache()
    for ref in ("s", "plain"):
        got = shown.where(F.col("ref") == ref).orderBy("message_index").collect()
        assert [(m.role, m.id, [(p.type, p.text or p.tool) for p in m.parts]) for m in got] == [
            ("user", "dsh-user-2", [("text", "Fix it")]), ("assistant", "a1", [("reasoning", "why"), ("text", "Settled."), ("tool", "Odd"), ("tool", "Read")]), ("assistant", "dsh-step-1-1", [("text", "Torn end"), ("reasoning", "think"), ("tool", "Grep")]),
        ]
        read, grep = got[1].parts[3], got[2].parts[2]
        assert (read.status, read.input, read.output, read.metadata, read.title) == ("completed", '{"f":"a"}', "contents", '{"k":1}', "read") and (grep.status, grep.input, grep.call_id) == ("running", '{"q":1}', "c2")
        assert (got[1].model, got[1].input, got[1].output, got[1].reasoning, got[1].cache_read) == ("mod2", 14, 5, 3, 4) and (got[2].model, got[2].provider, got[2].input, got[2].time_created) == ("mod2", "prov", 7, 300)
    h = {r.session_id: r for r in dsh.heads_of(heads, rows, shown).collect()}["s"]
    assert (h.title, h.parent_id, h.directory, h.time_created, h.time_updated, h.message_count) == ("Fix it", "up", "/p", 5, 311, 3)


def test_dsh_problems(spark, tmp_path):
    from loomspark.sources import dsh

    good = dsh_log(*numbered(dsh_events()[:3]))
    call = {"type": "tool/call", "data": {"callId": "c"}}
    logs = {
        "version": [{**good[0], "version": 1}, *good[1:]], "gap": [*good[:2], {**good[2], "seq": 5}], "unknown": [*good, {"type": "new/thing", "seq": 3, "time": 1, "data": {}}], "ignorable": [*good, {"type": "new/thing", "seq": 3, "time": 1, "ignorable": True}],
        "packed": [*good, {"type": "text-chunks", "seq0": 3, "time0": 1, "data": {"turn": 1, "step": 1, "index": 0, "texts": ["a", "b"], "dt": []}}], "twice": dsh_log(*numbered([call, call])), "seed": [{**good[0], "seedLength": 4}, *good[1:]], "surface": dsh_log(*numbered([{"type": "tool/result", "data": {}}])), "fine": good,
    }
    for name, records in logs.items():
        write_log(tmp_path / name / "session.jsonl", [{**records[0], "id": name}, *records[1:]])
    write_log(tmp_path / "bytes" / "session.jsonl.zstd", good, frames=[2], tail=b"no frame at all")
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "session.jsonl").write_bytes(b'{"cut')
    lines = dsh.read_logs(spark, str(tmp_path))
    heads, rows = dsh.headers(lines), dsh.events(lines)
    got = {r.file.split("/")[-2]: r.problem for r in dsh.problems(lines, heads, rows).collect()}
    assert got.keys() == set(logs) - {"fine", "ignorable"} | {"bytes", "empty"}
    assert (got["version"], got["gap"], got["unknown"], got["packed"]) == ("another version of the format", "the events' numbers have a gap", "an unknown event", "a packed row is malformed") and "frame" in got["bytes"]


def test_frames_are_decoded_one_by_one():
    import zstandard

    from loomspark.sources.framed import frames

    pack = zstandard.ZstdCompressor().compress
    big = bytes(range(256)) * 2000
    data = pack(b"one\n") + pack(big) + pack(b"") + pack(b"two\n")
    assert list(frames(data)) == [b"one\n", big, b"", b"two\n"] and list(frames(data[:-3])) == [b"one\n", big, b""] and list(frames(b"")) == []
