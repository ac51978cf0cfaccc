"""Programs of tool calls, line diffs and trigram search against plain versions."""

import json
import random

from pyspark.sql import functions as F

from loomspark.functions import exec_calls, linediff
from loomspark.operators import cursors, search, snippets, trigrams


def calls(source):
    return [(name, args and json.loads(args)) for name, args in exec_calls.decoded(source)]


def test_programs_of_calls():
    one = "const r = await tools.exec_command({cmd:\"sed -n '1,20p' a.md\",workdir:\"/tmp/p\",yield_time_ms:10000}); text(r.output)"
    assert calls(one) == [("exec_command", {"cmd": "sed -n '1,20p' a.md", "workdir": "/tmp/p", "yield_time_ms": 10000})]
    patch = 'const patch = "*** Begin Patch\\n*** Add File: a.txt\\n+hello";\nconst r = await tools.apply_patch({patch}); text(r.output)'
    assert calls(patch) == [("apply_patch", {"patch": "*** Begin Patch\n*** Add File: a.txt\n+hello"})]
    assert calls('const patch = "a: \\"x\\"\\npath\\\\to"; tools.apply_patch({patch});') == [("apply_patch", {"patch": 'a: "x"\npath\\to'})]
    plan = 'await tools.update_plan({plan:[{step:"a",status:"done"},{step:"b",status:"pending"},],explanation:"go",})'
    assert calls(plan) == [("update_plan", {"plan": [{"step": "a", "status": "done"}, {"step": "b", "status": "pending"}], "explanation": "go"})]
    assert [c[0] for c in calls('let r = tools.exec_command({cmd:"ls"}); const patch = "p"; tools.apply_patch({patch});')] == ["exec_command", "apply_patch"]
    assert calls("const x = 1; console.log(x)") == calls(None) == calls("") == []


def test_odd_programs():
    odd = "tools.a(x) tools.b([1,,2]) tools.c({a:foo, b:[foo, -1.5e3, .5, 0x1F, +0x1, 1e999], 'k y':null, d /*x*/ : // z\n true}) tools.e({a:1 tools.f({}) tools.g([]) tools.h({a}) tools.i('\\u0041\\x42\\q\\u00zz') tools.j({\"open"
    assert calls(odd) == [("a", None), ("c", {"b": [None, -1500, 0.5, 31, None, None], "k y": None, "d": True}), ("f", {}), ("g", []), ("h", {}), ("i", "ABqu00zz")]
    assert calls("var a = 'x'; let a = `y`; tools.t([a, {a}, {a: 'z'}]) tools.u(\"open\\") == [("t", ["y", {"a": "y"}, {"a": "z"}]), ("u", "open")]
    deep = "[" * 5000 + "]" * 5000
    assert exec_calls.value_at(deep, 0, {}) is not None


def test_call_names_and_targets(spark):
    rows = [(["exec_command", "apply_patch"],), (["update_plan", "exec_command"],), (["apply_patch", "update_plan"],), (["mcp__s__apply_patch", "mcp__s__run", "mcp__s__update_plan"],), ([],)]
    table = spark.createDataFrame(rows, "names array<string>")
    assert [r[0] for r in table.select(exec_calls.output_target(F.col("names"))).collect()] == [0, 1, 1, 1, -1]
    names = spark.createDataFrame([("mcp__node_repl__js",), ("exec_command",), ("mcp__",), ("mcp__x",)], "n string")
    assert [tuple(r) for r in names.select(exec_calls.own_name(F.col("n")), exec_calls.namespace(F.col("n"))).collect()] == [("js", "mcp__node_repl__"), ("exec_command", None), ("mcp__", None), ("x", "mcp__")]
    texts = spark.createDataFrame([("Script completed\nWall time 2.3 seconds\nOutput:\nhello", '"p"'), ("package.json", '{"patch":"q"}'), ("x", '{"patch":1}')], "o string, a string")
    assert [tuple(r) for r in texts.select(exec_calls.without_frame(F.col("o")), exec_calls.patch_text(F.col("a"))).collect()] == [("hello", "p"), ("package.json", "q"), ("x", "1")]


def common(a, b):
    """Length of a longest common subsequence, in quadratic time."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_diffs_are_shortest():
    rng = random.Random(3)
    for _ in range(1500):
        kinds = rng.choice([2, 3, 10, 50])
        a, b = ([str(rng.randrange(kinds)) for _ in range(rng.randint(0, 30))] for _ in range(2))
        got = linediff.matches(a, b)
        assert len(got) == common(a, b) and all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    a = [str(rng.randrange(900)) for _ in range(2000)]
    b = [x for x in a if rng.random() > 0.1]
    assert len(linediff.matches(a, b)) == len(b)


def test_diffs_of_texts(spark):
    rows = [("a\nb\nc\n", "a\nx\nc\n"), ("a\\nb", "a\nb"), (" ", None), (None, "n\n"), ("a", "a\n")]
    got = spark.createDataFrame(rows, "o string, n string").select(linediff.line_diff("o", "n").alias("d")).collect()
    marks = [[{"remove": "-", "add": "+", "context": " "}[x.type] + x.text for x in r.d] for r in got]
    assert marks == [[" a", "-b", "+x", " c"], [" a", " b"], [], ["+n"], ["-a", "+a"]]
    labels = spark.createDataFrame([("src/a.py",), ("a.py",), (" ",), ("src/",)], "p string").select(linediff.block_label(F.col("p"))).collect()
    assert [r[0] for r in labels] == ["a.py · src/a.py", "a.py", "edit", "src/"]


def test_trigrams_find_what_a_scan_finds(spark, tmp_path):
    import pyarrow.dataset as ds

    rng = random.Random(4)
    paths = ["".join(rng.choice("ab/é_%") for _ in range(rng.randint(0, 12))) for _ in range(800)] + ["common/" + str(i) for i in range(3000)] + [None, "", "AB", "ABA"]
    table = spark.createDataFrame([(p,) for p in paths], "path string")
    trigrams.postings(table, "path").write.option("parquet.block.size", 4096).parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    counts = trigrams.frequencies(index)
    for needle in ["aba", "ab/é", "%_", "É", "a", "common/12", "ommon/29", "zzz", "b" * 20, "ÉA", "ab" * 4]:
        found = trigrams.containing(index, counts, needle, table, "path")
        want = {p for p in paths if p is not None and needle.lower() in p.lower()}
        got = [r.text for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want, needle
    plan = trigrams.containing(index, counts, "common/12", table, "path")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [/12,com,n/1])" in plan.split("PushedFilters")[1]
    groups = [(s.min, s.max) for f in ds.dataset(tmp_path / "index").get_fragments() for g in f.row_groups for s in [type("S", (), g.statistics["gram"])]]
    assert sum(low <= "/12" <= high for low, high in groups) < len(groups) or len(groups) == 1
    assert trigrams.matching(table, trigrams.containing(index, counts, "aba", table, "path"), "path").count() == sum(p is not None and "aba" in p.lower() for p in paths)


def test_trigram_index_is_smaller_than_its_texts(spark, tmp_path):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(600)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:9])] + [(-1, None)], "id long, text string").repartition(1)
    size = lambda name: sum(p.stat().st_size for p in (tmp_path / name).rglob("*.parquet"))
    table.write.parquet(str(tmp_path / "texts"))
    trigrams.postings(table, "text").write.parquet(str(tmp_path / "index"))
    assert size("index") < 2 * size("texts")
    index = spark.read.parquet(str(tmp_path / "index"))
    needle = texts[3][50:58]
    got = sorted(r.id for r in trigrams.rows_containing(index, trigrams.frequencies(index), needle.upper(), table, "text").collect())
    assert got == [i for i, t in enumerate(texts + texts[:9]) if needle in t] and len(got) >= 2


def test_postings_are_made_without_a_shuffle(spark):
    table = spark.createDataFrame([(1, "b a b", "b a b"), (2, "", None), (3, None, "É e x-é")], "doc long, title string, text string")
    index, sizes = search.postings(table)
    got = sorted((r.doc, r.token, r.col, r.positions) for r in index.collect())
    assert got == [(1, "a", 0, [1]), (1, "a", 1, [1]), (1, "b", 0, [0, 2]), (1, "b", 1, [0, 2]), (3, "e", 1, [0, 1, 3]), (3, "x", 1, [2])]
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    again = index.unionByName(index.where("doc = 1"))  # a repeated row of one doc
    assert [r.doc for r in search.bm25(again, sizes, [["a"]]).collect()] == [1]


def test_snippets_are_the_best_windows(spark):
    rng = random.Random(5)
    texts = [(i, rng.choice(["", "-- "]) + " ".join(rng.choice(["a", "é", "bb", "x1", "y", "z", "w", "q", "r, s;"]) for _ in range(rng.randint(0, 60))) + rng.choice(["", "."])) for i in range(200)] + [(900, None), (901, "...")]
    table = spark.createDataFrame(texts, "doc long, text string").withColumn("title", F.lit("a bb"))
    index, _ = search.postings(table)
    got = {r.doc: (r.start, r.kinds, r.n, r.snippet) for r in snippets.snippets(table, index, ["a", "e", "bb"], 6).collect()}
    import re

    want = {}
    for doc, text in texts:
        words = [m for m in re.finditer(r"[^\W_]+", text or "")]
        held = [m[0].replace("é", "e") for m in words]
        scores = [(len({x for x in held[i : i + 6] if x in ("a", "e", "bb")}), sum(x in ("a", "e", "bb") for x in held[i : i + 6]), -i) for i in range(len(held))]
        if scores and max(scores)[0]:
            kinds, n, at = max(s for s in scores if held[-s[2]] in ("a", "e", "bb"))
            assert (kinds, n) == max(scores)[:2]  # of all windows, one that begins with a term is among the best
            end = min(len(words), 6 - at)
            want[doc] = (-at, kinds, n, (" … " if at else "") + text[words[-at].start() : words[end - 1].end()] + (" … " if len(words) > end else ""))
    assert got.keys() == want.keys()
    for doc, (start, kinds, n, snippet) in got.items():
        assert (kinds, n) == want[doc][1:3] and (start, snippet) == (want[doc][0], want[doc][3]), texts[doc]


def test_pages_by_cursor(spark):
    rng = random.Random(6)
    data = [(i, rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"])) for i in range(57)]
    rows = spark.createDataFrame(data, "id long, at long, name string")
    order = [("at", True), ("name", False), ("id", False)]
    params = {"q": "x", "tag": ["b", "a"], "limit": "10"}
    found, cursor = [], None
    while True:
        page = cursors.page(rows, order, 10, params, "s1", "v1", cursor)
        assert page.kind == "page"
        found += [tuple(r) for r in page.rows]
        if page.next_cursor is None:
            break
        cursor = page.next_cursor
    key = lambda r: (r[1] is None, -(r[1] or 0), r[2] is None, r[2] or "", r[0])
    assert found == sorted(data, key=key) and len(page.rows) == 7
    kind = lambda c, p=params, s="s1", v="v1": cursors.page(rows, order, 10, p, s, v, c).kind
    assert kind(cursor, {"limit": "5", "tag": ["a", "b"], "cursor": "z", "q": "x"}) == "page"
    assert kind(cursor, {"q": "y"}) == kind("!!") == kind("e30") == kind(cursor[:-3]) == kind("é") == kind("A" * 5000) == "invalid_cursor"
    assert kind(cursor, s="s2") == kind(cursor, v="v2") == "stale_snapshot"
    plan = cursors.seek(rows, order, 10, [2, None, 5])._jdf.queryExecution().executedPlan().toString()
    assert "offset" not in plan.lower().replace("offset=0", "") and "TakeOrderedAndProject" in plan
