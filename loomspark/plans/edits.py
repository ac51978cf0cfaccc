"""Registered queries: programs of tool calls, line diffs, substring search by trigrams, snippets and pages by cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import exec_calls as calls
from loomspark.functions.linediff import line_diff
from loomspark.operators import cursors, facts, snippets, trigrams
from loomspark.plans import lens
from loomspark.plans.analytics import FILES, Model
from loomspark.plans.lens import BASE, FACTS_SQL, with_sql
from loomspark.plans.lookup import TALKS, TOKENS, docs, index_of, talks

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str, *parts: str, alone: bool = False):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = (f"WITH {', '.join(parts)}\n" if alone else with_sql(*parts)) + sql
        return function

    return add


#: A program for each message: a command, a plan of nested values, and a patch that two calls name.
PROGRAM = r"""concat('// tools.none\nconst patch = "*** Begin Patch\\n*** Update File: ', path, '\\n\\u002b', message_index, '\\"\\n*** End Patch";', '\nlet r = await tools.exec_command({cmd: \'cat ', path, '\', "n": ', input, ', flags: [true, null, -', output, '.50, {deep: `x`},],}); text(r.output);',
  if(message_index % 3 = 1, concat('await tools.update_plan({plan:[{step:"', tool, '", done:false}]});'), ''), if(message_index % 2 = 0, 'tools.apply_patch({patch /* the patch */})', 'tools.apply_patch(patch)'), if(message_index % 4 = 0, ' tools.mcp__srv__run(unknown)', ''), ' tools.broken({a: b.c})')"""


@query("""SELECT f.ref || '/' || f.message_index AS id, c.name, c.namespace, c.args, c.name = 'run' OR (c.name = 'exec_command' AND message_index % 4 <> 0) AS target FROM facts f, LATERAL (
    SELECT 'exec_command' AS name, NULL AS namespace, '{"cmd":"cat ' || path || '","n":' || input || ',"flags":[true,null,-' || output || '.5,{"deep":"x"}]}' AS args
    UNION ALL SELECT 'update_plan', NULL, '{"plan":[{"step":"' || tool || '","done":false}]}' WHERE message_index % 3 = 1
    UNION ALL SELECT 'apply_patch', NULL, CASE WHEN message_index % 2 = 0 THEN '{"patch":' || p || '}' ELSE p END FROM (SELECT '"*** Begin Patch\\n*** Update File: ' || path || '\\n+' || message_index || '\\"\\n*** End Patch"' AS p)
    UNION ALL SELECT 'run', 'mcp__srv__', NULL WHERE message_index % 4 = 0) c""", *BASE, FACTS_SQL)
def codex_exec_calls(spark, sf_dir):
    rows = Model(spark, sf_dir).facts.select(F.concat_ws("/", "ref", "message_index").alias("id"), calls.exec_calls(F.expr(PROGRAM)).alias("calls"))
    # the outer form: else Spark filters on the number of calls, for which each program would be read twice
    each = rows.select("id", calls.output_target(F.transform("calls", lambda c: c["name"])).alias("at"), F.posexplode_outer("calls").alias("n", "c")).where("n is not null")
    return each.select("id", calls.own_name(F.col("c.name")).alias("name"), calls.namespace(F.col("c.name")).alias("namespace"), "c.args", (F.col("at") == F.col("n")).alias("target"))


def _edits(spark, sf_dir) -> DataFrame:
    """(ref, message_index, a, b): each message's sentences, a line each, and what is left of them after an edit that depends on their places."""
    rows = talks(spark, sf_dir)[0].withColumn("a", F.filter(F.split(F.regexp_replace("text", r"[.\n]+ *", "\n"), "\n"), lambda x: x != ""))
    moved = F.filter(F.transform("a", lambda x, i: F.when(i % 5 == 3, F.lit(None)).when(i % 7 == 4, F.upper(x)).otherwise(x)), lambda x: x.isNotNull())
    return rows.withColumn("b", F.concat(F.slice("a", F.size("a"), 1), moved, F.slice("a", 1, F.col("message_index").cast("int") % 3)))


EDITS = r"""a AS (SELECT ref, message_index, list_filter(string_split(regexp_replace(text, '[.\n]+ *', chr(10), 'g'), chr(10)), lambda x: x <> '') AS a FROM m),
e AS (SELECT *, a[len(a):len(a)] || list_filter(list_transform(a, lambda x, i: CASE WHEN (i - 1) % 5 = 3 THEN NULL WHEN (i - 1) % 7 = 4 THEN upper(x) ELSE x END), lambda x: x IS NOT NULL) || a[1:message_index % 3] AS b FROM a),
lcs AS (SELECT ref, message_index, a, b, 0::BIGINT AS i, list_transform(range(0, len(b) + 1), lambda j: 0::BIGINT) AS best FROM e
  UNION ALL SELECT ref, message_index, a, b, i + 1, list_transform(range(1, len(b) + 2), lambda j: list_max([best[j]] || list_transform(list_filter(range(1, j), lambda k: b[k] = a[i + 1]), lambda k: best[k] + 1))) FROM lcs WHERE i < len(a))"""


@query("SELECT ref, message_index, len(a) - best[len(b) + 1] AS removed, len(b) - best[len(b) + 1] AS added, best[len(b) + 1] AS kept, true AS whole FROM lcs WHERE i = len(a) AND len(a) > 0", "RECURSIVE_" , TALKS, EDITS, alone=True)
def edit_diffs(spark, sf_dir):
    """How many lines each edit removes, adds and keeps, and whether its diff holds both texts whole."""
    joined = lambda c: F.array_join(c, "\n")
    rows = _edits(spark, sf_dir).select("ref", "message_index", "a", "b", line_diff(F.concat(joined("a"), F.lit("\n")), F.concat(joined("b"), F.lit("\n"))).alias("d")).where("size(a) > 0")
    lines = lambda *kinds: F.transform(F.filter("d", lambda x: x["type"].isin(*kinds)), lambda x: x["text"])
    n = lambda kind: F.size(lines(kind)).cast("long")
    return rows.select("ref", "message_index", n("remove").alias("removed"), n("add").alias("added"), n("context").alias("kept"), ((lines("remove", "context") == F.col("a")) & (lines("add", "context") == F.col("b"))).alias("whole"))


ORACLES["edit_diffs"] = ORACLES["edit_diffs"].replace("WITH RECURSIVE_, ", "WITH RECURSIVE ")


def _index(spark, sf_dir, name: str, texts: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    index = lens.kept(spark, sf_dir, f"{name}-grams", lambda: trigrams.postings(texts, text))
    return index, lens.kept(spark, sf_dir, f"{name}-gram-counts", lambda: trigrams.frequencies(index))


@query("SELECT ref, kind, path, 'long' AS needle FROM files WHERE contains(lower(path), 'mall_ri') UNION ALL SELECT ref, kind, path, 'short' FROM files WHERE contains(lower(path), '/s') AND kind = 'edit'", *BASE, FACTS_SQL, FILES)
def path_trigram_search(spark, sf_dir):
    """File rows by a part of their path: a long one by the index, one of two characters by a scan, with a kind on the same row."""
    files = facts.file_activity(Model(spark, sf_dir).facts).select("ref", "kind", "path")
    index, counts = _index(spark, sf_dir, "paths", files, "path")
    hits = lambda rows, needle: trigrams.rows_containing(index, counts, needle, rows, "path")
    return hits(files, "MALL_ri").withColumn("needle", F.lit("long")).unionByName(hits(files.where("kind = 'edit'"), "/s").withColumn("needle", F.lit("short")))


@query("SELECT ref, message_index FROM m WHERE contains(lower(text), 'tion wh')", TALKS, alone=True)
def message_trigram_search(spark, sf_dir):
    messages = talks(spark, sf_dir)[0]
    index, counts = _index(spark, sf_dir, "messages", messages, "text")
    return trigrams.rows_containing(index, counts, "Tion wh", messages, "text").select("ref", "message_index")


@query(r"""SELECT doc, (start - 1)::INT AS start, kinds, n, CASE WHEN start > 1 THEN ' … ' ELSE '' END || array_to_string(p[2 * (start - 1) + lead + 1:2 * (least(start + 17, words) - 1) + lead + 1], '') || CASE WHEN words > start + 17 THEN ' … ' ELSE '' END AS snippet
  FROM (SELECT doc, arg_max(i, k * 1000000000000 + c * 1000000 - i) AS start, max(k)::INT AS kinds, arg_max(c, k * 1000000000000 + c * 1000000 - i) AS n FROM (SELECT doc, i, len(list_filter(w, lambda x: x IN ('the', 'with', 'pour'))) AS c,
      (list_contains(w, 'the')::INT + list_contains(w, 'with')::INT + list_contains(w, 'pour')::INT)::BIGINT AS k FROM (SELECT doc, i, b[i:i + 17] AS w FROM (SELECT doc, b, unnest(range(1, len(b) + 1)) AS i FROM tok) WHERE b[i] IN ('the', 'with', 'pour'))) GROUP BY doc)
  JOIN (SELECT doc_id AS doc, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS p, CASE WHEN regexp_matches(text, '^[\p{L}\p{N}]') THEN 0 ELSE 1 END AS lead FROM documents) USING (doc) JOIN (SELECT doc, len(b) AS words FROM tok) USING (doc)""", TOKENS, alone=True)
def search_snippet_windows(spark, sf_dir):
    """The best window of 18 words of every document with one of the terms."""
    index, _ = index_of(spark, sf_dir)
    return snippets.snippets(docs(spark, sf_dir), index, ["the", "with", "pour"])


@query("SELECT ref, activity, ((row_number() OVER (ORDER BY activity DESC, ref) - 1) // 60)::INT AS page FROM sessions ORDER BY activity DESC, ref LIMIT 240", *BASE)
def cursor_pages(spark, sf_dir):
    """The first four pages of the sessions, each continued from the last by its cursor."""
    rows, cursor, found = lens.heads(spark, sf_dir).select("ref", "activity"), None, []
    for n in range(4):
        page = cursors.page(rows, [("activity", True), ("ref", False)], 60, {"view": "sessions", "cursor": cursor or ""}, sf_dir, "by activity", cursor)
        found += [(*r, n) for r in page.rows]
        cursor = page.next_cursor
        if cursor is None:
            break
    return spark.createDataFrame(found, "ref string, activity long, page int")
