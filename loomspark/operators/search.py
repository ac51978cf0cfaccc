"""Structured full-text search: query language, postings index, BM25, match types and merging."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.functions.tags import TAGS
from loomspark.operators.closure import checkpointed

K1, B, TITLE_WEIGHT, TEXT_WEIGHT = 1.2, 0.75, 8.0, 1.0
#: Names of qualifiers, kinds of file use and of project identity.
QUALIFIERS = {
    "agent": "agent", "project": "project", "project-key": "project_key", "projectkey": "project_key", "project-kind": "project_kind", "projectkind": "project_kind",
    "cwd": "cwd", "tool": "tools", "file": "file", "path": "file", "kind": "file_kind", "filekind": "file_kind", "file-kind": "file_kind", "tag": "tags", "signal": "tags", "cost": "cost",
}
FILE_KINDS, PROJECT_KINDS = {"read", "edit", "write", "delete"}, {"git_remote", "git_common_dir", "manifest_path", "synthetic", "path", "loose"}


@dataclass
class Query:
    """A parsed search text: groups of terms, of which all terms of one group must match, and filters."""

    groups: list[list[str]] = field(default_factory=list)
    filters: dict = field(default_factory=dict)

    @property
    def terms(self) -> list[str]:
        return [t for group in self.groups for t in group]

    @property
    def any_term(self) -> bool:
        return len(self.groups) > 1

    @property
    def uses_index(self) -> bool:
        return bool(self.groups or {"file", "file_kind", "tools"} & self.filters.keys())


def cost_bounds(value: str) -> dict:
    """The ends that a cost qualifier sets: a..b, >a, >=a, <b, <=b or an exact number; nothing else sets any."""
    number = r"(\d+(?:\.\d+)?)"
    low = lambda n, open_end: {"cost_min": float(n), "above": open_end}
    high = lambda n, open_end: {"cost_max": float(n), "below": open_end}
    if m := re.fullmatch(f"{number}\\.\\.{number}", value):
        return low(m[1], False) | high(m[2], False)
    if m := re.fullmatch(f"(>=?|<=?){number}", value):
        return low(m[2], m[1] == ">") if m[1][0] == ">" else high(m[2], m[1] == "<")
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?", value, re.IGNORECASE):
        return low(value, False) | high(value, False)
    return {}


def _accepted(name: str, value: str) -> bool:
    """Whether a qualifier takes a value; one that doesn't is text."""
    allowed = {"project_kind": PROJECT_KINDS, "file_kind": FILE_KINDS, "tags": set(TAGS)}.get(name)
    return allowed is None or (value.lower() if name == "tags" else value) in allowed


def parse_query(text: str) -> Query:
    """Groups of terms and filters of a search text. Quotes hold a phrase; unknown or invalid qualifiers are text;
    one without a value is dropped; later cost ends replace earlier ones; OR, in any case and between terms only, parts groups."""
    words, filters = [], {}
    for word in re.findall(r'(?:"[^"]*(?:"|$)|[^\s"])+', text):
        m = re.fullmatch(r"([a-zA-Z][a-zA-Z_-]*):(.+)", word)
        name, value = (QUALIFIERS.get(m[1].lower()), _unwrapped(m[2])) if m else (None, word)
        if m and not value:
            continue
        if name is None or not _accepted(name, value):
            words.append(word)
        elif name in ("tools", "tags"):
            held = filters.setdefault(name, [])
            held += [] if value.lower() in held else [value.lower()]
        elif name == "cost":
            if bounds := cost_bounds(value):
                filters["cost"] = {"cost_min": None, "cost_max": None, "above": False, "below": False} | filters.get("cost", {}) | bounds
        else:
            filters[name] = value.lower() if name == "agent" else value
    groups: list[list[str]] = [[]]
    for at, word in enumerate(words):
        if word.upper() != "OR":
            groups[-1].append(_unwrapped(word) if word.startswith('"') else word.replace('"', ""))
        elif 0 < at < len(words) - 1 and "OR" not in (words[at - 1].upper(), words[at + 1].upper()):
            groups.append([])
    return Query([g for g in ([t for t in group if t] for group in groups) if g], filters)


def _unwrapped(value: str) -> str:
    value = value.strip()
    return value[1:-1].strip() if len(value) > 1 and value[0] == value[-1] == '"' else value.strip('"')


def tokenised(docs: DataFrame) -> DataFrame:
    """(doc, c) of docs(doc, title, text): the tokens of both columns, which the index and the sizes are made of."""
    return docs.select("doc", F.array(F.struct(F.lit(0).alias("col"), T.tokens(F.col("title")).alias("w")), F.struct(F.lit(1).alias("col"), T.tokens(F.col("text")).alias("w"))).alias("c"))


def postings(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, token, col, positions) and (doc, size) of docs(doc, title, text) or of their tokens: the index, to be written sorted by token.

    A text's postings are made where it lies: its tokens are sorted with their positions and cut where the token changes.
    """
    both = docs if "c" in docs.columns else tokenised(docs)
    sizes = both.select("doc", (F.size(F.get("c", F.lit(0))["w"]) + F.size(F.get("c", F.lit(1))["w"])).cast("long").alias("size"))
    flat = both.select("doc", F.inline("c")).select("doc", "col", F.explode(_runs(F.col("w"))).alias("r"))
    return flat.select("doc", "r.token", "col", "r.positions"), sizes


def _runs(words: Column) -> Column:
    """(token, positions) of the distinct tokens of an array."""

    def cut(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["token"] != F.get(s, i - 1)["token"]))
        end = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(s))
        return T.once(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i)["token"].alias("token"), F.transform(F.slice(s, i + 1, end(at, k) - i), lambda x: x["pos"]).alias("positions"))))

    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("token"), i.alias("pos"))))
    return F.when(F.size(words) > 0, T.once(placed, cut))


def _phrase_hits(words: list[str]) -> Column:
    """Occurrences of a phrase from the map of a row's token positions."""
    at = lambda k: F.transform(F.coalesce(F.try_element_at(F.col("m"), F.lit(words[k])), F.array().cast("array<int>")), lambda p: p - k)
    return F.size(reduce(F.array_intersect, [at(k) for k in range(len(words))]))


def bm25(index: DataFrame, sizes: DataFrame, groups: list[list[str]]) -> DataFrame:
    """(doc, score) of docs that match all terms of any group, lower is better; each term is a phrase of its tokens."""
    words = lambda t: re.findall(r"[^\W_]+", t.lower().translate(str.maketrans(T.ACCENTED, T.PLAIN)))
    parsed = [[w for w in map(words, group) if w] for group in groups]
    phrases = [p for group in parsed for p in group]
    wanted = sorted({x for p in phrases for x in p})
    of = lambda w: F.flatten(F.collect_list(F.when(F.col("token") == w, F.col("positions"))))
    rows = index.where(F.col("token").isin(wanted)).groupBy("doc", "col").agg(F.map_from_arrays(F.array(*map(F.lit, wanted)), F.array(*map(of, wanted))).alias("m"))
    weight = F.when(F.col("col") == 0, TITLE_WEIGHT).otherwise(TEXT_WEIGHT)
    hits = rows.select("doc", *[(_phrase_hits(p) * weight).alias(f"h{i}") for i, p in enumerate(phrases)])
    hits = hits.groupBy("doc").agg(*[F.sum(f"h{i}").alias(f"h{i}") for i in range(len(phrases))])
    hits = checkpointed(hits)  # narrow; read for the counts and for the scores
    seen = hits.agg(*[F.count_if(F.col(f"h{i}") > 0).alias(f"n{i}") for i in range(len(phrases))]).first()
    stats = sizes.agg(F.count("*").alias("n"), F.avg("size").alias("mean")).first()
    idf = [max(1e-6, math.log((stats["n"] - seen[f"n{i}"] + 0.5) / (seen[f"n{i}"] + 0.5))) for i in range(len(phrases))]
    tests, at = [], 0
    for group in parsed:
        if group:
            tests.append(reduce(and_, [F.col(f"h{i}") > 0 for i in range(at, at + len(group))]))
        at += len(group)
    norm = K1 * (1 - B + B * F.col("size") / F.lit(stats["mean"]))
    part = lambda i: F.lit(idf[i]) * (F.col(f"h{i}") * (K1 + 1)) / (F.col(f"h{i}") + norm)
    return hits.where(reduce(or_, tests)).join(sizes, "doc").select("doc", (-reduce(lambda a, b: a + b, [part(i) for i in range(len(phrases))])).alias("score"))


def filtered(sessions: DataFrame, query: Query) -> DataFrame:
    """sessions(agent_name, project_kind, project_key, project_name, directory, tags) that pass the agent, project, folder and tag filters."""
    f = query.filters
    if "agent" in f:
        sessions = sessions.where(F.lower("agent_name") == f["agent"])
    for name in ("project_kind", "project_key"):
        if name in f:
            sessions = sessions.where(F.col(name) == f[name])
    if "project" in f:
        needle = f["project"].lower()
        sessions = sessions.where(reduce(or_, [F.lower(F.coalesce(c, F.lit(""))).contains(needle) for c in ("project_key", "project_name", "directory")]))
    for tag in f.get("tags", []):
        sessions = sessions.where(F.array_contains("tags", tag))
    return in_project(sessions, path=f["cwd"]) if "cwd" in f else sessions


def with_options(query: Query, **options) -> Query:
    """Explicit options beat qualifiers; tags and tools are united."""
    given = {k: v for k, v in options.items() if v is not None}
    joined = {k: list(dict.fromkeys([*given[k], *query.filters.get(k, [])])) for k in ("tags", "tools") if k in given}
    return Query(query.groups, query.filters | given | joined)


def file_hits_with_text(text: DataFrame, files: DataFrame) -> DataFrame:
    """Text hits that are file hits too, where both are asked for explicitly."""
    return text.join(files.select("ref").distinct(), "ref", "left_semi")


def holds(text: Column, terms: list[str], any_term: bool = False) -> Column:
    tests = [F.lower(text).contains(t.lower()) for t in terms]
    return reduce(lambda a, b: a | b if any_term else a & b, tests)


def match_types(sessions: DataFrame, messages: DataFrame, terms: list[str], any_term: bool = False) -> DataFrame:
    """sessions(ref, title) with match_type and snippet: the title, else the first message that holds the terms, else the reply."""
    first = messages.where(holds(F.col("text"), terms, any_term)).groupBy("ref").agg(F.min_by(F.struct("role", "text"), "message_index").alias("m"))
    kind = F.when(F.col("m.role") == "user", "user_message").when(F.col("m.role") == "tool", "tool_output").otherwise("assistant_reply")
    in_title = holds(F.col("title"), terms, any_term)
    rows = sessions.join(first, "ref", "left")
    return rows.select("ref", "title", F.when(in_title, "title").otherwise(kind).alias("match_type"), F.when(in_title, F.col("title")).otherwise(T.snippet(F.col("m.text"), terms)).alias("snippet"))


def tools_and_files(sessions: DataFrame, tools: DataFrame, files: DataFrame, query: Query) -> DataFrame:
    """Sessions that used every tool and have one file row of the path part and kind."""
    for tool in query.filters.get("tools", []):
        sessions = sessions.join(tools.where(F.col("tool") == tool).select("ref").distinct(), "ref", "left_semi")
    path, kind = query.filters.get("file"), query.filters.get("file_kind")
    if path or kind:
        rows = files.where(F.lower("path").contains(path.lower())) if path else files
        rows = rows.where(F.col("kind") == kind) if kind else rows
        sessions = sessions.join(rows.select("ref").distinct(), "ref", "left_semi")
    return sessions


def within_cost(rows: DataFrame, bounds: dict, column: str = "subtree_cost") -> DataFrame:
    c = F.col(column)
    if bounds["cost_min"] is not None:
        rows = rows.where(c > bounds["cost_min"] if bounds["above"] else c >= bounds["cost_min"])
    if bounds["cost_max"] is not None:
        rows = rows.where(c < bounds["cost_max"] if bounds["below"] else c <= bounds["cost_max"])
    return rows


def in_project(sessions: DataFrame, kind: str | None = None, key: str | None = None, path: str | None = None, case_sensitive: bool = False) -> DataFrame:
    """Exact identity (half of one matches nothing), or the identity or a directory equal to, below or above the path."""
    if path is None:
        return sessions.where(F.lit(False) if kind is None or key is None else (F.col("project_kind") == kind) & (F.col("project_key") == key))
    fix = (lambda c: F.replace(c, F.lit("\\"), F.lit("/"))) if case_sensitive else (lambda c: F.lower(F.replace(c, F.lit("\\"), F.lit("/"))))
    here, there = fix(F.col("directory")), (path if case_sensitive else path.lower()).replace("\\", "/").rstrip("/")
    near = (here == there) | here.startswith(there + "/") | F.lit(there).startswith(F.concat(here, F.lit("/")))
    same = (F.col("project_kind") == kind) & (F.col("project_key") == key) if kind and key else F.lit(False)
    return sessions.where(same | near)


def merge_sources(sources: list[DataFrame], limit: int) -> DataFrame:
    """Union of result lists (ref, place), earlier sources first, each ref once, up to limit."""
    rows = reduce(DataFrame.unionByName, [s.select("ref", F.lit(i).alias("source"), "place") for i, s in enumerate(sources)])
    first = rows.groupBy("ref").agg(F.min(F.struct("source", "place")).alias("x")).select("ref", "x.source", "x.place")
    return first.orderBy("source", "place", "ref").limit(limit)


def alias_quota(results: DataFrame, aliases: DataFrame, limit: int, share: float = 0.25) -> DataFrame:
    """Alias hits take up to max(1, floor(limit * share)) of the slots, never all; the rest are results."""
    slots = min(max(1, int(limit * share)), max(0, limit - 1))
    named = aliases.orderBy("place", "ref").limit(slots).select("ref", F.lit(0).alias("source"), "place")
    rest = results.join(named, "ref", "left_anti").select("ref", F.lit(1).alias("source"), "place")
    return named.unionByName(rest).orderBy("source", "place", "ref").limit(limit)


def with_parent_titles(hits: DataFrame, sessions: DataFrame) -> DataFrame:
    """hits(ref) with the title of the parent, where there is one."""
    own = sessions.select("ref", "parent_ref")
    titles = sessions.select(F.col("ref").alias("parent_ref"), F.col("title").alias("parent_title"))
    return hits.join(own, "ref").join(titles, "parent_ref", "left").select(*hits.columns, "parent_title")


