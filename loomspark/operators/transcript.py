"""Session detail: display blocks, tables of contents, visible parts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.functions.text import once
from loomspark.operators.reduce import reduce_sessions

#: Tags whose block is internal text, tags of which only the marks go, and internal kinds of events.
INTERNAL_TAGS = ("command-message", "command-name", "local-command-caveat", "local-command-stdout", "system-reminder")
BARE_TAGS = ("command-args",)
INTERNAL_EVENTS = ("progress", "file history snapshot", "queue operation", "last prompt")


def _passes(tag: str) -> list[tuple[str, str]]:
    """What goes for an internal tag: blocks with lines of their own, other blocks, and all behind one that isn't closed."""
    opening = rf"<{tag}\b[^>]*>"
    block = rf"{opening}.*?</{tag}>"
    return [(rf"(?is)(^|\r?\n)[ \t]*{block}[ \t]*(?:\r?\n|\z)", "$1"), (rf"(?is){block}", ""), (rf"(?is)\n*{opening}.*\z", "")]


def cleaned(text: Column) -> Column:
    """Text without internal blocks (to the end where unclosed), loose marks and spaces at line ends; null if nothing is left.

    A tag's blocks go before the next tag's are looked for: of lines of blocks, each leaves the same line ends so.
    """
    marks = rf"(?i)</?(?:{'|'.join((*INTERNAL_TAGS, *BARE_TAGS))})\b[^>]*>"
    ends = [(r"[ \t]+(?=\r?\n|\z)", ""), (r"(?:\r?\n)+\z", "")]

    def replaced(out: Column, pairs: list[tuple[str, str]]) -> Column:
        for pattern, to in pairs:
            out = F.regexp_replace(out, pattern, to)
        return out

    def without(tag: str):
        """A tag's patterns are tried only on texts that name it."""
        return lambda t: F.when(F.lower(t).contains(f"<{tag}"), replaced(t, _passes(tag))).otherwise(t)

    def unmarked(t: Column) -> Column:
        for tag in INTERNAL_TAGS:
            t = once(t, without(tag))
        return once(t, lambda x: F.when(x.contains("<"), F.regexp_replace(x, marks, "")).otherwise(x))

    plain = once(text, lambda t: F.when(t.contains("<"), unmarked(t)).otherwise(t))
    trimmed = lambda t: F.when(t.endswith(" ") | t.endswith("\t") | t.contains("\n"), replaced(t, ends)).otherwise(t)
    return once(once(plain, trimmed), lambda t: F.when(t.rlike(r"\S"), t))


def is_internal_event(kind: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(kind)), "[_-]+", " ").isin(*INTERNAL_EVENTS)


def clean_messages(messages: DataFrame) -> DataFrame:
    """messages(.., parts array<struct<type, text>>) with cleaned parts; internal kinds, empty parts and messages without parts go."""
    kept = F.filter(F.transform("parts", lambda p: F.struct(p["type"].alias("type"), cleaned(p["text"]).alias("text"))), lambda p: p["text"].isNotNull() & ~is_internal_event(p["type"]))
    return messages.withColumn("parts", kept).where(F.size("parts") > 0)


def tool_status(status: Column, has_error: Column, has_output: Column) -> Column:
    """Explicit status (success is completed), else error, else completed when there is output, else running."""
    named = F.when(status == "success", "completed").when(status.isin("running", "completed", "error"), status)
    return F.coalesce(named, F.when(has_error, "error").when(has_output, "completed").otherwise("running"))


def display_blocks(parts: DataFrame) -> DataFrame:
    """(ref, block, type, text): adjacent parts of one type merge within a session; images and blank texts are dropped, plans stand alone."""
    shown = parts.where((F.col("type") != "image") & (F.trim("text") != ""))
    order = W.partitionBy("ref").orderBy("pos")
    starts = F.when((F.lag("type").over(order) == F.col("type")) & (F.col("type") != "plan"), 0).otherwise(1)
    numbered = shown.withColumn("start", starts).withColumn("block", F.sum("start").over(order.rowsBetween(W.unboundedPreceding, 0)))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    return numbered.groupBy("ref", "block").agg(F.first("type").alias("type"), texts.alias("text"), F.count("*").alias("parts"))


def contents(messages: DataFrame) -> DataFrame:
    """Counts of each session's messages by role and tool."""
    return messages.groupBy("ref", "role", "tool").agg(F.count("*").alias("n"))


def visible_branch(entries: DataFrame) -> DataFrame:
    """(ref, id, depth) on the path from each session's last entry back to its root; cycles end where they close.

    entries(ref, line, id, parent_id). Sessions are reduced one at a time: their size bounds the memory.
    """

    def walk(rows: list[dict]) -> list[tuple]:
        named = [r for r in rows if r["id"] is not None]
        parent, path = {r["id"]: r["parent_id"] for r in named}, {}
        at = named[-1]["id"] if named else None
        while at in parent and at not in path:
            path[at] = None
            at = parent[at]
        return [(rows[0]["ref"], x, n) for n, x in enumerate(reversed(path))]

    return reduce_sessions(entries, "line", walk, "ref string, id string, depth long")


def branch_depths(entries: DataFrame, place: str) -> DataFrame:
    """(ref, depths): for each session's entries by place their depth on the path from its last entry to the root; null off the path.

    entries(ref, id, parent_id, place) are dealt by session, as the window that numbers them leaves them; places go from zero
    without a gap. Of repeated ids the last counts, cycles end where they close. Rows stream through by Arrow batches, sorted; a session's ids are in memory at a time.
    """

    def of_session(ids: list, parents: list) -> list:
        places, path = {x: i for i, x in enumerate(ids)}, {}
        at = ids[-1]
        while at in places and at not in path:
            path[at] = None
            at = parents[places[at]]
        depths = [None] * len(ids)
        for n, x in enumerate(reversed(path)):
            depths[places[x]] = n
        return depths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref, ids, parents = None, [], []
        for batch in batches:
            refs, out = [], []
            for r, i, p in zip(*[batch.column(c).to_pylist() for c in ("ref", "id", "parent_id")]):
                if r != ref and ids:
                    refs.append(ref)
                    out.append(of_session(ids, parents))
                    ids, parents = [], []
                ref = r
                ids.append(i)
                parents.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(refs, pa.string()), pa.array(out, pa.list_(pa.int64()))], ["ref", "depths"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([ref], pa.string()), pa.array([of_session(ids, parents)], pa.list_(pa.int64()))], ["ref", "depths"])

    return entries.sortWithinPartitions("ref", place).select("ref", "id", "parent_id").mapInArrow(run, "ref string, depths array<bigint>")
