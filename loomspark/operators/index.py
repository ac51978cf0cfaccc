"""Upkeep of the session index: message replacement, document upserts, freshness, tags, ordering and detail rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.operators.closure import checkpointed


def replace_messages(existing: DataFrame, incoming: DataFrame, counts: DataFrame) -> DataFrame:
    """existing(ref, message_index, ..) after an upsert by index; of sessions in counts(ref, n) messages from n on go."""
    key = ["ref", "message_index"]
    rest = existing.join(incoming.select(*key), key, "left_anti").unionByName(incoming.select(*existing.columns))
    return rest.join(counts.select("ref", "n"), "ref", "left").where(F.col("n").isNull() | (F.col("message_index") < F.col("n"))).select(*existing.columns)


def upsert_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(ref, hash, messages, version, op): rows by ref; an incoming row replaces one of another hash, count or version."""
    facts = ("hash", "messages", "version")
    a, b = existing.select("ref", *[F.col(c).alias(f"a_{c}") for c in facts]), incoming.select("ref", *[F.col(c).alias(f"b_{c}") for c in facts])
    same = F.struct(*[f"a_{c}" for c in facts]) == F.struct(*[f"b_{c}" for c in facts])
    op = F.when(F.col("b_hash").isNull() | F.coalesce(same, F.lit(False)), "kept").when(F.col("a_hash").isNull(), "new").otherwise("updated")
    return a.join(b, "ref", "full").select("ref", *[F.coalesce(f"b_{c}", f"a_{c}").alias(c) for c in facts], op.alias("op"))


def content_hash(*facts: str) -> Column:
    """Digest of a row's facts in order; nulls are kept apart from empty values."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in facts]), 256)


def freshness(requested: DataFrame, documents: DataFrame, sessions: DataFrame, messages: DataFrame, version: int) -> DataFrame:
    """(ref, state) of requested ids: absent, unindexed, pending, old (version), changed (hash), partial (message count) or fresh."""
    n = messages.groupBy("ref").agg(F.count("*").alias("n"))
    rows = requested.select("ref").join(documents.select("ref", F.col("hash").alias("doc_hash"), "messages", "version", "pending"), "ref", "left")
    rows = rows.join(sessions.select("ref", F.col("hash").alias("now")), "ref", "left").join(n, "ref", "left")
    state = F.when(F.col("now").isNull(), "absent").when(F.col("doc_hash").isNull(), "unindexed").when(F.col("pending"), "pending").when(F.col("version") != version, "old")
    state = state.when(F.col("doc_hash") != F.col("now"), "changed").when(F.col("messages") != F.coalesce("n", F.lit(0)), "partial").otherwise("fresh")
    return rows.select("ref", state.alias("state"))


def to_reindex(documents: DataFrame, sessions: DataFrame) -> DataFrame:
    """Pending documents whose session still exists."""
    return documents.where("pending").join(sessions.select("ref", "activity"), "ref").select("ref", "activity")


def stale_tags(sessions: DataFrame, tags: DataFrame, revision: int) -> DataFrame:
    """Sessions whose tags are missing, of another source time or of another revision."""
    rows = sessions.select("ref", "activity").join(tags.select("ref", "source_time", "revision"), "ref", "left")
    return rows.where(F.col("revision").isNull() | (F.col("source_time") != F.col("activity")) | (F.col("revision") != revision)).select("ref")


def inherited_tags(sessions: DataFrame, known: DataFrame) -> DataFrame:
    """(ref, tags): own tags, else those of the same agent's session of that id, else none."""
    named = known.select(F.col("agent_name").alias("k_agent"), F.col("session_id").alias("k_id"), F.col("tags").alias("k_tags"))
    rows = sessions.join(named, (F.col("agent_name") == F.col("k_agent")) & (F.col("session_id") == F.col("k_id")), "left")
    return rows.select("ref", F.coalesce("tags", "k_tags", F.array().cast("array<string>")).alias("tags"))


def merged_shards(shards: list[DataFrame], *order: Column) -> DataFrame:
    """Sorted shards as one: the order, ties to the earlier shard."""
    rows = [shard.withColumn("shard", F.lit(i)) for i, shard in enumerate(shards)]
    whole = rows[0]
    for more in rows[1:]:
        whole = whole.unionByName(more)
    return whole.orderBy(*order, "shard")


def project_order(groups: DataFrame) -> DataFrame:
    """Project groups: loose ones last, then those without activity last, then the latest first."""
    return groups.orderBy((F.col("project_kind") == "loose").cast("int"), F.desc_nulls_last("latest"), "project_kind", "project_key")


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by an ordinal."""
    names = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*names), order).alias("x")).select(key, *[f"x.{c}" for c in names])


def depth_first(sessions: DataFrame, closure: DataFrame) -> DataFrame:
    """(ref, entry, path): sorting by path walks each tree depth first, siblings by activity and ref.

    Paths double: each round puts the path of a session's furthest known ancestor before its own, so a tree of any depth
    takes a join for each power of two.
    """
    own = F.struct(F.coalesce("activity", F.lit(0)).alias("activity"), F.col("ref").alias("ref"))
    up = F.when(F.col("depth") > 0, F.col("parent_ref"))
    rows = checkpointed(closure.join(sessions.select("ref", "parent_ref", "activity"), "ref").select("ref", "entry", up.alias("up"), F.array(own).alias("path")))
    while not rows.where("up is not null").isEmpty():
        far = rows.select(F.col("ref").alias("up"), F.col("up").alias("further"), F.col("path").alias("above"))
        grown = rows.where("up is not null").join(far, "up").select("ref", "entry", F.col("further").alias("up"), F.concat("above", "path").alias("path"))
        rows = checkpointed(rows.where("up is null").unionByName(grown))
    return rows.select("ref", "entry", "path")


def timeline_totals(entries: DataFrame, closure: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per entry: sessions below it, its own mount, and tokens of the whole."""
    rows = closure.join(sessions, "ref")
    tokens = F.coalesce("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    sums = rows.groupBy("entry").agg(F.sum(F.when(F.col("ref") != F.col("entry"), 1).otherwise(0)).alias("subs"), F.sum(tokens).alias("tokens"))
    return entries.select(F.col("ref").alias("entry"), "mount").join(sums, "entry").groupBy("mount").agg(F.count("*").alias("entries"), F.sum("subs").alias("subs"), F.sum("tokens").alias("tokens"))


def with_children(sessions: DataFrame) -> DataFrame:
    """(ref, messages, tokens, cost): a session's own numbers with its direct children's, for its detail only."""
    tokens = F.coalesce("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    own = sessions.select("ref", F.col("message_count").alias("messages"), tokens.alias("tokens"), F.col("total_cost").alias("cost"))
    below = sessions.where("parent_ref is not null").select(F.col("parent_ref").alias("ref"), F.col("message_count").alias("messages"), tokens.alias("tokens"), F.col("total_cost").alias("cost"))
    below = below.join(sessions.select("ref"), "ref", "left_semi")
    return own.unionByName(below).groupBy("ref").agg(*[F.sum(c).alias(c) for c in ("messages", "tokens", "cost")])


def file_changes(occurrences: DataFrame) -> DataFrame:
    """(ref, kind, path, n, at, last_index) of occurrences(ref, kind, path, at, message_index); of equal times the later record counts."""
    last = F.max(F.struct(F.coalesce("at", F.lit(0)).alias("at"), "message_index"))
    return occurrences.groupBy("ref", "kind", "path").agg(F.count("*").alias("n"), last.alias("x")).select("ref", "kind", "path", "n", "x.at", F.col("x.message_index").alias("last_index"))


def tool_names(messages: DataFrame) -> DataFrame:
    """(ref, message_index, tools) of messages(ref, message_index, calls array<string>): trimmed, lower case, each once."""
    return messages.select("ref", "message_index", F.array_distinct(F.filter(F.transform("calls", lambda c: F.lower(F.trim(c))), lambda c: c != "")).alias("tools"))


def tool_occurrences(messages: DataFrame) -> DataFrame:
    """(ref, message_index, tool_index, tool): each call with its place among its message's calls."""
    return messages.select("ref", "message_index", F.posexplode("calls").alias("tool_index", "tool"))


def tool_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """calls(ref, call_id, tool) with the status and output of their last result; without one they are running."""
    last = results.groupBy("ref", "call_id").agg(F.max_by(F.struct("error", "output"), "message_index").alias("r"))
    status = F.when(F.col("r").isNull(), "running").when(F.col("r.error"), "error").otherwise("completed")
    return calls.join(last, ["ref", "call_id"], "left").select("ref", "call_id", "tool", status.alias("status"), F.col("r.output").alias("output"))


def session_content(titles: DataFrame, messages: DataFrame) -> DataFrame:
    """(ref, content): the title and the messages' texts in order, a line each; blank ones are left out."""
    texts = messages.where(F.trim("text") != "").groupBy("ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("message_index", "text"))), lambda x: x["text"]).alias("texts"))
    return titles.join(texts, "ref", "left").select("ref", F.concat_ws("\n", "title", "texts").alias("content"))


def derived_stats(messages: DataFrame) -> DataFrame:
    """Per session: messages, token and cost sums, and the source, estimated if any message is."""
    source = F.when(F.bool_or(F.coalesce(F.col("cost_source") == "estimated", F.lit(False))), "estimated").when(F.count("cost_source") > 0, "recorded")
    return messages.groupBy("ref").agg(F.count("*").alias("messages"), F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("cost").alias("cost"), source.alias("cost_source"))


def finished_stats(base: DataFrame, derived: DataFrame) -> DataFrame:
    """Given stats win over derived ones, but for the number of messages."""
    b, d = base.alias("b"), derived.alias("d")
    return d.join(b, "ref", "left").select("ref", "d.messages", *[F.coalesce(f"b.{c}", f"d.{c}").alias(c) for c in ("input", "output", "cost")])


def ranked_agents(rows: DataFrame) -> DataFrame:
    """(agent_name, sessions, cost): most sessions first, then the highest cost."""
    return rows.groupBy("agent_name").agg(F.count("*").alias("sessions"), F.sum("total_cost").alias("cost")).orderBy(F.desc("sessions"), F.desc("cost"), "agent_name")


def cache_info(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.max("activity").alias("latest"), F.count("*").alias("sessions"))


def place(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    """rows with their place within a group of bounded size."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*order)))
