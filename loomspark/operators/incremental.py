"""Snapshots and changes: diff, merge, event coalescing, append cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signature(rows: DataFrame, *columns: str) -> Column:
    """Equality of canonical fields; nulls are kept apart from empty values."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def diff(old: DataFrame, new: DataFrame, partial: bool = False, removed: DataFrame | None = None) -> DataFrame:
    """(ref, op) of new, updated and removed rows of (ref, signature); a partial snapshot removes only what removed(ref) names."""
    a, b = old.select("ref", F.col("signature").alias("was")), new.select("ref", F.col("signature").alias("is_now"))
    op = F.when(F.col("was").isNull(), "new").when(F.col("is_now").isNull(), "removed").when(F.col("was") != F.col("is_now"), "updated")
    rows = a.join(b, "ref", "full").select("ref", op.alias("op")).where("op is not null")
    if not partial:
        return rows
    kept = rows.where("op <> 'removed'")
    if removed is None:
        return kept
    return kept.unionByName(removed.select("ref").join(old.select("ref"), "ref", "left_semi").select("ref", F.lit("removed").alias("op")))


def apply_changes(snapshot: DataFrame, upserts: DataFrame, removed: DataFrame) -> DataFrame:
    """Removals first, then upserts."""
    rest = snapshot.join(removed.select("ref"), "ref", "left_anti").join(upserts.select("ref"), "ref", "left_anti")
    return rest.unionByName(upserts.select(*snapshot.columns))


def merge_heads(target: DataFrame, source: DataFrame, keep_if_null: list[str]) -> DataFrame:
    """Upsert by ref; the named columns keep the target's value where the source has none."""
    t, s = target.withColumn("_in_t", F.lit(True)).alias("t"), source.withColumn("_in_s", F.lit(True)).alias("s")
    value = lambda c: F.coalesce(f"s.{c}", f"t.{c}") if c in keep_if_null else F.when(F.col("s._in_s"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}"))
    return t.join(s, "ref", "full").select("ref", *[value(c).alias(c) for c in target.columns if c != "ref"])


def coalesce_events(events: DataFrame, key: str = "key") -> DataFrame:
    """The last operation by key; a removal cancels earlier changes. events(key, op, at, value)."""
    return events.groupBy(key).agg(F.max(F.struct("at", "seq", "op", "value")).alias("e")).select(key, "e.op", "e.at", F.when(F.col("e.op") != "remove", F.col("e.value")).alias("value"))


def appended(messages: DataFrame, cursor: DataFrame) -> DataFrame:
    """Messages to send after cursor(ref, seen, digest): the tail where the first `seen` messages are unchanged, else all."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("message_index", "digest"))), lambda x: x["digest"])
    known = messages.join(cursor.select("ref", "seen"), "ref").where(F.col("message_index") < F.col("seen")).groupBy("ref").agg(F.sha2(F.array_join(lines, ","), 256).alias("now"))
    state = cursor.withColumnRenamed("digest", "was").join(known, "ref", "left").select("ref", F.when(F.col("was").eqNullSafe(F.col("now")) | (F.col("seen") == 0), F.col("seen")).otherwise(0).alias("start"))
    return messages.drop("digest").join(state, "ref").where("message_index >= start").drop("start")
