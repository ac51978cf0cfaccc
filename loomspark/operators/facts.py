"""Message facts and their rollups per session and per (session, model)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(messages: DataFrame) -> DataFrame:
    """messages with at_ms, the effective time: completed if positive, else created if positive, else null."""
    return messages.withColumn("at_ms", F.when(F.col("time_completed") > 0, F.col("time_completed")).when(F.col("time_created") > 0, F.col("time_created")))


def message_facts(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """timed() messages with their session's ref."""
    return timed(messages).join(sessions.select("session_id", "ref"), "session_id")


def session_summary(facts: DataFrame) -> DataFrame:
    """Counts, clamped token sums, untimed parts and cost sums per session; only positive costs count. known is that of messages with a model."""
    late, paid = F.col("at_ms").isNull(), F.col("cost") > 0
    kinds = ("input", "output", "reasoning", "cache_read", "cache_create")
    clamped = [F.greatest(F.col(c), F.lit(0)) for c in kinds]
    tokens = clamped[0] + clamped[1] + clamped[2] + clamped[3] + clamped[4]
    total = lambda condition: F.sum(F.when(condition, F.col("cost")).otherwise(0.0))
    return facts.groupBy("ref").agg(
        F.count("*").alias("n"), *[F.sum(x).alias(c) for x, c in zip(clamped, kinds)],
        F.sum(late.cast("long")).alias("untimed_n"), F.sum(F.when(late, tokens).otherwise(0)).alias("untimed_tokens"),
        total(paid).alias("cost"), total(paid & (F.col("model") != "")).alias("known"), total(paid & late).alias("untimed_cost"), total(paid & (F.coalesce("cost_source", F.lit("")) == "recorded")).alias("recorded_cost"),
    )


def named_costs(facts: DataFrame) -> DataFrame:
    """The messages with a cost and a model."""
    return facts.where((F.col("model") != "") & (F.col("cost") > 0))


def model_costs(facts: DataFrame) -> DataFrame:
    """Cost and recorded cost per (session, model); a null source is not recorded."""
    return named_costs(facts).groupBy("ref", "model").agg(
        F.sum("cost").alias("cost"), F.sum(F.when(F.col("cost_source") == "recorded", F.col("cost")).otherwise(0.0)).alias("recorded")
    )


def model_distribution(costs: DataFrame, sessions: DataFrame, start: int, end: int, limit: int | None = None) -> DataFrame:
    """Cost by model over sessions whose own activity lies in the window."""
    inside = sessions.where(F.col("activity").between(start, end)).select("ref")
    rows = costs.join(inside, "ref", "left_semi").groupBy("model").agg(F.sum("cost").alias("cost"), F.sum("recorded").alias("recorded"))
    rows = rows.withColumn("estimated", F.col("cost") - F.col("recorded"))
    return rows.orderBy(F.desc("cost"), "model").limit(limit) if limit else rows


def file_activity(facts: DataFrame) -> DataFrame:
    """Per session, path and kind: occurrences and the latest time."""
    kind = F.expr("CASE tool WHEN 'read' THEN 'read' WHEN 'edit' THEN 'edit' ELSE 'write' END")
    return facts.groupBy("ref", "path", kind.alias("kind")).agg(F.count("*").alias("count"), F.max(F.coalesce("at_ms", F.lit(0))).alias("latest"))


def latest_file_per_session(activity: DataFrame) -> DataFrame:
    """The session's most recent file: latest time, then count, then path; one row per session."""
    best = F.min(F.struct((-F.col("latest")).alias("a"), (-F.col("count")).alias("b"), "path", "kind"))
    return activity.groupBy("ref").agg(best.alias("x")).select("ref", "x.path", "x.kind", (-F.col("x.b")).alias("count"), (-F.col("x.a")).alias("latest"))
