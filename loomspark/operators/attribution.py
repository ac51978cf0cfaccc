"""Attribution of cost and usage to time.

Each session under a matching entry contributes its messages when they reconcile with its totals, else
one row at the entry's activity time. Detailed messages are windowed by their own time, so an entry
outside the window still contributes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators.facts import named_costs

ABSOLUTE, RELATIVE = 1e-8, 1e-6


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(ABSOLUTE), RELATIVE * F.greatest(F.abs(a), F.abs(b)))


def _nodes(sessions: DataFrame, closure: DataFrame, summary: DataFrame, scope: Column | None) -> DataFrame:
    """Sessions with their entry's agent, project and activity, and their summary as m_*."""
    tops = sessions if scope is None else sessions.where(scope)
    tops = tops.select(F.col("ref").alias("entry"), F.col("agent_name").alias("entry_agent"), F.concat_ws(":", "project_kind", "project_key").alias("project"), F.col("activity").alias("entry_activity"))
    own = summary.select("ref", *[F.col(c).alias(f"m_{c}") for c in summary.columns if c != "ref"])
    return closure.select("ref", "entry").join(tops, "entry").join(sessions.drop("activity"), "ref").join(own, "ref", "left")


def attributed_costs(sessions: DataFrame, closure: DataFrame, facts: DataFrame, summary: DataFrame, models: DataFrame | None, start: int, end: int, scope: Column | None = None) -> DataFrame:
    """(entry, ref, agent, project, at_ms, model, cost, source), one row per message or fallback part in the window.

    Costs by model are needed of a few sessions only; without models they are summed for these alone, session by session.
    """
    rows = _nodes(sessions, closure, summary, scope).withColumn("total", F.greatest(F.col("total_cost"), F.lit(0.0))).where("total > 0")
    detailed = F.col("m_n").isNotNull() & (F.col("m_untimed_cost") <= ABSOLUTE) & close(F.col("m_cost"), F.col("total"))
    rows = rows.withColumn("detailed", F.coalesce(detailed, F.lit(False)))
    keep = [F.col("entry"), F.col("ref"), F.col("entry_agent").alias("agent"), F.col("project")]
    paid = facts.where((F.col("cost") > 0) & F.col("at_ms").between(start, end)).select("ref", "at_ms", "model", F.col("cost").alias("part"), F.col("cost_source").alias("part_source"))
    detail = rows.where("detailed").join(paid, "ref").select(*keep, "at_ms", "model", F.col("part").alias("cost"), F.coalesce("part_source", "cost_source", F.lit("recorded")).alias("source"))
    rest = rows.where(~F.col("detailed") & F.col("entry_activity").between(start, end))
    rest = rest.withColumn("known", F.coalesce("m_known", F.lit(0.0)))
    rest = rest.withColumn("split", (F.col("known") > 0) & ((F.col("known") <= F.col("total")) | close(F.col("known"), F.col("total"))))
    source = F.coalesce("cost_source", F.lit("recorded"))
    by_model = named_costs(facts).select("ref", "model", F.col("cost").alias("part")) if models is None else models.select("ref", "model", F.col("cost").alias("part"))
    parts = rest.where("split").join(by_model, "ref").select(*keep, F.col("entry_activity").alias("at_ms"), "model", F.col("part").alias("cost"), source.alias("source"))
    if models is None:
        parts = parts.groupBy("ref", "model").agg(*[F.first(c).alias(c) for c in ("entry", "agent", "project", "at_ms")], F.sum("cost").alias("cost"), F.first("source").alias("source")).select("entry", "ref", "agent", "project", "at_ms", "model", "cost", "source")
    left = rest.withColumn("left", F.when(F.col("split"), F.greatest(F.col("total") - F.col("known"), F.lit(0.0))).otherwise(F.col("total"))).where(F.col("left") > RELATIVE)
    plain = left.select(*keep, F.col("entry_activity").alias("at_ms"), F.lit(None).cast("string").alias("model"), F.col("left").alias("cost"), source.alias("source"))
    return detail.unionByName(parts).unionByName(plain)


def attributed_usage(sessions: DataFrame, closure: DataFrame, facts: DataFrame, summary: DataFrame, start: int, end: int, scope: Column | None = None) -> DataFrame:
    """(entry, ref, agent, project, at_ms, messages, tokens, input, output, cache_read, cache_create) in the window.

    Messages and tokens qualify for detail apart from each other.
    """
    rows = _nodes(sessions, closure, summary, scope).withColumn("tokens", F.coalesce("total_tokens", F.col("input_tokens") + F.col("output_tokens")))
    counted = F.col("m_n").isNotNull() & (F.col("m_untimed_n") == 0) & (F.col("m_n") == F.col("message_count"))
    plain = F.col("m_output") == F.col("output_tokens")
    added = F.col("m_output") + F.col("m_reasoning") == F.col("output_tokens")
    matched = F.col("m_n").isNotNull() & (F.col("m_untimed_tokens") == 0) & (F.col("m_input") == F.col("input_tokens")) & (F.col("m_cache_read") == F.col("cache_read")) & (F.col("m_cache_create") == F.col("cache_create"))
    matched = matched & (plain | added) & (F.col("input_tokens") + F.col("output_tokens") == F.col("tokens"))
    rows = rows.withColumns({"by_message": F.coalesce(counted, F.lit(False)), "by_token": F.coalesce(matched, F.lit(False)), "reasoned": ~F.coalesce(plain, F.lit(False))})
    keep = [F.col("entry"), F.col("ref"), F.col("entry_agent").alias("agent"), F.col("project")]
    timed = facts.where(F.col("at_ms").between(start, end)).select("ref", "at_ms", *[F.greatest(F.col(c), F.lit(0)).alias(f"f_{c}") for c in ("input", "output", "reasoning", "cache_read", "cache_create")])
    used = rows.where("by_message or by_token").join(timed, "ref")
    tokens = lambda x: F.when(F.col("by_token"), x).otherwise(0).cast("long")
    output = F.col("f_output") + F.when(F.col("reasoned"), F.col("f_reasoning")).otherwise(0)
    detail = used.select(*keep, "at_ms", F.col("by_message").cast("long").alias("messages"), tokens(F.col("f_input") + output).alias("tokens"), tokens(F.col("f_input")).alias("input"), tokens(output).alias("output"), tokens(F.col("f_cache_read")).alias("cache_read"), tokens(F.col("f_cache_create")).alias("cache_create"))
    rest = rows.where(~(F.col("by_message") & F.col("by_token")) & F.col("entry_activity").between(start, end))
    whole = lambda flag, x: F.when(F.col(flag), 0).otherwise(F.col(x)).cast("long").alias(x if x != "message_count" else "messages")
    names = {"input_tokens": "input", "output_tokens": "output"}
    fallback = rest.select(*keep, F.col("entry_activity").alias("at_ms"), whole("by_message", "message_count"), *[whole("by_token", c).alias(names.get(c, c)) for c in ("tokens", "input_tokens", "output_tokens", "cache_read", "cache_create")])
    return detail.unionByName(fallback).where("messages > 0 or tokens > 0 or input > 0 or output > 0 or cache_read > 0 or cache_create > 0")
