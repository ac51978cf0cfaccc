"""Dashboard and project aggregates over attributed costs, attributed usage and top entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.plans.lens import DAY


def day_of(ms: Column) -> Column:
    """Calendar day in the session time zone."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def in_window(entries: DataFrame, start: int, end: int) -> DataFrame:
    return entries.where(F.col("activity").between(start, end))


def cost_source() -> Column:
    """Over attributed costs: any estimated cost makes the sum estimated."""
    return F.when(F.bool_or(F.col("source") == "estimated"), "estimated").when(F.count("*") > 0, "recorded")


def totals(entries: DataFrame, costs: DataFrame, usage: DataFrame, start: int, end: int) -> DataFrame:
    """One row: sessions, distinct projects and agents, messages, tokens, cost with its recorded and estimated parts."""
    heads = in_window(entries, start, end).agg(F.count("*").alias("sessions"), F.count_distinct("project_key", "project_kind").alias("projects"), F.count_distinct("agent_name").alias("agents"))
    used = usage.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("messages", "tokens", "cache_read")])
    recorded = F.sum(F.when(F.col("source") == "recorded", F.col("cost")).otherwise(0.0))
    paid = costs.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.coalesce(recorded, F.lit(0.0)).alias("recorded_cost"), cost_source().alias("cost_source"))
    one = F.lit(1).alias("one")
    joined = heads.select("*", one).join(used.select("*", one), "one").join(paid.select("*", one), "one").drop("one")
    return joined.withColumn("estimated_cost", F.col("cost") - F.col("recorded_cost"))


def _days(spark: SparkSession, start: int, end: int) -> DataFrame:
    """(day) of a window's calendar days."""
    days = F.sequence(F.to_date(F.timestamp_millis(F.lit(start))), F.to_date(F.timestamp_millis(F.lit(end))))
    return spark.range(1).select(F.explode(days).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))


def _cost_of_days(costs: DataFrame) -> DataFrame:
    return costs.groupBy(day_of(F.col("at_ms")).alias("day")).agg(F.sum("cost").alias("cost"))


def daily_costs(costs: DataFrame, start: int, end: int) -> DataFrame:
    """(day, cost) of dense calendar days, without what daily() has besides."""
    return _days(costs.sparkSession, start, end).join(_cost_of_days(costs), "day", "left").na.fill(0)


def daily(entries: DataFrame, costs: DataFrame, usage: DataFrame, start: int, end: int) -> DataFrame:
    """Dense calendar-day buckets; input leaves cache tokens out and is never negative."""
    spine = _days(entries.sparkSession, start, end)
    heads = in_window(entries, start, end).groupBy(day_of(F.col("activity")).alias("day")).agg(F.count("*").alias("sessions"))
    used = usage.groupBy(day_of(F.col("at_ms")).alias("day")).agg(*[F.sum(c).alias(c) for c in ("messages", "tokens", "input", "output", "cache_read", "cache_create")])
    paid = _cost_of_days(costs)
    rows = spine.join(heads, "day", "left").join(used, "day", "left").join(paid, "day", "left").na.fill(0)
    fresh = F.greatest(F.col("input") - F.col("cache_read") - F.col("cache_create"), F.lit(0))
    return rows.withColumn("input", fresh)


def per_agent(entries: DataFrame, costs: DataFrame, usage: DataFrame, start: int, end: int) -> DataFrame:
    heads = in_window(entries, start, end).groupBy(F.col("agent_name").alias("agent")).agg(F.count("*").alias("sessions"))
    used = usage.groupBy("agent").agg(F.sum("messages").alias("messages"), F.sum("tokens").alias("tokens"))
    paid = costs.groupBy("agent").agg(F.sum("cost").alias("cost"))
    return heads.join(used, "agent", "full").join(paid, "agent", "full").na.fill(0)


def model_costs(costs: DataFrame, limit: int = 20) -> DataFrame:
    """The top models by attributed cost; recorded never exceeds cost."""
    recorded = F.sum(F.when(F.col("source") == "recorded", F.col("cost")).otherwise(0.0))
    rows = costs.where("model is not null").groupBy("model").agg(F.sum("cost").alias("cost"), recorded.alias("recorded"))
    rows = rows.withColumn("recorded", F.greatest(F.lit(0.0), F.least("recorded", "cost")))
    return rows.orderBy(F.desc("cost"), "model").limit(limit)


def model_sessions(entries: DataFrame, closure: DataFrame, facts: DataFrame, start: int, end: int) -> DataFrame:
    """Tokens by model over the subtrees of entries in the window; an entry counts once for each of its models."""
    inside = in_window(entries, start, end).select(F.col("ref").alias("entry"))
    own = facts.groupBy("ref", "model").agg(F.sum(F.col("input") + F.col("output")).alias("tokens"))
    rows = closure.select("ref", "entry").join(inside, "entry", "left_semi").join(own, "ref")
    by_entry = rows.groupBy("entry", "model").agg(F.sum("tokens").alias("tokens"))
    return by_entry.groupBy("model").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("sessions"))


def projects(entries: DataFrame, costs: DataFrame, usage: DataFrame, start: int, end: int) -> DataFrame:
    """Per project: sessions, messages, tokens, cost and its agents by sessions."""
    project = F.concat_ws(":", "project_kind", "project_key").alias("project")
    heads = in_window(entries, start, end).groupBy(project, "agent_name").agg(F.count("*").alias("n"))
    ranked = heads.groupBy("project").agg(F.sum("n").alias("sessions"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "agent_name"))).alias("a"))  # one element an agent
    heads = ranked.select("project", "sessions", F.array_join(F.transform("a", lambda x: x["agent_name"]), ",").alias("agents"))
    used = usage.groupBy("project").agg(F.sum("messages").alias("messages"), F.sum("tokens").alias("tokens"))
    paid = costs.groupBy("project").agg(F.sum("cost").alias("cost"))
    return heads.join(used, "project", "full").join(paid, "project", "full").na.fill(0).na.fill("", ["agents"])


def top_with_rest(ranked: DataFrame, limit: int = 12) -> DataFrame:
    """The top projects by cost and one row for the rest; the ranked table has one row a project."""
    best = ranked.orderBy(F.desc("cost"), "project").limit(limit).select("project", "sessions", "messages", "tokens", "cost")
    rest = ranked.join(best.select("project"), "project", "left_anti")
    tail = rest.agg(*[F.sum(c).alias(c) for c in ("sessions", "messages", "tokens", "cost")], F.count("*").alias("n")).where("n > 0")
    return best.unionByName(tail.select(F.lit("(other)").alias("project"), "sessions", "messages", "tokens", "cost"))


def sparkline(costs: DataFrame, end: int, days: int = 14) -> DataFrame:
    """Cost per project and day slot, the last day being slot days - 1."""
    last = F.to_date(F.timestamp_millis(F.lit(end)))
    slot = (days - 1 - F.datediff(last, F.to_date(F.timestamp_millis("at_ms")))).alias("slot")
    return costs.select("project", slot, "cost").where(F.col("slot").between(0, days - 1)).groupBy("project", "slot").agg(F.sum("cost").alias("cost"))


def recent(entries: DataFrame, start: int, end: int, limit: int = 10) -> DataFrame:
    return in_window(entries, start, end).orderBy(F.desc("activity"), "agent_name", "session_id").limit(limit)


def ratios(now: DataFrame, before: DataFrame, days: int) -> DataFrame:
    """Key figures against the previous window: change in percent only over a positive previous value."""
    old = before.select(F.col("sessions").alias("s0"), F.col("cost").alias("c0"), F.col("tokens").alias("t0"), F.lit(1).alias("one"))
    change = lambda a, b: F.when(F.col(b) > 0, (F.col(a) - F.col(b)) / F.col(b) * 100)
    return now.select("*", F.lit(1).alias("one")).join(old, "one").select(
        "sessions", "cost", "tokens", change("sessions", "s0").alias("sessions_change"), change("cost", "c0").alias("cost_change"), change("tokens", "t0").alias("tokens_change"),
        (F.col("sessions") / days).alias("sessions_per_day"), F.coalesce(F.try_divide("messages", "sessions"), F.lit(0.0)).alias("messages_per_session"), F.coalesce(F.try_divide("cache_read", "tokens"), F.lit(0.0)).alias("cache_hit"),
    )


def composition(models: DataFrame, limit: int = 5, least: float = 0.01) -> DataFrame:
    """The top models by cost and 'Other' when the remainder exceeds a share of the total."""
    best = models.orderBy(F.desc("cost"), "model").limit(limit)
    sums = models.agg(F.sum("cost").alias("all")).select("all", F.lit(1).alias("one")).join(best.agg(F.sum("cost").alias("top")).select("top", F.lit(1).alias("one")), "one")
    other = sums.where(F.col("all") - F.col("top") > least * F.col("all")).select(F.lit("Other").alias("model"), (F.col("all") - F.col("top")).alias("cost"))
    return best.select("model", "cost").unionByName(other)


def curve(days: DataFrame) -> DataFrame:
    """Peak, average and total of daily cost."""
    return days.agg(F.max("cost").alias("peak"), F.avg("cost").alias("average"), F.sum("cost").alias("total"))


def project_groups(heads: DataFrame, name: Column, *more: Column) -> DataFrame:
    """Groups by project identity: name, distinct agents, sessions, the latest activity, and more."""
    return heads.groupBy("project_kind", "project_key").agg(name.alias("name"), F.array_join(F.sort_array(F.collect_set("agent_name")), ",").alias("agents"), F.count("*").alias("sessions"), F.max("activity").alias("latest"), *more)


def project_metrics(sessions: DataFrame, closure: DataFrame) -> DataFrame:
    """project_groups() of the top entries, named by the first, with the messages, tokens and cost of all below them.

    A tree's sums and its entry's own columns come of one grouping, so that sessions are read and joined once.
    """
    own = F.struct("project_kind", "project_key", "project_name", "agent_name", "activity", "ordinal")
    tokens = F.coalesce("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    rows = sessions.join(closure.select("ref", "entry"), "ref")
    trees = rows.groupBy("entry").agg(F.max(F.when(F.col("ref") == F.col("entry"), own)).alias("own"), F.sum("message_count").alias("messages"), F.sum(tokens).alias("tokens"), F.sum("total_cost").alias("cost"))
    trees = trees.select("own.*", "messages", "tokens", "cost")
    return project_groups(trees, F.min_by("project_name", "ordinal"), *[F.sum(c).alias(c) for c in ("messages", "tokens", "cost")])


def page(rows: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """Rows offset .. offset + size of an ordered snapshot."""
    return rows.orderBy(*order).offset(offset).limit(size)


def previous_window(start: int, end: int) -> tuple[int, int]:
    """The window of the same number of calendar days just before."""
    days = (end - start) // DAY + 1
    return start - days * DAY, start - 1


def aligned_pages(rows: DataFrame, key: str, order: list[Column], size: int = 40) -> DataFrame:
    """rows with the page of their place within the key."""
    return rows.withColumn("page", F.floor((F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1) / size).cast("int"))
