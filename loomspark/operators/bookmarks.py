"""Bookmarks and aliases beside live and stored sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bookmark_views(bookmarks: DataFrame, live: DataFrame, stored: DataFrame) -> DataFrame:
    """bookmarks(ref, marked) with title and activity from live, else stored sessions, and where they were found."""
    a = live.select("ref", F.col("title").alias("live_title"), F.col("activity").alias("live_at"))
    b = stored.select("ref", F.col("title").alias("stored_title"), F.col("activity").alias("stored_at"))
    found = F.when(F.col("live_at").isNotNull(), "live").when(F.col("stored_at").isNotNull(), "stored").otherwise("missing")
    return bookmarks.join(a, "ref", "left").join(b, "ref", "left").select("ref", "marked", F.coalesce("live_title", "stored_title").alias("title"), F.coalesce("live_at", "stored_at", "marked").alias("activity"), found.alias("availability"))


def display_titles(sessions: DataFrame, aliases: DataFrame) -> DataFrame:
    """sessions with display_title: the alias, else the title."""
    named = aliases.where(F.length(F.trim("alias")).between(1, 160)).select("ref", F.trim("alias").alias("alias"))
    return sessions.join(named, "ref", "left").withColumn("display_title", F.coalesce("alias", "title"))


def mark(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert of bookmarks(ref, marked) that keeps the first time a session was marked."""
    return existing.unionByName(incoming).groupBy("ref").agg(F.min("marked").alias("marked"))


def rename(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Last-wins merge of aliases(ref, alias): trimmed, 1 to 160 characters; a null or blank alias deletes."""
    named = incoming.select("ref", F.trim("alias").alias("alias"))
    kept = existing.join(named.select("ref"), "ref", "left_anti")
    return kept.unionByName(named.where(F.length("alias").between(1, 160)))


def facets(sessions: DataFrame, selected: str | None = None, limit: int = 8) -> DataFrame:
    """(project, n): the top projects by sessions; a selected project stays, at 0 if it has none."""
    project = F.concat_ws(":", "project_kind", "project_key").alias("project")
    top = sessions.groupBy(project).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project").limit(limit)
    if selected is None:
        return top
    one = sessions.sparkSession.createDataFrame([(selected, 0)], "project string, n long")
    return top.unionByName(one.join(top, "project", "left_anti").select("project", "n"))
