"""Synchronisation of session sources: what changed since the last pass, and the heads after it.

A source is read again when it is new, or its path or fingerprint differs, or what is known of it is stale. A known session
whose source was not found is removed only where that proves it gone: the pass looked where it must lie, and its
path is empty or no longer exists. A source that fails keeps its last known good head, and the pass is partial then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def looked_at(changed_at: Column, start: int | None, end: int | None) -> Column:
    """Whether a pass over a window of change times would have found a source; an unknown time proves nothing."""
    test = F.lit(True)
    if start is not None:
        test = test & (changed_at >= start)
    if end is not None:
        test = test & (changed_at <= end)
    return F.coalesce(test, F.lit(False))


def source_changes(found: DataFrame, known: DataFrame, present: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """(ref, path, fingerprint, state): changed, unchanged, missing, failed, or unseen.

    found(ref, path, fingerprint) was listed in this pass; known(ref, path, fingerprint, changed_at, stale) is from the last
    one; present(path) are paths that exist. unseen sources lie outside the window and keep what is known; failed
    ones exist but were not listed.
    """
    f = found.select("ref", F.col("path").alias("f_path"), F.col("fingerprint").alias("f_print"), F.lit(True).alias("is_found"))
    k = known.select("ref", F.col("path").alias("k_path"), F.col("fingerprint").alias("k_print"), "changed_at", "stale", F.lit(True).alias("is_known"))
    there = present.select(F.col("path").alias("k_path"), F.lit(True).alias("exists")).distinct()
    rows = f.join(k, "ref", "full").join(there, "k_path", "left")
    same = F.col("is_known") & (F.col("f_path") == F.col("k_path")) & (F.col("f_print") == F.col("k_print")) & ~F.coalesce("stale", F.lit(False))
    gone = F.when(F.coalesce("k_path", F.lit("")) == "", "missing").when(F.col("exists"), "failed").otherwise("missing")
    absent = F.when(looked_at(F.col("changed_at"), start, end), gone).otherwise("unseen")
    state = F.when(F.col("is_found"), F.when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")).otherwise(absent)
    return rows.select("ref", F.coalesce("f_path", "k_path").alias("path"), F.coalesce("f_print", "k_print").alias("fingerprint"), state.alias("state"))


def outcomes_of(changes: DataFrame, read: DataFrame, heads: DataFrame) -> DataFrame:
    """(ref, outcome, known) of a pass: parsed, filtered, missing or failed for what was looked at, kept for the rest.

    read(ref, status) says how reading the changed sources ended; a changed source without a row there is missing. known
    tells a failure with a head to fall back on from one of a source that never had any, which doesn't count.
    """
    rows = changes.join(read.select("ref", "status"), "ref", "left").join(heads.select("ref", F.lit(True).alias("known")), "ref", "left")
    outcome = F.when(F.col("state") == "changed", F.coalesce("status", F.lit("missing"))).when(F.col("state").isin("missing", "failed"), F.col("state")).otherwise("kept")
    return rows.select("ref", outcome.alias("outcome"), F.coalesce("known", F.lit(False)).alias("known"))


def synchronised(heads: DataFrame, parsed: DataFrame, outcomes: DataFrame) -> DataFrame:
    """heads(ref, ..) after a pass: parsed(source_ref, ref, ..) replaces the head of its source, whatever its own ref; filtered and missing ones go, failed ones stay."""
    columns = heads.columns
    new = parsed.join(outcomes.where("outcome = 'parsed'").select(F.col("ref").alias("source_ref")), "source_ref", "left_semi")
    kept = heads.join(outcomes.where("outcome in ('kept', 'failed')").select("ref"), "ref", "left_semi").join(new.select("ref").distinct(), "ref", "left_anti")
    return kept.select(*columns).unionByName(new.select(*columns))


def completeness(outcomes: DataFrame, windowed: bool) -> DataFrame:
    """One row (completeness, failures): partial if the pass had a window or a known session failed."""
    failures = F.count_if((F.col("outcome") == "failed") & F.col("known"))
    return outcomes.agg(failures.alias("failures")).select(F.when(F.lit(windowed) | (F.col("failures") > 0), "partial").otherwise("complete").alias("completeness"), "failures")
