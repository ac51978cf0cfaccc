"""Registered queries: synchronisation of sources over the lens, in which some sources changed, moved, went or fail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators import sync
from loomspark.plans import lens
from loomspark.plans.lens import BASE, FROM, TO, with_sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str, *parts: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = with_sql(*parts) + sql
        return function

    return add


def _sources(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(heads, found, known, present)."""
    rows = lens.heads(spark, sf_dir)
    found = rows.where("ordinal % 7 <> 0").selectExpr("ref", "concat('/logs/', if(ordinal % 11 = 0, 'new/', ''), session_id) AS path", "concat(activity, if(ordinal % 3 = 0, 'b', 'a')) AS fingerprint")
    heads = rows.where("ordinal % 5 <> 0")
    known = heads.selectExpr("ref", "if(ordinal % 21 = 0, '', concat('/logs/', session_id)) AS path", "concat(activity, 'a') AS fingerprint", "if(ordinal % 13 = 0, null, activity) AS changed_at", "ordinal % 17 = 0 AS stale")
    present = rows.where("ordinal % 14 = 0 or ordinal % 7 <> 0").selectExpr("concat('/logs/', session_id) AS path")
    return heads, found, known, present


CHANGES = f"""changes AS (SELECT ref, ordinal, CASE WHEN ordinal % 7 <> 0 THEN CASE WHEN ordinal % 5 <> 0 AND ordinal % 11 <> 0 AND ordinal % 3 <> 0 AND ordinal % 17 <> 0 THEN 'unchanged' ELSE 'changed' END
  WHEN ordinal % 13 = 0 OR activity NOT BETWEEN {FROM} AND {TO} THEN 'unseen' WHEN ordinal % 21 = 0 THEN 'missing' WHEN ordinal % 14 = 0 THEN 'failed' ELSE 'missing' END AS state FROM sessions WHERE ordinal % 7 <> 0 OR ordinal % 5 <> 0),
outcomes AS (SELECT *, CASE WHEN state = 'changed' THEN CASE ordinal % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'filtered' WHEN 2 THEN 'parsed' ELSE CASE WHEN ordinal % 8 = 3 THEN 'missing' ELSE 'parsed' END END WHEN state IN ('missing', 'failed') THEN state ELSE 'kept' END AS outcome FROM changes)"""


@query("SELECT state, count(*) AS n, sum(ordinal)::BIGINT AS ordinals FROM changes GROUP BY 1", *BASE, CHANGES)
def source_changes(spark, sf_dir):
    _, found, known, present = _sources(spark, sf_dir)
    changes = sync.source_changes(found, known, present, FROM, TO)
    return changes.join(lens.heads(spark, sf_dir).select("ref", "ordinal"), "ref").groupBy("state").agg(F.count("*").alias("n"), F.sum("ordinal").alias("ordinals"))


def _pass(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(heads, parsed, outcomes) of a pass whose sources fail, are filtered, can be read, or went meanwhile, by their number."""
    heads, found, known, present = _sources(spark, sf_dir)
    read = lens.heads(spark, sf_dir).where("ordinal % 8 <> 3").selectExpr("ref", "ordinal", "title", "activity", "CASE ordinal % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'filtered' ELSE 'parsed' END AS status")
    outcomes = sync.outcomes_of(sync.source_changes(found, known, present, FROM, TO), read, heads)
    parsed = read.where("status = 'parsed'").selectExpr("ref AS source_ref", "if(ordinal % 6 = 0, concat(ref, '/x'), ref) AS ref", "concat('read ', title) AS title", "activity + 1 AS activity")
    return heads.select("ref", "title", "activity"), parsed, outcomes


@query("""SELECT s.ref, title, activity FROM sessions s JOIN outcomes o USING (ref) WHERE s.ordinal % 5 <> 0 AND outcome IN ('kept', 'failed')
  UNION ALL SELECT CASE WHEN s.ordinal % 6 = 0 THEN s.ref || '/x' ELSE s.ref END, 'read ' || title, activity + 1 FROM sessions s JOIN outcomes o USING (ref) WHERE outcome = 'parsed'""", *BASE, CHANGES)
def source_synchronised(spark, sf_dir):
    return sync.synchronised(*_pass(spark, sf_dir))


@query("SELECT 'partial' AS completeness, count(*) FILTER (WHERE outcome = 'failed' AND ordinal % 5 <> 0) AS failures FROM outcomes", *BASE, CHANGES)
def source_completeness(spark, sf_dir):
    return sync.completeness(_pass(spark, sf_dir)[2], windowed=True)
