"""Registered queries: the change feed over the events table, as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.closure import shared_folder
from loomspark.plans.lens import table
from loomspark.streaming import feed

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return add


def _log(spark, sf_dir) -> DataFrame:
    """The changes of a stream that reads the events table's files; every fifth event of a user is two hours late.

    A stream takes a folder or a pattern; the pattern stands for the table, be it a folder or one file.
    """
    schema = table(spark, sf_dir, "events").schema
    at = F.unix_millis(F.col("ts").cast("timestamp")) - F.when(F.col("event_id") % 5 == 0, 7_200_000).otherwise(0)
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").select(F.col("user_id").cast("long").alias("key"), F.when(F.col("event_type") == "error", "remove").otherwise("upsert").alias("op"), at.alias("at"), F.col("event_id").cast("long").alias("seq"), F.col("value").cast("double").alias("value"))
    root = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    feed.written(events, f"{root}/changes", f"{root}/checkpoint").awaitTermination()
    return feed.read_changes(spark, f"{root}/changes")


LAST = "e AS (SELECT user_id::BIGINT AS key, event_type = 'error' AS removed, epoch_us(ts) // 1000 - CASE WHEN event_id % 5 = 0 THEN 7200000 ELSE 0 END AS t, event_id AS seq, value FROM events), c AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY t DESC, seq DESC) = 1)"


@query(f'WITH {LAST} SELECT key, t AS "at", value FROM c WHERE NOT removed')
def stream_current_versions(spark, sf_dir):
    return feed.current(_log(spark, sf_dir))


@query(f'WITH {LAST} SELECT key, t AS "at" FROM c WHERE NOT removed AND t + 60000 <= (SELECT max(t) FROM e) - 600000')
def stream_settled(spark, sf_dir):
    return feed.settled(_log(spark, sf_dir))
