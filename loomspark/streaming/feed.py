"""Change feed: a stream of session events folded by key in keyed state, written to a plain file sink.

The state of a key is the version that counts: time, sequence number, value, and whether the key is removed. An event of an
older version than the known one is late and changes nothing, also behind a removal. A key that has been quiet for QUIET
milliseconds of event time is reported as settled, once, by a timer. Spark's checkpoint holds the state, the timers and
which files are done; the sink's log makes a batch appear once, so a restart neither loses nor repeats a change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

EVENTS = "key long, op string, at long, seq long, value double"
CHANGES = "key long, op string, at long, seq long, value double"
VERSION = "at long, seq long, value double, removed boolean, settled boolean"
#: Milliseconds without a change until a session counts as settled, and how late an event may be before it moves no timer.
QUIET, LATENESS = 60_000, "10 minutes"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold(StatefulProcessor):
    """Keeps the last version of a key and a timer for when it will have been quiet."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.version = handle.getValueState("version", VERSION)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.version.get() if self.version.exists() else None
        last = (known[0], known[1]) if known else None
        newest = None
        for batch in rows:
            for at, seq, op, value in zip(batch["at"].tolist(), batch["seq"].tolist(), batch["op"].tolist(), batch["value"].tolist()):
                if last is None or (at, seq) > last:
                    last, newest = (at, seq), (op, None if pd.isna(value) or op == "remove" else float(value))
        if newest is None:
            return
        op, value = newest
        self.version.update((last[0], last[1], value, op == "remove", False))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if op != "remove":
            self.handle.registerTimer(last[0] + QUIET)
        yield pd.DataFrame({"key": [key[0]], "op": ["remove" if op == "remove" else "upsert"], "at": [last[0]], "seq": [last[1]], "value": [value]})

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, seq, value, removed, settled = self.version.get()
        if not removed and not settled and at + QUIET <= expiredTimerInfo.getExpiryTimeInMs():
            self.version.update((at, seq, value, removed, True))
            yield pd.DataFrame({"key": [key[0]], "op": ["settled"], "at": [at], "seq": [seq], "value": [value]})

    def close(self) -> None:
        pass


def changes(events: DataFrame) -> DataFrame:
    """(key, op, at, seq, value) of a stream of EVENTS: upsert and remove where a version counts, settled after a quiet time."""
    timed = events.where("key is not null and at is not null").withColumn("time", F.timestamp_millis("at")).withWatermark("time", LATENESS)
    return timed.groupBy("key").transformWithStateInPandas(Fold(), CHANGES, "Append", "EventTime")


def written(events: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Write the changes of a stream of EVENTS to files at sink; what is available only, then stop."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    writer = changes(events).writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def start(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Fold the JSON files that appear in source into change files at sink."""
    return written(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 100).json(source), sink, checkpoint)


def read_changes(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.schema(CHANGES).parquet(sink)


def current(log: DataFrame) -> DataFrame:
    """(key, at, value) that stands after a log of changes(); a reader sees whole batches only."""
    last = log.where("op <> 'settled'").groupBy("key").agg(F.max(F.struct("at", "seq", "op", "value")).alias("c"))
    return last.where("c.op <> 'remove'").select("key", "c.at", "c.value")


def settled(log: DataFrame) -> DataFrame:
    """(key, at) of the keys whose standing version has been quiet."""
    quiet = log.where("op = 'settled'").groupBy("key").agg(F.max("at").alias("quiet"))
    return current(log).join(quiet, "key").where("quiet = at").select("key", "at")
