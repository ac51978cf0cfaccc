"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after counting it against this many narrow rows (about 16 MB of ids).
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a folder of our own only on a local master (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or "/tmp/checkpoints"


#: Spark then removes the shuffle files of a query when it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run within leaves no shuffle files; for results that are written, so that nothing reads the shuffles again."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder; for narrow tables."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # the setting holds for tables made under it


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written table."""
    return f"{shared_dir(spark)}/loomspark/{name}-{uuid.uuid4().hex}"


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it where df has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sized(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow, settled table, marked for broadcast only when its counted rows stay within the bound.

    Beyond the bound Spark joins by shuffle, where adaptive execution splits hot keys.
    """
    df = settle(df)
    return F.broadcast(df) if df.count() <= bound else df


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not in ids(doc_id). Rows without a doc_id stay."""
    gone = sized(ids.select(F.col("doc_id").alias("_gone")).where("_gone is not null").distinct())
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def one_row_per_id(docs: DataFrame) -> DataFrame:
    """Collapse repeated rows of one doc_id; only the repeated ids' rows are shuffled. Null ids stay."""
    again = sized(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias("_again")))
    if again.isEmpty():
        return docs
    repeated = docs.join(again, docs["doc_id"] == again["_again"], "left_semi").dropDuplicates(["doc_id"])
    return docs.join(again, docs["doc_id"] == again["_again"], "left_anti").unionByName(repeated)


def words_of(text: Column) -> Column:
    """Words: runs of characters other than space and \\x09-\\x0D; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def hashed(text: Column, pattern: str = "(?U)[^\\p{L}\\p{N}]+") -> Column:
    """Hashes of the words of a normalised text (lower case, letters and digits only)."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), pattern), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def empty(kind: str) -> Column:
    """An empty array of a type such as 'string'."""
    return F.array().cast(f"array<{kind}>")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, columnar and compressed."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key() -> Column:
    """Identifies a document row by its id and text; repeated rows share it."""
    return F.xxhash64("doc_id", "text")
