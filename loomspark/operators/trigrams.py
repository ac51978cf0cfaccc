"""Substring search by an index of trigrams: blocks of texts by trigram, the rarest ones intersected, then the texts verified.

Letter case is ignored. Texts fall into blocks of about BLOCK by their hash, copies into the same one, and the index holds
the numbers of a trigram's blocks, no texts: a small part of what it indexes. A search reads the pages of its few
trigrams in each file, and verifies the texts of the blocks that hold all of them. Blocks stay where the texts were
grouped, so the postings of a frequent trigram are spread over all files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import once

SIZE = 3
#: Trigrams of a needle that are intersected, the rarest first; the texts left are verified anyway.
RAREST = 3
#: Texts of a block, on average.
BLOCK = 16


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case; the characters are taken apart once."""

    def made(chars: Column) -> Column:
        starts = F.when(F.size(chars) >= SIZE, F.sequence(F.lit(0), F.size(chars) - SIZE))
        return F.array_distinct(F.transform(starts, lambda i: F.concat(*[F.get(chars, i + k) for k in range(SIZE)])))

    return once(F.split(F.lower(text), ""), made)


def block_of(text: Column, of: int) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(of)).cast("int")


def postings(texts: DataFrame, text: str) -> DataFrame:
    """(gram, block, of) of the texts in `of` blocks, sorted by gram within partitions, to be written."""
    rows = texts.select(F.col(text).alias("text")).where("text is not null")
    of = min(max(1, -(-rows.count() // BLOCK)), 2**31 - 1)
    each = rows.groupBy(block_of(F.col("text"), of).alias("block")).agg(F.collect_set("text").alias("texts"))
    held = each.select("block", F.array_distinct(F.flatten(F.filter(F.transform("texts", grams), lambda g: g.isNotNull()))).alias("grams"))
    return held.select(F.explode("grams").alias("gram"), "block", F.lit(of).alias("of")).sortWithinPartitions("gram", "block")


def frequencies(index: DataFrame) -> DataFrame:
    """(gram, n) of postings(), sorted by gram, to be written."""
    return index.groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram")


def rows_containing(index: DataFrame, counts: DataFrame, needle: str, rows: DataFrame, text: str) -> DataFrame:
    """The rows whose text, which is one of those indexed, contains the needle; for one shorter than a trigram all are looked at."""
    low = needle.lower()
    holds = F.lower(text).contains(low)
    if len(low) < SIZE:
        return rows.where(holds)
    wanted = sorted({low[i : i + SIZE] for i in range(len(low) - SIZE + 1)})
    known = {r["gram"]: r["n"] for r in counts.where(F.col("gram").isin(wanted)).collect()}  # no more rows than the needle has trigrams
    if len(known) < len(wanted):
        return rows.where(F.lit(False))
    rarest = sorted(wanted, key=lambda g: (known[g], g))[:RAREST]
    blocks = index.where(F.col("gram").isin(rarest)).groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest)).select(F.col("block").alias("_block"))
    of = index.select("of").first()["of"]
    return rows.join(blocks, block_of(F.col(text), of) == blocks["_block"], "left_semi").where(holds)


def containing(index: DataFrame, counts: DataFrame, needle: str, texts: DataFrame, text: str) -> DataFrame:
    """(text) of the distinct texts that contain the needle."""
    return rows_containing(index, counts, needle, texts, text).select(F.col(text).alias("text")).distinct()


def matching(rows: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """rows whose text is one of containing()."""
    return rows.join(found.withColumnRenamed("text", text), text, "left_semi").select(*rows.columns)
