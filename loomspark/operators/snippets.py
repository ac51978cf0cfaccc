"""Snippets of search hits: the window of a text's words that holds most different terms, then most of them, then the first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.functions.text import once

WORDS = 18
#: Words and what stands between them, so that a text can be cut at words.
PIECES = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"


def pieces(text: Column) -> Column:
    """(piece, pos) of a text in order; pos is the number of the word, null between words."""
    found = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    return F.transform(found, lambda p, i: F.struct(p.alias("piece"), i.alias("i"), p.rlike(r"[\p{L}\p{N}]").alias("word")))


def positions(index: DataFrame, terms: list[str], column: int = 1) -> DataFrame:
    """(doc, pos, term) of the words of one column that are one of the terms, from the postings.

    A text's postings meet before their positions are taken apart, in the partitions that windows() needs.
    """
    held = index.where(F.col("token").isin(terms) & (F.col("col") == column)).repartition("doc")
    return held.select("doc", F.explode("positions").alias("pos"), F.col("token").alias("term"))


def windows(hits: DataFrame, terms: list[str], size: int = WORDS) -> DataFrame:
    """(doc, start, kinds, n): the best window of each doc that begins at a hit(doc, pos, term).

    Counts slide over the hits in order, so a text costs its hits, not its windows.
    """
    ahead = W.partitionBy("doc").orderBy("pos").rangeBetween(0, size - 1)
    counts = [F.count_if(F.col("term") == t).over(ahead) for t in terms]
    kinds = reduce(lambda a, b: a + b, [F.when(c > 0, 1).otherwise(0) for c in counts])
    each = hits.select("doc", "pos", kinds.alias("kinds"), reduce(lambda a, b: a + b, counts).alias("n"))
    best = F.max(F.struct("kinds", "n", (-F.col("pos")).alias("before"))).alias("b")
    return each.groupBy("doc").agg(best).select("doc", (-F.col("b.before")).alias("start"), "b.kinds", "b.n")


def cut(text: Column, start: Column, size: int = WORDS, mark: str = " … ") -> Column:
    """The text from a word on, size words long, with marks where more stands before or behind."""

    def made(all_pieces: Column) -> Column:
        words = F.filter(all_pieces, lambda p: p["word"])
        first, last = F.get(words, start)["i"], F.get(words, F.least(F.size(words), start + size) - 1)["i"]
        body = F.array_join(F.transform(F.slice(all_pieces, first + 1, last - first + 1), lambda p: p["piece"]), "")
        return F.concat(F.when(start > 0, mark).otherwise(""), body, F.when(F.size(words) > start + size, mark).otherwise(""))

    return once(pieces(text), made)


def snippets(texts: DataFrame, index: DataFrame, terms: list[str], size: int = WORDS) -> DataFrame:
    """(doc, start, kinds, n, snippet) of texts(doc, text) with any of the terms, which are tokens of the index."""
    wanted = sorted(set(terms))
    best = windows(positions(index, wanted), wanted, size)
    return texts.join(best, "doc").select("doc", "start", "kinds", "n", cut(F.col("text"), F.col("start"), size).alias("snippet"))
