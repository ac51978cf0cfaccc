"""Operator 6, quality rules with cross-document line frequency.

Base rules read one text: fewer than 20 words, or over 30 % of its words in repeated 8-word windows, fail.
The method looks across documents: lines are normalised (lower case, digits to 0, spaces collapsed) and
hashed, the distinct texts of each host (the source column) that hold a line are counted, and lines in
more than the host's limit, max(min_docs, share * distinct texts of the host), are removed. Copies of one
text count once, so a copied document doesn't condemn its own lines; with copies=True each document counts. A
document that loses more than max_loss of its characters is depleted and rejected.

Defined cases: null texts are empty and fail; a null source is the host ''; a null doc_id is judged like
any other; repeated rows are judged each and count once; a line at the limit stays; very long texts and lines
are read whole; an empty table gives an empty result; extra columns are ignored or, in strip_frequent_lines,
kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import empty, let, read, row_key, sized, unused

SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_DOCS, SHARE, MAX_LOSS = 20, 0.01, 0.5
ROW = ("_row", "_text")


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """How many words lie in n-word windows that occur twice or more."""

    def covered(positions: Column) -> Column:
        gaps = F.transform(positions, lambda p, i: F.when(i == 0, n).otherwise(F.least(F.lit(n), p - F.get(positions, i - 1))))
        return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

    def count(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        again = lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        spots = let(placed, lambda s: F.sort_array(F.transform(again(s), lambda x: x["p"])))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(spots, covered))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(F.slice(h, i, n))))
    return F.when(F.size(words) < n, 0).otherwise(let(windows, count)).cast("long")


def lines_of(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(line), "123456789", "000000000"), SPACE, " "))


def base_rules(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    out = docs.withColumn("_w", counts).select(
        *docs.columns, F.col("_w.n").alias("n_words"), F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines_of(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.col("_w.r").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _identified(docs: DataFrame, copies: bool = False) -> DataFrame:
    """(source, text, _row, _text): hashes of a row's id and text, and of what counts as one document: its text or, with copies, the row."""
    row = row_key()
    return docs.select("source", "text", row.alias("_row"), (row if copies else F.xxhash64("text")).alias("_text"))


def _lines(docs: DataFrame) -> DataFrame:
    """(_row, _text, _host, pos, line, size) of an identified table; line hashes host and normalised line."""
    host = F.coalesce(F.col("source"), F.lit(""))
    parts = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("x")))
    rows = docs.select(*ROW, host.alias("_h"), F.explode(F.filter(parts, lambda p: p["x"].rlike(WORD))).alias("p"))
    return rows.select(*ROW, F.xxhash64("_h").alias("_host"), F.col("p.pos").alias("pos"), F.xxhash64("_h", normalised(F.col("p.x"))).alias("line"), F.length("p.x").cast("long").alias("size"))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, copies: bool = False) -> DataFrame:
    """(line, n_docs) of the lines above their host's limit."""
    docs = _identified(docs, copies)
    hosts = docs.select(F.xxhash64(F.coalesce("source", F.lit(""))).alias("_host"), "_text").distinct().groupBy("_host").agg(F.greatest(F.lit(float(min_docs)), F.count("*") * share).alias("limit"))
    counts = _lines(docs).select("line", "_host", "_text").distinct().groupBy("line", "_host").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
    return counts.join(sized(hosts), "_host").where("n_docs > limit").select("line", "n_docs")


def _hits(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """(_row, pos, size): where frequent lines stand; repeated rows once."""
    return _lines(docs).join(sized(frequent.select("line")), "line").select("_row", "pos", "size").distinct()


def strip_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, max_loss: float = MAX_LOSS, copies: bool = False) -> DataFrame:
    """docs without their frequent lines and without depleted documents."""
    columns = docs.columns
    of, at, lost = (unused(docs, x) for x in ("_of", "_at", "_lost"))
    hits = _hits(_identified(docs), frequent_lines(docs, min_docs, share, copies)).groupBy("_row").agg(F.collect_list("pos").alias(at), F.sum("size").alias(lost))
    rows = docs.join(sized(hits.withColumnRenamed("_row", of), 50_000), row_key() == F.col(of), "left")
    total = F.aggregate(lines_of(F.col("text")), F.lit(0), lambda s, x: s + F.length(x))
    rows = rows.where(F.col(lost).isNull() | (F.col(lost) <= total * max_loss))
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(at, i))
    return rows.withColumn("text", F.when(F.col(at).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))).select(*columns)


def quality(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, max_loss: float = MAX_LOSS, copies: bool = False) -> DataFrame:
    """Base counts and kept for each row of docs."""
    docs = docs.select("doc_id", "source", "text")
    lost = _hits(_identified(docs), frequent_lines(docs, min_docs, share, copies)).groupBy("_row").agg(F.sum("size").alias("_lost"))
    lost = sized(lost.withColumnRenamed("_row", "_r"))
    total = F.aggregate(lines_of(F.coalesce(F.col("text"), F.lit(""))), F.lit(0), lambda s, x: s + F.length(x))
    rows = base_rules(docs.withColumns({"_row": row_key(), "_all": total})).join(lost, F.col("_row") == F.col("_r"), "left")
    depleted = F.coalesce(F.col("_lost") > F.col("_all") * max_loss, F.lit(False))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, text, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 6, 1))) AS i) WHERE len(ws) >= 8),
again AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT i + j) AS n FROM again, range(0, 8) t(j) GROUP BY rid),
l AS (SELECT rid, host, text, pos, x, trim(regexp_replace(translate(lower(x), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line
  FROM (SELECT rid, host, text, unnest(string_split(t, chr(10))) AS x, unnest(range(0, len(string_split(t, chr(10))))) AS pos FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
lim AS (SELECT host, greatest(20.0, count(DISTINCT coalesce(text, chr(0))) * 0.01) AS lim FROM d GROUP BY host),
f AS (SELECT host, line FROM l JOIN lim USING (host) GROUP BY host, line, lim HAVING count(DISTINCT text) > lim),
s AS (SELECT rid, sum(length(x)) AS total, sum(CASE WHEN f.line IS NOT NULL THEN length(x) ELSE 0 END) AS lost, count(*) - count(DISTINCT x) AS dup FROM l LEFT JOIN f USING (host, line) GROUP BY rid),
b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(lost > total * 0.5, false) AS depleted
  FROM w LEFT JOIN r USING (rid) LEFT JOIN s USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT depleted AS kept
FROM b
"""
