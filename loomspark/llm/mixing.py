"""Operator 9, mixing sources to target weights by Poisson replication.

A source with n of the N documents and target weight w is to fill w of the mixed corpus, so each of its
documents has a mean repetition rate of w * epochs * N / n. A document's count is the Poisson
distribution with that mean, inverted at a uniform number from the MD5 of seed, doc_id and text: the same in
every run and on every cluster. Rates above RATE are cut into equal parts whose counts add up, each with
its own uniform number, so no distribution underflows; rows of several parts are first dealt part by part over
the cluster, so no task makes all copies of a row. Documents are exploded by their counts and dealt to
partitions by a hash of the copy, in the order of that hash within a partition: a global shuffle.

Defined cases: a null source is a source of its own; a source without a target weight (when weights are
given) gets rate zero; weights are scaled to sum to one over the sources present; a null doc_id or text hashes
as the empty string, so rows without doc_id still differ by their texts; repeated rows get equal counts; null,
empty and very long texts are mixed like others; copy numbers of a row begin at 1 and are unique, part p having
those from (p - 1) * TERMS on; an empty table gives an empty result; extra columns are kept, whatever their
names, but those named as the copy's number and hash are replaced; the caller may choose other names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import let, read, settle, unused

#: The largest mean inverted at once.
RATE = 16.0
#: Terms of the distribution kept: beyond it a mean of RATE leaves less than 1e-20.
TERMS = 80
#: Parts of a row that one task makes at once.
PARTS = 64


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(source, rate) over the sources present; weights None: the same weight for each."""
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        sizes = sizes.withColumn("w", F.lit(1.0))
    elif weights:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        sizes = sizes.join(given, sizes["source"].eqNullSafe(given["source"]), "left").select(sizes["source"], "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    else:
        raise ValueError("weights must name a source or be None")
    sizes = settle(sizes)
    total, mass = sizes.agg(F.sum("n"), F.sum("w")).first()
    scale = epochs * float(total or 0) / mass if mass else 0.0
    return sizes.select("source", (F.col("w") * F.lit(scale) / F.col("n")).alias("rate"))


def identity() -> Column:
    """A row's identity in the draws: its doc_id and the MD5 of its text."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _uniform(seed: int, identity: Column, part: Column) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), identity, part.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def replicate(docs: DataFrame, rates: DataFrame, seed: int = 1, copy: str = "copy", key: str = "mix_key") -> DataFrame:
    """docs with columns copy (1, 2, ...) and key, the hash of seed, row and copy: each row as often as its inverted count."""
    columns = [c for c in docs.columns if c not in (copy, key)]
    docs = docs.select(*[F.col(f"`{c}`") for c in columns])
    of, parts, part, cdf, who, n = (unused(docs, x) for x in ("_source", "_parts", "_part", "_cdf", "_who", "_n"))
    terms = [1.0 / math.factorial(k) for k in range(TERMS)]
    tables = rates.select(F.col("source").alias(of), F.greatest(F.ceil(F.col("rate") / RATE), F.lit(1)).cast("long").alias(parts), "rate").where("rate > 0")
    mean = F.col("rate") / F.col(parts)
    masses = F.array(*[F.exp(-mean) * F.pow(mean, F.lit(float(k))) * F.lit(t) for k, t in enumerate(terms)])
    cumulative = F.transform(F.sequence(F.lit(1), F.lit(TERMS)), lambda i: F.aggregate(F.slice("mass", 1, i), F.lit(0.0), lambda s, x: s + x))
    tables = settle(tables.withColumn("mass", masses).select(of, parts, cumulative.alias(cdf)))
    several = tables.where(F.col(parts) > 1)
    cut = not several.isEmpty()
    tables = F.broadcast(tables) if tables.count() <= 10_000 else tables
    held = docs.join(tables, docs["source"].eqNullSafe(tables[of])).withColumn(who, identity())
    whole = (held.where(F.col(parts) == 1) if cut else held).withColumn(part, F.lit(1).cast("long"))
    if cut:  # first runs of up to PARTS parts, then parts, are dealt to all tasks
        runs = held.where(F.col(parts) > 1).withColumn(part, F.explode(F.sequence(F.lit(1).cast("long"), F.col(parts), F.lit(PARTS).cast("long"))))
        runs = runs.repartition(F.xxhash64(F.col(who), F.col(part)))
        last = F.least(F.col(parts), F.col(part) + PARTS - 1)
        whole = whole.unionByName(runs.withColumn(part, F.explode(F.sequence(F.col(part), last))))
    counted = whole.withColumn(n, let(_uniform(seed, F.col(who), F.col(part)), lambda u: F.size(F.filter(cdf, lambda c: c <= u)))).where(F.col(n) > 0)
    first = (F.col(part) - 1) * TERMS
    copies = counted.withColumn(copy, F.explode(F.sequence(first + 1, first + F.col(n))))
    return copies.withColumn(key, F.xxhash64(F.lit(seed), F.col(who), F.col(copy))).select(*[F.col(f"`{c}`") for c in columns], copy, key)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 1, copy: str = "copy", key: str = "mix_key") -> DataFrame:
    """docs replicated to the target weights and shuffled globally; adds the copy's number and its hash, which gives its place."""
    return replicate(docs, source_rates(docs, weights, epochs), seed, copy, key).repartition(key).sortWithinPartitions(key)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "text", "lang", "source", "n_chars", "copy")


OP9_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, * FROM documents),
sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE * ((SELECT count(*) FROM documents)::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE) / n AS rate FROM sizes),
parts AS (SELECT source, rate, greatest(ceil(rate / 16.0), 1)::INT AS parts, rate / greatest(ceil(rate / 16.0), 1) AS mean FROM rates WHERE rate > 0),
mass AS (SELECT source, parts, k, exp(k * ln(mean) - mean - lgamma(k + 1)) AS m FROM parts, range(0, 80) t(k)),
cdf AS (SELECT source, parts, k, sum(m) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM mass),
draws AS (
  SELECT d.rid, d.source, p.part, ('0x' || substr(md5('1:' || coalesce(d.doc_id::VARCHAR, '') || ':' || md5(coalesce(d.text, '')) || ':' || p.part::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM d JOIN parts s ON d.source IS NOT DISTINCT FROM s.source, LATERAL (SELECT unnest(range(1, s.parts + 1)) AS part) p),
counts AS (SELECT w.rid, w.part, count(*) AS n FROM draws w JOIN cdf ON w.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= w.u GROUP BY w.rid, w.part)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, unnest(range(1, n::INT + 1))::BIGINT + (part - 1) * 80 AS copy
FROM d JOIN counts USING (rid)
"""
