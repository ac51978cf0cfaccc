"""Operator 13, a Merkle manifest of a dataset.

Every row is a leaf: the SHA-256 of its columns, each as `-` for null, else byte count, colon and value. Within
a group (a source) leaves stand in the order of their ids; every FANOUT consecutive digests are hashed to their
parent until one is left, the group's subroot. Subroots, in the order of the groups, make the root in the same way.

Places come from row_number() within runs of a range partitioning, behind the counts of the runs before, so a group
of any size is numbered by all tasks. A level is a grouping by place divided by FANOUT, which hashes the sorted
children; its table is a third as long as the one before and is settled. Proofs are made from the top down: each
level joins its nodes to their parents' proofs and appends the siblings. The levels of a proof hold the digests left
and right of the node; folding hashes them around a leaf's digest up to the root.

Defined cases: a null group is one of its own and the first; null ids come first within a group and are never
tampered with; of equal ids the smaller digest comes first, and equal rows have the same digest, each a leaf of its
own with a proof of its own; null and empty texts have different leaves; very long texts are hashed whole; a lone
leaf is its group's subroot and a lone subroot the root, with an empty proof; an empty table has neither leaves nor
a root; columns that aren't named are no part of a leaf, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.common import read, settle, stash

FANOUT = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """`-` for null, else the number of bytes of the value as text, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def leaf(columns: tuple[str, ...] = COLUMNS, **changed: Column) -> Column:
    """A row's digest; changed: other values for some columns."""
    return digest(*[field(changed.get(c, F.col(f"`{c}`"))) for c in columns])


def group_key(source: Column) -> Column:
    """A group as a text that is never null and sorts as the source does, null first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """rows(part, ..) with place, 0, 1, .. within part by order, and size, the part's rows; also the largest size.

    Rows are dealt by ranges of (part, order), so a part that holds most rows is spread over all tasks.
    """
    runs = rows.withColumn("tie", F.monotonically_increasing_id())  # equal rows may fall in several ranges
    runs = runs.repartitionByRange("part", *order, "tie").withColumn("run", F.spark_partition_id())
    within = Window.partitionBy("part", "run").orderBy(*order, "tie")
    runs = stash(runs.withColumn("at", F.row_number().over(within)).drop("tie"), "runs")
    counts = runs.groupBy("part", "run").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("part")  # a row for each partition at most
    ahead = F.coalesce(F.sum("n").over(whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = settle(counts.select("part", "run", ahead.alias("ahead"), F.sum("n").over(whole).alias("size")))
    placed = runs.join(offsets, ["part", "run"]).withColumn("place", F.col("ahead") + F.col("at") - 1)
    return placed.drop("run", "at", "ahead"), offsets.agg(F.max("size")).first()[0] or 0


def levels_of(nodes: DataFrame, most: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Tables (part, place, size, digest, kids) from nodes(part, place, size, digest) up to one node for each part.

    kids are the digests a node was hashed from, in order; size is the number of nodes of its part on its level, most the
    largest of the lowest. A part with one node keeps it on the levels above.
    """
    found = [nodes.select("part", "place", "size", "digest", F.array().cast("array<string>").alias("kids"))]
    while most > 1:
        children = F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda c: c["digest"])
        up = found[-1].groupBy("part", F.floor(F.col("place") / fanout).alias("place")).agg(F.first("size").alias("below"), children.alias("kids"))
        hashed = F.when(F.col("below") > 1, F.sha2(F.array_join("kids", ""), 256)).otherwise(F.get("kids", F.lit(0)))
        found.append(settle(up.select("part", "place", F.ceil(F.col("below") / fanout).alias("size"), hashed.alias("digest"), "kids")))
        most = -(-most // fanout)
    return found


def proofs_of(levels: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(part, place, steps, ..) of each node of the lowest level: its siblings, those of its parent and so on, then the steps of tops.

    tops(part, steps, ..) are the proofs of the parts' last nodes, with other columns to hand down.
    """
    known = levels[-1].select("part", "place", "kids").join(tops, "part")
    for k, level in reversed(list(enumerate(levels[:-1]))):
        mine = level.select("part", "place", "size", "kids").withColumns({"up": F.floor(F.col("place") / fanout), "nth": (F.col("place") % fanout).cast("int")})
        parents = known.withColumnsRenamed({"place": "up", "kids": "run", "steps": "upper"})
        before = F.array_join(F.slice("run", 1, F.col("nth")), "")
        after = F.array_join(F.slice("run", F.col("nth") + 2, F.lit(fanout)), "")
        own = F.when(F.col("size") > 1, F.array(F.struct(before.alias("before"), after.alias("after")))).otherwise(F.array().cast(STEPS))
        known = mine.join(parents, ["part", "up"]).withColumn("steps", F.concat(own, "upper")).select(*known.columns)
        if k > 1:  # short plans; the two longest tables go straight on
            known = settle(known)
    return known.drop("kids")


def proof_text(steps: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


def folded(leaf_digest: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    return F.aggregate(steps, leaf_digest, lambda d, s: digest(s["before"], d, s["after"]))


def manifest(rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """rows(source, doc_id, leaf, ..) with subroot, root and steps, the proof from leaf to root."""
    leaves, most = numbered(rows.withColumn("part", group_key(F.col("source"))), "doc_id", "leaf")
    levels = levels_of(leaves.withColumnRenamed("leaf", "digest"), most, fanout)
    subroots = levels[-1].select(F.lit("").alias("part"), F.col("part").alias("name"), "digest")
    tops, many = numbered(subroots, "name")
    upper = levels_of(tops, many, fanout)
    root = upper[-1].select("digest").first()  # one row, none for an empty table
    last = upper[-1].select("part", F.array().cast(STEPS).alias("steps"))
    above = proofs_of(upper, last, fanout).join(tops.select("place", "name", "digest"), "place")
    above = settle(above.select(F.col("name").alias("part"), "steps", F.col("digest").alias("subroot")))
    out = leaves.join(proofs_of(levels, above, fanout), ["part", "place"])
    return out.withColumn("root", F.lit(root[0] if root else None).cast("string")).drop("part", "place", "size")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    other = F.when(tampered & F.col("text").contains("\n"), leaf(text=F.replace("text", F.lit("\n"), F.lit(""))))
    made = manifest(docs.select("source", "doc_id", leaf().alias("leaf"), other.alias("other")))
    ends = made.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("steps")))
    return ends.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("steps")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP13_SQL = """
WITH RECURSIVE docs AS (SELECT doc_id, coalesce('=' || source, '') AS part, text, [coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')].array_to_string('') AS head FROM documents),
leaves AS (SELECT doc_id, part, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS changed,
  list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda acc, b: list_reduce([xor(acc, b)] || range(8), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) & 1 = 1 AS tampered FROM docs),
placed AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY part) AS size FROM leaves),
low AS (SELECT part, 0 AS level, place, size, leaf AS digest FROM placed
  UNION ALL SELECT part, level + 1, place // 3, (any_value(size) + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM low WHERE size > 1 GROUP BY part, level, place // 3),
tops AS (SELECT part, level AS height, digest, row_number() OVER (ORDER BY part) - 1 AS place, count(*) OVER () AS size FROM low WHERE size = 1),
high AS (SELECT 0 AS level, place, size, digest FROM tops
  UNION ALL SELECT level + 1, place // 3, (any_value(size) + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM high WHERE size > 1 GROUP BY level, place // 3),
steps AS (
  SELECT p.part, p.place AS leaf_place, l.level, coalesce(string_agg(n.digest, '' ORDER BY n.place) FILTER (WHERE n.place < x), '') AS before, coalesce(string_agg(n.digest, '' ORDER BY n.place) FILTER (WHERE n.place > x), '') AS after
  FROM placed p JOIN (SELECT DISTINCT part, level, size FROM low WHERE size > 1) l USING (part), LATERAL (SELECT p.place // (3 ** l.level)::BIGINT AS x) JOIN low n ON n.part = p.part AND n.level = l.level AND n.place // 3 = x // 3 GROUP BY ALL
  UNION ALL SELECT p.part, p.place, t.height + l.level, coalesce(string_agg(n.digest, '' ORDER BY n.place) FILTER (WHERE n.place < x), ''), coalesce(string_agg(n.digest, '' ORDER BY n.place) FILTER (WHERE n.place > x), '')
  FROM placed p JOIN tops t USING (part) CROSS JOIN (SELECT DISTINCT level FROM high WHERE size > 1) l, LATERAL (SELECT t.place // (3 ** l.level)::BIGINT AS x) JOIN high n ON n.level = l.level AND n.place // 3 = x // 3 GROUP BY p.part, p.place, t.height, l.level),
proofs AS (SELECT part, leaf_place AS place, list(struct_pack(a := before, b := after) ORDER BY level) AS steps FROM steps GROUP BY ALL),
started AS (SELECT p.*, coalesce(steps, []) AS steps, CASE WHEN tampered THEN changed ELSE leaf END AS d FROM placed p LEFT JOIN proofs USING (part, place)),
folds AS (SELECT part, place, 1 AS k, d, steps FROM started UNION ALL SELECT part, place, k + 1, sha256(steps[k].a || d || steps[k].b), steps FROM folds WHERE k <= len(steps))
SELECT s.doc_id, s.leaf, t.digest AS subroot, r.digest AS root, sha256(array_to_string(list_transform(s.steps, lambda x: x.a || x.b), '')) AS proof_sha256, f.d AS folded_root, f.d = r.digest AS verified
FROM started s JOIN tops t USING (part) CROSS JOIN (SELECT digest FROM high WHERE size = 1) r JOIN folds f ON f.part = s.part AND f.place = s.place AND f.k = len(s.steps) + 1
"""
