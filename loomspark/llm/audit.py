"""Operator 11, an audit of how filters interact.

A document gets a mask of the filters that it fails. Four look at its own text; the fifth fails a text that a smaller
doc_id has too, anywhere in the table. For it texts are routed by the xxhash of their bytes. An input partition first
keeps chains of its own, by hash: each text with the minimum id seen and how many rows have it. A row that isn't
the minimum is decided there and goes on without its text, so of a group of copies each partition sends one text.
The texts' bytes, summed before, give the number of partitions that they are routed to. Routed rows are sorted by hash
within their partition, so one collision chain with its full texts is held at a time.
Non-minimum ids are emitted. combineByKey then merges vectors of counts, one cell for each mask and label, for each
part; a partition sends one vector of a part. All orders of the filters follow from such a vector.

Defined cases: null texts count as empty; a null source is the part ''; a null doc_id is neither smaller than another
nor larger, so it never fails for a copy; repeated rows of one doc_id and text don't fail for each other; a row counts
as often as it comes; several labels of a doc_id count as set if any is; very long texts are read whole, and a
partition's own chains are handed on whenever they hold CHAIN bytes; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby, permutations

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import read, settle

FILTERS = "ABCDE"
#: Few words, few of them distinct, many capitals, and characters that mark markup.
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, MARKUP = 200, 50, 2, b"#$%&*|"
#: Bits of a cell: the five filters, then quality and toxic.
COPY, GOOD, TOXIC, CELLS = 1 << 4, 1 << 5, 1 << 6, 1 << 7
#: Bytes of texts that an input partition's own chains hold.
CHAIN = 32 << 20
#: Bytes of texts for each partition that they are routed to, if the session's number of them isn't larger.
ROUTED = 128 << 20

#: hash -> text -> [minimum id, {part: rows}, mask]
Chains = dict[int, dict[bytes, list]]
#: (doc_id, part, mask, rows)
Decided = tuple[int | None, str, int, int]


def own_mask(text: bytes, length: int) -> int:
    """Filters that a text of so many code points fails by itself."""
    words = text.split()  # of bytes: at \x20 and \x09-\x0D only
    capitals = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    failed = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < DISTINCT_PERCENT * len(words),
        100 * capitals > CAPITALS_PERCENT * length,
        len(text.translate(None, MARKUP)) < len(text),
    )
    return sum(bit << i for i, bit in enumerate(failed))


def chained(chains: Chains, key: int, text: bytes, doc_id: int, parts: dict[str, int], mask: int) -> Iterator[Decided]:
    """Put rows of one id into the chain of their hash; yields what turns out not to have the minimum id."""
    chain = chains.setdefault(key, {})
    held = chain.get(text)
    if held is None:
        chain[text] = [doc_id, dict(parts), mask]
        return
    if doc_id == held[0]:
        for part, n in parts.items():
            held[1][part] = held[1].get(part, 0) + n
        return
    gone_id, gone = (doc_id, parts) if doc_id > held[0] else (held[0], held[1])
    if doc_id < held[0]:
        held[:2] = [doc_id, dict(parts)]
    for part, n in gone.items():
        yield gone_id, part, mask | COPY, n


def _minima(chains: Chains) -> Iterator[tuple[int, bytes, int, dict[str, int], int]]:
    for key, chain in chains.items():
        for text, (doc_id, parts, mask) in chain.items():
            yield key, text, doc_id, parts, mask


def _local(rows: Iterable) -> Iterator[tuple[int, tuple]]:
    """(key, decided row) or (hash, row with its text) of an input partition."""
    import xxhash

    chains: Chains = {}
    held = 0

    def sent() -> Iterator[tuple[int, tuple]]:
        for key, *rest in _minima(chains):
            yield key, tuple(rest)
        chains.clear()

    for place, (doc_id, part, text) in enumerate(rows):
        raw = (text or "").encode()
        mask = own_mask(raw, len(text or ""))
        if doc_id is None:
            yield xxhash.xxh64_intdigest(str(place)), (None, None, part, mask, 1)
            continue
        held += len(raw)
        for x in chained(chains, xxhash.xxh64_intdigest(raw), raw, doc_id, {part: 1}, mask):
            yield xxhash.xxh64_intdigest(str(x[0])), (None, *x)  # no text: dealt by its id
        if held > CHAIN:
            yield from sent()
            held = 0
    yield from sent()


def _routed(rows: Iterable[tuple[int, tuple]]) -> Iterator[Decided]:
    """Decided rows of a partition sorted by hash."""
    for key, group in groupby(rows, key=lambda r: r[0]):
        chains: Chains = {}
        for _, row in group:
            if row[0] is None:
                yield row[1:]
            else:
                text, doc_id, parts, mask = row
                yield from chained(chains, key, text, doc_id, parts, mask)
        for _, _, doc_id, parts, mask in _minima(chains):
            for part, n in parts.items():
                yield doc_id, part, mask, n


def decided(docs: DataFrame) -> RDD[Decided]:
    """(doc_id, part, mask, rows): each row of docs(doc_id, source, text) with the filters it fails; equal ones may be one row."""
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = docs.select(F.col("doc_id").cast("long"), part, "text").rdd.mapPartitions(_local)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // ROUTED))
    return rows.repartitionAndSortWithinPartitions(n, lambda key: key % n).mapPartitions(_routed, True)


def masks(docs: DataFrame) -> DataFrame:
    """The rows of decided() as a table, settled."""
    return settle(docs.sparkSession.createDataFrame(decided(docs), "doc_id long, part string, mask int, n long", verifySchema=False))


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id): ids of documents whose text a smaller id has, too."""
    return masks(docs).where(F.col("mask").bitwiseAND(COPY) > 0).select("doc_id").distinct()


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """masks() with the bits of the labels(doc_id, quality, toxic)."""
    flag = lambda c, bit: F.when(F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))) == 1, bit).otherwise(0)
    flags = labels.where("doc_id is not null").groupBy("doc_id").agg((flag("quality", GOOD) + flag("toxic", TOXIC)).alias("flags"))
    known = rows.where("doc_id is not null").join(flags, "doc_id", "left").withColumn("mask", F.col("mask") + F.coalesce("flags", F.lit(0))).drop("flags")
    return known.unionByName(rows.where("doc_id is null"))


def count_vectors(rows: DataFrame) -> RDD[tuple[str, list[int]]]:
    """(part, vector): how many of the part's rows have each mask."""

    def create(x: tuple[int, int]) -> list[int]:
        return add([0] * CELLS, x)

    def add(vector: list[int], x: tuple[int, int]) -> list[int]:
        vector[x[0]] += x[1]
        return vector

    def merge(a: list[int], b: list[int]) -> list[int]:
        return [x + y for x, y in zip(a, b)]

    cells = rows.select("part", "mask", "n").rdd.map(lambda r: (r[0], (r[1], r[2])))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.combineByKey(create, add, merge, n)


def report(part: str, vector: list[int]) -> Iterator[tuple]:
    """Rows of OUT for all orders of the filters over one part."""
    orders = list(permutations(range(len(FILTERS))))
    of = lambda wanted: [(mask, n) for mask, n in enumerate(vector) if n and wanted(mask)]
    total, rows, shapley = sum(vector), [], [0] * len(FILTERS)
    unique = [sum(n for _, n in of(lambda m: m & (2 * COPY - 1) == 1 << f)) for f in range(len(FILTERS))]
    failing = [of(lambda m: m >> f & 1) for f in range(len(FILTERS))]
    for order in orders:
        before, left = 0, total
        for step, f in enumerate(order, 1):
            here = [(m, n) for m, n in failing[f] if not m & before]
            removed = sum(n for _, n in here)
            left -= removed
            shapley[f] += removed
            lost = [sum(n for m, n in here if m & bit) for bit in (GOOD, TOXIC)]
            redundant = sum(n for _, n in failing[f]) - removed
            rows.append((part, "".join(FILTERS[i] for i in order), step, left, removed, redundant, unique[f], *lost, f))
            before |= 1 << f
    for *row, f in rows:
        yield *row, shapley[f]


OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step; see OUT."""
    vectors = count_vectors(labelled(masks(docs), labels))
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda x: report(*x)), OUT, verifySchema=False)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
failing AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM words),
flags AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY 1),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM failing LEFT JOIN flags USING (doc_id) GROUP BY ALL),
parts AS (SELECT DISTINCT part FROM cells),
f AS (SELECT unnest(range(5)) AS f),
orders AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT list_transform(o, lambda x: chr((65 + x)::INT)).array_to_string('') AS filter_order, s::INT AS step, o[s] AS f, list_sum(list_transform(o[1:s - 1], lambda x: (2 ** x)::BIGINT)) AS before FROM orders, range(1, 6) r(s)),
rows_ AS (SELECT part, filter_order, step, s.f, coalesce(sum(n) FILTER (WHERE mask & ((2 ** s.f)::BIGINT | coalesce(before, 0)::BIGINT) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE mask >> s.f & 1 = 1 AND mask & coalesce(before, 0)::BIGINT = 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE mask >> s.f & 1 = 1 AND mask & coalesce(before, 0)::BIGINT <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE mask = (2 ** s.f)::BIGINT), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (WHERE mask >> s.f & 1 = 1 AND mask & coalesce(before, 0)::BIGINT = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(bad) FILTER (WHERE mask >> s.f & 1 = 1 AND mask & coalesce(before, 0)::BIGINT = 0), 0)::BIGINT AS toxic_lost FROM steps s, cells GROUP BY ALL)
SELECT * EXCLUDE (f), sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM rows_
"""
