"""Operator 7, benchmark decontamination.

Texts and items are reduced to words of letters and digits in lower case. A document window of an item's
size is as similar as asked only if the shingles it shares with the item have that share of the item's weight
at least. A running sum over the positions of shared shingles gives all starts of such windows, in whatever
order the shingles stand; the rest can't be similar. Each window gets a SimHash of its shingles,
weighted by their rarity in the benchmark. RADIUS + 1 blocks cut the 64 bits; a window within RADIUS bits
of an item's fingerprint equals it in a block, so a join on (size, block, value) finds all of them. Exact
weighted Jaccard similarity of the shingle multisets, 0.8 or more, verifies each. Items of fewer than five
words are one shingle as a whole.

Defined cases: null texts and texts without words match nothing, nor do items without words; a null
doc_id or item_id is matched like any other; repeated rows give one match and are all dropped by
decontaminate(); an empty table on either side gives no matches; extra columns are kept by decontaminate().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.common import hashed, let, read, row_key, settle, sized, unused

WORDS, RADIUS, SIMILARITY = 5, 20, 0.8
SCALE = 1000


def shingles(words: Column, k: int) -> Column:
    """Hashes of the k-word shingles of an array of word hashes, in order."""
    made = let(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k))))
    return F.when(F.size(words) >= k, made).otherwise(F.array().cast("array<bigint>"))


def _shingles_of(words: Column, k: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.xxhash64(F.slice(words, i, k)))


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, size, k, shingle array); item identifies the row."""
    rows = benchmark.select(F.xxhash64("item_id", "text").alias("item"), "item_id", hashed(F.col("text")).alias("w")).dropDuplicates(["item"])
    rows = rows.where("size(w) > 0").withColumns({"size": F.size("w"), "k": F.least(F.size("w"), F.lit(WORDS))})
    return settle(rows.select("item", "item_id", "size", "k", let(F.col("w"), lambda w: _shingles_of(w, F.col("k"))).alias("s")))


def rarity(items: DataFrame) -> tuple[DataFrame, int]:
    """(s, weight) in thousandths for the benchmark's shingles, and the weight of others."""
    n = items.count()
    seen = items.select("item", F.explode(F.array_distinct("s")).alias("s")).groupBy("s").agg(F.count("*").alias("df"))
    weight = F.round(F.log(1 + n / F.col("df")) * SCALE).cast("long")
    import math

    return sized(seen.select("s", weight.alias("weight"))), round(math.log(1 + n) * SCALE)


def fingerprints(counted: DataFrame, keys: list[str]) -> DataFrame:
    """keys with fp: SimHash of counted(keys, s, c, weight)."""
    votes = [F.sum(F.when(F.shiftrightunsigned("s", b).bitwiseAND(F.lit(1)) == 1, F.col("c") * F.col("weight")).otherwise(-F.col("c") * F.col("weight"))).alias(f"b{b}") for b in range(64)]
    bits = [F.when(F.col(f"b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(64)]
    fp = bits[0]
    for bit in bits[1:]:
        fp = fp.bitwiseOR(bit)
    return counted.groupBy(*keys).agg(*votes).select(*keys, fp.alias("fp"))


def blocks(fp: Column, radius: int = RADIUS) -> Column:
    """Array of (block, value): radius + 1 blocks that cover the 64 bits."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << edges[i + 1] - edges[i]) - 1)).alias("value")) for i in range(n)])


def weight_or(common: int) -> Column:
    return F.coalesce("weight", F.lit(common)).alias("weight")


def window_starts(texts: DataFrame, ks: list[int], item_counts: DataFrame, similarity: float) -> DataFrame:
    """(_row, size, start): all windows of texts(_row, w) that share enough weight with an item of their size.

    Enough is `similarity` of the item's weight; repeated shingles of a window count in full, so none is lost.
    """
    need = F.greatest(F.lit(1), F.floor(F.col("theirs") * similarity))
    wanted = sized(item_counts.select("item", "size", "s", (F.col("c") * F.col("weight")).alias("worth"), "weight", need.alias("need")))
    hits = None
    for k in ks:
        placed = texts.select("_row", F.size("w").alias("n"), F.posexplode(shingles(F.col("w"), k)).alias("pos", "s"))
        found = placed.join(wanted.where(F.least("size", F.lit(WORDS)) == k), "s").withColumn("k", F.lit(k))
        hits = found if hits is None else hits.union(found)
    hits = settle(hits.distinct())
    pair = ["_row", "item"]
    likely = hits.select(*pair, "s", "worth", "need").distinct().groupBy(*pair).agg(F.sum("worth").alias("most"), F.first("need").alias("least")).where("most >= least")
    first = F.greatest(F.lit(0), F.col("pos") - (F.col("size") - F.col("k")))
    last = F.least(F.col("pos"), F.greatest(F.lit(0), F.col("n") - F.col("size")))
    ends = F.array(F.struct(first.alias("at"), F.col("weight").alias("step")), F.struct((last + 1).alias("at"), (-F.col("weight")).alias("step")))
    steps = hits.join(sized(likely.select(*pair)), pair).select(*pair, "size", "need", F.inline(ends)).groupBy(*pair, "size", "need", "at").agg(F.sum("step").alias("step"))
    order = Window.partitionBy(*pair).orderBy("at")
    runs = steps.select(*pair, "size", "need", "at", F.sum("step").over(order).alias("shared"), F.lead("at").over(order).alias("next")).where("shared >= need")
    return runs.select("_row", "size", F.explode(F.sequence("at", F.col("next") - 1)).alias("start")).distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """(_row, doc_id, item_id, start, similarity): each document row's best window of each item it leaks."""
    items = items_of(benchmark)
    weights, common = rarity(items)
    ks = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most WORDS values
    texts = docs.select(row_key().alias("_row"), "doc_id", hashed(F.col("text")).alias("w"))
    item_counts = settle(items.select("item", "size", F.explode("s").alias("s")).groupBy("item", "size", "s").agg(F.count("*").alias("c")).join(weights, "s", "left").select("item", "size", "s", "c", weight_or(common)))
    theirs = sized(item_counts.groupBy("item").agg(F.sum(F.col("c") * F.col("weight")).alias("theirs")))
    if not ks:
        schema = docs.select(row_key().alias("_row"), "doc_id").limit(0)
        return schema.select("_row", "doc_id", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start"), F.lit(0.0).alias("similarity"))
    windows = settle(window_starts(texts, ks, item_counts.join(theirs, "item"), similarity))
    rows = sized(windows.select("_row").distinct())
    cut = texts.join(rows, "_row", "left_semi").dropDuplicates(["_row"]).join(windows, "_row")
    cut = cut.select("_row", "size", "start", F.slice("w", F.col("start") + 1, F.col("size")).alias("w"))
    made = let(F.col("w"), lambda w: _shingles_of(w, F.least(F.size(w), F.lit(WORDS))))
    window = ["_row", "size", "start"]
    counted = cut.select(*window, F.explode(made).alias("s")).groupBy(*window, "s").agg(F.count("*").alias("c"))
    counted = settle(counted.join(weights, "s", "left").select(*window, "s", "c", weight_or(common)))
    window_fp = fingerprints(counted, window)
    item_fp = fingerprints(item_counts, ["item", "size"])
    cells = sized(item_fp.select("item", "size", F.col("fp").alias("item_fp"), F.inline(blocks(F.col("fp"), radius))))
    near = window_fp.select(*window, "fp", F.inline(blocks(F.col("fp"), radius))).join(cells, ["size", "block", "value"])
    near = settle(near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select(*window, "item").distinct())
    mine = counted.groupBy(*window).agg(F.sum(F.col("c") * F.col("weight")).alias("mine"))
    item_cells = sized(item_counts.select("item", "s", F.col("c").alias("item_c")))
    shared = near.join(counted, window).join(item_cells, ["item", "s"]).groupBy(*window, "item").agg(F.sum(F.least("c", "item_c") * F.col("weight")).alias("shared"))
    score = shared.join(mine, window).join(theirs, "item").withColumn("similarity", F.col("shared") / (F.col("mine") + F.col("theirs") - F.col("shared")))
    best = score.where(F.col("similarity") >= similarity).groupBy("_row", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"))).alias("best"))
    named = best.join(sized(items.select("item", "item_id")), "item").select("_row", "item_id", (-F.col("best.before")).alias("start"), F.col("best.similarity").alias("similarity"))
    ids = docs.select(row_key().alias("_row"), "doc_id")
    return settle(ids.join(sized(named), "_row").distinct().select("_row", "doc_id", "item_id", "start", "similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item."""
    name = unused(docs, "_leak")
    leaks = sized(find_leaks(docs.select("doc_id", "text"), benchmark).select(F.col("_row").alias(name)).distinct())
    return docs.join(leaks, row_key() == F.col(name), "left_anti")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", F.round("similarity", 6).alias("similarity"))
