"""Model prices: key normalisation, resolution over a price table, message cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Provider prefixes tried before a bare model key.
PREFIXES = ("anthropic/", "openai/", "openrouter/openai/", "openrouter/anthropic/", "moonshotai/", "novita/moonshotai/")


def model_key(model: Column) -> Column:
    """Lower case, underscores as dashes, without an @ suffix or a dated version."""
    key = F.replace(F.lower(F.trim(model)), F.lit("_"), F.lit("-"))
    return F.regexp_replace(F.regexp_replace(key, "@.*$", ""), "-[0-9]{8}$", "")


def resolve_prices(models: DataFrame, prices: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(model, price_key): the first candidate with a price, else the longest price key that begins it.

    models(model) holds distinct names; prices(price_key, ...) is a small dimension. Candidates keep their
    order: the key, its alias, the key without its provider, its alias, then provider prefixes.
    """
    alias = F.create_map(*[F.lit(x) for pair in (aliases or {"": ""}).items() for x in pair])
    named = lambda c: F.coalesce(F.try_element_at(alias, c), c)
    bare = F.element_at(F.split("key", "/"), -1)
    rows = models.select("model").distinct().withColumn("key", model_key(F.col("model"))).withColumn("bare", bare)
    candidates = F.array(F.col("key"), named(F.col("key")), F.col("bare"), named(F.col("bare")), *[F.concat(F.lit(p), F.col("bare")) for p in PREFIXES])
    listed = rows.select("model", F.posexplode(candidates).alias("rank", "candidate")).withColumn("candidate", named(F.col("candidate")))
    exact = listed.join(F.broadcast(prices.select("price_key")), F.col("candidate") == F.col("price_key")).select("model", "price_key", "rank", F.lit(0).alias("loose"))
    stems = listed.withColumn("parts", F.split("candidate", "[-@]")).select("model", "candidate", "rank", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n"), "parts")
    stem = F.array_join(F.slice("parts", F.lit(1), F.col("n")), "-")
    loose = stems.withColumn("stem", stem).join(F.broadcast(prices.select("price_key")), F.col("stem") == F.col("price_key")).select("model", "price_key", "rank", (1000 - F.length("price_key")).alias("loose"))
    best = exact.union(loose).groupBy("model").agg(F.min(F.struct(F.when(F.col("loose") > 0, 1).otherwise(0).alias("fuzzy"), "rank", "loose", "price_key")).alias("b"))
    return best.select("model", F.col("b.price_key").alias("price_key"))


def message_cost() -> Column:
    """Estimated cost of a row with token and price columns: input net of cache, eight places, null unless positive."""
    more = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    net = F.greatest(more("input") - more("cache_read") - more("cache_create"), F.lit(0))
    cost = net * F.col("input_price") + more("output") * F.col("output_price") + more("reasoning") * F.col("output_price") + more("cache_read") * F.col("read_price") + more("cache_create") * F.col("create_price")
    return F.when(cost > 0, F.round(cost, 8))
