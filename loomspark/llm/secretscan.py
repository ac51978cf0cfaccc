"""Operator 8, secret scans with character Markov models.

Patterns find assigned secrets, access keys and long hexadecimal runs. For all other tokens of TOKEN, two
first-order Markov models over characters compare: one of random strings, one of ordinary identifiers. A token
whose log-likelihood ratio is high enough in all and on average is a secret too. The models are trained on
labelled samples (sample, is_random, weight): by default random strings from seeded digests, and identifiers
formed of every word of every document, weighted by the number of documents that hold it, so junk and the
secrets themselves hardly count. Transitions are mixed with a uniform share, so ratios don't grow with the corpus.

Defined cases: null and empty texts have no spans; a null doc_id is scanned; repeated rows are scanned
each; of overlapping spans the base ones stay and a token that touches one is not scored; very long texts are
scanned whole, in linear time; without words only the random model is trained; an empty table gives an empty
result; extra columns are kept by scan(), but a column found is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import empty, let, read

#: The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
NAMED = r"(?i)password|passwd|secret|token|api_?key"
ACCESS = r"AKIA[A-Z0-9]{16,}"  # maximal runs: the same matches as AKIA[A-Z0-9]+ of 20 or more
HEX = r"[0-9a-f]{24,}"  # maximal runs: the same matches as [0-9a-f]+ of 24 or more
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(LETTERS) + 1  # and the start
SAMPLE_RANDOM = 3_000
#: Share of the uniform distribution in each transition.
UNIFORM = 0.05
MIN_RATIO, MIN_MEAN = 12.0, 0.5
#: Matches whose places are summed at once.
BLOCK = 64


def spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Array of (start, stop, kind) of the leftmost matches whose group has at least `least` characters."""
    matches, sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    size = lambda a: F.transform(a, lambda x: F.length(x))
    parts = F.arrays_zip(size(F.split(text, pattern, -1)).alias("gap"), size(matches).alias("m"), size(sizes).alias("g"))

    def add(s: Column, p: Column) -> Column:
        begin = s["at"] + p["gap"]
        end = begin + F.coalesce(p["m"], F.lit(0))
        new = F.array(F.struct(begin.alias("start"), end.alias("stop"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(p["g"] >= least, F.concat(s["out"], new)).otherwise(s["out"]).alias("out"))

    def placed(blocks: Column, before: Column) -> Column:
        begin = lambda b: F.struct(F.aggregate(F.slice(before, 1, b), F.lit(0), lambda s, x: s + x).alias("at"), empty("struct<start:int,stop:int,kind:int>").alias("out"))
        return F.flatten(F.transform(blocks, lambda block, b: F.aggregate(block, begin(b), add)["out"]))

    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda b: F.slice(p, b * BLOCK + 1, BLOCK))
    total = lambda block: F.aggregate(block, F.lit(0), lambda s, p: s + p["gap"] + F.coalesce(p["m"], F.lit(0)))
    return let(let(parts, cut), lambda blocks: let(F.transform(blocks, total), lambda before: placed(blocks, before)))


def base_spans(text: Column) -> Column:
    none = empty("struct<start:int,stop:int,kind:int>")
    return F.concat(
        F.when(text.rlike(NAMED), spans(text, ASSIGN, 0, 2, 6)).otherwise(none),
        F.when(text.contains("AKIA"), spans(text, ACCESS, 1)).otherwise(none),
        F.when(text.rlike(HEX), spans(text, HEX, 2)).otherwise(none),
    )


def samples(docs: DataFrame, sample_random: int = SAMPLE_RANDOM) -> DataFrame:
    """(sample, is_random, weight): random strings of a bounded number, and identifiers of all words of docs."""
    digest = F.sha2(F.concat(F.lit("random:"), F.col("id").cast("string")), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(digest)), "[=\\n\\r]", "")
    shape = F.when(F.col("id") % 3 == 0, digest).when(F.col("id") % 3 == 1, mixed).otherwise(F.upper(mixed))
    random = docs.sparkSession.range(0, sample_random, 1, 4).select(shape.alias("sample"), F.lit(1).alias("is_random"), F.lit(1).cast("long").alias("weight"))
    words = docs.select(F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "[^A-Za-z]+"))).alias("w")).where("length(w) >= 3")
    words = words.groupBy("w").agg(F.count("*").alias("weight"))
    w, capital = F.col("w"), F.initcap("w")
    forms = F.array(*[F.concat(w, F.lit(glue), w) for glue in "_-/"], F.concat(capital, capital), F.concat(F.upper(w), F.lit("_"), F.upper(w)), F.concat(w, F.pmod(F.xxhash64("w"), F.lit(100)).cast("string")))
    return random.unionByName(words.select(F.explode(forms).alias("sample"), F.lit(0).alias("is_random"), "weight"))


def _state(token: Column, at: Column) -> Column:
    return F.when(at == 0, 0).otherwise(F.instr(F.lit(LETTERS), F.substring(token, at, F.lit(1))))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio of random to ordinary for each (state, next state); STATES squared numbers."""
    weight = F.col("weight") if "weight" in labelled.columns else F.lit(1)
    steps = labelled.where("sample is not null and sample <> ''").select("is_random", weight.alias("weight"), F.explode(F.transform(F.sequence(F.lit(1), F.length("sample")), lambda i: _state(F.col("sample"), i - 1) * STATES + _state(F.col("sample"), i))).alias("step"))
    counts = {(r["is_random"], r["step"]): r["n"] for r in steps.groupBy("is_random", "step").agg(F.sum("weight").alias("n")).collect()}  # at most 2 * STATES ** 2 rows
    totals = {(k, a): sum(counts.get((k, a * STATES + b), 0) for b in range(STATES)) for k in (0, 1) for a in range(STATES)}
    chance = lambda k, a, b: UNIFORM / STATES + (1 - UNIFORM) * (counts.get((k, a * STATES + b), 0) / totals[k, a] if totals[k, a] else 1 / STATES)
    return [math.log(chance(1, a, b) / chance(0, a, b)) for a in range(STATES) for b in range(STATES)]


def ratio(token: Column, model: Column) -> Column:
    """Log-likelihood ratio of a token."""
    return let(token, lambda t: F.aggregate(F.sequence(F.lit(1), F.length(t)), F.lit(0.0), lambda s, i: s + F.get(model, _state(t, i - 1) * STATES + _state(t, i))))


def in_order(spans: Column) -> Column:
    order = F.array_sort(spans, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["kind"] - y["kind"]))
    return F.when(F.size(spans) > 1, order).otherwise(spans)


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """docs with found: (start, stop, kind) of all spans in order; kind indexes KINDS, code points, stop exclusive."""
    model = F.lit(train(samples(docs) if labelled is None else labelled))
    text = F.coalesce(F.col("text"), F.lit(""))

    def extended(base: Column) -> Column:
        def random(blocks: Column) -> Column:
            def test(s: Column) -> Column:
                score = ratio(F.substring(text, s["start"] + 1, s["stop"] - s["start"]), model)
                meets = lambda b: (b["start"] < s["stop"]) & (b["stop"] > s["start"])
                apart = ~F.exists(blocks, lambda block: meets(block) & F.exists(block["spans"], meets))
                return apart & let(score, lambda x: (x >= MIN_RATIO) & (x >= MIN_MEAN * (s["stop"] - s["start"])))

            return F.when(text.rlike(TOKEN), F.filter(spans(text, TOKEN, 3), test)).otherwise(empty("struct<start:int,stop:int,kind:int>"))

        def blocked(s: Column) -> Column:
            """Spans in order, in blocks with their reach, so that a token is compared with few of them."""
            cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda b: F.slice(s, b * BLOCK + 1, BLOCK))
            return F.transform(cut, lambda c: F.struct(c[0]["start"].alias("start"), F.array_max(F.transform(c, lambda x: x["stop"])).alias("stop"), c.alias("spans")))

        blocks = F.when(F.size(base) > 0, blocked(base)).otherwise(empty("struct<start:int,stop:int,spans:array<struct<start:int,stop:int,kind:int>>>"))
        return let(let(blocks, random), lambda tokens: F.when(F.size(tokens) > 0, in_order(F.concat(base, tokens))).otherwise(base))

    return docs.withColumn("found", let(let(base_spans(text), in_order), extended))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "found")
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")
    number = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = joined(F.filter("found", lambda s: s["kind"] < 3))
    return found.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
