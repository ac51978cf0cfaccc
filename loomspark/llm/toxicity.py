"""Operator 5, toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first, in two ways: lower case, homoglyphs of other scripts and digit substitutions to one
letter each (so l, i and 1 are one), everything else to spaces; the second way also takes accents away, and whole
words of four letters or more are matched in it too. The lexicon holds folded words and word beginnings, with the log of how
much denser they stand in toxic texts as weight. It is learned from labelled documents: Spark counts in how many toxic and clean texts a term occurs,
and occurs densely; a likelihood-ratio test against chance over all terms tried selects terms, and words that a
selected beginning would hit but that clean texts use become exception phrases. A hit inside an exception phrase
doesn't count. The sum of weights is normalised by length: a logistic function of it, of the number of words and
of the sum for each word gives the score, fitted on the training rows by folds (each row is weighed with a
lexicon learned without its fold). Fitting uses at most max_labels labelled rows (the smallest CRC-32 of their
doc_id); scoring reads whole texts of all rows.

Defined cases: null and empty texts, and texts without letters or without a hit, score 0; a null doc_id is scored
and never used for fitting; without labelled rows of both kinds the lexicon is empty and all scores are 0;
repeated texts count once in fitting, as toxic if any of them is; of hits that begin at one place the heaviest
counts; very long texts are matched whole, in linear time; an empty table gives an empty result; extra columns
are ignored or kept, but a column toxicity is replaced by score_toxicity().
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import read, settle

#: Letters of other scripts, digits and signs that stand for a letter.
HOMOGLYPHS = {
    "a": "а α 4 @", "b": "Ь в β 8", "c": "с ϲ", "e": "е ё ε 3 €", "g": "ɡ 9", "h": "һ н", "i": "і ι 1 l | ł", "j": "ј",
    "k": "к κ", "m": "м", "n": "ո η", "o": "о ο σ 0", "p": "р ρ", "r": "г", "s": "ѕ 5 $", "t": "т τ 7 +", "u": "υ", "v": "ν ѵ",
    "w": "ш ω", "x": "х χ", "y": "у γ",
}
#: Accented letters, folded in the second way.
ACCENTS = {"a": "á à â ã å ā", "c": "ć ç", "e": "è é ê ë ē", "i": "ì í î ï ī", "n": "ñ", "o": "ò ó ô õ ō", "s": "ş š", "u": "ù ú û ū", "y": "ý ÿ"}
LENGTHS = (3, 4, 5, 6, 7)
#: Bounds of the model: labelled rows it is fitted on, terms it keeps (those of the largest gain).
MAX_LABELS = 20_000
MAX_TERMS = 5_000
#: A term is dense in a text where it is one of this many words; the least weight of a term of the lexicon.
DENSE, MIN_WEIGHT = 150, 1.5
FOLDS = 3
#: Terms that a task counts before it hands them on.
HELD = 200_000
#: Where few labelled texts have hits the coefficients stay near these: 1, log of the sum, log of words, sum for 10 words, a single hit.
PRIOR = (0.0, 4.0, -2.0, 1.5, -0.7)


class _Fold(dict):
    """Translation table that learns: letters stay, the rest becomes a space."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = value = c if c.isalpha() or "̀" <= c <= "ͯ" else " "
        return value


def _fold_table(accents: bool) -> _Fold:
    groups = [HOMOGLYPHS, ACCENTS] if accents else [HOMOGLYPHS]
    table = _Fold({ord(c): to for group in groups for to, signs in group.items() for c in signs.lower().split()})
    table.update({p: None for p in (0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF)})
    return table


def fold_tables() -> list[_Fold]:
    return [_fold_table(False), _fold_table(True)]


def fold(text: str | None, table: dict) -> str:
    return (text or "").lower().translate(table)


def _terms(word: str) -> list[str]:
    """Beginnings as ' begin', the whole word as ' word '."""
    return ([f" {word} "] if len(word) >= 3 else []) + [f" {word[:n]}" for n in LENGTHS if len(word) >= n]


class Model(NamedTuple):
    """Terms with their weights, exception phrases, coefficients of the score."""

    lexicon: dict[str, float]
    exceptions: list[str]
    coefficients: tuple[float, ...]


def labelled(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """(text, toxic) of at most max_labels labelled training rows, each text once."""
    key = F.crc32(F.col("doc_id").cast("string"))
    rows = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(key % 4 != 2)
    rows = rows.withColumn("_order", F.crc32(F.concat(F.lit("s"), F.col("doc_id").cast("string")))).orderBy("_order", "doc_id", "toxic").limit(max_labels)
    found = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # at most max_labels narrow rows
    return found.where("text is not null").groupBy(F.xxhash64("text").alias("_h")).agg(F.max_by("text", "doc_id").alias("text"), F.max("toxic").alias("toxic"))


def term_counts(train: DataFrame) -> DataFrame:
    """(part, term, t, c, dt, dc, rt, rc) of train(part, text, toxic): toxic and clean texts with the term, with it densely, and its summed densities.

    The term '' has the numbers of texts, and its densities the sums of 1 / words.
    """
    names = ["t", "c", "dt", "dc", "rt", "rc"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, seen = _fold_table(False), defaultdict(lambda: [0, 0, 0, 0, 0.0, 0.0])
        made = lambda: pd.DataFrame([(*key, *row) for key, row in seen.items()], columns=["part", "term", *names])
        for batch in batches:
            for part, text, toxic in zip(batch["part"], batch["text"], batch["toxic"]):
                side = 0 if toxic == 1 else 1
                words = fold(text, table).split()
                found = Counter(x for w in words for x in _terms(w))
                found[""] = 1
                for term, k in found.items():
                    row = seen[part, term]
                    row[side] += 1
                    row[2 + side] += DENSE * k >= len(words)
                    row[4 + side] += k / max(1, len(words))
                if len(seen) > HELD:
                    yield made()
                    seen.clear()
        yield made()

    schema = "part int, term string, t long, c long, dt long, dc long, rt double, rc double"
    return train.mapInPandas(count, schema).groupBy("part", "term").agg(*[F.sum(x).alias(x) for x in names])


def _gain(t: Column, c: Column, base: float) -> Column:
    """Log-likelihood ratio of a term's share of toxic texts against the base share, where it is larger."""
    share = t / F.greatest(t + c, F.lit(1))
    gain = t * F.log(share / base) + F.when(c > 0, c * F.log((1 - share) / (1 - base))).otherwise(0.0)
    return F.when((t > 0) & (share > base), gain).otherwise(0.0)


def fit_model(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, max_terms: int = MAX_TERMS) -> Model:
    """The lexicon, exceptions and coefficients learned from the labelled training rows."""
    import numpy as np

    train = labelled(docs, labels, max_labels).select(F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("part"), "text", "toxic").coalesce(16)
    counts = settle(term_counts(train))
    none = Model({}, [], PRIOR)
    sizes = counts.where("term = ''").collect()  # one row a fold
    n_terms = counts.select("term").distinct().count()
    left_out = [*range(FOLDS), -1]  # the last leaves nothing out
    terms, ok = counts.where("term <> ''"), F.lit(False)
    weighed = terms.groupBy("term").agg(*[F.sum(F.when(F.col("part") != p, F.col(x)).otherwise(0)).alias(f"{x}{i}") for i, p in enumerate(left_out) for x in ("t", "c", "dt", "dc", "rt", "rc")])
    columns = []
    for i, p in enumerate(left_out):
        kept = [r for r in sizes if r["part"] != p]
        toxic, clean = sum(r["t"] for r in kept), sum(r["c"] for r in kept)
        if not toxic or not clean:
            if p == -1:
                return none
            columns.append(F.lit(0.0).alias(f"w{i}"))
            continue
        one = sum(r["rt"] + r["rc"] for r in kept) / (toxic + clean)  # density of one hit in a usual text
        base = toxic / (toxic + clean)
        gain = F.greatest(_gain(F.col(f"t{i}"), F.col(f"c{i}"), base), _gain(F.col(f"dt{i}"), F.col(f"dc{i}"), base))
        weight = F.log((F.col(f"rt{i}") + one) / (toxic + 1)) - F.log((F.col(f"rc{i}") + one) / (clean + 1))
        good = (gain >= math.log(n_terms) + 2.7) & (weight >= MIN_WEIGHT)
        columns.append(F.when(good, weight).otherwise(0.0).alias(f"w{i}"))
        if p == -1:
            columns.append(gain.alias("gain"))
        ok = ok | good
    rows = weighed.where(ok).select("term", *columns).orderBy(F.desc("gain"), "term").limit(max_terms).collect()
    lexicons = [{r["term"]: r[f"w{i}"] for r in rows if r[f"w{i}"] > 0} for i in range(len(left_out))]
    exceptions = _exceptions(counts, lexicons[-1], max_terms)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matchers = [matcher(lexicon, exceptions) for lexicon in lexicons[:-1]]
        for batch in batches:
            found = [(*matchers[part](text), toxic) for part, text, toxic in zip(batch["part"], batch["text"], batch["toxic"])]
            yield pd.DataFrame(found, columns=["total", "hits", "words", "toxic"])

    seen = train.mapInPandas(weigh, "total double, hits long, words long, toxic int").where("hits > 0").toPandas()  # four numbers for each of at most max_labels rows
    x = np.array([features(*r) for r in zip(seen["total"], seen["hits"], seen["words"])]).reshape(-1, len(PRIOR))
    return Model(lexicons[-1], exceptions, tuple(_logistic(x, seen["toxic"].to_numpy(dtype=float))))


def _exceptions(counts: DataFrame, lexicon: dict[str, float], max_terms: int) -> list[str]:
    """Whole words of clean texts that a beginning of the lexicon would hit."""
    begins = [x for x in lexicon if not x.endswith(" ")]
    if not begins:
        return []
    words = counts.where("term like '% '").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("c >= 2 and t < 0.3 * (t + c)")
    words = words.where(F.substring("term", 1, min(LENGTHS) + 1).isin(sorted({x[: min(LENGTHS) + 1] for x in begins})))
    phrases = [r["term"] for r in words.orderBy(F.desc("c"), "term").limit(max_terms).collect()]
    return [p for p in phrases if p not in lexicon and any(p.startswith(x) for x in begins)]


def _logistic(x, y, rounds: int = 40, ridge: float = 0.5):
    """Coefficients of a logistic regression, drawn towards PRIOR."""
    import numpy as np

    prior = np.array(PRIOR)
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * (w - prior)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
    return w.tolist()


def features(total: float, hits: int, words: int) -> tuple[float, ...]:
    return 1.0, math.log1p(total), math.log1p(words), 10 * total / (words + 20), float(hits == 1)


def matcher(lexicon: dict[str, float], exceptions: Sequence[str]):
    """match(text) -> (sum of weights, number of hits, number of words)."""
    import ahocorasick

    tables, automata = fold_tables(), []
    plain = {term: weight for term, weight in lexicon.items() if term.endswith(" ") and len(term) >= 6 and term.isascii()}
    for table, terms in zip(tables, (lexicon, plain)):
        values: dict[str, tuple[int, float]] = {term: (len(term), weight) for term, weight in terms.items()}
        values |= {(spared := f" {fold(p, table).strip()} "): (len(spared), -1.0) for p in exceptions}
        automaton = ahocorasick.Automaton() if values else None
        for term, value in values.items():
            automaton.add_word(term, value)
        if values:
            automaton.make_automaton()
        automata.append(automaton)

    def match(text: str | None) -> tuple[float, int, int]:
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        words = 0
        for table, automaton in zip(tables, automata):
            folded = f" {' '.join(fold(text, table).split())} "  # both ways fold sign for sign, so places agree
            words = max(words, folded.count(" ") - 1) if folded.strip() else 0
            for end, (size, weight) in automaton.iter(folded) if automaton else ():
                if weight < 0:
                    spared.append((end - size + 1, end))
                elif weight > best.get(end - size + 1, 0.0):
                    best[end - size + 1] = weight
        if spared and best:
            best = _outside(best, spared)
        return sum(best.values()), len(best), words

    return match


def _outside(best: dict[int, float], spared: list[tuple[int, int]]) -> dict[int, float]:
    """The hits that lie in no spared span, by one pass over both in order."""
    spared, kept, i, reach = sorted(spared), {}, 0, -1
    for at in sorted(best):
        while i < len(spared) and spared[i][0] <= at:
            reach = max(reach, spared[i][1])
            i += 1
        if at >= reach:
            kept[at] = best[at]
    return kept


def scorer(model: Model):
    """score(text) -> (score, number of hits) under a model."""
    match = matcher(model.lexicon, model.exceptions)

    def score(text: str | None) -> tuple[float, int]:
        total, hits, words = match(text)
        if not hits:
            return 0.0, 0
        z = sum(a * b for a, b in zip(model.coefficients, features(total, hits, words)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), hits

    return score


def toxicity_score(model: Model):
    """The score as a vectorised column function of a text column."""

    @F.pandas_udf("score double, hits int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = scorer(model)
        for texts in batches:
            yield pd.DataFrame([score(x) for x in texts], columns=["score", "hits"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with a column toxicity(score, hits) from a lexicon learned from labels."""
    return docs.withColumn("toxicity", toxicity_score(fit_model(docs, labels))(F.col("text")))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without those that score the threshold or more."""
    columns = docs.columns
    udf = toxicity_score(fit_model(docs, labels))
    return docs.where(udf(F.col("text"))["score"] < threshold).select(*columns)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    score = F.col("toxicity.score")
    return scored.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"), F.col("toxicity.hits").alias("hits"))
