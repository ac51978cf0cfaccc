"""Text functions: folding, tokens, titles, snippets, highlights and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāēīōū"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaeiou"


def once(value: Column, body) -> Column:
    """body(value), with the value worked out once and its expressions kept out of generated code, whose size is limited."""
    return F.transform(F.array(value), body)[0]


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def first_line_title(text: Column, size: int = 100) -> Column:
    """The first visible line, spaces collapsed, cut to size; null if there is none."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.substring(F.get(lines, F.lit(0)), 1, size)


def title_of(explicit: Column, message: Column, directory: Column) -> Column:
    """Explicit title, else the message's, else the last part of the directory."""
    base = F.element_at(F.filter(F.split(F.replace(directory, F.lit("\\"), F.lit("/")), "/"), lambda x: x != ""), -1)
    return F.coalesce(first_line_title(explicit), first_line_title(message), base, F.lit("Untitled Session"))


def snippet(text: Column, terms: list[str], around: int = 80) -> Column:
    """The text around the first of the terms it holds, with ellipses where cut; without terms its first 180 characters."""
    if not terms:
        return F.substring(text, 1, 180)
    low = F.lower(text)
    pick = F.coalesce(*[F.when(low.contains(t.lower()), F.lit(t.lower())) for t in terms], F.lit(terms[0].lower()))
    at = F.instr(low, pick) - 1
    start = F.greatest(at - around, F.lit(0))
    end = F.least(F.length(text), at + F.length(pick) + around)
    return F.concat(F.when(start > 0, "… ").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), " …").otherwise(""))


def highlights(text: Column, terms: list[str]) -> Column:
    """Merged (start, stop) ranges of all terms, letter case ignored; stop exclusive."""

    def of(term: str) -> Column:
        n = len(term)
        gaps = F.split(F.lower(text), F.lit("\\Q" + term.lower() + "\\E"), -1)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))
        add = lambda s, g: F.struct((s["at"] + F.length(g) + n).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + F.length(g)).alias("start"), (s["at"] + F.length(g) + n).alias("stop")))).alias("out"))
        return F.aggregate(F.slice(gaps, F.lit(1), F.size(gaps) - 1), start, add)["out"]

    found = F.array_sort(F.concat(*[of(t) for t in terms]))

    def merge(out: Column, r: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], r["stop"]).alias("stop"))))
        return F.when((F.size(out) > 0) & (F.get(out, F.size(out) - 1)["stop"] >= r["start"]), joined).otherwise(F.concat(out, F.array(r)))

    return F.when(F.size(found) == 0, found).otherwise(F.aggregate(found, F.slice(found, 1, 1), merge))


def parsed_millis(value: Column) -> Column:
    """Epoch milliseconds of a timestamp text; numbers are milliseconds, texts without a zone are UTC, failures null."""
    text = F.trim(value)
    iso = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2})[ ](?=\d)", "$1T")
    zoned = F.when(iso.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), iso).otherwise(F.concat(iso, F.lit("Z")))
    return F.when(text.rlike(r"^\d+(\.\d+)?$"), F.floor(text.try_cast("double"))).otherwise(F.unix_millis(F.try_to_timestamp(zoned)))
