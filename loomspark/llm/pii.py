"""Operator 10, format-preserving Feistel pseudonyms for personal data.

One pattern finds candidates; a validator decides: payment cards (13 to 19 digits with a valid check digit),
phone numbers, IPv4 addresses (octets up to 255) and calendar dates from 1900 to 2099, with the day or the month
first. A run of digit groups is searched for cards from left to right: at each group those of 16, 15, 14, 13, 19,
18 and 17 digits are tried in this order, so a card is found beside an expiry date or another card. Each valid
value is mapped to an index of its format, split into Z_a x Z_b and permuted by an alternating Feistel
network of ROUNDS rounds whose round function is keyed SHA-256. The result is written in the same format,
so it is valid again (cards get a new check digit), keeps its separators, and equal values stay equal
across documents. E-mail addresses are no numbers: their local part becomes a keyed digest.

Defined cases: null texts stay null, empty ones empty; a null doc_id is handled; values that fail
validation stay; a date valid in both orders is read with the day first; repeated rows give repeated results;
very long texts are read whole, runs of digits in pieces of RUN groups; an empty table gives an empty result;
extra columns are kept by pseudonymise(), whatever their names, but a column kinds is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import let, read, unused

#: Digit groups of a run that are searched at once.
RUN = 400
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
DATE = r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])"
PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
#: Groups of digits, 13 digits or more; no group after the first begins a date or a phone number.
CARD = r"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){12})[0-9]+(?:[ -](?!%s|%s)[0-9]+){0,%d}+" % (DATE, PHONE, RUN - 1)
#: In the order tried; the name is the kind.
PATTERNS = {"email": EMAIL, "ipv4": IPV4, "date": DATE, "phone": PHONE, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Numbers of digits of a card, in the order tried at a group.
SIZES = (16, 15, 14, 13, 19, 18, 17)
ROUNDS = 8
#: 1900-01-01 to 2099-12-31 are 73,049 days, 229 x 319.
FIRST_DAY, DAYS = "1900-01-01", (229, 319)
FORMATS = [("-", "yyyy-MM-dd"), ("/", "dd/MM/yyyy"), ("/", "MM/dd/yyyy"), (".", "dd.MM.yyyy")]


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """(l, r): the keyed permutation of Z_a x Z_b at (left, right)."""

    def digest(n: Column, half: Column, modulus: Column) -> Column:
        hexed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), a, b, n, half), 256)
        return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long") % modulus

    def step(s: Column, n: Column) -> Column:
        even = n % 2 == 0
        return F.struct(F.when(even, (s["l"] + digest(n, s["r"], a)) % a).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise((s["r"] + digest(n, s["l"], b)) % b).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 36 digits permuted among those of its length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    power = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("long")
    out = feistel(F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, rest), power(half), power(rest), key, kind)
    return let(out, lambda s: F.concat(F.lpad(s["l"].cast("string"), half, "0"), F.lpad(s["r"].cast("string"), rest, "0")))


def luhn_digit(payload: Column) -> Column:
    """The check digit that makes payload valid."""
    digit = lambda i: F.substring(payload, F.length(payload) - i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(0), F.length(payload) - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i)))
    return ((10 - total % 10) % 10).cast("string")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(value: Column, digits: Column) -> Column:
    """value with its digits replaced in order."""
    place = lambda i: F.length(_digits(F.substring(value, F.lit(1), i)))
    sign = lambda i: F.substring(value, i, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.when(sign(i).rlike("[0-9]"), F.substring(digits, place(i), F.lit(1))).otherwise(sign(i))), "")


def _cards(digits: Column, sizes: Column) -> Column:
    """Array of (start, stop): digits of the cards among groups of the given sizes, from left to right."""
    last = F.size(sizes) - 1
    ends = F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda s, x: s + x))

    def search(ends: Column) -> Column:
        start = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1))

        def best(i: Column) -> Column:
            """The first size of SIZES that ends at a group and has a right check digit, else null."""
            reach = F.slice(ends, i + 1, F.least(F.lit(max(SIZES)), last - i + 1))
            fits = lambda n: F.array_contains(reach, start(i) + n) & let(F.substring(digits, start(i) + 1, n), _valid_card)
            return F.get(F.filter(F.array(*[F.lit(n) for n in SIZES]), fits), F.lit(0))

        def step(s: Column, i: Column) -> Column:
            found = let(best(i), lambda n: F.when(n.isNull(), s).otherwise(F.struct((start(i) + n).alias("at"), F.concat(s["out"], F.array(F.struct(start(i).alias("start"), (start(i) + n).alias("stop")))).alias("out"))))
            return F.when(start(i) < s["at"], s).otherwise(found)

        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), last), none, step)["out"]

    return let(ends, search)


def _valid_card(digits: Column) -> Column:
    return luhn_digit(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.substring(digits, F.length(digits), F.lit(1))


def _new_card(digits: Column, key: str) -> Column:
    return let(permute_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card"), lambda p: F.concat(p, luhn_digit(p)))


def _card(value: Column, key: str) -> Column:
    """(n, value) of a run of digit groups: how many cards it holds, and the run with their pseudonyms."""

    def written(digits: Column, cards: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
        new = lambda c: _new_card(F.substring(digits, c["start"] + 1, c["stop"] - c["start"]), key)
        done = F.aggregate(cards, start, lambda s, c: F.struct(c["stop"].alias("at"), F.concat(s["text"], F.substring(digits, s["at"] + 1, c["start"] - s["at"]), new(c)).alias("text")))
        return let(done, lambda s: F.concat(s["text"], F.substring(digits, s["at"] + 1, F.length(digits))))

    def replaced(digits: Column) -> Column:
        cards = _cards(digits, F.transform(F.split(value, "[ -]"), lambda g: F.length(g)))
        return let(cards, lambda c: F.struct(F.size(c).alias("n"), F.when(F.size(c) > 0, _refill(value, written(digits, c))).otherwise(value).alias("value")))

    return let(_digits(value), replaced)


def _phone(value: Column, key: str) -> Column:
    """The last ten digits are permuted, a country code stays."""
    return let(_digits(value), lambda d: _refill(value, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), permute_digits(F.substring(d, F.length(d) - 9, F.lit(10)), key, "phone"))))


def _ipv4(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, "\\."), lambda x: x.cast("long"))
    pair = lambda n: F.concat_ws(".", F.floor(n / 256).cast("long"), n % 256)
    new = lambda o: let(feistel(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), F.lit(65536), F.lit(65536), key, "ipv4"), lambda s: F.concat_ws(".", pair(s["l"]), pair(s["r"])))
    return let(octets, lambda o: F.when(F.forall(o, lambda x: x <= 255), new(o)))


def _date(value: Column, key: str) -> Column:
    a, b = DAYS
    first = F.lit(FIRST_DAY).cast("date")

    def new(day: Column, form: str) -> Column:
        index = F.datediff(day, first)
        moved = let(feistel(F.floor(index / b), index % b, F.lit(a), F.lit(b), key, "date"), lambda s: F.date_add(first, (s["l"] * b + s["r"]).cast("int")))
        return F.when((index >= 0) & (index < a * b), F.date_format(moved, form))

    def tried(sign: str, form: str) -> Column:
        return let(F.try_to_date(F.when(value.contains(sign), value), form), lambda day: new(day, form))

    return F.coalesce(*[tried(sign, form) for sign, form in FORMATS])


def _email(value: Column, key: str) -> Column:
    local = F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value)), 256), 1, 12)
    return F.concat(F.lit("u"), local, F.lit("@"), F.element_at(F.split(value, "@"), -1))


def _one(value: Column, new: Column) -> Column:
    """(n, value) of a value that is one candidate."""
    return let(new, lambda x: F.struct(F.when(x.isNull(), 0).otherwise(1).alias("n"), F.coalesce(x, value).alias("value")))


MAKERS = {"email": _email, "ipv4": _ipv4, "date": _date, "phone": _phone}


def _replaced(value: Column, key: str) -> Column:
    """(kinds, value): the kind of each value replaced, and the text."""

    def made(kind: str) -> Column:
        named = _card(value, key) if kind == "card" else _one(value, MAKERS[kind](value, key))
        return let(named, lambda x: F.struct(x["n"].alias("n"), x["value"].alias("value"), F.lit(kind).alias("kind")))

    out = F.struct(F.lit(0).alias("n"), value.alias("value"), F.lit("").alias("kind"))
    for kind in reversed(PATTERNS):
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), made(kind)).otherwise(out)
    return let(out, lambda x: F.struct(F.array_repeat(x["kind"], x["n"]).alias("kinds"), x["value"].alias("value")))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with text pseudonymised and kinds, the kind of each value replaced in order."""
    text, name = F.col("text"), unused(docs, "_pii")
    found = let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: F.transform(m, lambda v: _replaced(v, key)))
    gaps = F.split(text, ANY, -1)
    joined = lambda r: F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), r.alias("r")), lambda p: F.array(p["g"], F.coalesce(p["r"]["value"], F.lit(""))))), "")
    out = F.when(text.rlike("[0-9@]"), let(found, lambda r: F.struct(joined(r).alias("text"), F.flatten(F.transform(r, lambda x: x["kinds"])).alias("kinds"))))
    rows = docs.withColumn(name, out)
    return rows.withColumns({"text": F.coalesce(f"{name}.text", "text"), "kinds": F.coalesce(f"{name}.kinds", F.array().cast("array<string>"))}).drop(name)


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str, key: str = "rotate-me") -> DataFrame:
    out = pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), key)
    number = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long")
    return out.select("doc_id", "text", *[number(k).alias(f"n_{k}") for k in PATTERNS])
