"""Message parts of one shape: (type, text, tool, title, call_id, status, input, output, error, metadata).

A part is read as VARIANT, where a missing key differs from a JSON null. Of the names of an input or output the first
that is there counts, also if it is null; a null shows as null but is an output all the same. Texts, titles and ids are
JSON strings, anything else is none. Keys of a tool's state without a meaning of their own are metadata. Texts and
reasoning need a text, tools a name (their own or the one in their title), plans a text and images an address or typed
data; all others are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import once
from loomspark.operators.transcript import cleaned, tool_status

FIELDS = ("type", "text", "tool", "title", "call_id", "status", "input", "output", "error", "metadata")
#: Names of a tool's state that have a meaning of their own, and what an object of a plan may call its text.
STATE_KEYS = ("status", "input", "arguments", "output", "result", "error", "metadata", "meta")
PLAN_KEYS = ("text", "plan", "content")


def part(**fields: Column) -> Column:
    """A part with the given fields; the others are null."""
    return F.struct(*[fields.get(c, F.lit(None)).cast("string").alias(c) for c in FIELDS])


def member(value: Column, *keys: str) -> Column:
    """The first of an object's members that is there, a JSON null included; null if there is none."""
    return F.coalesce(*[F.try_variant_get(value, f"$.{k}", "variant") for k in keys])


def given(value: Column) -> Column:
    """A variant, but null for a JSON null."""
    return F.when(~F.is_variant_null(value), value)


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def text_in(value: Column) -> Column:
    """The text of a JSON string; null for anything else."""
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))


def shown(value: Column) -> Column:
    """A JSON string as its text, other values as JSON, null for a JSON null."""
    return F.coalesce(text_in(value), F.to_json(given(value)))


def filled(text: Column) -> Column:
    return F.when(text != "", text)


def plan_text(value: Column) -> Column:
    """A text, or what an object of any depth names as its text, plan or content."""
    inner = lambda v: F.coalesce(*[given(member(v, k)) for k in PLAN_KEYS])
    step = lambda v, _: F.when(is_object(v), inner(v)).otherwise(v)
    depth = F.length(F.regexp_replace(F.to_json(value), r"[^{]", ""))  # no value is nested deeper than it has braces
    unwrapped = once(depth, lambda n: F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), value, step)).otherwise(value))
    return once(unwrapped, text_in)


def metadata_of(state: Column) -> Column:
    """JSON of a state's metadata with its other keys folded in; these replace metadata that is no object."""
    members = lambda v: F.coalesce(F.when(is_object(v), v.try_cast("map<string,variant>")), F.expr("cast(map() as map<string,variant>)"))

    def folded(x: Column) -> Column:
        kept = F.map_filter(members(x["own"]), lambda k, _: ~F.array_contains(F.map_keys(x["extra"]), k))
        return F.when(F.size(x["extra"]) > 0, F.to_json(F.map_concat(kept, x["extra"]))).otherwise(shown(x["own"]))

    own = F.coalesce(given(member(state, "metadata")), given(member(state, "meta")))
    extra = F.map_filter(members(state), lambda k, _: ~k.isin(*STATE_KEYS))
    return once(F.struct(own.alias("own"), extra.alias("extra")), folded)


def _tool(raw: Column, state: Column) -> Column:
    """The part of a tool with a name of its own or in its title."""
    put = F.coalesce(member(state, "input", "arguments"), member(raw, "input"))
    got = F.coalesce(member(state, "output", "result"), member(raw, "output"))
    title = filled(text_in(member(raw, "title")))
    read = F.struct(put.alias("put"), got.alias("got"), member(state, "error").alias("error"), title.alias("title"), text_in(member(state, "status")).alias("status"))

    def made(x: Column) -> Column:
        tool = F.coalesce(filled(F.trim(text_in(member(raw, "tool")))), filled(F.trim(F.regexp_replace(x["title"], r"(?i)^tool:\s*", ""))))
        status = tool_status(x["status"], given(x["error"]).isNotNull(), x["got"].isNotNull())
        return once(tool, lambda name: F.when(name.isNotNull(), part(type=F.lit("tool"), tool=name, title=cleaned(x["title"]), call_id=filled(text_in(member(raw, "callID"))), status=status, input=shown(x["put"]), output=shown(x["got"]), error=shown(x["error"]), metadata=metadata_of(state))))

    return once(read, made)


def _plan(raw: Column) -> Column:
    def made(failed: Column) -> Column:
        value = F.coalesce(given(member(raw, "text")), F.when(failed, member(raw, "output")).otherwise(member(raw, "input")))
        text = cleaned(once(value, plan_text))
        return once(text, lambda t: F.when(t.isNotNull(), part(type=F.lit("plan"), text=t, status=F.when(failed, "fail").otherwise("success"))))

    return once(F.coalesce(text_in(member(raw, "approval_status")) == "fail", F.lit(False)), made)


def _image(raw: Column) -> Column:
    url = filled(text_in(member(raw, "url")))
    typed_data = filled(text_in(member(raw, "data"))).isNotNull() & filled(text_in(member(raw, "mime_type"))).isNotNull()
    return F.when(url.isNotNull() | typed_data, part(type=F.lit("image"), text=url))


def part_of(data: Column) -> Column:
    """The part that a JSON text describes, with internal text cleaned away; null if it shows nothing."""

    def made(raw: Column) -> Column:
        spoken = lambda kind: once(cleaned(text_in(member(raw, "text"))), lambda t: F.when(t.isNotNull(), part(type=kind, text=t)))
        state = F.when(is_object(member(raw, "state")), member(raw, "state"))
        by_kind = lambda kind: (
            F.when(kind.isin("text", "reasoning"), spoken(kind)).when(kind == "tool", once(state, lambda s: _tool(raw, s))).when(kind == "plan", _plan(raw)).when(kind == "image", _image(raw))
        )
        return once(text_in(member(raw, "type")), by_kind)

    return once(F.try_parse_json(data), made)


def with_part(rows: DataFrame, name: str) -> DataFrame:
    """rows with a column of the part_of() their data, those that show nothing left out.

    The part is generated, so that it is made once: a filter on a column is worked out anew below it.
    """
    return rows.select("*", F.explode_outer(F.array(part_of(F.col("data")))).alias(name)).where(f"{name} is not null")
