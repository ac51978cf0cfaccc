"""Tool calls inside small programs: `tools.name(argument)` with JavaScript literals as arguments.

A program is cut into tokens by one pattern; a value is then built by a loop with a stack, so nesting costs no
recursion. Names stand for the texts that the program assigned to them; anything that isn't a literal or a name makes
the call unreadable, and it is skipped.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Spaces and comments, which are never given back, and the token behind them: a text, number, name or mark.
TOKEN = re.compile(
    r"""(?:[ \t\n\r]|//[^\n]*(?:\n|\Z)|/\*(?:.*?\*/|.*))*+(?:("(?:[^"\\]|\\.)*(?:"|\\?\Z)|'(?:[^'\\]|\\.)*(?:'|\\?\Z)|`(?:[^`\\]|\\.)*(?:`|\\?\Z))"""
    r"""|([-+]?(?:0[xX][0-9a-fA-F]+|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?))|([A-Za-z_$][A-Za-z0-9_$]*)|([{}\[\]:,]))""",
    re.DOTALL,
)
TEXT, NUMBER, NAME, MARK = range(1, 5)
CALL = re.compile(r"tools\.([A-Za-z_$][A-Za-z0-9_$]*)[ \t\n\r\f\v\u00a0\ufeff\u2028\u2029]*\(")
ASSIGNED = re.compile(r"(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*")
ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.)|\Z)", re.DOTALL)
#: Escapes with a meaning of their own, words that are values, calls without output, and the frame of an output.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
WORDS = {"true": True, "false": False, "null": None}
SILENT = ("apply_patch", "update_plan")
FRAME = r"\AScript completed\nWall time [^\n]*\nOutput:\n?"


class Missing:
    """A name without a known value."""


MISSING = Missing()


def _text(token: str) -> str:
    """The text that a quoted token stands for; the quote at its end may be missing."""
    body, quote = token[1:], token[0]
    if "\\" not in token:
        out = body[:-1] if body.endswith(quote) else body
    else:
        if body.endswith(quote) and (len(body) - 1 - len(body[:-1].rstrip("\\"))) % 2 == 0:
            body = body[:-1]
        out = ESCAPE.sub(_escaped, body)
    return out if out.isascii() else out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # pairs of escapes are one character


def _escaped(m: re.Match) -> str:
    code, byte, char = m.groups()
    return chr(int(code or byte, 16)) if code or byte else ESCAPES.get(char, char or "")


def _number(token: str) -> float | int | None:
    """The number of a token; None where the language has none (a sign before a hexadecimal, or too large)."""
    if "x" in token.lower():
        return int(token, 16) if token[0] == "0" else None
    value = float(token)
    if not math.isfinite(value):
        return None
    return int(value) if value == int(value) and abs(value) < 1e21 else value


#: What a container waits for: a colon after a key, a value, either of these or its end, or a comma or its end.
COLON, VALUE, KEY_OR_END, VALUE_OR_END, NEXT = range(5)


def value_at(source: str, at: int, names: dict[str, str]) -> tuple[object, int] | None:
    """The literal that begins at a place, and where it ends; None if there is none."""
    stack: list[tuple] = []  # the containers around the open one: (container, key)
    inner, key, state = None, None, VALUE  # the open container, its key, and what it waits for
    token_at = TOKEN.match
    while True:
        m = token_at(source, at)
        if m is None:
            return None
        at, kind = m.end(), m.lastindex
        token = m[kind]
        if kind == MARK:
            if token == ",":
                if state == COLON:  # a key alone stands for the name's value
                    _put(inner, key, names.get(key, MISSING))
                elif state != NEXT:
                    return None
                state = KEY_OR_END if type(inner) is dict else VALUE_OR_END
                continue
            if token == ":":
                if state != COLON:
                    return None
                state = VALUE
                continue
            if token == "{" or token == "[":
                if state != VALUE and state != VALUE_OR_END:
                    return None
                stack.append((inner, key))
                inner, key, state = ({}, None, KEY_OR_END) if token == "{" else ([], None, VALUE_OR_END)
                continue
            if inner is None or state == VALUE or token != ("}" if type(inner) is dict else "]"):
                return None
            if state == COLON:
                _put(inner, key, names.get(key, MISSING))
            done = inner
            inner, key = stack.pop()
        elif state == KEY_OR_END:
            if kind == NUMBER:
                return None
            key, state = _text(token) if kind == TEXT else token, COLON
            continue
        elif state == NEXT or state == COLON:
            return None
        elif kind == TEXT:
            done = _text(token)
        elif kind == NUMBER:
            done = int(token) if len(token) < 16 and token.isdigit() else _number(token)
        else:
            done = WORDS[token] if token in WORDS else names.get(token, MISSING)
        if inner is None:
            return done, at
        _put(inner, key, done)
        state = NEXT


def _put(inner: dict | list, key: str | None, value: object) -> None:
    if type(inner) is list:
        inner.append(None if value is MISSING else value)
    elif value is MISSING:
        inner.pop(key, None)
    else:
        inner[key] = value


#: An argument as JSON.
SHOWN = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def decoded(source: str | None) -> list[tuple[str, str | None]]:
    """(name, argument as JSON) of the calls of a program in order; the argument is None for a name without a value."""
    if not source or "tools." not in source:
        return []
    names: dict[str, str] = {}
    at = 0
    while m := ASSIGNED.search(source, at):
        found = value_at(source, m.end(), names)
        at = found[1] if found else m.end()
        if found and isinstance(found[0], str):
            names[m[1]] = found[0]
    calls, at = [], 0
    while m := CALL.search(source, at):
        found = value_at(source, m.end(), names)
        at = found[1] if found else m.end()
        if found:
            calls.append((m[1], None if found[0] is MISSING else SHOWN(found[0])))
    return calls


CALLS = ArrayType(StructType([StructField("name", StringType()), StructField("args", StringType())]))


@F.arrow_udf(CALLS)
def exec_calls(source: pa.Array) -> pa.Array:
    """The calls of each program, as decoded() gives them."""
    ends, names, args = [0], [], []
    for program in source.to_pylist():
        for name, value in decoded(program):
            names.append(name)
            args.append(value)
        ends.append(len(names))
    calls = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(args, pa.string())], ["name", "args"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), calls)


def own_name(name: Column) -> Column:
    """A call's name without its namespace: `mcp__server__tool` is `tool` of `mcp__server__`."""
    return F.when(name.startswith("mcp__") & ~name.endswith("__"), F.substring_index(name, "__", -1)).otherwise(name)


def namespace(name: Column) -> Column:
    """What goes before own_name(); null if nothing does."""
    size = F.length(name) - F.length(own_name(name))
    return F.when(size > 0, F.substring(name, F.lit(1), size))


def output_target(names: Column) -> Column:
    """Place of the call that the program's output belongs to: the last that isn't silent, else the last; -1 without calls."""
    loud = F.filter(F.transform(names, lambda n, i: F.when(~own_name(n).isin(*SILENT), i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_max(loud), F.size(names) - 1)


def patch_text(args: Column) -> Column:
    """The patch of an argument as JSON: a text of its own, or the member patch of an object; else empty."""
    value = F.try_parse_json(args)
    text = F.when(F.schema_of_variant(value) == "STRING", value.cast("string")).otherwise(F.try_variant_get(value, "$.patch", "string"))
    return F.coalesce(text, F.lit(""))


def without_frame(output: Column) -> Column:
    return F.regexp_replace(output, FRAME, "")
