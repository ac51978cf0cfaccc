"""Tool payloads: leaf text of any JSON, paths named in it, files of a patch, tool kinds."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of keys that never name a path, whole keys that don't, and tool labels by what they do to a file.
NOT_PATH_PARTS = ("command", "content", "text", "prompt", "url", "body", "title", "description")
NOT_PATH_KEYS = ("cwd", "workdir", "directory")
KINDS = {"read": ("read", "readfile", "read_file"), "edit": ("edit", "multiedit", "apply_patch", "notebookedit"), "write": ("write", "writefile", "write_file", "create_file"), "delete": ("delete", "delete_file")}
MAX_DEPTH = 4


def is_path_key(key: str) -> bool:
    key = key.strip().lower()
    if key in NOT_PATH_KEYS or any(part in key for part in NOT_PATH_PARTS):
        return False
    return "file" in key or "path" in key


def is_path(text: str) -> bool:
    """One line of at most 300 characters, no address or markup, with a slash or a file extension."""
    text = text.strip()
    if not 0 < len(text) <= 300 or re.search(r"[\n<>{}]|^[A-Za-z]+://", text):
        return False
    return "/" in text or "\\" in text or re.fullmatch(r"[A-Za-z0-9_.@-]+\.[A-Za-z0-9_-]+", text) is not None


def leaves(value) -> Iterator[str]:
    """Texts (trimmed), numbers and booleans of a JSON value in order; keys are no leaves."""
    if isinstance(value, dict):
        for v in value.values():
            yield from leaves(v)
    elif isinstance(value, list):
        for v in value:
            yield from leaves(v)
    elif isinstance(value, str):
        if value.strip():
            yield value.strip()
    elif value is not None:
        yield json.dumps(value)


def paths(value, key: str = "", depth: int = 0) -> Iterator[str]:
    """Texts that look like paths under a key that names one, at most MAX_DEPTH levels down."""
    if depth > MAX_DEPTH:
        return
    if isinstance(value, str) and is_path_key(key) and is_path(value):
        yield value.strip()
    elif isinstance(value, (dict, list)):
        for name, v in value.items() if isinstance(value, dict) else ((key, v) for v in value):
            yield from paths(v, name, depth + 1)


def _parsed(text: str | None):
    try:
        return json.loads(text) if isinstance(text, str) else None
    except ValueError:
        return text


def leaf_text(payload: Column) -> Column:
    """The leaves of a JSON text, one a line; a text that is no JSON is its own leaf."""

    def run(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda x: "\n".join(leaves(_parsed(x))))

    return F.pandas_udf(run, "string")(payload)


def path_list(payload: Column) -> Column:
    """The distinct paths a JSON text names, in order."""

    def run(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda x: list(dict.fromkeys(paths(_parsed(x)))))

    return F.pandas_udf(run, "array<string>")(payload)


def tool_kind(tool: Column) -> Column:
    """What a tool does to files by its exact label, else null."""
    found = F.lit(None).cast("string")
    for kind, labels in KINDS.items():
        found = F.when(F.lower(F.trim(tool)).isin(*labels), kind).otherwise(found)
    return found


def patch_files(patch: Column) -> Column:
    """(kind, path) of each file section of a patch text."""
    pattern = r"(?m)^\*\*\* (Add|Update|Delete) File: (.+?)\s*$"
    actions, names = F.regexp_extract_all(patch, F.lit(pattern), F.lit(1)), F.regexp_extract_all(patch, F.lit(pattern), F.lit(2))
    kind = lambda a: F.when(a == "Add", "write").when(a == "Delete", "delete").otherwise("edit")
    return F.transform(F.arrays_zip(actions.alias("a"), names.alias("p")), lambda x: F.struct(kind(x["a"]).alias("kind"), x["p"].alias("path")))
