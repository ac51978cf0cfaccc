"""Pages of an ordered snapshot by cursors that seek: a token holds the sort key of the last row seen.

A token is bound to the snapshot, the view of it and the query, so that a page can't be continued on other data or
with other parameters. A page filters by the key and takes the first rows, at no offset, so the last page costs what the first does.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

VERSION, LONGEST = 2, 4096
#: Parameters that don't change what is listed.
PAGING = ("cursor", "limit")


@dataclass
class Page:
    """rows and the token of the page after it, None on the last; kind is page, invalid_cursor or stale_snapshot."""

    kind: str
    rows: list[Row]
    next_cursor: str | None = None


def fingerprint(params: dict[str, str | list[str]]) -> str:
    """Digest of a query's parameters, whatever their order; those of paging don't count."""
    pairs = sorted((k, v) for k, values in params.items() if k not in PAGING for v in (values if isinstance(values, list) else [values]))
    return base64.urlsafe_b64encode(hashlib.sha256(urlencode(pairs).encode()).digest()).decode().rstrip("=")


def encoded(token: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(token, separators=(",", ":")).encode()).decode().rstrip("=")


def decoded(cursor: str, keys: int) -> dict | None:
    """The token of a cursor; None unless it is whole and of this version."""
    try:
        if len(cursor) > LONGEST or not cursor.isascii():
            return None
        token = json.loads(base64.b64decode(cursor + "=" * (-len(cursor) % 4), b"-_", validate=True))
    except (binascii.Error, ValueError):
        return None
    whole = isinstance(token, dict) and token.get("version") == VERSION and all(isinstance(token.get(k), str) for k in ("snapshot", "view", "query"))
    return token if whole and isinstance(token.get("after"), list) and len(token["after"]) == keys else None


def after(rows: DataFrame, order: list[tuple[str, bool]], key: list) -> Column:
    """Rows that come after a key in the order: (column, descending) each, nulls last either way."""

    def beyond(name: str, down: bool, value) -> Column:
        if value is None:
            return F.lit(False)
        held = F.lit(value).cast(rows.schema[name].dataType)
        return (F.col(name) < held if down else F.col(name) > held) | F.col(name).isNull()

    def same(name: str, value) -> Column:
        return F.col(name).isNull() if value is None else F.col(name) == F.lit(value).cast(rows.schema[name].dataType)

    steps = []
    for i, (name, down) in enumerate(order):
        equal = [same(n, v) for (n, _), v in zip(order[:i], key)]
        steps.append(reduce(and_, [*equal, beyond(name, down, key[i])]))
    return reduce(or_, steps)


def seek(rows: DataFrame, order: list[tuple[str, bool]], size: int, key: list | None = None) -> DataFrame:
    """The first rows, size at most, after a key; the last column of the order must tell rows apart."""
    if key is not None:
        rows = rows.where(after(rows, order, key))
    return rows.orderBy(*[F.desc_nulls_last(n) if down else F.asc_nulls_last(n) for n, down in order]).limit(size)


def page(rows: DataFrame, order: list[tuple[str, bool]], size: int, params: dict, snapshot: str, view: str, cursor: str | None = None) -> Page:
    """A page of rows; at most size + 1 of them reach the driver."""
    query, key = fingerprint(params), None
    if cursor:
        token = decoded(cursor, len(order))
        if token is None or token["query"] != query:
            return Page("invalid_cursor", [])
        if (token["snapshot"], token["view"]) != (snapshot, view):
            return Page("stale_snapshot", [])
        key = token["after"]
    found = seek(rows, order, size + 1, key).collect()
    more = None
    if len(found) > size:
        more = encoded({"version": VERSION, "snapshot": snapshot, "view": view, "query": query, "after": [found[size - 1][n] for n, _ in order]})
    return Page("page", found[:size], more)
