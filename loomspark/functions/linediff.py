"""Line diffs of edits: the fewest added and removed lines that turn one text into the other.

The greedy search for the furthest reaching path on each diagonal, from both ends at once, finds the middle of a shortest
script, and each half is cut again, so memory is linear in the lines. All diagonals of a step are moved together as
arrays; equal lines of a step are walked together, too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

LINES = ArrayType(StructType([StructField("type", StringType()), StructField("text", StringType())]))


def _coded(old: list[str], new: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lines as numbers, equal ones as equal numbers."""
    codes: dict[str, int] = {}
    number = lambda lines: np.array([codes.setdefault(x, len(codes)) for x in lines], np.int64)
    return number(old), number(new)


def _slide(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
    """x after all equal lines that follow (step 1) or go before (step -1) each point."""
    x, y = x.copy(), y.copy()
    live = np.arange(len(x))
    while len(live):
        i, j = x[live] - (step < 0), y[live] - (step < 0)
        inside = (i >= 0) & (j >= 0) & (i < len(a)) & (j < len(b))
        live, i, j = live[inside], i[inside], j[inside]
        live = live[a[i] == b[j]]
        x[live] += step
        y[live] += step
    return x


def _middle(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """A point on a shortest script of two sequences, neither empty, that differ at both ends."""
    n, m = len(a), len(b)
    delta, size = n - m, n + m + 1
    never, ever = -size, n + size  # diagonals that no path has reached
    front, back = np.full(2 * size + 1, never, np.int64), np.full(2 * size + 1, ever, np.int64)
    for d in range((n + m + 1) // 2 + 1):
        k = np.arange(-d, d + 1, 2)
        o = k + size
        right, down = front[o - 1] + 1, front[o + 1]
        x = np.maximum(np.where(right <= n, right, never), np.where(down - k <= m, down, never)) if d else np.zeros(1, np.int64)
        on = x >= 0
        k, o, x = k[on], o[on], x[on]
        front[o] = x = _slide(a, b, x, x - k, 1)
        if delta % 2:
            met = np.flatnonzero(x >= back[delta - k + size])
            if len(met):
                return int(x[met[0]]), int(x[met[0]] - k[met[0]])
        k = np.arange(-d, d + 1, 2)  # of the other corner: (n - x) - (m - y)
        o = k + size
        left, up = back[o - 1] - 1, back[o + 1]
        x = np.minimum(np.where(left >= 0, left, ever), np.where(up - (delta - k) >= 0, up, ever)) if d else np.full(1, n, np.int64)
        on = x <= n
        k, o, x = k[on], o[on], x[on]
        back[o] = x = _slide(a, b, x, x - (delta - k), -1)
        if delta % 2 == 0:
            met = np.flatnonzero(x <= front[delta - k + size])
            if len(met):
                return int(x[met[0]]), int(x[met[0]] - (delta - k[met[0]]))
    raise AssertionError("two paths meet at half the length of a script")


def matches(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of the lines that stay, in order: a longest common subsequence."""
    a, b = _coded(old, new)
    found, stack = [], [(0, len(a), 0, len(b))]
    while stack:
        lo, hi, low, high = stack.pop()
        same = _prefix(a[lo:hi], b[low:high])
        found += [(lo + i, low + i) for i in range(same)]
        lo, low = lo + same, low + same
        same = _prefix(a[lo:hi][::-1], b[low:high][::-1])
        found += [(hi - 1 - i, high - 1 - i) for i in range(same)]
        hi, high = hi - same, high - same
        if lo < hi and low < high:
            x, y = _middle(a[lo:hi], b[low:high])
            stack += [(lo, lo + x, low, low + y), (lo + x, hi, low + y, high)]
    return sorted(found)


def _prefix(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    unequal = np.flatnonzero(a[:n] != b[:n])
    return int(unequal[0]) if len(unequal) else n


def diff(old: str | None, new: str | None) -> list[dict]:
    """Lines of a diff: removed ones before added ones between the lines that stay; a line's end is a part of it."""
    before, after = ((x or "").replace("\\n", "\n") for x in (old, new))
    if not before.strip() and not after.strip():
        return []
    a, b = _lines(before), _lines(after)
    out, i, j = [], 0, 0
    row = lambda kind, line: {"type": kind, "text": line.removesuffix("\n")}
    for x, y in [*matches(a, b), (len(a), len(b))]:
        out += [row("remove", line) for line in a[i:x]] + [row("add", line) for line in b[j:y]]
        if x < len(a):
            out.append(row("context", a[x]))
        i, j = x + 1, y + 1
    return out


def _lines(text: str) -> list[str]:
    """Lines with their ends; only \\n ends a line."""
    lines = [x + "\n" for x in text.split("\n")]
    lines[-1] = lines[-1][:-1]
    return lines if lines[-1] else lines[:-1]


@F.pandas_udf(LINES)
def line_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """The diff of each pair of texts."""
    return pd.Series([diff(a, b) for a, b in zip(old, new)])


def block_label(path: Column) -> Column:
    """A file's name with its path behind it, where they differ."""
    trimmed = F.trim(path)
    name = F.substring_index(trimmed, "/", -1)
    return F.when(trimmed == "", "edit").when((name == "") | (name == trimmed), trimmed).otherwise(F.concat(name, F.lit(" · "), trimmed))
