"""SQLite tables as a Spark data source: rowid ranges are partitions, each read read-only by its own task.

spark.dataSource.register(SqliteSource); then spark.read.format("sqlite").schema(...)
.option("path", file).option("table", name).option("ranges", n).load(). The file must lie on storage that
all executors mount.

With .option("column", name).option("beginning", text) only rows whose column begins with the text are read. With
.option("push", "true") and spark.sql.python.filterPushdown.enabled comparisons, lists and beginnings in a filter become part of the SQL that each
task runs, too, and Spark tests what comes back again. Spark 4.1 plans such filters once for a loaded DataFrame, so one that
is filtered in two ways within a query must be loaded twice; the options have no such bound.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

COMPARISONS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: Values that SQLite compares as Spark does.
PLAIN = (int, str)


@dataclass
class RowRange(InputPartition):
    first: int
    last: int


def connect(path: str):
    import sqlite3

    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def column_names(path: str, table: str) -> set[str]:
    """Names of a table's columns; none where it is missing. SQLite takes unknown quoted names for texts, so ask first."""
    with connect(path) as db:
        return {row[1] for row in db.execute(f"PRAGMA table_info({quoted(table)})")}


def fingerprint(path: str) -> list[tuple[str, int, int]]:
    """Name, size and time of change of a database file and of its write-ahead log, which holds what isn't in the file yet."""
    found = [(suffix, os.stat(path + suffix)) for suffix in ("", "-wal") if os.path.exists(path + suffix)]
    return [(suffix, x.st_size, x.st_mtime_ns) for suffix, x in found]


def condition(f: Filter) -> tuple[str, list] | None:
    """SQL of a filter on one column with its parameters; None if it has none."""
    name = quoted(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
    value = getattr(f, "value", None)
    if name is None:
        return None
    if type(f) in COMPARISONS and isinstance(value, PLAIN) and not isinstance(value, bool):
        return f"{name} {COMPARISONS[type(f)]} ?", [value]
    if isinstance(f, In) and value and all(isinstance(v, PLAIN) and not isinstance(v, bool) for v in value):
        return f"{name} IN ({', '.join('?' * len(value))})", list(value)
    if isinstance(f, StringStartsWith) and value and ord(value[-1]) < 0xD7FF:
        return f"{name} >= ? AND {name} < ?", [value, value[:-1] + chr(ord(value[-1]) + 1)]
    return (f"{name} IS NOT NULL", []) if isinstance(f, IsNotNull) else None


class SqliteReader(DataSourceReader):
    def __init__(self, columns: list[str], options: dict[str, str]):
        self.columns, self.path, self.table, self.ranges = columns, options["path"], options["table"], int(options.get("ranges", 8))
        beginning = StringStartsWith((options.get("column", ""),), options.get("beginning", ""))
        self.given = [sql] if (sql := condition(beginning)) else []
        self.tests = self.given

    def sql(self, names: str) -> tuple[str, list]:
        """The statement of a task but for its rows, and its parameters."""
        tests = ["rowid BETWEEN ? AND ?", *(f"({test})" for test, _ in self.tests)]
        return f"SELECT {names} FROM {quoted(self.table)} WHERE {' AND '.join(tests)}", [v for _, values in self.tests for v in values]

    def partitions(self) -> list[RowRange]:
        tests = " AND ".join(f"({test})" for test, _ in self.tests) or "1"
        with connect(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)} WHERE {tests}", [v for _, values in self.tests for v in values]).fetchone()
        if low is None:
            return []
        step = -(-(high - low + 1) // self.ranges)
        return [RowRange(at, min(high, at + step - 1)) for at in range(low, high + 1, step)]

    def read(self, part: RowRange) -> Iterator[tuple]:
        statement, values = self.sql(", ".join(map(quoted, self.columns)))
        with connect(self.path) as db:
            yield from db.execute(statement, [part.first, part.last, *values])


class PushingReader(SqliteReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes over what SQL can test; all are handed back, so that Spark's own comparison decides."""
        self.tests = [*self.given, *(sql for f in filters if (sql := condition(f)))]
        yield from filters


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema) -> SqliteReader:
        reader = PushingReader if self.options.get("push", "").lower() == "true" else SqliteReader
        return reader(schema.fieldNames(), self.options)
