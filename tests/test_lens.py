"""The lens: what its tables are made from, against DuckDB."""

from __future__ import annotations

from datetime import datetime

import duckdb
import pytest

from loomspark.operators import closure
from loomspark.plans import lens
from loomspark.plans.registry import QUERIES

TABLES = "/root/testdata/sf0.001"


@pytest.fixture
def odd_tables(tmp_path):
    """A few orders whose items name a missing part, a part twice, or no order."""
    at = datetime(1997, 1, 2)
    made = duckdb.connect()
    made.execute("CREATE TABLE lineitem AS SELECT * FROM (SELECT i // 4 AS l_orderkey, i % 3 AS l_partkey, i AS l_suppkey, (i % 7 + 1)::INT AS l_linenumber, i::DOUBLE AS l_quantity, i * 10.5 AS l_extendedprice, 0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, 'A' AS l_returnflag, 'F' AS l_linestatus, $1::TIMESTAMP AS l_shipdate FROM range(40) r(i))", [at])
    made.execute("CREATE TABLE part AS SELECT k::BIGINT AS p_partkey, 'red ring' AS p_name, 'Brand#' || n AS p_brand, 'SMALL' AS p_type, 1 AS p_size, 1.0::DOUBLE AS p_retailprice FROM (VALUES (0, 1), (1, 2), (1, 3)) v(k, n)")
    made.execute("CREATE TABLE orders AS SELECT k AS o_orderkey, k % 2 AS o_custkey, 'F' AS o_orderstatus, 1.5::DOUBLE AS o_totalprice, $1::TIMESTAMP AS o_orderdate, '5-LOW' AS o_orderpriority FROM range(8) r(k)", [at])
    made.execute("CREATE TABLE customer AS SELECT k AS c_custkey, 'c' AS c_name, 0::INT AS c_nationkey, 0.0::DOUBLE AS c_acctbal, 'M' AS c_mktsegment FROM range(2) r(k)")
    made.execute("CREATE TABLE nation AS SELECT 0::INT AS n_nationkey, 'N' AS n_name, 0::INT AS n_regionkey")
    for name in ("lineitem", "part", "orders", "customer", "nation"):
        made.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    return made, str(tmp_path)


def test_items_without_one_part_each(spark, odd_tables):
    made, folder = odd_tables
    parts = (*lens.BASE, lens.FACTS_SQL)
    for rows, source, columns in (
        (lens.messages(spark, folder), "messages", "session_id, message_index, role, model, tool, path, time_created, time_completed, input, cost"),
        (lens.facts(spark, folder), "facts", "ref, message_index, model, at_ms, input, cost"),
        (lens.sessions(spark, folder), "sessions", "ref, parent_ref, title, directory, message_count, input_tokens, total_tokens, total_cost, activity"),
    ):
        want = made.execute(lens.with_sql(*parts) + f"SELECT {columns} FROM {source}").fetchall()
        key = lambda r: str(r)
        assert sorted(map(tuple, rows.selectExpr(*columns.split(", ")).collect()), key=key) == sorted(want, key=key)


def test_heads_need_no_messages(spark):
    kept = lambda: {k[2] for k in lens._KEPT if k[1] == TABLES}
    before = dict(lens._KEPT)
    lens._KEPT.clear()
    try:
        for name in ("stale_tags", "mount_state", "timeline_pages", "cursor_pages"):
            QUERIES[name](spark, TABLES).count()
        assert not kept() & {"messages", "sessions"}
        QUERIES["inclusive_stats"](spark, TABLES).count()
        assert "sessions" in kept() and "messages" not in kept()
    finally:
        lens._KEPT.update(before)


def test_curve_needs_no_usage(spark):
    before = dict(lens._KEPT)
    lens._KEPT.clear()
    try:
        assert QUERIES["cost_curve"](spark, TABLES).count() == 1
        assert not any(k[2].startswith("usage") for k in lens._KEPT)
    finally:
        lens._KEPT.update(before)


def test_mount_joins_only_open_sessions(spark, monkeypatch):
    """A round writes the sessions whose top isn't found yet, not all."""
    sizes, write = [], closure.written
    monkeypatch.setattr(closure, "written", lambda df, name: (out := write(df, name), sizes.append(out.count()))[0])
    rows = [(f"r{i}", None) for i in range(50)] + [(f"c{i}", f"r{i}") for i in range(10)] + [("d", "c0"), ("x", "y"), ("y", "x"), ("o", "gone")]
    got = {r[0]: tuple(r[1:]) for r in closure.mount(spark.createDataFrame(rows, "ref string, parent_ref string")).collect()}
    assert len(got) == len(rows) and got["d"] == ("r0", 2, "mounted") and got["x"] == ("x", 0, "orphan") and got["o"] == ("o", 0, "orphan") and got["r1"] == ("r1", 0, "root")
    assert sizes == [14, 13, 3, 2]
