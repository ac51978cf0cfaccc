"""What is shuffled: each table once by its key, whatever else follows."""

from __future__ import annotations

import pytest

from loomspark.functions.parts import with_part
from loomspark.operators import builder, transcript
from loomspark.plans.edits import QUERIES
from loomspark.sources import pi


@pytest.fixture
def no_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_branch_entries_are_shuffled_by_file_alone(no_broadcasts, tmp_path):
    (tmp_path / "a_1.jsonl").write_text('{"type": "session", "id": "h"}\n{"type": "message", "id": "x", "message": {"role": "user", "content": "hi"}}\n')
    entries = pi.read_entries(no_broadcasts, str(tmp_path))
    branch = pi.branches(entries)
    assert shuffles(branch) == 3  # the entries, their ids, and the depths of each file
    shown = pi.transcripts(branch)
    assert shuffles(shown) == shuffles(pi.tool_calls(branch, shown)) == 3
    assert shuffles(pi.heads(entries, branch, shown)) == 4
    assert [(r.ref, r.id, r.depth) for r in branch.collect()] == [("1", "x", 0)]


def test_depths_count_the_last_of_repeated_ids(spark):
    rows = [("s", 0, "a", None), ("s", 1, "b", "a"), ("s", 2, "b", "c"), ("s", 3, "c", "a"), ("s", 4, "d", "b"), ("t", 0, "x", "y"), ("t", 1, "y", "x"), ("u", 0, "z", "gone")]
    df = spark.createDataFrame(rows, "ref string, place int, id string, parent_id string").repartition("ref")
    got = {r.ref: r.depths for r in transcript.branch_depths(df, "place").collect()}
    assert got == {"s": [0, None, 2, 1, 3], "t": [0, 1], "u": [0]}


def test_parts_are_made_once(spark):
    rows = spark.createDataFrame([("m", '{"type": "text", "text": "<system-reminder>x</system-reminder>hi "}'), ("n", "{}")], "id string, data string")
    got = with_part(rows, "p")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1 and "Filter isnotnull(p" in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.id, r.p.text) for r in got.collect()] == [("m", "hi")]


def test_assigned_events_are_read_by_column(spark):
    said = spark.createDataFrame([("r", 1, "message", "user", "e")], "ref string, line long, kind string, role string, id string")
    rows = builder.assigned(builder.events_of(said)).select("ref", "message")
    assert "FileScan parquet" in rows._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in rows.collect()] == [("r", 0)]


def test_programs_are_read_once(spark):
    rows = QUERIES["codex_exec_calls"](spark, "/root/testdata/sf0.001")
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert rows.where("name is null or target is null").isEmpty()
