"""Every registered query against its SQL check, and what its plan must not hold."""

from __future__ import annotations

import os
import re

import pytest
from compare import connect, difference

import __spark_entry__ as entry_points
from tallyfield.queries import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NO_SQL: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    if name in NO_SQL:
        assert df.count() > 0
        return
    assert difference(df, con, ORACLES[name]) is None


def test_every_query_has_a_check():
    assert set(QUERIES) - set(ORACLES) == NO_SQL
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_every_query_reads_the_tables():
    for name, sql in ORACLES.items():
        assert re.search(r"\b(lineitem|orders|customer|part|events|embeddings)\b", sql), name


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns[:3] == ["yr", "transect", "point"] and len(df.columns) == 33


def read_schemas(df, capsys) -> str:
    df.explain("formatted")
    return " ".join(re.findall(r"ReadSchema: struct<([^>]*)>", capsys.readouterr().out))


def test_scans_read_only_what_is_used(spark, capsys):
    used = read_schemas(QUERIES["distance_time_pivot"](spark, FOLDER), capsys)
    assert "l_quantity" in used and "l_extendedprice" not in used and "l_returnflag" not in used
    used = read_schemas(QUERIES["lookup_broadcast"](spark, FOLDER), capsys)
    assert "c_acctbal" in used and "c_name" not in used
    used = read_schemas(QUERIES["posterior_summary"](spark, FOLDER), capsys)
    assert "props" not in used


def test_filters_reach_the_scan(spark, capsys):
    QUERIES["masterlist_overlap"](spark, FOLDER).explain("formatted")
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)" in capsys.readouterr().out
