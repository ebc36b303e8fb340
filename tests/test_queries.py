"""Every registered query against its SQL in DuckDB, and what its plan must not hold."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
NO_SQL: set[str] = set()
# Tested on their own, next to the operators.
TEXT_QUERIES = {name for name in entry.queries() if re.match(r"op\d+_|pipeline$", name)}


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    return None if value is None else str(value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain_rows = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(plain_rows, key=lambda row: tuple(v or "" for v in row))


def test_all_but_the_named_queries_have_sql():
    assert set(entry.queries()) - set(entry.oracle_sql()) - TEXT_QUERIES == NO_SQL


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - TEXT_QUERIES))
def test_query_equals_sql(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [column[0] for column in result.description]
    assert sorted(df.columns) == sorted(columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_query_without_sql_has_rows(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf):
    queries = entry.queries()
    board = plan_of(queries["leaderboard_all"](spark, sf))
    assert "partial_sum" in board
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in board
    # Names are looked up for the top list only, where the members are read.
    top = plan_of(queries["leaderboard_top10"](spark, sf))
    assert "LeftSemi" in top and "hashpartitioning" not in top
    exports = plan_of(queries["trade_exports_top5"](spark, sf))
    assert "WindowGroupLimit" in exports and "Partial" in exports
    assert "TakeOrderedAndProject" in plan_of(queries["gdp_24"](spark, sf))
    assert "TakeOrderedAndProject" in plan_of(queries["random_quote"](spark, sf))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
