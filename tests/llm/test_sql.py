"""Queries that SQL can express, against DuckDB."""

import pytest

from agorametrics.llm import queries


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(str(row[i]) for i in order) for row in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, sf, name):
    df = queries.QUERIES[name](spark, sf)
    result = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.collect(), df.columns) == plain(result.fetchall(), columns)
