"""Every query against its SQL, and the shape of its plan."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from postweir.plans import catalog
from tools.compare import connect, rows_of

SF = "/root/testdata/sf0.001"
QUERIES = {name: query for name, query in contract.queries().items() if name in catalog.queries()}
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, cursor.fetchall())


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracles())


def test_entry(spark):
    assert contract.entry(spark).columns == ["id", "num_replies", "num_quotes", "num_retweets"]
