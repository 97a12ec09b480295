"""Every registered query against its SQL on whole tables."""

import pytest
from conftest import SMALL
from oracle_check import compare, connect

from contextmill.plans.oracle import ORACLE
from contextmill.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in ORACLE:
        assert compare(df, con, ORACLE[name]) == ""
    assert df.limit(1).count() == 1


def test_every_query_has_its_sql():
    assert set(ORACLE) == set(QUERIES)


def test_the_sql_shares_nothing_with_the_engine():
    from contextmill.plans import oracle

    with open(oracle.__file__) as source:
        assert "contextmill" not in source.read()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
