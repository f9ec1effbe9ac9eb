"""Every query with SQL gives the SQL's rows; the others run and have rows."""

import parity
import pytest

from inkframe.plans import queries as q


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_same_rows(spark, data, name):
    assert parity.differences(q.QUERIES[name](spark, data).toPandas(), parity.oracle(data, q.SQL[name])) == []


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_runs(spark, data, name):
    assert q.QUERIES[name](spark, data).limit(5).count() > 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
