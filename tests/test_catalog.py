"""Every catalog query with SQL must equal it on the smallest tables; the others must yield rows."""

import pytest
from compare import check, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    message, ok = check(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert ok, message


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["dimension", "item", "tp", "fp", "fn", "precision", "recall", "f1"]
    assert df.count() > 0
