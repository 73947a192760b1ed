"""Every registered query against its SQL, on the smallest tables."""

import pytest
from oracle_compare import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    difference, _ = compare(df, duck, sql)
    assert difference is None


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    flagship = entry.entry(spark)
    assert {"match_id", "journey_sk", "origin_city", "nb_stops"} <= set(flagship.columns)
    assert flagship.count() > 0
