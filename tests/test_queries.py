import pytest

import __spark_entry__ as entry_module
from kindred.plans.catalogue import ORACLE_SQL, QUERIES
from oracle import check


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_sql(spark, sf, name):
    check(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_without_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["query_id", "image_id", "pid", "votes", "score", "rank"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
