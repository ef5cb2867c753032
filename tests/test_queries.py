"""Every query of the catalog engine against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.conftest import table_rows
from vistaquery.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf, con):
    got, want = QUERIES[name](spark, sf).toArrow(), con.sql(ORACLES[name]).to_arrow_table()
    assert table_rows(got) == table_rows(want)


def test_rows_only_queries(spark, sf):
    assert QUERIES["gallery_random"](spark, sf).count() == 48
    assert QUERIES["random_sample"](spark, sf).count() == 100


def test_entry_and_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
