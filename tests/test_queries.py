"""Every registered speaker-verification query against its SQL, and the contract of the entry module."""

import pytest

import __spark_entry__ as entry
from voicegrid.plans import catalogue

SQL = sorted(catalogue.oracle_sql())


@pytest.mark.parametrize("name", SQL)
def test_equals_sql(compare, name):
    assert compare(name) == [0, 0]


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_rows_only(spark, name):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    (row,) = entry.entry(spark).collect()
    assert 0 <= row["eer"] <= 1 and 0 <= row["threshold"] < 1


def test_sql_is_of_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
