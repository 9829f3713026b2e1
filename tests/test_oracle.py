"""Every query with a SQL twin gives the same rows as DuckDB."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, con, name):
    difference = compare(entry.queries()[name](spark, SF), entry.oracle_sql()[name], con)
    assert difference is None, difference


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
