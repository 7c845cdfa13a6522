"""Every registered query that SQL can express gives the rows of its DuckDB equivalent."""

import pytest
from compare import connect, differs
from tidemark import catalogue

import __spark_entry__ as entry


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, small, name):
    assert differs(entry.queries()[name](spark, small), entry.oracle_sql()[name], connect(small)) is None


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, small, name):
    assert entry.queries()[name](spark, small).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
