"""Every review query against its DuckDB counterpart, and those without one for running at all."""

import pytest

from glossator.plans import registry
from tests.helpers import SF, duck_rows, rows_of


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, name):
    df = registry.QUERIES[name](spark, SF)
    columns, expected = duck_rows(registry.SQL[name])
    assert sorted(df.columns) == columns
    assert rows_of(df) == expected


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_rows_without_counterpart(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
