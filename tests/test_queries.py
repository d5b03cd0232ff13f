"""Every registered query against its SQL on the same tables."""

import pytest
from conftest import rows_of

from lumenfold.plans.registry import everything

QUERIES, ORACLES = everything()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    found = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        expected = duck.execute(ORACLES[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows_of(found) == rows_of(expected)
    else:
        assert len(found)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
