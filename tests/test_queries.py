"""Every registered query of the model against its SQL."""

import pytest

from quaestor.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLES[name])


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(registry.ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() == 8
