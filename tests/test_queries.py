"""Every query of the reference's own workload against its SQL."""

import pytest

from pixelweir.jobs import registry
from tests.conftest import rows_of


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert rows_of(registry.QUERIES[name](spark, sf_dir).toPandas()) == rows_of(duck.execute(registry.ORACLE_SQL[name]).df())


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
