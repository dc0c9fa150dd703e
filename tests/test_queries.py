"""Every registered query outside the optional parts against its SQL."""

import pytest
from support import same

from rootflow import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(name, spark, sf_dir, duck):
    same(QUERIES[name](spark, sf_dir), duck, SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["c_name", "total", "place"]
