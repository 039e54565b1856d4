"""Every core query against its SQL, or at least to an end with rows."""

import pytest

from rillflow import catalog

NAMES = sorted(catalog.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, data, duck, same):
    got = catalog.queries()[name](spark, data).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql:
        same(got, duck.sql(sql).df())
    else:
        assert len(got) > 0


def test_sql_names_have_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
