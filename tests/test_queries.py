"""Every registered query of the library against its SQL, and the driver contract."""

import pytest

from creditlake.plans.registry import QUERIES
from tests.oracle import agrees


@pytest.mark.parametrize("name", [k for k, q in QUERIES.items() if q.sql])
def test_query_agrees_with_sql(spark, sf, name):
    agrees(QUERIES[name].run(spark, sf), QUERIES[name].sql, sf)


@pytest.mark.parametrize("name", [k for k, q in QUERIES.items() if not q.sql])
def test_query_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name].run(spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
