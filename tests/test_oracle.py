"""Every query with SQL equals DuckDB on the same tables; the others run."""

import pytest

from codestrata.plans import registry
from tests.conftest import SF, assert_same

SQL = registry.oracle_sql()
HEAVY = {"graph_components", "graph_recursive", "graph_closure"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    assert_same(registry.queries()[name](spark, SF), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
