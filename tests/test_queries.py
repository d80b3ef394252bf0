"""Every registered query against its SQL in DuckDB on the smallest tables."""

import pytest

from corpusloom.plans import registry
from tests import compare

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return compare.database(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    assert compare.difference(spark, db, registry.QUERIES[name], registry.ORACLE_SQL[name], SF_DIR) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
