"""Every registered query against DuckDB on the smallest tables."""

import pytest
from harness import compare, duck

from bitextra.plans import load_registry

REGISTRY = load_registry()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(name, spark, sf_dir, con):
    fn, sql = REGISTRY[name]
    ok, message = compare(spark, con, sf_dir, name, fn, sql)
    assert ok, message


def test_entry_runs(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert "critical" in df.columns and df.count() > 0
