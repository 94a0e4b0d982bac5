"""Every query with SQL agrees with DuckDB on the small tables."""

import pytest
from oracle import compare

from watchtide.plans.all import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, name):
    compare(spark, sf, QUERIES[name], ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(ORACLES) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())
