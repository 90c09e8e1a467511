"""Every registered query against its check SQL (CHECK_SF picks the size, 0.001 by default)."""

import pytest
from check import duck, duck_rows, spark_rows

from gatewatch.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    got = spark_rows(df)
    if name not in ORACLES:
        assert df.columns
        return
    want, cols = duck_rows(con, ORACLES[name])
    assert sorted(df.columns) == cols
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["remote_addr", "verdict", "n"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
