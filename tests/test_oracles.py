"""Every query that has SQL gives the same rows as DuckDB; the others run."""

import pytest
from conftest import DATA, same_rows

from graphloom import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    same_rows(spark, duck, name)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    df = registry.queries()[name](spark, f"{DATA}/sf0.001")
    assert len(set(df.columns)) == len(df.columns) and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
