"""One session for all tests, and DuckDB over the same tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(f"{DATA}/sf0.001"):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/sf0.001/{f}'")
    return c


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(v):
        return round(float(v), 6) if isinstance(v, float) else v

    return sorted(columns), sorted(repr(tuple(plain(r[k]) for k in order)) for r in rows)


def same_rows(spark, duck, name, sf="sf0.001"):
    import __spark_entry__ as e

    df = e.queries()[name](spark, f"{DATA}/{sf}")
    theirs = duck.sql(e.oracle_sql()[name])
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert mine == rows_of(theirs.columns, theirs.fetchall())
