"""One session for all tests, and DuckDB beside it."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """compare(query, sql, folder): the rows of both, columns in order of name, as sorted texts."""
    import duckdb

    def run(query, sql, folder):
        con = duckdb.connect()
        for f in os.listdir(folder):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
        df = query(spark, folder)
        names = sorted(df.columns)
        got = sorted(repr(tuple(r)) for r in df.select(*[f"`{c}`" for c in names]).collect())
        cursor = con.execute(sql)
        theirs = [c[0] for c in cursor.description]
        assert sorted(theirs) == names
        place = [theirs.index(c) for c in names]
        want = sorted(repr(tuple(r[i] for i in place)) for r in cursor.fetchall())
        return got, want

    return run
