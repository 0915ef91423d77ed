import os
import sys
import tempfile

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="threadloom-tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    return connection


def plain(value):
    return int(value) if type(value).__name__ == "Decimal" and value == int(value) else value


@pytest.fixture(scope="session")
def same_rows(duck):
    """Compares a DataFrame with a DuckDB query as multisets of rows, columns by name."""

    def compare(df, sql):
        expected = duck.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(expected.columns)
        got = sorted(repr(tuple(plain(row[c]) for c in columns)) for row in df.collect())
        order = [expected.columns.index(c) for c in columns]
        assert got == sorted(repr(tuple(plain(row[i]) for i in order)) for row in expected.fetchall())

    return compare
