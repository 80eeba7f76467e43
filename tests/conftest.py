import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def agrees(spark, data):
    """Compares a query with its SQL over the smallest tables."""
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(data):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{data}/{t}'")

    def norm(v):
        if isinstance(v, float):
            return round(v, 6)
        return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v

    def check(queries, sql, name):
        got = queries[name](spark, data)
        want = con.sql(sql[name]).to_arrow_table()
        assert sorted(got.columns) == sorted(want.column_names)
        cols = sorted(got.columns)
        rows = lambda x: sorted((tuple(norm(r[c]) for c in cols) for r in x), key=repr)
        assert rows(got.toArrow().to_pylist()) == rows(want.to_pylist())

    return check
