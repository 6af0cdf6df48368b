import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the tables of the smallest scale as views."""
    import duckdb

    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
    connection = duckdb.connect()
    for name in names.split():
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/sf0.001/{name}.parquet'")
    return connection


@pytest.fixture(scope="session")
def same(spark, duck):
    """Assert that a query and its SQL have the same columns and rows."""

    def norm(v):
        return str(round(v, 6)) if isinstance(v, float) else str(v)

    def check(query, sql, sf="sf0.001"):
        df, answer = query(spark, f"{DATA}/{sf}"), duck.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(answer.columns)
        at = [answer.columns.index(c) for c in columns]
        got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
        assert got == sorted(tuple(norm(r[i]) for i in at) for r in answer.fetchall())

    return check
