import os
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}" + ("/*.parquet" if os.path.isdir(f"{SF}/{name}") else "")
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="session")
def sf():
    return SF


def canonical(frame):
    """Rows in an order of their own, with columns by name and numbers to nine digits."""

    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or not isinstance(v, list) and pd.isna(v):
            return "null"
        return f"{v:.9g}" if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(frame.columns), sorted(tuple(map(plain, row)) for row in frame.itertuples(index=False))
