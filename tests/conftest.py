import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def duck(sf_dir: str, sql: str) -> list[tuple]:
    """Rows of SQL over the tables, in text order."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    frame = con.execute(sql).df()
    return sorted(map(str, frame[sorted(frame.columns)].itertuples(index=False, name=None)))


def sparked(df) -> list[tuple]:
    frame = df.toPandas()
    return sorted(map(str, frame[sorted(frame.columns)].itertuples(index=False, name=None)))
