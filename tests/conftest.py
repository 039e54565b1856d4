import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in sorted(os.listdir(data)):
        path = f"{data}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.fixture(scope="session")
def same():
    """Compare two pandas frames without regard to the order of rows and columns."""

    def normal(df):
        df = df[sorted(df.columns)].copy()
        for c in df.columns:
            if df[c].dtype.kind == "f":
                df[c] = df[c].round(6) + 0.0
        df = df.astype(str).replace({"None": "NULL", "nan": "NULL", "<NA>": "NULL", "NaT": "NULL"})
        return df.sort_values(list(df.columns)).reset_index(drop=True)

    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        a, b = normal(a), normal(b)
        assert len(a) == len(b)
        assert a.equals(b), a.merge(b, how="outer", indicator=True).query("_merge != 'both'").head(6).to_string()

    return check
