import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
DATA = os.environ.get("QUERN_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import glob

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(table):
    """Rows of an Arrow table with columns by name, floats rounded, in order."""
    names = sorted(table.schema.names)
    plain = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(plain(r[c]) for c in names) for r in table.to_pylist())


@pytest.fixture(scope="session")
def same(spark, duck, data):
    """Whether a query's rows and DuckDB's are the same."""

    def check(name: str, fn, sql: str) -> None:
        ours, theirs = fn(spark, data).toArrow(), duck.sql(sql).to_arrow_table()
        assert sorted(ours.schema.names) == sorted(theirs.schema.names), name
        assert rows_of(ours) == rows_of(theirs), name

    return check
