"""Every query against DuckDB on the smallest tables; those without SQL give rows of a stable schema."""

import pytest

from quern.queries import all_queries, all_sql

QUERIES, SQL = all_queries(), all_sql()
MAY_BE_EMPTY = {"UR10", "TX2", "ST5"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_duckdb(name, same):
    same(name, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(name, spark, data):
    rows = QUERIES[name](spark, data)
    assert rows.columns and (rows.count() > 0 or name in MAY_BE_EMPTY)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_the_training_data_operators(tmp_path, data):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "quern"), tmp_path / "quern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and not any(n.startswith('op') for n in q), len(q); e.oracle_sql()"
    run = f"; from pyspark.sql import SparkSession as S; s = S.builder.master('local[4]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '4').getOrCreate(); assert all(q[n](s, {data!r}).count() for n in ('search', 'AG16', 'UR3', 'GR5', 'SRC7', 'ST4'))"
    subprocess.run([sys.executable, "-c", code + run], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


@pytest.mark.parametrize("name", ["ST1", "ST7"])
def test_streams_of_tables_in_several_files(name, spark, duck, data, tmp_path):
    import os

    from tests.conftest import rows_of

    for table in ("documents", "pages"):
        spark.read.parquet(f"{data}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert len(os.listdir(tmp_path / "pages.parquet")) > 3
    assert rows_of(QUERIES[name](spark, str(tmp_path)).toArrow()) == rows_of(duck.sql(SQL[name]).to_arrow_table())
