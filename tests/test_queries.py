"""Every registered query of the core package against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from lorespark import plans


@pytest.fixture(scope="module")
def database(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(plans.all_queries()))
def test_query(spark, sf_dir, database, name):
    run, sql = plans.all_queries()[name]
    frame = run(spark, sf_dir)
    columns = sorted(frame.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    if sql is None:
        # Repeated runs agree, and there is something to agree on.
        again = run(spark, sf_dir)
        assert found and found == sorted((tuple(plain(r[c]) for c in columns) for r in again.collect()), key=repr)
        return
    cursor = database.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert found == wanted


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.all_queries()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_core_does_not_need_the_optional_part():
    import pathlib

    root = pathlib.Path(plans.__file__).parent.parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "lorespark.llm" not in path.read_text(), path
