"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from tidelark import registry

DATA = "/root/testdata/sf0.001"
#: Bench-sized text queries with more than a few seconds are run once here too.


@pytest.fixture(scope="module")
def database():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return "" if math.isnan(x) else f"{x:.6g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return "" if x is None else str(x)


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_rows_equal_the_sql(spark, database, name):
    df = registry.QUERIES[name](spark, DATA)
    expected = database.execute(registry.SQL[name])
    columns = [d[0] for d in expected.description]
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(expected.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_queries_without_sql_run(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
