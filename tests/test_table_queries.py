"""Every registered query against its SQL, on whole tables at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from deckspark.plans.oracle import ORACLE_SQL
from deckspark.plans.table_queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, database, name):
    got = entry_points.queries()[name](spark, SF)
    columns = sorted(got.columns)
    wanted = database.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    assert columns == sorted(names)
    expected = ordered(tuple(row[names.index(c)] for c in columns) for row in wanted.fetchall())
    assert ordered(tuple(row[c] for c in columns) for row in got.collect()) == expected


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLE_SQL) <= set(entry_points.oracle_sql())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
