"""Every registered query against its SQL on the smallest data."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_points  # noqa: E402

from semcat.registry.oracles import ORACLES  # noqa: E402
from semcat.registry.queries import QUERIES  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def rounded(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    frame = entry_points.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(repr([rounded(r[c]) for c in columns]) for r in frame.collect())
    sql = entry_points.oracle_sql()[name]
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(repr([rounded(r[i]) for i in order]) for r in cursor.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert frame.columns[:3] == ["qid", "rank", "project_id"] and frame.count() > 0
