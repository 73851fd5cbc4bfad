"""The registered queries against their SQL, and their columns."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from semcat.llm.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    1: "doc_id size source_size target taken", 2: "doc_id held_out score predicted",
    3: "doc_id held_out n_tokens n_known train_tokens base_score score", 4: "doc_id n_shingles component_id",
    5: "doc_id held_out lang_pred score", 6: "doc_id n_bytes n_tokens over_limit", 7: "doc_id item_id edits",
    8: "doc_id held_out score predicted", 9: "vec_id n_links component_id kept", 10: "doc_id n_bytes n_removed n_spans kept_sha256",
    11: "doc_id leaf subroot root proof_sha256 folded_root verified", 12: "word form root n n_near form_n", 13: "query_id rank vec_id score",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rounded(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(repr([rounded(r[c]) for c in columns]) for r in frame.collect())
    cursor = con.execute(ORACLES[name])
    order = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert got == sorted(repr([rounded(r[i]) for i in order]) for r in cursor.fetchall())


def test_all_operators_are_registered():
    names = entry_points.queries()
    assert "pipeline" in names
    for n in COLUMNS:
        assert [q for q in names if q.startswith(f"op{n}_")]


@pytest.mark.parametrize("n", [2, 3, 5, 6, 8])
def test_columns_and_rows(spark, n):
    name = next(q for q in QUERIES if q.startswith(f"op{n}_"))
    frame = QUERIES[name](spark, SF)
    assert set(COLUMNS[n].split()) <= set(frame.columns)
    assert frame.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


TYPES = {
    9: {"n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    10: {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    11: {"doc_id": "bigint", "folded_root": "string", "verified": "boolean"},
    12: {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
    13: {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
}


@pytest.mark.parametrize("n", sorted(TYPES))
def test_types(spark, n):
    frame = QUERIES[next(q for q in QUERIES if q.startswith(f"op{n}_"))](spark, SF)
    assert set(COLUMNS[n].split()) <= set(frame.columns)
    assert TYPES[n].items() <= dict(frame.dtypes).items()
