"""The vector searches ask with every row of ``embeddings``."""

import datetime as dt

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from semcat.operators import topk
from semcat.registry.oracles import ORACLES
from semcat.registry.queries import QUERIES

SEARCHES = (
    "q_topk_batch", "q_topk_blocked", "q_collapse_hits", "q_collapse_again", "q_search_filtered", "q_search_by_key",
    "q_render", "q_render_calls",
)
IDS = [1, 2, 3, 7, 19, 20, 21, 39, 41, 50, 63, 100]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    n, day = len(IDS), dt.datetime(2024, 5, 1)
    vectors = np.random.default_rng(5).normal(size=(n, 64)).astype(np.float32)
    ids, ints = pa.array(IDS, pa.int64()), lambda values: pa.array(list(values), pa.int32())
    stamps = pa.array([day + dt.timedelta(hours=i) for i in range(n)], pa.timestamp("us"))
    given = {
        "embeddings": {"vec_id": ids, "embedding": pa.array(list(vectors), pa.list_(pa.float32())), "label": ints(i % 4 for i in range(n))},
        "documents": {"doc_id": ids, "text": [f"title {i}\nbody" for i in IDS], "lang": ["en"] * n, "source": ["src1"] * n},
        "labels": {"doc_id": ids, "quality": ints([1] * n), "toxic": ints([0] * n)},
        "orders": {"o_orderkey": ids, "o_orderdate": stamps},
        "events": {"event_id": ids, "ts": stamps},
    }
    for name, columns in given.items():
        pq.write_table(pa.table(columns), folder / f"{name}.parquet")
    return folder


@pytest.mark.parametrize("name", SEARCHES)
def test_every_vector_asks(spark, tables, name):
    found = QUERIES[name](spark, str(tables))
    assert {r["qid"] for r in found.select("qid").collect()} == set(map(str, IDS))
    duck = duckdb.connect()
    for path in tables.glob("*.parquet"):
        duck.execute(f"create view {path.stem} as select * from '{path}'")
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(map(repr, (tuple(r) for r in found.select(*names).collect()))) == sorted(map(repr, cursor.fetchall()))


def _points(spark, vectors):
    rows = [(f"p{i:04d}", 0, list(map(float, v))) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "uuid string, chunk_no int, vector array<float>")


def _hits(df):
    return sorted((r["qid"], r["rank"], r["uuid"], r["score"]) for r in df.collect())


def test_known_floors_keep_few_others_and_lose_none(spark, monkeypatch):
    """Blocks of queries with a first bar: the same hits as one batch, with ties, zeros and too few seeds."""
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(400, 6)).astype(np.float32)
    vectors[100:130], vectors[200:204] = vectors[0], 0
    points = _points(spark, vectors)
    queries = points.select(points["uuid"].alias("qid"), "vector")
    floors, given = [], topk._shipped
    for k in (5, 40):  # 40 seeds are more than a sixteenth of the points
        monkeypatch.undo()
        want = _hits(topk.top_k(points, queries, k))
        monkeypatch.setattr(topk, "_shipped", lambda s, part: floors.extend(part["floor"].to_pylist()) or given(s, part))
        floors.clear()
        assert _hits(topk.top_k(points, queries, k, broadcast_bytes=3000)) == want
        assert len(floors) == 400 and np.isfinite(floors).all() == (k == 5)
    monkeypatch.undo()
    kth = {q: s for q, rank, _, s in _hits(topk.top_k(points, queries, 5)) if rank == 5}
    unit = topk._unit(vectors)
    bars = topk._floors(vectors, unit[np.linalg.norm(vectors, axis=1) > 0][:60], 5)
    assert all(bars[i] <= kth[f"p{i:04d}"] + 1e-5 for i in range(400))


def test_floors_leave_less_to_score_again(monkeypatch):
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(8000, 8)).astype(np.float32)
    queries, seeds = vectors[:200], topk._unit(vectors[::8])
    scored, score = [], topk._exact_scores
    monkeypatch.setattr(topk, "_exact_scores", lambda q, p, qi, pi: scored.append(len(qi)) or score(q, p, qi, pi))
    names = [str(i) for i in range(200)]

    def scan(first, packed):
        scored.clear()
        batches = []
        for at in range(0, 8000, 500):
            column = pa.array(list(vectors[at : at + 500]), pa.list_(pa.float32()))
            column = topk._packed(column) if packed else column
            ids = pa.array([f"p{i:04d}" for i in range(at, at + 500)])
            batches.append(pa.RecordBatch.from_pydict({"uuid": ids, "chunk_no": pa.array([0] * 500, pa.int32()), "vector": column}))
        hits = topk._scan(names, queries, iter(batches), 10, first)
        return sorted(map(tuple, (r.values() for r in hits.to_pylist()))), sum(scored)

    plain, without = scan(None, False)
    packed, again = scan(topk._floors(queries, seeds, 10), True)
    best = lambda hits: {q: sorted((-r[-1], r[1]) for r in hits if r[0] == q)[:10] for q in names}
    assert best(plain) == best(packed) and again < 0.6 * without


def test_packed_vectors_read_back(spark):
    lists = pa.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], pa.list_(pa.float32()))
    packed = topk._packed(lists)
    assert topk._rows(packed).tolist() == [[1, 2], [3, 4], [5, 6]] and topk._rows(packed.slice(1, 2)).tolist() == [[3, 4], [5, 6]]
    with pytest.raises(ValueError, match="null"):
        topk._packed(pa.array([[1.0], None], pa.list_(pa.float32())))
    with pytest.raises(ValueError, match="length"):
        topk._rows(pa.array([b"\0" * 4, b"\0" * 12], pa.binary()))
    marks = np.zeros(1003, bool)
    marks[[0, 7, 8, 500, 999, 1000, 1002]] = True
    assert topk._places(marks).tolist() == [0, 7, 8, 500, 999, 1000, 1002]
