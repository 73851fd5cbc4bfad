"""Sources, sinks and the vector store on storage."""

import io
import json
import os
import threading
import zipfile
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semcat.schema import CALL_SCHEMA, ORDER_COLUMN
from semcat.sources import catalogue, pages, paths, snapshots
from semcat.sources import store as store_module
from semcat.sources.store import CommitConflict, VectorStore

DUMP = T.StructType([T.StructField("id_hash", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])


def write_zip(path, rows, member="data.parquet"):
    pq.write_table(pa.Table.from_pylist(rows), f"{path}.parquet")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("readme.txt", "x")
        z.write(f"{path}.parquet", member)


def test_archives(spark, tmp_path):
    for name in ("b", "a"):
        write_zip(tmp_path / f"{name}.zip", [{"id_hash": f"{name}{i}", "tags": ["t", None], "unused": i} for i in range(5)])
    one = catalogue.read_archives(spark, str(tmp_path / "b.zip"), DUMP)
    assert [r["id_hash"] for r in one.orderBy(ORDER_COLUMN).collect()] == [f"b{i}" for i in range(5)]
    both = catalogue.read_archives(spark, str(tmp_path / "*.zip"), DUMP)
    assert [r["id_hash"] for r in both.orderBy(ORDER_COLUMN).collect()] == [f"{n}{i}" for n in "ab" for i in range(5)]
    assert both.first()["tags"] == ["t", None]


def test_row_order_of_plain_tables(spark, tmp_path):
    for name, first in (("b", 10), ("a c", 0)):
        pq.write_table(pa.Table.from_pylist([{"id_hash": str(first + i)} for i in range(5)]), tmp_path / f"{name}.parquet")
    rows = catalogue.read_ordered(spark, str(tmp_path)).orderBy(ORDER_COLUMN).collect()
    assert [r["id_hash"] for r in rows] == [str(i) for i in (0, 1, 2, 3, 4, 10, 11, 12, 13, 14)]


def test_archive_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        catalogue.read_archives(spark, str(tmp_path / "none.zip"), DUMP)
    write_zip(tmp_path / "x.zip", [{"id_hash": "1", "tags": []}], member="other.parquet")
    with pytest.raises(Exception, match="readme.txt.*other.parquet"):
        catalogue.read_archives(spark, str(tmp_path / "x.zip"), DUMP).collect()


def page_body(*ids):
    return json.dumps({"results": [{"metadata": {"identifier": i}} for i in ids]})


def landed(spark, tmp_path, bodies):
    for number, body in bodies.items():
        (tmp_path / f"page_{number:04d}.json").write_text(body, encoding="utf-8")
    return pages.parsed_pages(pages.read_page_files(spark, str(tmp_path)))


def item_ids(parsed):
    rows = pages.page_items(parsed).orderBy(ORDER_COLUMN).collect()
    return [json.loads(r["item"])["metadata"]["identifier"] for r in rows]


def test_pages_stop_at_the_first_empty_one(spark, tmp_path):
    parsed = landed(spark, tmp_path, {1: page_body("ä", "b"), 2: page_body("c"), 3: page_body(), 4: page_body("d")})
    assert item_ids(pages.before_first_empty(parsed)) == ["ä", "b", "c"]
    assert item_ids(pages.before_first_empty(parsed, max_pages=1)) == ["ä", "b"]


def test_page_without_results_is_empty(spark, tmp_path):
    parsed = landed(spark, tmp_path, {1: page_body("a"), 2: '{"total": 0}', 3: page_body("b")})
    assert item_ids(pages.before_first_empty(parsed)) == ["a"]


def test_broken_page_is_an_error(spark, tmp_path):
    parsed = landed(spark, tmp_path, {1: page_body("a"), 2: '{"results": ['})
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        item_ids(pages.before_first_empty(parsed))


def test_no_empty_page_keeps_all(spark, tmp_path):
    parsed = landed(spark, tmp_path, {n: page_body(str(n)) for n in range(1, 4)})
    assert item_ids(pages.before_first_empty(parsed, max_pages=None)) == ["1", "2", "3"]


def test_pages_per_line(spark, tmp_path):
    lines = [json.dumps({"page": n, "results": [{"metadata": {"identifier": f"i{n}"}}]}) for n in (2, 1, 12)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    parsed = pages.parsed_pages(pages.read_page_files(spark, str(tmp_path), per_line=True))
    assert item_ids(parsed) == ["i1", "i2", "i12"]


def test_requested_items(spark):
    def item(kind, status, language):
        return json.dumps({"language": language, "metadata": {"type": kind, "status": status}})

    rows = [
        item("1", "31094501", "en"), item(["9", "2"], ["31094503"], "en"), item("3", "31094501", "en"),
        item("1", "5", "en"), item("1", "31094501", "de"), item(None, None, None),
    ]
    frame = spark.createDataFrame(list(enumerate(rows)), "n int, item string")
    assert sorted(r["n"] for r in pages.requested_items(frame).collect()) == [0, 1]


def calls(spark, *ids):
    return spark.createDataFrame([tuple([i, "Tä\n"] + [None] * 8 + [["k", "l"], None, []]) for i in ids], CALL_SCHEMA)


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "cache")

    def broken():
        raise ConnectionError("down")

    with pytest.raises(ConnectionError):
        snapshots.fresh_or_cached_calls(spark, broken, root, "b0")
    fresh = snapshots.fresh_or_cached_calls(spark, lambda: calls(spark, "1", "2"), root, "b1")
    assert sorted(r["id"] for r in fresh.collect()) == ["1", "2"]
    # A batch that fails while it is written, here on its second file, is not a good snapshot.
    snapshots.write_calls(calls(spark, "3").repartition(1), str(tmp_path / "landed"))
    (tmp_path / "landed" / "broken.json.gz").write_bytes(b"no gzip at all")
    failing = lambda: snapshots.read_calls(spark, str(tmp_path / "landed"))
    cached = snapshots.fresh_or_cached_calls(spark, failing, root, "b2")
    assert sorted(r["id"] for r in cached.collect()) == ["1", "2"]
    # The same batch failing again must not harm the good one.
    rerun = snapshots.fresh_or_cached_calls(spark, failing, root, "b1")
    assert sorted(r["id"] for r in rerun.collect()) == ["1", "2"]
    with pytest.raises(AttributeError):
        snapshots.fresh_or_cached_calls(spark, lambda: None, root, "b3")
    again = snapshots.fresh_or_cached_calls(spark, lambda: calls(spark, "4"), root, "b3")
    assert [r["id"] for r in again.collect()] == ["4"]
    first = cached.first()
    assert first["title"] == "Tä\n" and first["keywords"] == ["k", "l"] and first["metadata_languages"] == []


def test_array_document(spark, tmp_path):
    rows = [{"id": "1", "title": "ä", "keywords": ["k"]}, {"id": "2", "summary": "s"}]
    (tmp_path / "calls.json").write_text(json.dumps(rows, ensure_ascii=False, indent=2), encoding="utf-8")
    got = snapshots.read_calls(spark, str(tmp_path / "calls.json"), array_document=True)
    assert sorted((r["id"], r["title"], r["summary"]) for r in got.collect()) == [("1", "ä", None), ("2", None, "s")]


def test_facet_files(spark, tmp_path):
    values = spark.createDataFrame([("a", "b c"), ("a", "Ä"), ("a", "B"), ("x", "y")], "column string, value string")
    catalogue.write_facets(values, str(tmp_path), ("a", "x"), "p_")
    text = "".join(f.read_text(encoding="utf-8") for f in sorted((tmp_path / "p_a.txt").glob("part-*")))
    assert text == "B\nb c\nÄ\n"
    assert [r["value"] for r in catalogue.read_facet_options(spark, str(tmp_path / "p_x.txt")).collect()] == ["y"]
    (tmp_path / "raw.txt").write_text(" a \n\n\t\nb\n")
    assert [r["value"] for r in catalogue.read_facet_options(spark, str(tmp_path / "raw.txt")).collect()] == ["a", "b"]


def points(spark, *rows):
    return spark.createDataFrame([(u, n, [float(x), 0.0]) for u, n, x in rows], "uuid string, chunk_no int, vector array<float>")


def payload(spark, *rows):
    return spark.createDataFrame(rows, "uuid string, title string")


def state(store):
    p = sorted((r["uuid"], r["chunk_no"], r["vector"][0]) for r in store.points().collect())
    t = store.payload()
    return p, sorted(map(tuple, t.collect())) if t is not None else []


def test_store(spark, tmp_path):
    root = str(tmp_path / "store")
    store = VectorStore.open(spark, root, "m", 2)
    assert state(store) == ([], []) and store.ids().count() == 0
    store.upsert(points(spark, ("a", 0, 1), ("a", 1, 2), ("b", 0, 3)), payload(spark, ("a", "A"), ("b", "B")))
    store.upsert(points(spark, ("a", 0, 9), ("c", 0, 4)), payload(spark, ("a", "A2"), ("c", "C")))
    expected = [("a", 0, 9.0), ("b", 0, 3.0), ("c", 0, 4.0)], [("a", "A2"), ("b", "B"), ("c", "C")]
    assert state(store) == expected
    assert store.delete(payload(spark).select("uuid")) is None
    store.delete(payload(spark, ("b", ""), ("none", "")).select("uuid"))
    expected = [("a", 0, 9.0), ("c", 0, 4.0)], [("a", "A2"), ("c", "C")]
    assert state(store) == expected == state(VectorStore.open(spark, root, "m", 2))
    store.compact()
    assert state(store) == expected and len(store.commits()) == 1
    store.upsert(points(spark, ("b", 0, 7)), payload(spark, ("b", "B3")))
    assert state(store) == ([("a", 0, 9.0), ("b", 0, 7.0), ("c", 0, 4.0)], [("a", "A2"), ("b", "B3"), ("c", "C")])
    assert sorted(r["uuid"] for r in store.ids().collect()) == ["a", "b", "c"]


def test_payload_columns_may_grow(spark, tmp_path):
    store = VectorStore.open(spark, str(tmp_path), "m", 2)
    store.upsert(points(spark, ("a", 0, 1)), payload(spark, ("a", "A")))
    store.upsert(points(spark, ("b", 0, 1)), payload(spark, ("b", "B")).withColumn("more", F.lit(1)))
    assert sorted(map(tuple, store.payload().collect())) == [("a", "A", None), ("b", "B", 1)]
    store.upsert(points(spark, ("c", 0, 1)), payload(spark, ("c", "C")).withColumn("more", F.lit("x")))
    with pytest.raises(ValueError, match="more"):
        store.payload()


def test_uncommitted_parts_do_not_count(spark, tmp_path):
    store = VectorStore.open(spark, str(tmp_path), "m", 2)
    store.write_part("points", store.next_version(), points(spark, ("a", 0, 1)))
    assert state(store) == ([], [])
    store.upsert(points(spark, ("b", 0, 1)), payload(spark, ("b", "B")))
    assert [u for u, *_ in state(store)[0]] == ["b"]


def test_store_rejects_other_models_and_sizes(spark, tmp_path):
    store = VectorStore.open(spark, str(tmp_path), "m", 2)
    with pytest.raises(ValueError, match="not other"):
        VectorStore.open(spark, str(tmp_path), "other", 2)
    with pytest.raises(Exception, match="vector size is not 2"):
        store.upsert(points(spark, ("a", 0, 1)).withColumn("vector", F.array(F.lit(1.0).cast("float"))), payload(spark, ("a", "A")))


def test_two_writers_cannot_commit_one_version(spark, tmp_path):
    first, second = (VectorStore.open(spark, str(tmp_path), "m", 2) for _ in range(2))
    version = first.next_version()
    first.commit("sync", version, [])
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        second.commit("sync", version, [])


def test_id_scan_reads_no_vectors(spark, tmp_path):
    store = VectorStore.open(spark, str(tmp_path), "m", 2)
    store.upsert(points(spark, ("a", 0, 1)), payload(spark, ("a", "A")))
    plan = store.ids()._jdf.queryExecution().executedPlan().toString()
    schemas = [line.split("ReadSchema")[1] for line in plan.splitlines() if "ReadSchema" in line]
    assert schemas and all("uuid" in s and "vector" not in s for s in schemas)


def test_coding_errors_are_raised(spark, tmp_path):
    root = str(tmp_path / "cache")
    snapshots.fresh_or_cached_calls(spark, lambda: calls(spark, "1"), root, "b1")
    with pytest.raises(Exception, match="no_such_column"):
        snapshots.fresh_or_cached_calls(spark, lambda: calls(spark, "2").select("no_such_column"), root, "b2")


def test_failing_function_is_raised_and_missing_file_falls_back(spark, tmp_path):
    """By the innermost cause: both come wrapped as a failed write."""
    root = str(tmp_path / "cache")
    snapshots.fresh_or_cached_calls(spark, lambda: calls(spark, "1"), root, "b1")

    @F.udf("string")
    def bug(value):
        return value.no_such_method()

    bugs = {
        "no_such_method": lambda: calls(spark, "2").withColumn("id", bug("id")),
        "no number": lambda: calls(spark, "2").withColumn("id", F.raise_error(F.lit("a page has no number")).cast("string")),
        "DIVIDE_BY_ZERO": lambda: calls(spark, "2").withColumn("id", (F.lit(1) / F.length(F.regexp_replace("id", ".", ""))).cast("string")),
    }
    for message, fetch in bugs.items():
        with pytest.raises(Exception, match=message):
            snapshots.fresh_or_cached_calls(spark, fetch, root, "b2")

    snapshots.write_calls(calls(spark, "3", "4").repartition(2), str(tmp_path / "landed"))
    landed_calls = snapshots.read_calls(spark, str(tmp_path / "landed"))
    for part in (tmp_path / "landed").glob("part-*"):
        part.unlink()
    for fetch in (lambda: landed_calls, lambda: snapshots.read_calls(spark, str(tmp_path / "nowhere"))):
        assert [r["id"] for r in snapshots.fresh_or_cached_calls(spark, fetch, root, "b3").collect()] == ["1"]


def test_large_members_are_split(spark, tmp_path):
    """A member of many row groups is read by many tasks; stored and deflated archives alike."""
    table = pa.table({"id_hash": [f"{i:032d}" for i in range(40_000)], "tags": [["t"]] * 40_000, "unused": range(40_000)})
    pq.write_table(table, tmp_path / "d.parquet", row_group_size=1000, compression="none")
    for name, kind in (("a", zipfile.ZIP_STORED), ("b", zipfile.ZIP_DEFLATED)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", kind) as z:
            z.writestr("readme.txt", "x" * 10)
            z.write(tmp_path / "d.parquet", "data.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        rows = catalogue.read_archives(spark, str(tmp_path / "*.zip"), DUMP)
        tasks = rows.select(F.spark_partition_id().alias("p"), "id_hash").groupBy("p").count()
        assert tasks.count() >= 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = [r["id_hash"] for r in rows.orderBy(ORDER_COLUMN).select("id_hash").collect()]
    assert got == table["id_hash"].to_pylist() * 2
    scan = rows.select("id_hash")._jdf.queryExecution().executedPlan().toString()
    assert "tags" not in scan.split("ReadSchema")[1] and "readme" not in scan and "ArrowEval" not in scan and "MapInArrow" not in scan


def test_bodies_are_parsed_once(spark):
    count = spark.sparkContext.accumulator(0)
    bodies = [(1, page_body("a")), (2, page_body("b")), (3, page_body()), (4, page_body("c"))]

    @F.udf("string")
    def seen(body):
        count.add(1)
        return body

    frame = spark.createDataFrame(bodies, "page long, body string").withColumn("body", seen("body"))
    cut = pages.before_first_empty(pages.parsed_pages(frame))
    assert sorted(r["page"] for r in cut.collect()) == [1, 2] and pages.page_items(cut).count() == 2
    assert count.value == 4 and "from_json" not in cut._jdf.queryExecution().executedPlan().toString()


def test_page_without_a_number_is_an_error(spark, tmp_path):
    (tmp_path / "pages.jsonl").write_text('{"page": 1, "results": []}\n{"results": []}\n')
    with pytest.raises(Exception, match="no number"):
        pages.read_page_files(spark, str(tmp_path / "pages.jsonl"), per_line=True).collect()


def test_put_if_absent_lets_one_of_many_writers_through(spark, tmp_path):
    """All pass any check of existence: every writer starts from an empty folder at the same moment."""
    path = f"{tmp_path}/log/v=1.json"
    ready = threading.Barrier(8)

    def write(n):
        ready.wait()
        return paths.put_if_absent(spark, path, f"writer {n}" * 500)

    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(write, range(8)))
    assert sum(won) == 1 and paths.read_text(spark, path) == f"writer {won.index(True)}" * 500
    assert paths.put_if_absent(spark, path, f"writer {won.index(True)}" * 500)  # the winner tries again
    assert os.listdir(tmp_path / "log") == ["v=1.json"]


def test_put_replaces(spark, tmp_path):
    for text in ("one", "two ü"):
        paths.put(spark, f"{tmp_path}/hint", text)
        assert paths.read_text(spark, f"{tmp_path}/hint") == text
    assert paths.read_text(spark, f"{tmp_path}/none") is None and paths.file_names(spark, f"{tmp_path}/none") == []


def test_racing_writers_leave_one_record(spark, tmp_path):
    stores = [VectorStore.open(spark, str(tmp_path), "m", 2) for _ in range(4)]
    ready = threading.Barrier(4)

    def commit(store):
        store.write_part("points", 2, points(spark, (str(id(store)), 0, 1)))
        store.write_part("payload", 2, payload(spark, (str(id(store)), "x")))
        ready.wait()
        try:
            return store.commit("upsert", 2, ["points", "payload"])
        except CommitConflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(commit, stores))
    assert sorted(d is not None for d in done) == [False, False, False, True]
    winner = str(id(stores[[d is not None for d in done].index(True)]))
    for store in (*stores, VectorStore.open(spark, str(tmp_path), "m", 2)):
        assert [r["uuid"] for r in store.points().collect()] == [winner] and len(store.commits()) == 2


def test_opening_costs_the_same_after_many_versions(spark, tmp_path, monkeypatch):
    """Foldings every 50 versions: calls to the file system and folders read do not grow."""
    calls = []
    for name in ("subfolders", "file_names", "read_text"):
        real = getattr(paths, name)
        monkeypatch.setattr(store_module, name, lambda *a, real=real, name=name: calls.append(name) or real(*a))
    costs = []
    writer = VectorStore.open(spark, str(tmp_path), "m", 2)
    for version in range(2, 260):
        folding = version % 50 == 0
        writer._commit(version, "compact" if folding else "upsert", "m", 2, f"b{version}", batches=[f"b{v}" for v in range(2, version)] if folding else None)
        if folding:
            paths.put(spark, f"{tmp_path}/commits/_folded", str(version))
        if version in (52, 102, 152, 252):
            calls.clear()
            reader = VectorStore.open(spark, str(tmp_path), "m", 2)
            costs.append(len(calls))
            assert [r["version"] for r in reader.commits()] == [version - 2, version - 1, version]
            assert reader.has_batch("b2") and reader.has_batch(f"b{version}") and reader.next_version() == version + 1
    assert max(costs) <= 8 and costs[-1] <= costs[0] + 1


def test_lost_hint_changes_nothing(spark, tmp_path):
    store = VectorStore.open(spark, str(tmp_path), "m", 2)
    store.upsert(points(spark, ("a", 0, 1)), payload(spark, ("a", "A")), batch="b1")
    store.compact()
    (tmp_path / "commits" / "_folded").unlink()
    again = VectorStore.open(spark, str(tmp_path), "m", 2)
    assert state(again) == state(store) and again.has_batch("b1") and len(again.commits()) == 1


def test_archives_of_a_partition_come_a_few_at_a_time(spark):
    """Forty archives of a megabyte in one task, once a single batch; the rows of each in small batches."""
    from semcat.session import bound_batches

    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("b", T.BinaryType())])
    table = pa.table({"n": pa.array(range(3000), pa.int64()), "b": [os.urandom(350) for _ in range(3000)]})
    parquet, packed = io.BytesIO(), io.BytesIO()
    pq.write_table(table, parquet)
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("data.parquet", parquet.getvalue())
    one = spark.createDataFrame([(bytearray(packed.getvalue()),)], "content binary")
    archives = spark.range(0, 40, numPartitions=1).crossJoin(one).select(F.col("id").cast("string").alias("path"), "content", F.col("id").alias("position"))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = catalogue.archive_rows(archives, schema)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    came = archives.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in came) == 40 and max(r["bytes"] for r in came) < 12 << 20
    assert rows.count() == 40 * 3000 and rows.agg(F.countDistinct("row_order")).first()[0] == 40 * 3000
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "3m")
    bound_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "3m"  # a setting of the session's own stays
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_landed_programmes_are_files_of_bounded_size(spark, tmp_path, monkeypatch):
    from semcat.registry import fixtures

    rows = spark.range(2000).select(F.col("id").cast("string").alias("uuid"), F.sha2(F.col("id").cast("string"), 256).alias("description"))
    rows.write.parquet(str(tmp_path / "table"))
    table = spark.read.parquet(str(tmp_path / "table"))
    assert fixtures.land_programmes(table, str(tmp_path / "few")) == 1 and len(list((tmp_path / "few").glob("*.parquet"))) == 2
    monkeypatch.setattr(fixtures, "LANDED_BYTES", 20_000)
    share = fixtures.land_programmes(table, str(tmp_path / "many"))
    files = list((tmp_path / "many").glob("*.parquet"))
    assert share > 2 and len(files) == 2 * share and max(f.stat().st_size for f in files) < 60_000
    assert sorted(spark.read.parquet(str(tmp_path / "many")).collect()) == sorted(table.collect())
