"""Programme tables, dump archives and facet lists on storage."""

from __future__ import annotations

import io
import shutil
import tempfile
import zipfile
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from semcat.functions.text import py_strip
from semcat.schema import ORDER_COLUMN
from semcat.session import bound_batches, work_dir
from semcat.sources.paths import matching, unpack_member

# Fixed value: the table inside a dump archive.
DUMP_MEMBER = "data.parquet"
_FILE_ROWS = 1 << 32
UNPACKED_AT_ONCE = 4  # archives
_BATCH_ROWS = 1024


def read_programmes(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_ordered(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A programme table with ``row_order``: files by name, then rows as stored.

    The scan gives the place inside a file; the list of files is a small table.
    """
    rows = read_programmes(spark, path, schema)
    names = rows.select(F.col("_metadata.file_path").alias("file")).distinct().collect()
    files = [(name, position) for position, name in enumerate(sorted(r["file"] for r in names))]
    positions = spark.createDataFrame(files, "file string, position long")
    place = F.col("position") * F.lit(_FILE_ROWS) + F.col("row_index")
    return (
        rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))
        .join(positions, "file")
        .select(*rows.columns, place.alias(ORDER_COLUMN))
    )


def write_programmes(df: DataFrame, path: str, drop: tuple[str, ...] = ()) -> None:
    df.drop(*drop).write.mode("overwrite").parquet(path)


def archive_rows(
    archives: DataFrame, schema: T.StructType, member: str = DUMP_MEMBER
) -> DataFrame:
    """Rows of one Parquet member of every archive in (path, content, position).

    Archives are read in parallel.  ``row_order`` follows the position of the
    archive, then the place of the row inside it.  A worker holds archives of a few
    megabytes at a time, or one larger, and some rows of it: the member is unpacked to a
    file that goes with its last row.
    """
    bound_batches(archives.sparkSession)
    ordered = T.StructType([*schema.fields, T.StructField(ORDER_COLUMN, T.LongType())])
    arrow = to_arrow_schema(ordered)
    names = schema.names

    def rows_of(path: str, content: bytes, first: int) -> Iterator[pa.RecordBatch]:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            members = archive.namelist()
            if member not in members:
                raise ValueError(f"{member!r} not found in {path}; members: {members}")
            with tempfile.TemporaryFile() as unpacked:
                with archive.open(member) as packed:
                    shutil.copyfileobj(packed, unpacked, 1 << 20)
                unpacked.seek(0)
                for batch in pq.ParquetFile(unpacked).iter_batches(_BATCH_ROWS, columns=names):
                    columns = [batch.column(n).cast(arrow.field(n).type) for n in names]
                    columns.append(pa.array(range(first, first + batch.num_rows), pa.int64()))
                    first += batch.num_rows
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, position in zip(*batch.columns):
                yield from rows_of(path.as_py(), content.as_py(), position.as_py() * _FILE_ROWS)

    return archives.select("path", "content", F.col("position").cast("long")).mapInArrow(scan, ordered)


def read_archives(
    spark: SparkSession, path: str, schema: T.StructType, member: str = DUMP_MEMBER
) -> DataFrame:
    """Rows of the dump archives at ``path``, with ``row_order``.

    A zip member can only be unpacked from its start, so every archive is streamed once,
    a buffer at a time, into a Parquet file in the shared folder, whatever its size.  That
    file is read like any other: split by row group, only the columns asked for.
    """
    archives = matching(spark, path)
    if not archives:
        raise FileNotFoundError(f"archive not found: {path}")
    folder = work_dir(spark, "dump")
    with ThreadPoolExecutor(UNPACKED_AT_ONCE) as pool:
        copies = [
            pool.submit(unpack_member, spark, archive, member, f"{folder}/{position:09d}.parquet")
            for position, archive in enumerate(archives)
        ]
        for copy in copies:
            copy.result()
    rows = read_programmes(spark, folder, schema)
    place = F.regexp_extract("_metadata.file_name", r"(\d+)", 1).cast("long") * F.lit(_FILE_ROWS)
    return rows.select("*", (place + F.col("_metadata.row_index")).alias(ORDER_COLUMN))


def write_facets(
    values: DataFrame, folder: str, columns: Sequence[str], prefix: str = ""
) -> None:
    """Facet values as a table ``{prefix}values`` and, per column, a sorted text
    folder ``{prefix}{column}.txt`` with one value a line.

    The table is written first, so the values are computed once.  The sort is by
    range: a long list is several files in order.
    """
    spark = values.sparkSession
    values.write.mode("overwrite").parquet(f"{folder}/{prefix}values")
    written = spark.read.parquet(f"{folder}/{prefix}values")
    for name in columns:
        written.filter(F.col("column") == name).select("value").orderBy("value").write.mode(
            "overwrite"
        ).text(f"{folder}/{prefix}{name}.txt")


def read_facet_options(spark: SparkSession, path: str) -> DataFrame:
    """Values of a facet list: stripped, blank lines dropped."""
    return facet_options(spark.read.text(path))


def facet_options(lines: DataFrame) -> DataFrame:
    return lines.select(py_strip(F.col("value")).alias("value")).filter(F.col("value") != "")
