"""The given tables seen as a programme catalogue.

``documents`` are the programmes, ``labels`` say which are withdrawn and which
lack a public id, ``pages`` give HTML, ``embeddings`` are stored vectors and
``events`` arrive as API result pages.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semcat.functions.ids import uuid5
from semcat.schema import ORDER_COLUMN
from semcat.session import bound_batches, scan_bytes
from semcat.sources import paths

DIM = 64  # vector size of the embeddings table
EVENTS_PER_PAGE = 25
ARCHIVE_ROWS = 1000
LANDED_BYTES = 32 << 20  # of the tables read, for one landed file


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    # A known schema saves a job that reads footers.
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def doc_uuid(key) -> F.Column:
    return uuid5(key.cast("string"))


def programmes(spark: SparkSession, sf_dir: str, dated: bool = False) -> DataFrame:
    """``documents`` with the programme columns the jobs read.

    ``dated`` looks the two dates up in ``orders`` and ``events``.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id", "left")
    if dated:
        orders = table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("date_1")
        )
        events = table(spark, sf_dir, "events").select(
            F.col("event_id").alias("doc_id"), F.col("ts").alias("date_2")
        )
        rows = rows.join(orders, "doc_id", "left").join(events, "doc_id", "left")
    else:
        unknown = F.lit(None).cast("timestamp_ntz")
        rows = rows.withColumns({"date_1": unknown, "date_2": unknown})
    c = F.col
    return (
        rows.select(
            c("doc_id").alias(ORDER_COLUMN),
            doc_uuid(c("doc_id")).alias("uuid"),
            F.when(c("quality") == 0, F.lit("N/A"))
            .otherwise(F.concat(F.lit("doc/"), c("doc_id").cast("string")))
            .alias("id_url"),
            F.concat(F.lit("https://example.org/"), c("doc_id").cast("string")).alias("url"),
            F.substring_index("text", "\n", 1).alias("title"),
            c("text").alias("description"),
            F.when(c("lang") == "fr", F.lit("N/A")).otherwise(c("source")).alias("project_short_description"),
            F.when(c("lang").isin("fr", "es"), F.lit("N/A")).otherwise(c("text")).alias("project_full_description"),
            F.array(F.lit("Zuschuss")).alias("funding_type"),
            F.array("source", "lang").alias("funding_area"),
            F.array("lang").alias("funding_location"),
            F.array().cast("array<string>").alias("eligible_applicants"),
            c("date_1"),
            c("date_2"),
            (c("toxic") == 1).alias("deleted"),
        )
    )


def stored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        doc_uuid(F.col("vec_id")).alias("uuid"), F.lit(0).alias("chunk_no"), F.col("embedding").alias("vector")
    )


def stored_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(doc_uuid(F.col("vec_id")).alias("uuid"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("qid"), F.col("embedding").alias("vector")
    )


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "conversations")
        .filter(F.col("role") == "user")
        .select(F.concat_ws("-", "conv_id", "turn").alias("qid"), "text")
    )


def event_pages(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    """(page, body): ``events`` as result documents, loosely nested as the API has
    them.  ``only`` keeps items of one event type, so a page may come out empty.

    The page size bounds every group.
    """
    c, lit = F.col, F.lit
    kind, text = c("event_type"), c("event_id").cast("string")
    item = F.to_json(
        F.struct(
            F.when(kind == "view", lit("de")).when(kind == "click", lit("en")).when(kind != "signup", lit("EN")).alias("language"),
            F.concat(lit("event "), kind).alias("summary"),
            F.struct(
                F.array(F.concat(lit(" EV-"), text)).alias("identifier"),
                F.struct(
                    lit(" ").alias("label"),
                    F.when(c("value") < 10, lit("31094501"))
                    .when(c("value") < 25, lit("31094502"))
                    .when(c("value") < 50, lit("31094503"))
                    .otherwise(lit("31094509"))
                    .alias("value"),
                ).alias("status"),
                F.when(kind == "signup", F.array(lit("de"), lit("en-GB"))).alias("language"),
                F.array(kind, F.concat(lit("u"), c("user_id").cast("string"))).alias("keywords"),
                F.when(kind == "click", lit("1")).otherwise(lit("8")).alias("type"),
                F.array(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'+0200'")).alias("startDate"),
                c("user_id").alias("callIdentifier"),
                F.concat(lit("<p>Event <b>"), kind, lit("</b> of user "), c("user_id").cast("string"), lit("</p>")).alias("descriptionByte"),
            ).alias("metadata"),
        )
    )
    wanted = kind == only if only is not None else lit(True)
    paged = table(spark, sf_dir, "events").select(
        (F.floor(c("event_id") / EVENTS_PER_PAGE) + 1).cast("long").alias("page"),
        F.when(wanted, F.struct("event_id", item.alias("item"))).alias("entry"),
    )
    return (
        paged.groupBy("page")
        .agg(F.sort_array(F.collect_list("entry")).alias("entries"))
        .select(
            "page",
            F.concat(
                lit('{"page":'), c("page").cast("string"), lit(',"results":['),
                F.array_join(F.transform("entries", lambda e: e["item"]), ","),
                lit("]}"),
            ).alias("body"),
        )
    )


def zipped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, position): every ARCHIVE_ROWS of a batch of ``documents`` as a dump archive."""
    import io
    import zipfile

    import pyarrow as pa
    import pyarrow.parquet as pq

    bound_batches(spark)
    size = ARCHIVE_ROWS

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole[at : at + size] for whole in batches for at in range(0, whole.num_rows, size)):
            parquet, archive = io.BytesIO(), io.BytesIO()
            pq.write_table(pa.Table.from_batches([batch]), parquet)
            with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("readme.txt", "dump")
                z.writestr("data.parquet", parquet.getvalue())
            first = batch.column("doc_id")[0].as_py()
            yield pa.RecordBatch.from_pydict(
                {"path": [f"dump-{first}.zip"], "content": [archive.getvalue()], "position": [0]}
            )

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return docs.mapInArrow(archives, "path string, content binary, position long")


def land_archives(spark: SparkSession, rows: DataFrame, folder: str) -> str:
    """``rows`` as dump archives, one per Parquet file, streamed; the pattern that finds them."""
    rows.write.parquet(f"{folder}/unpacked")
    files = paths.matching(spark, f"{folder}/unpacked/*.parquet")
    for number, file in enumerate(files):
        paths.pack_member(spark, file, "data.parquet", f"{folder}/zips/dump-{number:06d}.zip")
    return f"{folder}/zips/*.zip"


def land_programmes(rows: DataFrame, folder: str) -> int:
    """Programme files of bounded size, in number twice what is returned: a batch's share of two."""
    share = math.ceil(scan_bytes(rows) / (2 * LANDED_BYTES))
    rows.repartition(2 * max(1, share), "uuid").write.parquet(folder)
    return max(1, share)


def land_pages(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """Result pages as text files with one page a line."""
    event_pages(spark, sf_dir).select("body").write.text(f"{folder}/landed")
    return f"{folder}/landed"


class CharacterCodec:
    """Tokens are code points."""

    def encode(self, text: str) -> list[int]:
        return list(map(ord, text))

    def decode(self, tokens: list[int]) -> str:
        return "".join(map(chr, tokens))
