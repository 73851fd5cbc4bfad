"""Incremental refresh over landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from semcat.operators.embed import Embedder
from semcat.operators.normalise import items_to_calls, kept_calls
from semcat.plans.sync import sync
from semcat.sources.pages import page_items, parsed_pages, stream_page_files
from semcat.sources.store import VectorStore


def refresh_stream(
    spark: SparkSession,
    programmes_path: str,
    schema: T.StructType,
    store: VectorStore,
    embedder: Embedder,
    checkpoint: str,
    files_per_batch: int | None = None,
    **sync_options,
) -> StreamingQuery:
    """Sync every newly landed programme file into the store, then stop.

    A batch replayed after a failure finds its id committed and does nothing.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def apply(batch: DataFrame, batch_id: int) -> None:
        sync(batch, store, embedder, batch=f"{checkpoint}#{batch_id}", **sync_options)

    return (
        reader.parquet(programmes_path)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def calls_stream(
    spark: SparkSession,
    pages_path: str,
    out: str,
    checkpoint: str,
    per_line: bool = False,
    asked_only: bool = True,
) -> StreamingQuery:
    """Normalised, filtered calls of newly landed API pages, appended as Parquet.

    The cut at the first empty page needs all pages and is a batch matter.
    """
    items = page_items(parsed_pages(stream_page_files(spark, pages_path, per_line)))
    return (
        kept_calls(items_to_calls(items, asked_only=asked_only))
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
