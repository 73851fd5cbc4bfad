"""Batch jobs from landed data to the two stored programme tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from semcat.operators.clean import clean_programmes, with_uuid
from semcat.operators.facets import facet_values
from semcat.operators.normalise import (
    calls_to_programmes,
    dump_to_programmes,
    items_to_calls,
    kept_calls,
)
from semcat.schema import FACET_COLUMNS
from semcat.sources.catalogue import (
    read_archives,
    read_programmes,
    write_facets,
    write_programmes,
)
from semcat.sources.pages import (
    before_first_empty,
    page_items,
    parsed_pages,
    read_page_files,
)
from semcat.sources.paths import remove_folder, replace_folder
from semcat.sources.snapshots import fresh_or_cached_calls

Processor = Callable[[DataFrame], DataFrame]


def clean_and_store(
    programmes: DataFrame,
    cleaned_path: str,
    uuid_path: str,
    source_column: str,
    facet_folder: str,
    facet_columns: Sequence[str] = FACET_COLUMNS,
    facet_prefix: str = "",
    drop: tuple[str, ...] = (),
) -> None:
    """Cleaned table, facet lists, then the table with ids, which readers wait for.

    The cleaning runs once and the wide table is written twice: as it is with ids, under
    another name at first, and from that without them.
    """
    spark = programmes.sparkSession
    facet_columns = tuple(facet_columns) or FACET_COLUMNS
    staged = f"{uuid_path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    try:
        write_programmes(with_uuid(clean_programmes(programmes), source_column), staged, drop)
        written = read_programmes(spark, staged)
        write_programmes(written, cleaned_path, ("uuid",))
        write_facets(facet_values(written, facet_columns), facet_folder, facet_columns, facet_prefix)
        replace_folder(spark, staged, uuid_path)
    finally:
        remove_folder(spark, staged)


def calls_of_pages(
    pages: DataFrame, max_pages: int | None = None, asked_only: bool = True
) -> DataFrame:
    """Kept calls of (page, body) rows: cut, explode, look up, filter.

    Only what the request asks for is kept; ``asked_only=False`` is for pages that
    came from another request.
    """
    items = page_items(before_first_empty(parsed_pages(pages), max_pages))
    return kept_calls(items_to_calls(items, asked_only=asked_only)).drop("page")


def ingest_pages(
    spark: SparkSession,
    pages_path: str,
    cache_root: str,
    batch: str,
    out: str,
    max_pages: int | None = None,
    per_line: bool = False,
    asked_only: bool = True,
) -> None:
    """Landed API pages to ``out``/cleaned, ``out``/uuid and facet lists."""
    calls = fresh_or_cached_calls(
        spark,
        lambda: calls_of_pages(read_page_files(spark, pages_path, per_line), max_pages, asked_only),
        cache_root,
        batch,
    )
    clean_and_store(
        calls_to_programmes(calls),
        f"{out}/cleaned",
        f"{out}/uuid",
        "uuid_source_call_id",
        f"{out}/facets",
        ("funding_area",),
        "eu_",
        ("uuid_source_call_id",),
    )


def ingest_dump(
    spark: SparkSession,
    archive_path: str,
    schema: T.StructType,
    out: str,
    processor: Processor = dump_to_programmes,
) -> None:
    """A dump archive to ``out``/cleaned, ``out``/uuid and facet lists."""
    dump = read_archives(spark, archive_path, schema)
    clean_and_store(
        dump.transform(processor),
        f"{out}/cleaned",
        f"{out}/uuid",
        "id_hash",
        f"{out}/facets",
        facet_prefix="german_",
    )
