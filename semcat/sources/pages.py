"""Landed result pages of the search API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from semcat.functions.jsonx import with_json_fields
from semcat.operators.normalise import REQUEST_LISTS, is_requested
from semcat.schema import ORDER_COLUMN
from semcat.session import written

# Fixed value: items per page.
PAGE_SIZE = 50
_POSITION_BITS = 1 << 20


def read_page_files(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """(page, body) of landed pages.

    Either a file is one page and its name ends in the page number, or, for many
    pages, every line of a file is one page with a ``page`` field.
    """
    return _pages(spark.read.text(path, wholetext=not per_line), per_line)


def stream_page_files(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    return _pages(spark.readStream.text(path, wholetext=not per_line), per_line)


def _pages(texts: DataFrame, per_line: bool) -> DataFrame:
    if per_line:
        number = F.get_json_object("value", "$.page")
    else:
        number = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\D*$", 1)
    page = number.cast("long")
    missing = F.raise_error(F.lit("a page has no number")).cast("long")
    return texts.select(F.coalesce(page, missing).alias("page"), F.col("value").alias("body"))


def _results(body: Column) -> Column:
    """Items as JSON texts; a page without results is an empty page.

    A page that is no JSON document is an error, as it would end the result.
    """
    parsed = F.from_json(body, "results array<string>", {"mode": "FAILFAST"})
    items = parsed.getField("results")
    return F.coalesce(items, F.array().cast("array<string>"))


def parsed_pages(pages: DataFrame) -> DataFrame:
    return pages.select("page", _results(F.col("body")).alias("items"))


def before_first_empty(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Parsed pages before the first one without items; up to ``max_pages``, if given.

    Bodies are parsed once: the pages are written, and the number of the first empty one
    is observed on the way.
    """
    if max_pages is not None:
        pages = pages.filter(F.col("page") <= max_pages)
    empty = Observation("empty_pages")
    first = F.min(F.when(F.size("items") == 0, F.col("page"))).alias("first")
    pages = written(pages.observe(empty, first), "pages")
    cut = empty.get["first"]
    return pages if cut is None else pages.filter(F.col("page") < cut)


def page_items(parsed: DataFrame) -> DataFrame:
    """(page, row_order, item), in the order of pages and positions."""
    return parsed.select("page", F.posexplode("items").alias("position", "item")).select(
        "page", (F.col("page") * _POSITION_BITS + F.col("position")).alias(ORDER_COLUMN), "item"
    )


def requested_items(items: DataFrame) -> DataFrame:
    """The conditions sent with the request, for landed data that is broader.

    The order by status is what the page order already reflects.
    """
    fields = {"asked_status": "metadata.status"}
    asked = is_requested(F.col("asked_type"), F.col("asked_status"), F.col("asked_language"))
    return with_json_fields(items, "item", fields, REQUEST_LISTS).filter(asked).drop(*fields, *REQUEST_LISTS)
