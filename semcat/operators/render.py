"""Result rows as display strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semcat.functions.dates import display_time
from semcat.functions.text import MISSING, percent, safe_join


def _heading() -> Column:
    return F.concat(
        F.lit("["),
        F.coalesce("project_title", F.lit("No title")),
        F.lit("]("),
        F.coalesce("project_website", F.lit("#")),
        F.lit(")"),
    )


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(MISSING))


def _score() -> Column:
    return percent(F.coalesce("matching_score", F.lit(0.0)))


def dump_cards(results: DataFrame, keys: tuple[str, ...] = ("qid", "rank")) -> DataFrame:
    """Cards of the dump source; the dates show only if both are there."""
    both = F.col("date_1").isNotNull() & F.col("date_2").isNotNull()
    return results.select(
        *keys,
        _heading().alias("heading"),
        _text("project_short_description").alias("short_description"),
        _text("project_full_description").alias("full_description"),
        F.when(both, display_time(F.col("date_1"))).alias("on_website_since"),
        F.when(both, display_time(F.col("date_2"))).alias("last_updated"),
        safe_join(F.col("funding_type")).alias("type_of_funding"),
        safe_join(F.col("funding_location")).alias("target_area"),
        safe_join(F.col("funding_area")).alias("funding_area"),
        safe_join(F.col("eligible_applicants")).alias("eligible_applicants"),
        _score().alias("score"),
    )


def call_cards(results: DataFrame, keys: tuple[str, ...] = ("qid", "rank")) -> DataFrame:
    """Cards of the API source; each date shows on its own."""
    return results.select(
        *keys,
        _heading().alias("heading"),
        _text("project_full_description").alias("description"),
        display_time(F.col("date_1")).alias("planned_opening_date"),
        display_time(F.col("date_2")).alias("deadline"),
        _score().alias("score"),
    )
