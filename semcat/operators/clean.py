"""Shared cleaning: sections, defaults, HTML to text, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcat.functions.html import clean_strings
from semcat.functions.ids import NAMESPACE, uuid5
from semcat.functions.text import FULL_SECTION, SHORT_SECTION, section


def with_sections(df: DataFrame) -> DataFrame:
    """Short and full description from the dump's headings.

    A value that is already there wins, even an empty one.
    """

    def filled(name: str, pattern: str):
        extracted = section(F.col("description"), pattern)
        if name in df.columns:
            return F.coalesce(F.col(name), extracted)
        return extracted

    return df.withColumns(
        {
            "project_short_description": filled("project_short_description", SHORT_SECTION),
            "project_full_description": filled("project_full_description", FULL_SECTION),
        }
    )


def clean_programmes(df: DataFrame) -> DataFrame:
    """Sections first, then "N/A" defaults and text cleaning on every string."""
    return clean_strings(with_sections(df))


def with_uuid(
    df: DataFrame, source_column: str, target: str = "uuid", namespace: str = NAMESPACE
) -> DataFrame:
    return df.withColumn(target, uuid5(F.col(source_column), namespace))
