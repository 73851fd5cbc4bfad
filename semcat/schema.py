"""Table schemas of the catalogue and the projection that enforces them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STR = T.StringType()
_STRS = T.ArrayType(T.StringType())
_TS = T.TimestampNTZType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


# Column names and types of the common programme table.
PROGRAMME_SCHEMA = _struct(
    ("id_hash", _STR),
    ("id_url", _STR),
    ("url", _STR),
    ("title", _STR),
    ("description", _STR),
    ("more_info", _STR),
    ("legal_basis", _STR),
    ("contact_info_institution", _STR),
    ("contact_info_street", _STR),
    ("contact_info_city", _STR),
    ("contact_info_fax", _STR),
    ("contact_info_phone", _STR),
    ("contact_info_email", _STR),
    ("contact_info_website", _STR),
    ("funding_type", _STRS),
    ("funding_area", _STRS),
    ("funding_location", _STRS),
    ("eligible_applicants", _STRS),
    ("funding_body", _STR),
    ("further_links", _STRS),
    ("checksum", _STR),
    ("license_info", _STR),
    ("previous_update_dates", T.ArrayType(_TS)),
    ("date_2", _TS),
    ("date_1", _TS),
    ("deleted", T.BooleanType()),
    ("project_short_description", _STR),
    ("project_full_description", _STR),
    ("uuid_source_call_id", _STR),
)

# The normalised call, one row per item of the search API.
CALL_SCHEMA = _struct(
    ("id", _STR),
    ("title", _STR),
    ("call_id", _STR),
    ("programme", _STR),
    ("status_code", _STR),
    ("start_date", _STR),
    ("deadline", _STR),
    ("url", _STR),
    ("summary", _STR),
    ("description_html", _STR),
    ("keywords", _STRS),
    ("language", _STR),
    ("metadata_languages", _STRS),
)

POINT_SCHEMA = _struct(
    ("uuid", _STR),
    ("chunk_no", T.IntegerType()),
    ("vector", T.ArrayType(T.FloatType())),
)

HIT_SCHEMA = _struct(
    ("qid", _STR),
    ("uuid", _STR),
    ("chunk_no", T.IntegerType()),
    ("score", T.DoubleType()),
)

# The facets offered for filtering.
FACET_COLUMNS = (
    "funding_type",
    "funding_area",
    "funding_location",
    "eligible_applicants",
)

# Column that carries the row order of the source ("first seen", "last wins").
ORDER_COLUMN = "row_order"


def conform(df: DataFrame, schema: T.StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """Select exactly ``schema`` (missing columns become typed nulls) plus ``keep``."""
    have = set(df.columns)
    fixed = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    return df.select(*fixed, *[c for c in keep if c in have and c not in schema.names])


def rename_required(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename columns; a name that is not there is an error (Spark would skip it)."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; available: {df.columns}")
    return df.withColumnsRenamed(names)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
